"""Walk-forward learning: all folds of all series in one plan, training rows purged of labels that reach into the test rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import join_on, numbered
from ..functions.windows import Series, ratio
from .indicators import BARS

c = F.col


@dataclass(frozen=True)
class Folds:
    """Fold k of a series trains on places k*step to k*step + train (from 0 on if expanding), leaves ``embargo`` places out and tests on
    the next ``test``; only whole test windows count. A label looks ``horizon`` places ahead: training places whose label
    would come from a test place or later are purged."""

    train: int
    test: int
    step: int | None = None
    embargo: int = 0
    horizon: int = 1
    expanding: bool = False

    def __post_init__(self) -> None:
        if min(self.train, self.test, self.every) < 1 or min(self.embargo, self.horizon) < 0:
            raise ValueError("train, test and step must be positive, embargo and horizon not negative")
        if self.known < 1:
            raise ValueError("the horizon leaves no training row")

    @property
    def every(self) -> int:
        return self.test if self.step is None else self.step

    @property
    def begin(self) -> int:
        """First test place of fold 0."""
        return self.train + self.embargo

    @property
    def known(self) -> int:
        """Places from k*step on that fold k trains on."""
        return min(self.train, self.begin - self.horizon)


def _pairs(m: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(m) for j in range(i, m)]


def _solve(sums: np.ndarray, m: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and coefficients of ridge regressions on standardised features, from rows of sums of products of (1, features, target)."""
    whole = np.zeros((len(sums), m + 2, m + 2))
    for k, (i, j) in enumerate(_pairs(m + 2)):
        whole[:, i, j] = whole[:, j, i] = sums[:, k]
    n = whole[:, 0, 0]
    mean = whole[:, 0, 1:] / n[:, None]
    about = whole[:, 1:, 1:] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    spread = np.sqrt(np.maximum(np.diagonal(about, axis1=1, axis2=2)[:, :m], 0) / n[:, None])
    flat = spread <= 1e-12 * np.abs(mean[:, :m])
    scale = np.where(flat, 1.0, spread)
    z = np.where(flat[:, :, None] | flat[:, None, :], 0.0, about[:, :m, :m] / (scale[:, :, None] * scale[:, None, :]))
    right = np.where(flat, 0.0, about[:, :m, m] / scale)
    found = np.linalg.solve(z + penalty * np.eye(m), right[..., None])[..., 0] / scale
    return mean[:, m] - (found * mean[:, :m]).sum(axis=1), found


def walk_forward(rows: DataFrame, features: Sequence[str], target: str, folds: Folds, penalty: float = 1.0, s: Series = BARS) -> DataFrame:
    """The test rows of every fold with ``fold``, ``n_train``, ``intercept``, ``coefficients`` and ``prediction``, by a ridge regression
    of the target on standardised features (the penalty is on the standardised coefficients, positive).

    Each row is counted once: places are cut into segments where training windows begin or end, sums of products are one aggregate
    by segment, and a fold adds its segments up. Only these small sums are solved, many folds at a time. Places are numbered by ranges, so
    one series may hold any share of the rows. Rows with a feature or target that is null or not finite keep their place but don't train;
    without all features there is no prediction. A fold without training rows predicts nothing. Steps shorter than the test window
    repeat rows, once a fold.
    """
    if penalty <= 0:
        raise ValueError("penalty must be positive")
    keys, m, every = list(s.keys), len(features), folds.every
    placed = numbered(rows, list(s.order), keys, "_place")
    finite = lambda x: c(x).isNotNull() & ~F.isnan(c(x).cast("double")) & (F.abs(c(x).cast("double")) < float("inf"))
    usable = F.lit(True)
    for f in features:
        usable = usable & finite(f)

    # segments 2q and 2q + 1: places from q*every on, before and after where a training window ends
    cut = folds.known % every
    segment = 2 * F.floor(c("_place") / every) + (c("_place") % every >= cut).cast("long")
    last = 2 * ((folds.known - 1) // every) + int((folds.known - 1) % every >= cut)
    parts = [F.lit(1.0), *(c(f).cast("double") for f in features), c(target).cast("double")]
    trains = usable & finite(target)
    sums = [F.sum(F.when(trains, parts[i] * parts[j]).otherwise(0.0)).alias(f"_s{k}") for k, (i, j) in enumerate(_pairs(m + 2))]
    by_segment = placed.groupBy(*keys, segment.alias("_segment")).agg(*sums)
    # a segment may be without places (cut = 0), so a frame over values, not rows; the fold hangs on the last place it trains on
    w = Window.partitionBy(*keys).orderBy("_segment")
    w = w.rangeBetween(Window.unboundedPreceding if folds.expanding else -last, 0)
    names = [f"_s{k}" for k in range(len(sums))]
    trained = by_segment.select(*keys, ((c("_segment") - last) / 2).alias("_fold"), *(F.sum(x).over(w).alias(x) for x in names))
    trained = trained.filter((c("_fold") >= 0) & (c("_fold") == F.floor("_fold")) & (c("_s0") > 0)).withColumn("fold", c("_fold").cast("long"))

    fields = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            if len(part):
                intercept, found = _solve(part[names].to_numpy(float), m, penalty)
                yield part[[*keys, "fold"]].assign(n_train=part["_s0"].astype("int64"), intercept=intercept, coefficients=list(found))

    models = trained.select(*keys, "fold", *names).mapInPandas(solved, f"{fields}fold bigint, n_train bigint, intercept double, coefficients array<double>")

    # the folds whose test window [begin + k*every, + test) holds the place and lies within the series
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    since = c("_place") - folds.begin
    most = F.least(F.floor(since / every), F.floor((c("_n") - folds.begin - folds.test) / every))
    least = F.greatest(F.floor((since - folds.test) / every) + 1, F.lit(0).cast("long"))
    tested = join_on(placed, sizes, keys).withColumns({"_least": least, "_most": most}).filter("_least <= _most")
    tested = tested.withColumn("fold", F.explode(F.sequence("_least", "_most"))).drop("_least", "_most", "_n", "_place")
    out = join_on(tested, models, [*keys, "fold"], "left")
    value = c("intercept")
    for i, f in enumerate(features):
        value = value + F.get("coefficients", F.lit(i)) * c(f).cast("double")
    return out.withColumn("prediction", F.when(usable, value))


def fold_scores(predicted: DataFrame, target: str, s: Series = BARS) -> DataFrame:
    """(keys, fold, n, mse, hit_rate, correlation) over the rows that have prediction and target; rows of target 0 count as no hit."""
    p, y = c("prediction"), c(target)
    known = predicted.filter(p.isNotNull() & y.isNotNull())
    sums = known.groupBy(*s.keys, "fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg((p - y) * (p - y)).alias("mse"), F.avg((p * y > 0).cast("double")).alias("hit_rate"), F.covar_pop(p, y).alias("_c"), F.var_pop(p).alias("_p"), F.var_pop(y).alias("_y")
    )
    return sums.withColumn("correlation", ratio(c("_c"), F.sqrt(c("_p") * c("_y")))).drop("_c", "_p", "_y")
