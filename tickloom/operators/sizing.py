"""Rolling shrunk covariances at rebalance dates, and Kelly weights under a variance budget.

Every row of returns is counted once: the dates at which some window begins or ends cut time into segments, cross
products are summed by segment, and a window's sums are differences of the segments' running sums. The same sums
hold all that the Ledoit-Wolf shrinkage needs, as the squared length of a row's vector is one of its entries.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import cut_lineage, numbered
from ..functions.windows import Series, ratio
from .multivariate import cross_products

c = F.col


@dataclass(frozen=True)
class Sizing:
    """Limits of the weights."""

    kelly_fraction: float = 0.5
    edge_trades_back: int = 50
    edge_min_trades: int = 10
    default_win: float = 0.5
    default_payoff: float = 1.0
    sigma_target: float = 0.12
    max_name: float = 0.05
    max_total: float = 1.0
    cluster_corr: float = 0.70
    max_cluster: float = 0.30
    lookback: int = 252
    periods: float = 252.0


def panel_returns(bars: DataFrame, s: Series = Series(), close: str = "close") -> DataFrame:
    """(keys, time, ret): simple returns; a series' first row, and rows next to a null or zero price, have none."""
    made = bars.withColumn("ret", ratio(c(close), s.lag(close)) - 1)
    return made.select(*s.keys, *s.order, "ret").filter(c("ret").isNotNull())


def window_moments(returns: DataFrame, names: Sequence, lookback: int, every: int, key: str = "symbol", time: str = "ts", value: str = "ret") -> DataFrame:
    """(time, i, j, s, n): cross products of (1, returns, squared length) over the last ``lookback`` rows at every ``every``-th
    row, counted from the first row with a whole window; rows are the times at which all series have a return."""
    named = F.array(*(F.max(F.when(c(key) == n, c(value).cast("double"))) for n in names))
    rows = returns.filter(c(key).isin(list(names))).groupBy(time).agg(named.alias("y")).filter(F.forall("y", lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = numbered(rows, [time])
    # a window ends with row e = lookback - 1 + m every and begins behind row e - lookback; a segment's number is
    # how many of these rows lie before its rows
    ends = (c("_n") >= lookback - 1) & ((c("_n") - (lookback - 1)) % every == 0)
    segment = F.greatest(F.floor((c("_n") - lookback) / every) + 1, F.lit(0)) + F.floor(c("_n") / every)
    vector = F.concat(F.array(F.lit(1.0)), c("y"), F.array(F.aggregate("y", F.lit(0.0), lambda a, x: a + x * x)))
    cut = cut_lineage(rows.withColumns({"_seg": segment.cast("long"), "_ends": ends}))
    sums = cross_products(cut, ["_seg"], vector)
    order = Window.partitionBy("i", "j").orderBy("_seg")
    running = sums.select("i", "j", "_seg", F.sum("s").over(order).alias("s"), F.sum("n").over(order).alias("n"))
    dates = cut.filter("_ends").select(time, c("_seg").alias("_to"), (c("_n") - lookback).alias("_from_n"))
    # the segment that ends with row e - lookback; the first window has none
    starts = cut.select(c("_n").alias("_from_n"), c("_seg").alias("_from"))
    dates = dates.join(starts, "_from_n", "left").drop("_from_n")
    upper = dates.join(running.withColumnRenamed("_seg", "_to"), "_to")
    lower = running.select("i", "j", c("_seg").alias("_from"), c("s").alias("_s0"), c("n").alias("_n0"))
    joined = upper.join(lower, ["_from", "i", "j"], "left")
    return joined.select(time, "i", "j", (c("s") - F.coalesce("_s0", F.lit(0.0))).alias("s"), (c("n") - F.coalesce("_n0", F.lit(0))).alias("n"))


def shrunk(m: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Covariance shrunk towards a multiple of the identity, and the share of that, from the moments of one window."""
    k = len(m) - 2
    mean = m[0, 1 : k + 1] / n
    s = m[1 : k + 1, 1 : k + 1] / n - np.outer(mean, mean)
    centre = np.trace(s) / k
    distance = ((s - centre * np.eye(k)) ** 2).sum() / k
    if distance < 1e-20:
        return s, 0.0
    # sum of the squared lengths' squares about the mean, from those about zero
    square = mean @ mean
    by_mean = mean @ m[1 : k + 1, 1 : k + 1] @ mean
    fourth = m[-1, -1] + 4 * by_mean + n * square**2 - 4 * (m[1 : k + 1, -1] @ mean) + 2 * square * m[0, -1] - 4 * square * n * square
    noise = (fourth / n - (s**2).sum()) / n / k
    share = min(max(noise, 0.0), distance) / distance
    return (1 - share) * s + share * centre * np.eye(k), float(share)


def _matrices(moments: DataFrame, time: str) -> DataFrame:
    return moments.groupBy(time).agg(F.max("n").alias("n"), F.collect_list(F.struct("i", "j", "s")).alias("m"))


def _matrix(entries) -> np.ndarray:
    size = max(e["i"] for e in entries) + 1
    m = np.zeros((size, size))
    for e in entries:
        m[e["i"], e["j"]] = m[e["j"], e["i"]] = e["s"]
    return m


def rolling_covariance(returns: DataFrame, names: Sequence, lookback: int, every: int, key: str = "symbol", time: str = "ts", value: str = "ret") -> DataFrame:
    """(time, a, b, cov, shrinkage): covariances of all pairs of ``names`` (a before b there, or the same), shrunk."""
    kind = returns.schema[key].dataType.simpleString()

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                cov, share = shrunk(_matrix(row.m), int(row.n))
                yield pd.DataFrame([(row[0], names[i], names[j], cov[i, j], share) for i in range(len(names)) for j in range(i, len(names))], columns=[time, "a", "b", "cov", "shrinkage"])

    names = list(names)
    flat = _matrices(window_moments(returns, names, lookback, every, key, time, value), time)
    return flat.select(time, "n", "m").mapInPandas(run, f"`{time}` {returns.schema[time].dataType.simpleString()}, a {kind}, b {kind}, cov double, shrinkage double")


def edges(trades: DataFrame, dates: DataFrame, names: Sequence, sizing: Sizing = Sizing(), key: str = "symbol", time: str = "ts", exit_time: str = "exit_ts", ret: str = "ret") -> DataFrame:
    """(time, key, win, payoff, n_trades, kelly) for each date and each series of ``names`` that has closed a trade by then.

    win: share of gains among the last ``edge_trades_back`` trades closed at or before the date; payoff: mean gain over mean
    loss. With fewer than ``edge_min_trades`` trades, or only gains or only losses, the defaults stand.
    """
    closed = Window.partitionBy(key).orderBy(exit_time, ret)
    recent = closed.rowsBetween(1 - sizing.edge_trades_back, 0)
    gain, loss = F.when(c(ret) > 0, c(ret)), F.when(c(ret) < 0, c(ret))
    told = trades.select(
        key, c(exit_time).alias("_at"), F.row_number().over(closed).alias("_n"), F.count(F.lit(1)).over(recent).alias("n_trades"), F.count(gain).over(recent).alias("_g"), F.count(loss).over(recent).alias("_l"),
        F.avg(gain).over(recent).alias("_gain"), F.avg(loss).over(recent).alias("_loss"),
    )
    told = told.groupBy(key, "_at").agg(F.max_by(F.struct("n_trades", "_g", "_l", "_gain", "_loss"), "_n").alias("_e"))
    # as-of join: dates and trades in one order, the last trade's figures carried on
    asked = dates.select(time, F.explode(F.array(*(F.lit(n).cast(trades.schema[key].dataType) for n in names))).alias(key))
    both = told.select(key, c("_at").alias(time), "_e", F.lit(0).alias("_ask")).unionByName(asked.select(key, time, F.lit(None).cast(told.schema["_e"].dataType).alias("_e"), F.lit(1).alias("_ask")))
    w = Window.partitionBy(key).orderBy(time, "_ask").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_e", F.last("_e", ignorenulls=True).over(w)).filter("_ask = 1").filter(c("_e").isNotNull()).select(time, key, "_e.*")
    enough = (c("n_trades") >= sizing.edge_min_trades) & (c("_g") > 0) & (c("_l") > 0)
    win = F.when(enough, c("_g") / c("n_trades")).otherwise(sizing.default_win)
    payoff = F.when(enough, c("_gain") / -c("_loss")).otherwise(sizing.default_payoff)
    found = found.withColumns({"win": win, "payoff": payoff})
    best = (c("win") * c("payoff") - (1 - c("win"))) / c("payoff")
    return found.select(time, key, "win", "payoff", "n_trades", (F.least(F.greatest(best, F.lit(0.0)), F.lit(1.0)) * sizing.kelly_fraction).alias("kelly"))


def clusters(corr: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest member's number for each series, where |corr| >= threshold links two."""
    linked = np.abs(corr) >= threshold
    np.fill_diagonal(linked, True)
    label = np.arange(len(corr))
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            return label
        label = new


def bounded(target: np.ndarray, cov: np.ndarray, sizing: Sizing) -> np.ndarray:
    """Weights scaled into the variance budget, then capped by name, by cluster and in total."""
    variance = target @ cov @ target
    if variance > sizing.sigma_target**2:
        target = target * (sizing.sigma_target / np.sqrt(variance))
    target = np.minimum(target, sizing.max_name)
    sd = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    scale = np.outer(sd, sd)
    corr = np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 0)
    label = clusters(corr, sizing.cluster_corr)
    totals = np.bincount(label, target, minlength=len(target))[label]
    target = np.where(totals > sizing.max_cluster, target * sizing.max_cluster / np.where(totals > 0, totals, 1.0), target)
    total = target.sum()
    return target * (sizing.max_total / total) if total > sizing.max_total else target


def kelly_weights(returns: DataFrame, trades: DataFrame, names: Sequence, every: int = 21, sizing: Sizing = Sizing(), key: str = "symbol", time: str = "ts", value: str = "ret") -> DataFrame:
    """(time, key, kelly, weight) at every rebalance date for every series of ``names``.

    kelly is the fraction from the series' own trades closed by then (those of the defaults if it has none); weight is what
    the variance budget under the shrunk, annual covariance and the caps leave of it. Each date is solved on its own.
    """
    names = list(names)
    flat = cut_lineage(_matrices(window_moments(returns, names, sizing.lookback, every, key, time, value), time))
    told = edges(trades, flat.select(time), names, sizing, key, time).groupBy(time).agg(F.collect_list(F.struct(c(key).cast("string").alias("k"), "kelly")).alias("e"))
    kind = returns.schema[key].dataType.simpleString()
    unknown = sizing.kelly_fraction * min(max((sizing.default_win * sizing.default_payoff - 1 + sizing.default_win) / sizing.default_payoff, 0.0), 1.0)

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                known = {e["k"]: e["kelly"] for e in (row.e if row.e is not None else [])}
                target = np.array([known.get(str(n), unknown) for n in names], float)
                weight = bounded(target, shrunk(_matrix(row.m), int(row.n))[0] * sizing.periods, sizing)
                yield pd.DataFrame({time: [row[0]] * len(names), key: names, "kelly": target, "weight": weight})

    return flat.join(told, time, "left").select(time, "n", "m", "e").mapInPandas(run, f"`{time}` {returns.schema[time].dataType.simpleString()}, `{key}` {kind}, kelly double, weight double")
