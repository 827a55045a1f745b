"""Walk-forward learning against a plain loop over folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.windows import Series
from tickloom.operators.learning import Folds, fold_scores, walk_forward

S = Series(("k",), ("t",))
SCHEMA = "k string, t int, a double, b double, y double"


def made(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for key, n in (("long", 140), ("short", 40), ("tiny", 5), (None, 60)):
        a, b = rng.normal(5, 2, n), rng.normal(0, 1, n)
        y = 0.5 * a - b + rng.normal(0, 0.1, n)
        rows += [(key, i, float(a[i]) if i % 17 else None, float(b[i]) if i % 23 else float("nan"), float(y[i]) if i < n - 2 else None) for i in range(n)]
    return rows


def plain(rows, f, penalty):
    """{(key, t, fold): (prediction, n_train)} by lists of places and a solver for each fold."""
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        k, step = 0, f.step or f.test
        while (start := f.train + k * step + f.embargo) + f.test <= len(mine):
            test = range(start, start + f.test)
            known = [p for p in range(0 if f.expanding else k * step, k * step + f.train) if p + f.horizon < start]
            data = np.array([mine[p][2:] for p in known], dtype=float)
            data = data[np.isfinite(data).all(axis=1)]
            assert not set(known) & set(test)
            x, y = data[:, :2], data[:, 2]
            z = (x - x.mean(0)) / x.std(0)
            w = np.linalg.solve(z.T @ z + penalty * np.eye(2), z.T @ (y - y.mean())) / x.std(0)
            for p in test:
                v = np.array(mine[p][2:4], dtype=float)
                out[key, p, k] = (y.mean() + (v - x.mean(0)) @ w if np.isfinite(v).all() else None, len(data))
            k += 1
    return out


@pytest.mark.parametrize("folds", [Folds(20, 10), Folds(20, 10, 4, 2, 5), Folds(17, 6, 9, 0, 3), Folds(20, 10, 7, 3, 2, True), Folds(12, 3, 12, 12, 1)])
def test_folds_equal_a_plain_loop(spark, folds):
    rows = made()
    out = walk_forward(spark.createDataFrame(rows, SCHEMA).repartition(3), ["a", "b"], "y", folds, 1.5, S).collect()
    want = plain(rows, folds, 1.5)
    assert len(out) == len(want)
    for r in out:
        value, n = want[r.k, r.t, r.fold]
        assert r.n_train == n and (r.prediction is None if value is None else r.prediction == pytest.approx(value, abs=1e-9))


def test_nothing_from_the_test_window_on_reaches_a_fold(spark):
    folds, rows = Folds(20, 10, 5, 2, 4), [r for r in made() if r[0] == "long"]
    start = folds.begin + 5 * 5
    # a label at place p is made of the value at p + horizon, so every place that sees the test window or later is changed
    later = [(k, t, a, b, None if y is None else 1e6) if t + folds.horizon >= start else (k, t, a, b, y) for k, t, a, b, y in rows]
    one, two = ({(r.t, r.fold): r.prediction for r in walk_forward(spark.createDataFrame(x, SCHEMA), ["a", "b"], "y", folds, 1.0, S).filter("fold <= 5").collect()} for x in (rows, later))
    assert one == two and len(one) == 60


def test_flat_features_empty_tables_and_bad_arguments(spark):
    rows = spark.createDataFrame(made(), SCHEMA)
    out = walk_forward(rows.withColumn("b", F.lit(7.1)), ["b"], "y", Folds(20, 10), 1.0, S)
    assert {tuple(r.coefficients) for r in out.collect()} == {(0.0,)}
    assert walk_forward(rows.limit(0), ["a"], "y", Folds(20, 10), 1.0, S).count() == 0
    blank = walk_forward(rows.withColumn("y", F.lit(None).cast("double")), ["a"], "y", Folds(20, 10), 1.0, S)
    assert blank.count() > 0 and blank.filter("prediction is not null").count() == 0
    for bad in ((0, 1), (1, 0), (3, 3, 0), (3, 1, 1, 0, 9)):
        with pytest.raises(ValueError):
            Folds(*bad)
    with pytest.raises(ValueError):
        walk_forward(rows, ["a"], "y", Folds(20, 10), 0.0, S)


def test_scores_of_folds(spark):
    rows = [("A", 0, 1.0, 1.0), ("A", 0, -1.0, 1.0), ("A", 0, None, 1.0), ("A", 1, 2.0, 2.0)]
    a, b = fold_scores(spark.createDataFrame(rows, "symbol string, fold long, prediction double, y double"), "y").orderBy("fold").collect()
    assert (a.n, a.mse, a.hit_rate, a.correlation) == (2, 2.0, 0.5, None) and (b.n, b.mse, b.hit_rate) == (1, 0.0, 1.0)
