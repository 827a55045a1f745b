"""The scan over blocks against a plain filter and smoother; numbers and lags in a global order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import ordering
from tickloom.functions.windows import Series
from tickloom.operators import statespace

S = Series()


def plain(model, z):
    """Kalman filter and Rauch-Tung-Striebel smoother, row by row."""
    x, p, out = model.start, model.spread, []
    for row in z:
        ahead = model.step @ x, model.step @ p @ model.step.T + model.drift
        x, p, gap, ll = *ahead, None, None
        if np.isfinite(row).all():
            gap = row - model.seen @ x
            s = model.seen @ p @ model.seen.T + model.error
            gain = p @ model.seen.T @ np.linalg.inv(s)
            ll = -0.5 * (len(row) * np.log(2 * np.pi) + np.log(np.linalg.det(s)) + gap @ np.linalg.inv(s) @ gap)
            x, p = x + gain @ gap, p - gain @ model.seen @ p
        out.append([x, p, gap, ll, *ahead, None, None])
    for i in range(len(out) - 1, -1, -1):
        x, p = out[i][:2]
        if i + 1 < len(out):
            nx, nv = out[i + 1][4:6]
            e = p @ model.step.T @ np.linalg.pinv(nv, rcond=1e-10, hermitian=True)
            x, p = x + e @ (out[i + 1][6] - nx), p + e @ (out[i + 1][7] - nv) @ e.T
        out[i][6:] = x, p
    return out


MODELS = {
    "level": statespace.local_level(0.1, 0.5, 1.0, 10.0),
    "trend": statespace.local_trend(0.1, 0.01, 0.5, 100.0),
    "arma": statespace.arma([0.5, -0.2], [0.4, 0.3, 0.1], 0.8),
    "two": statespace.Model([[0.9, 0.1], [0.0, 0.8]], np.eye(2), [[0.3, 0.1], [0.1, 0.2]], [[0.2, 0.05], [0.05, 0.1]], [0.5, -0.5], np.eye(2)),
}


@pytest.mark.parametrize("name, block, broadcast", [("level", 8, 100), ("trend", 16, 0), ("arma", 1, 100), ("arma", 4096, 100), ("two", 4, 0)])
def test_blocks_equal_a_plain_pass(spark, monkeypatch, name, block, broadcast):
    monkeypatch.setattr(statespace, "BLOCK_ROWS", block)
    monkeypatch.setattr(statespace, "STEP_ROWS", 40)
    monkeypatch.setattr(statespace, "BROADCAST_BLOCKS", broadcast)
    model, rng, rows, series = MODELS[name], np.random.default_rng(4), [], {}
    m = len(model.seen)
    for key, size in (("long", 150), ("one", 1), ("gaps", 37), (None, 5)):
        z = rng.normal(size=(size, m)).cumsum(axis=0)
        z[rng.random(size) < (0.5 if key == "gaps" else 0.1)] = np.nan
        if key == "gaps":
            z[0, 0] = z[-1, 0] = np.inf
        series[key] = z
        rows += [(key, t, *(None if np.isnan(v) else float(v) for v in r)) for t, r in enumerate(z)]
    names = [f"v{i}" for i in range(m)]
    df = spark.createDataFrame(rows, "symbol string, ts long, " + ", ".join(f"{x} double" for x in names)).repartition(3).withColumn("smoothed", F.lit("own"))
    got = {(r.symbol, r.ts): r for r in statespace.smooth(df, names, model, S).collect()}
    assert len(got) == 193
    for key in series:
        for t, (x, p, gap, ll, _, _, xs, ps) in enumerate(plain(model, series[key])):
            r = got[key, t]
            assert np.allclose(r.filtered, x, atol=1e-8) and np.allclose(r.filtered_var, np.diag(p), atol=1e-8)
            assert np.allclose(r.smoothed, xs, atol=1e-7) and np.allclose(r.smoothed_var, np.diag(ps), atol=1e-7)
            assert (r.innovation is None) == (gap is None) and (gap is None or np.allclose(r.innovation, gap) and np.isclose(r.log_lik, ll))


def test_elements_compose_in_any_grouping():
    model, rng = MODELS["arma"], np.random.default_rng(2)
    es = [tuple(a[0] for a in statespace.elements(model, rng.normal(size=(1, 1)), np.array([k]))) for k in (0, 1, 0, 2)]
    left = statespace.compose(statespace.compose(statespace.compose(es[0], es[1]), es[2]), es[3])
    right = statespace.compose(es[0], statespace.compose(es[1], statespace.compose(es[2], es[3])))
    assert all(np.allclose(a, b) for a, b in zip(left, right, strict=True))


def test_models_are_checked():
    with pytest.raises(ValueError):
        statespace.arma([1.1], [], 1.0)
    with pytest.raises(ValueError):
        statespace.Model([[1.0]], [[1.0, 0.0]], [[1.0]], [[1.0]], [0.0], [[1.0]])
    with pytest.raises(ValueError):
        statespace.local_level(0.0, 0.0)


def test_numbers_and_lags(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(t), float(t) ** 2) for k in ("a", "b", None) for t in rng.permutation(60 if k else 7)]
    df = spark.createDataFrame(rows, "g string, t long, v double").repartition(5)
    out = ordering.lagged(ordering.numbered(df, ["t"], ["g"]), "v", 2, "_n", ["g"], block=8).collect()
    assert len(out) == 127 and all(r._n == r.t for r in out)
    assert all(r.v_1 == ((r.t - 1) ** 2 if r.t else None) and r.v_2 == ((r.t - 2) ** 2 if r.t > 1 else None) for r in out)
    assert sorted(r._n for r in ordering.numbered(df.filter("g = 'a'"), ["t"]).collect()) == list(range(60))
    assert ordering.numbered(df.limit(0), ["t"], ["g"]).count() == 0
