"""Models from moments, rolling covariances and Kelly weights against plain NumPy."""

import datetime as dt

import numpy as np
import pytest

from tickloom.operators import multivariate as mv
from tickloom.operators import sizing

DAY = dt.datetime(2020, 1, 1)


def related(seed, n, k, rank):
    """k walks with ``rank`` relations."""
    rng = np.random.default_rng(seed)
    walks = rng.normal(size=(n, k - rank)).cumsum(axis=0)
    return np.column_stack([walks, walks @ rng.normal(size=(k - rank, rank)) + rng.normal(size=(n, rank))])


def panel_of(spark, groups):
    rows = [(g, f"s{j}", DAY + dt.timedelta(days=i), float(v)) for g, y in groups.items() for i, r in enumerate(y) for j, v in enumerate(r)]
    rows += [("a", "s0", DAY + dt.timedelta(days=9000), 1.0), ("a", "other", DAY, 5.0), ("tiny", "s0", DAY, 1.0), ("tiny", "s1", DAY, 1.0), ("tiny", "s2", DAY, 1.0)]
    return spark.createDataFrame(rows, "g string, symbol string, ts timestamp_ntz, close double").repartition(5)


def plain_johansen(y, lags, constant):
    dy = np.diff(y, axis=0)
    new, old = dy[lags:], y[lags:-1]
    z = [dy[lags - q : len(dy) - q] for q in range(1, lags + 1)]
    one = np.ones((len(new), 1))
    old, z = (np.column_stack([old, one]), z) if constant == 0 else (old, [*z, one])
    if z:
        z = np.column_stack(z)
        new, old = (a - z @ np.linalg.lstsq(z, a, rcond=None)[0] for a in (new, old))
    m = np.linalg.solve(old.T @ old, old.T @ new) @ np.linalg.solve(new.T @ new, new.T @ old)
    return np.sort(np.linalg.eigvals(m).real)[::-1][: y.shape[1]], len(new)


@pytest.mark.parametrize("lags, constant", [(1, 0), (2, 1), (0, 0)])
def test_johansen(spark, lags, constant):
    groups = {"a": related(1, 400, 3, 1), "b": related(2, 300, 3, 2), "c": related(3, 500, 3, 0)}
    out = mv.johansen(panel_of(spark, groups), ["s0", "s1", "s2"], ["g"], lags, constant).orderBy("g", "r").collect()
    assert [(r.g, r.r) for r in out] == [(g, r) for g in "abc" for r in range(3)]
    for g, y in groups.items():
        values, n = plain_johansen(y, lags, constant)
        mine = [r for r in out if r.g == g]
        assert np.allclose([r.eigenvalue for r in mine], values, atol=1e-9) and mine[0].n == n
        assert np.allclose([r.trace for r in mine], [-n * np.log(1 - values[i:]).sum() for i in range(3)])
    ranks = {r.g: r.rank_trace for r in out}
    assert ranks["a"] == 1 and ranks["b"] == 2 and ranks["c"] <= 1


def test_critical_values():
    assert mv.critical(1, 0) == (2.71, 3.84, 6.65) and mv.critical(1, 1, "eigen") == (2.69, 3.76, 6.65)
    assert mv.critical(2, 0) == (13.31, 15.41, 20.04) and mv.critical(12, 1) == (317.95, 326.06, 343.20) and mv.critical(3, 1, "eigen") == (18.60, 20.97, 25.52)


@pytest.mark.parametrize("constant", [0, 1])
def test_vecm(spark, constant):
    y, lags = related(5, 600, 3, 1), 2
    rows = mv.vecm(panel_of(spark, {"a": y}).filter("g = 'a'"), ["s0", "s1", "s2"], 1, ["g"], lags, constant).collect()
    got = {(r.part, r.lag, r.i, r.j): r.value for r in rows}
    beta = np.array([[got["beta", 0, i, 0]] for i in range(3)])
    assert beta[0, 0] == pytest.approx(1)
    dy = np.diff(y, axis=0)
    x = np.column_stack([y[lags:-1] @ beta, *(dy[lags - q : len(dy) - q] for q in range(1, lags + 1)), *([np.ones(len(dy) - lags)] if constant else [])])
    coef = np.linalg.lstsq(x, dy[lags:], rcond=None)[0].T
    rest = dy[lags:] - x @ coef.T
    assert np.allclose([got["alpha", 0, i, 0] for i in range(3)], coef[:, 0])
    assert np.allclose([[got["gamma", 2, i, j] for j in range(3)] for i in range(3)], coef[:, 4:7])
    assert np.allclose([[got["sigma", 0, i, j] for j in range(3)] for i in range(3)], rest.T @ rest / len(rest))
    assert (("constant", 0, 0, 0) in got) == bool(constant)
    with pytest.raises(ValueError):
        mv.vecm(panel_of(spark, {"a": y}), ["s0", "s1"], 2)


def test_var_and_forecast(spark):
    rng = np.random.default_rng(8)
    y = np.zeros((300, 2))
    for t in range(2, 300):
        y[t] = [0.2, -0.1] + np.array([[0.5, 0.1], [-0.2, 0.3]]) @ y[t - 1] + 0.1 * y[t - 2] + rng.normal(size=2)
    panel = panel_of(spark, {"a": y})
    got = {(r.part, r.lag, r.i, r.j): r.value for r in mv.var(panel, ["s0", "s1"], 2, 4, ["g"]).filter("g = 'a'").collect()}
    x = np.column_stack([np.ones(298), y[1:-1], y[:-2]])
    coef = np.linalg.lstsq(x, y[2:], rcond=None)[0]
    rest = y[2:] - x @ coef
    sigma = rest.T @ rest / 298
    assert np.allclose([got["constant", 0, i, 0] for i in range(2)], coef[0])
    a1, a2 = coef[1:3].T, coef[3:5].T
    assert np.allclose([[got["coefficient", 2, i, j] for j in range(2)] for i in range(2)], a2)
    shock = np.linalg.cholesky(sigma)
    assert np.allclose([[got["response", 2, i, j] for j in range(2)] for i in range(2)], (a1 @ a1 + a2) @ shock)
    assert got["stationary", 0, 0, 0] == 1 and got["n", 0, 0, 0] == 298
    assert got["aic", 0, 0, 0] == pytest.approx(20 + 298 * (2 * np.log(2 * np.pi) + np.log(np.linalg.det(sigma)) + 2))
    steps = {(r.step, r.i): r.value for r in mv.forecast(panel, ["s0", "s1"], 2, 3, ["g"]).filter("g = 'a'").collect()}
    one = coef[0] + a1 @ y[-1] + a2 @ y[-2]
    two = coef[0] + a1 @ one + a2 @ y[-1]
    assert np.allclose([steps[1, 0], steps[1, 1], steps[2, 0], steps[2, 1]], [*one, *two]) and len(steps) == 6


def plain_shrunk(x):
    x = x - x.mean(axis=0)
    n, k = x.shape
    s = x.T @ x / n
    centre = np.trace(s) / k
    d = ((s - centre * np.eye(k)) ** 2).sum() / k
    b = sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / n**2 / k
    share = min(b, d) / d
    return (1 - share) * s + share * centre * np.eye(k), share


def returns_of(spark, x):
    rows = [(f"s{j}", DAY + dt.timedelta(days=i), None if np.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double").repartition(4)


@pytest.mark.parametrize("lookback, every", [(20, 7), (5, 5), (6, 10), (30, 1)])
def test_rolling_covariance(spark, lookback, every):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3)) @ rng.normal(size=(3, 3)) * 0.01 + 0.002
    x[4, 1] = np.nan
    whole, at = np.delete(x, 4, axis=0), np.delete(np.arange(90), 4)
    out = sizing.rolling_covariance(returns_of(spark, x), ["s0", "s1", "s2"], lookback, every).collect()
    ends = range(lookback - 1, len(whole), every)
    assert len(out) == 6 * len(ends)
    got = {(r.ts, r.a, r.b): (r.cov, r.shrinkage) for r in out}
    for e in ends:
        cov, share = plain_shrunk(whole[e - lookback + 1 : e + 1])
        for i in range(3):
            for j in range(i, 3):
                assert np.allclose(got[DAY + dt.timedelta(days=int(at[e])), f"s{i}", f"s{j}"], (cov[i, j], share), rtol=1e-8)


def test_kelly_weights(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4)) * 0.02
    x[:, 1] = x[:, 0] + rng.normal(size=80) * 0.001
    limits = sizing.Sizing(edge_trades_back=12, edge_min_trades=5, max_name=0.3, max_cluster=0.2, max_total=0.4, sigma_target=0.2, lookback=30, cluster_corr=0.4)
    trades = [(f"s{j}", DAY + dt.timedelta(days=int(d)), float(r)) for j in range(3) for d, r in zip(np.sort(rng.choice(75, 25, replace=False)), rng.normal(0.012, 0.02, 25))] + [("s2", DAY + dt.timedelta(days=1), 0.0)]
    frame = spark.createDataFrame(trades, "symbol string, exit_ts timestamp_ntz, ret double")
    names = ["s0", "s1", "s2", "s3"]
    out = sizing.kelly_weights(returns_of(spark, x), frame, names, 10, limits).collect()
    assert len(out) == 24
    for e in range(29, 80, 10):
        when = DAY + dt.timedelta(days=e)
        kelly = []
        for n in names:
            past = [t[2] for t in sorted(t for t in trades if t[0] == n and t[1] <= when)][-12:]
            up, down = [v for v in past if v > 0], [v for v in past if v < 0]
            p, b = (len(up) / len(past), np.mean(up) / -np.mean(down)) if len(past) >= 5 and up and down else (0.5, 1.0)
            kelly.append(min(max((p * b - 1 + p) / b, 0), 1) * 0.5)
        cov = plain_shrunk(x[e - 29 : e + 1])[0] * 252
        w = np.array(kelly)
        if w @ cov @ w > 0.04:
            w = w * 0.2 / np.sqrt(w @ cov @ w)
        w = np.minimum(w, 0.3)
        if w[:2].sum() > 0.2:
            w[:2] *= 0.2 / w[:2].sum()
        w[2:] = np.minimum(w[2:], 0.2)  # clusters of one
        w *= min(1.0, 0.4 / w.sum()) if w.sum() else 1.0
        got = {r.symbol: r for r in out if r.ts == when}
        assert np.allclose([got[n].kelly for n in names], kelly) and np.allclose([got[n].weight for n in names], w)


def test_panel_returns_and_clusters(spark):
    bars = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("a", 3, 0.0), ("a", 4, 1.0), ("b", 1, None), ("b", 2, 1.0)], "symbol string, ts long, close double")
    assert [tuple(r) for r in sizing.panel_returns(bars).orderBy("ts").collect()] == [("a", 2, 0.5), ("a", 3, -1.0)]
    corr = np.eye(5)
    for i, j in ((0, 3), (3, 4)):
        corr[i, j] = corr[j, i] = -0.9
    assert sizing.clusters(corr, 0.7).tolist() == [0, 1, 2, 0, 0]
