"""Kernels and array functions against values that can be worked out by hand or simulated."""

import math
from datetime import date

import numpy as np
import pytest

from tickloom.functions import hmm, kernels, special
from tickloom.functions import timeseries as ts
from tickloom.operators import backtest, options, portfolio, temporal
from tickloom.operators.bars import imbalance_ends, runs_ends, threshold_ends


def test_averages():
    x = np.arange(1.0, 21)
    assert np.isnan(kernels.ema(x, 5)[3]) and kernels.ema(x, 5)[4] == 3
    assert kernels.wilder(x, 4)[3] == 2.5 and kernels.wilder(x, 4)[4] == 2.5 + 2.5 / 4
    assert kernels.wilder_sum(x, 3)[3] == 6 + 4 - 2


def test_rsi_of_monotone_prices():
    assert kernels.rsi(np.arange(1.0, 40), 14)[-1] == 100
    assert kernels.rsi(np.arange(40.0, 1, -1), 14)[-1] == 0
    assert np.isnan(kernels.rsi(np.arange(1.0, 40), 14)[13]) and not np.isnan(kernels.rsi(np.arange(1.0, 40), 14)[14])


def test_adx_warm_up_and_trend():
    close = np.arange(1.0, 61)
    strength, plus, minus = kernels.adx(close + 0.5, close - 0.5, close, 14)
    assert np.isnan(strength[26]) and strength[27] == pytest.approx(100) and plus[-1] > minus[-1] == 0


def test_threshold_bars_drop_overshoot_and_open_bar():
    bars = threshold_ends(np.full(6, 40.0), 100)
    assert bars.tolist() == [0, 0, 0, 1, 1, 1]
    assert np.isnan(threshold_ends(np.full(4, 40.0), 100)[3])
    assert np.nanmax(imbalance_ends(np.ones(50), 5.0, 0.1, 1)) == 9


def test_zigzag_and_value_area():
    found = kernels.zigzag(np.array([1, 2, 3, 2, 1, 2.0]), np.array([1, 2, 3, 2, 1, 2.0]), 0.3)
    assert [f[2] for f in found] == [-1, 1, -1, 1] and found[1][1] == 3
    assert kernels.value_area(np.array([1, 5, 10, 5, 1.0]), 0.7) == (2, 1, 3)


def test_special_functions():
    assert special.student_t_cdf(np.array([0.0, 1.0]), 1.0) == pytest.approx([0.5, 0.75])
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.f_sf(4.0, 2, 10) == pytest.approx((1 + 2 * 4 / 10) ** -5, rel=1e-9)
    assert special.normal_cdf(np.array([1.959963984540054]))[0] == pytest.approx(0.975)


def test_black_scholes_parity_and_implied_vol():
    rng = np.random.default_rng(7)
    s, k, t, v = rng.uniform(80, 120, 64), rng.uniform(80, 120, 64), rng.uniform(0.05, 2, 64), rng.uniform(0.1, 0.6, 64)
    call, put = (options.black_scholes(s, k, t, 0.03, 0.01, v, x) for x in (1, 0))
    assert call["price"] - put["price"] == pytest.approx(s * np.exp(-0.01 * t) - k * np.exp(-0.03 * t), abs=1e-10)
    up, down = (options.black_scholes(s + h, k, t, 0.03, 0.01, v, 1)["price"] for h in (1e-4, -1e-4))
    assert call["delta"] == pytest.approx((up - down) / 2e-4, abs=1e-6)
    later = options.black_scholes(s, k, t - 1e-5, 0.03, 0.01, v, 1)
    assert call["charm"] == pytest.approx((later["delta"] - call["delta"]) / 1e-5, abs=1e-2)
    assert options.implied_volatility(call["price"], s, k, t, 0.03, 0.01, 1) == pytest.approx(v, abs=1e-5)
    assert np.isnan(options.implied_volatility(200.0, 100, 100, 1, 0, 0, 1))
    assert options.black_scholes(110, 100, 0, 0, 0, 0.2, 1)["price"] == 10


def test_portfolios():
    mu = np.array([0.08, 0.12, 0.06, 0.10])
    cov = np.array([[0.04, 0.006, 0.01, 0], [0.006, 0.09, 0, 0.02], [0.01, 0, 0.0225, 0.004], [0, 0.02, 0.004, 0.0625]])
    w = portfolio.min_variance(cov)
    free = np.linalg.solve(cov, np.ones(4))
    assert w == pytest.approx(free / free.sum(), abs=1e-6)
    erc = portfolio.risk_parity(cov)
    assert np.ptp(erc * (cov @ erc)) < 1e-9
    best = np.linalg.solve(cov, mu)
    assert portfolio.max_sharpe(mu, cov) == pytest.approx(best / best.sum(), abs=0.02)
    assert portfolio.efficient_return(mu, cov, 0.09) @ mu == pytest.approx(0.09, abs=1e-4)
    shrunk, share = portfolio.ledoit_wolf_matrix(np.random.default_rng(0).normal(size=(60, 5)))
    assert 0 <= share <= 1 and np.allclose(shrunk, shrunk.T)


def test_calendar_2024():
    closed, half = temporal.nyse_holidays(2024)
    assert closed == {date(2024, 1, 1), date(2024, 1, 15), date(2024, 2, 19), date(2024, 3, 29), date(2024, 5, 27), date(2024, 6, 19), date(2024, 7, 4), date(2024, 9, 2), date(2024, 11, 28), date(2024, 12, 25)}
    assert half == {date(2024, 7, 3), date(2024, 11, 29), date(2024, 12, 24)}


def test_time_series_recovery():
    rng = np.random.default_rng(1)
    x = np.zeros(3000)
    for t in range(1, 3000):
        x[t] = 0.6 * x[t - 1] + rng.normal()
    assert ts.pacf(x, 3)[1] == pytest.approx(0.6, abs=0.05)
    assert ts.adf(x)[0] < -10 and ts.adf(np.cumsum(rng.normal(size=800)))[0] > -3.5
    assert ts.arma_fit(x, 1, 0)["phi"][0] == pytest.approx(0.6, abs=0.05)
    assert ts.hurst(rng.normal(size=4000), "dfa") == pytest.approx(0.5, abs=0.1)
    assert ts.variance_ratio(np.cumsum(rng.normal(size=4000)), 5)[0] == pytest.approx(1, abs=0.15)
    assert ts.crps(0.0, np.array([0.0])) == 0
    r, v = np.empty(3000), 1.0
    for t in range(3000):
        r[t] = math.sqrt(v) * rng.normal()
        v = 0.05 + 0.1 * r[t] ** 2 + 0.85 * v
    fit = ts.garch_fit(r)
    assert 0.03 < fit["alpha"] < 0.2 and 0.7 < fit["beta"] < 0.95
    walk = np.cumsum(rng.normal(size=600))
    beta, t = ts.engle_granger(2 * walk + rng.normal(size=600), walk)
    assert beta == pytest.approx(2, abs=0.1) and t < -5
    trace, _, _ = ts.johansen(np.column_stack([2 * walk + rng.normal(size=600), walk]))
    assert trace[0] > 20 > 10 > trace[1]
    assert ts.granger(np.roll(walk, 1)[1:], walk[1:], 1)[1] < 0.01
    assert ts.kalman_hedge(3 * walk + 0.1 * rng.normal(size=600), walk)[0][-1] == pytest.approx(3, abs=0.1)


def test_hmm_likelihood_and_path():
    emit = np.log(np.array([[0.9, 0.1], [0.8, 0.2], [0.1, 0.9], [0.2, 0.8]]))
    step, start = np.log(np.array([[0.9, 0.1], [0.1, 0.9]])), np.log(np.array([0.5, 0.5]))
    gamma, xi, total = hmm.posteriors(emit, step, start)
    paths = [(sum([start[p[0]], *(step[a, b] for a, b in zip(p, p[1:], strict=False)), *(emit[i, s] for i, s in enumerate(p))]), p) for p in np.ndindex(2, 2, 2, 2)]
    assert total == pytest.approx(math.log(sum(math.exp(x) for x, _ in paths)))
    assert tuple(hmm.viterbi(emit, step, start)) == max(paths)[1] and gamma.sum() == pytest.approx(4) and xi.sum() == pytest.approx(3)


def test_discrete_hmm_of_many_series_equals_a_plain_fit_of_each(monkeypatch):
    rng, calls = np.random.default_rng(3), []
    obs = [rng.integers(0, 3, n) for n in (1, 2, 3, 17, 40, *[20] * 60)]
    expected = hmm._expected
    monkeypatch.setattr(hmm, "_expected", lambda *a: calls.append(1) or expected(*a))
    fits = hmm.fit_discrete_many(obs, 2, 3, 2, 30)
    assert len(calls) <= 6 * 30  # side by side: passes by groups of lengths, not by series
    for x, fit, path in zip(obs[:8], fits, hmm.viterbi_discrete_many(obs, fits), strict=False):
        draw, best = np.random.default_rng(0), -np.inf
        starts = [(draw.dirichlet(np.ones(2)), draw.dirichlet(np.ones(2), 2), draw.dirichlet(np.ones(3), 2)) for _ in range(2)]
        for pi, a, e in starts:
            before = -np.inf
            for _ in range(30):
                gamma, xi, now = hmm.posteriors(np.log(np.maximum(e, 1e-12))[:, x].T, np.log(np.maximum(a, 1e-12)), np.log(np.maximum(pi, 1e-12)))
                pi, a = gamma[0] / gamma[0].sum(), xi / np.maximum(xi.sum(axis=1, keepdims=True), 1e-12)
                e = np.stack([gamma[x == o].sum(axis=0) for o in range(3)], axis=1)
                e = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-12)
                if now - before < 1e-6:
                    break
                before = now
            best = max(best, now)
        assert fit["log_likelihood"] == pytest.approx(best, abs=1e-5)
        assert path.tolist() == hmm.viterbi(np.log(fit["emit"] + 1e-12)[:, x].T, np.log(fit["step"] + 1e-12), np.log(fit["start"] + 1e-12)).tolist()


def test_orders_fill_by_the_bar():
    class Bar:
        open, high, low, close = 100.0, 105.0, 95.0, 101.0

    fill = backtest.fill_price
    assert fill(backtest.Order("A", 1), Bar) == 100
    assert fill(backtest.Order("A", 1, "limit", limit=97), Bar) == 97 and fill(backtest.Order("A", 1, "limit", limit=102), Bar) == 100 and fill(backtest.Order("A", 1, "limit", limit=94), Bar) is None
    assert fill(backtest.Order("A", 1, "stop", stop=103), Bar) == 103 and fill(backtest.Order("A", -1, "stop", stop=96), Bar) == 96 and fill(backtest.Order("A", 1, "stop", stop=106), Bar) is None
    with pytest.raises(ValueError):
        backtest.Order("A", 0)
    book = backtest.Book(1000.0)
    book.apply("A", 10, 10, 1)
    book.apply("A", -15, 12, 1)
    assert book.realized == 20 and book.quantity["A"] == -5 and book.cost["A"] == 12 and book.cash == 1000 - 100 - 1 + 180 - 1
    assert len(backtest.folds(100, 40, 20)) == 3


def test_differences_and_seasonal_models():
    x = np.array([1.0, 4, 9, 16, 25])
    assert ts.inverse_difference(ts.difference(x[1:], 1), np.array([4.0])).tolist() == [9, 16, 25]
    assert ts.seasonal_difference(x, 2).tolist() == [8, 12, 16]
    assert ts.expand_seasonal([0.5], [0.3], 3) == pytest.approx([0.5, 0, 0.3, -0.15])
    assert ts.impulse_weights(np.array([0.5]), np.array([0.2]), 2) == pytest.approx([1, 0.7, 0.35])
    y = ts.arma_simulate(np.array([0.5, 0, 0, 0.3, -0.15]), np.zeros(0), 1500, seed=2)
    fit = ts.sarima_fit(y, 1, 0, 0, 1, 0, 4)
    assert fit["phi"][0] == pytest.approx(0.5, abs=0.08) and fit["phi"][3] == pytest.approx(0.3, abs=0.08)
    assert ts.garch_forecast(0.1, 0.1, 0.8, 1.0, 5) == pytest.approx(np.ones(5))
    assert ts.mase(np.array([1.0]), np.array([2.0]), np.array([1.0, 2, 3])) == 1


def test_error_correction_trend_and_walks():
    rng = np.random.default_rng(3)
    walk = np.cumsum(rng.normal(size=800))
    fit = ts.vecm(np.column_stack([walk, 0.5 * walk + rng.normal(size=800)]), 1)
    assert fit["beta"][1, 0] == pytest.approx(-2, abs=0.3)
    level, slope = ts.trend_filter(np.arange(50.0), 1e-6, 1e-6, 1.0)
    assert level[-1] == pytest.approx(49, abs=0.1) and slope[-1] == pytest.approx(1, abs=0.05)
    made = ts.rolling_backtest(np.arange(20.0), lambda w: None, lambda m, w, h: w[-1], 5)
    assert len(made) == 15 and all(a - f == 1 for _, f, a in made)
    from tickloom.operators import markov
    from tickloom.operators.profile import bracket_letters

    x = markov.ou_simulate(0.2, 1.0, 0.3, 1.0, 3000)
    assert markov.ou_log_likelihood(x, 0.2, 1.0, 0.3) > markov.ou_log_likelihood(x, 0.5, 1.0, 0.3)
    assert markov.stationary(np.array([[0.9, 0.1], [0.3, 0.7]])) == pytest.approx([0.75, 0.25])
    assert bracket_letters(54)[-3:] == ["z", "AA", "AB"]
    assert markov.simulate_tensor({("a", "b"): {"a": 1.0}, ("b", "a"): {"b": 1.0}}, ("a", "b"), 4) == list("ababab")


def test_p_values_are_the_published_ones():
    """A unit root's p value is 5 % at the asymptotic 5 % value, and rises without a gap."""
    for case, five in (("n", -1.941), ("c", -2.8615), ("ct", -3.4105), (1, -3.3377), (2, -3.7429)):
        assert abs(ts.df_p_value(five, case, 10_000) - 0.05) < 0.002
        at = np.linspace(-15, 0.5, 400)
        p = np.array([ts.df_p_value(t, case, 100) for t in at])
        assert (np.diff(p) >= -0.005).all() and np.abs(np.diff(p)).max() < 0.03
    assert ts.df_p_value(-30, "c", 50) == 0 and ts.df_p_value(5, "c", 50) == 1
    assert ts.kpss_p_value(0.463) == pytest.approx(0.05) and ts.kpss_p_value(9) == 0.01 and ts.kpss_p_value(0.0, True) == 0.1


def _plain_supertrend(high, low, close, width):
    up, down, side, out = None, None, 1, []
    for i in range(len(close)):
        a, b = (high[i] + low[i]) / 2 + width[i], (high[i] + low[i]) / 2 - width[i]
        if up is not None:
            a = a if close[i - 1] > up else min(a, up)
            b = b if close[i - 1] < down else max(b, down)
            side = -1 if side == 1 and close[i] < b else 1 if side == -1 and close[i] > a else side
        up, down = a, b
        out.append((b if side == 1 else a, side))
    return out


def test_supertrend_and_adaptive_bars_equal_plain_loops():
    rng = np.random.default_rng(6)
    close = 100 + rng.normal(size=400).cumsum()
    high, low = close + rng.random(400), close - rng.random(400)
    width = np.concatenate([np.full(5, np.nan), 1 + rng.random(395)])
    line, side = kernels.supertrend(high, low, close, width)
    assert np.isnan(line[:5]).all() and set(side[5:]) == {1, -1}
    assert np.allclose(np.column_stack([line[5:], side[5:]]), _plain_supertrend(high[4:], low[4:], close[4:], np.concatenate([[1e9], width[5:]]))[1:])
    for least, threshold in ((1, 5.0), (7, 2.0), (1, 0.0)):
        sign = rng.choice([-1.0, 0.0, 1.0], 3000)
        for ends, sizes in ((imbalance_ends, lambda part: abs(part.sum())), (runs_ends, lambda part: max((part > 0).sum(), (part < 0).sum()))):
            found, limit, start, bar = np.full(3000, np.nan), threshold, 0, 0
            for i in range(3000):
                size = sizes(sign[start : i + 1])
                if i + 1 - start >= least and size >= limit:
                    found[start : i + 1] = bar
                    limit = 0.2 * size + 0.8 * limit
                    limit, start, bar = limit if limit >= 1e-9 else threshold, i + 1, bar + 1
            assert np.array_equal(ends(sign, threshold, 0.2, least), found, equal_nan=True)


def test_symbols_stay_apart(spark):
    from tickloom.operators import markov

    rows = spark.createDataFrame([(s,) for s in ("view", "error", "signup", "click", "buy", "error", None)], "state string")
    assert {r.state: r.symbol for r in markov.symbols(rows, "state").collect()} == {"buy": 0, "click": 1, "error": 2, "signup": 3, "view": 4}


def test_adaptive_bars_of_batches_equal_those_of_the_whole():
    from tickloom.operators import bars

    rng = np.random.default_rng(8)
    sign = rng.choice([-1.0, 0.0, 1.0], 3000)
    for whole, start, values in ((imbalance_ends, bars.imbalance, bars._signed), (runs_ends, bars.runs, bars._sides)):
        for least, size in ((1, 1), (1, 97), (7, 5), (7, 1000)):
            ends, got, last = start(5.0, 0.2, least), [], []
            for i in range(0, 3000, size):
                bar, at = ends(values(sign[i : i + size]))
                got, last = got + bar.tolist(), last + at.tolist()
            want = whole(sign, 5.0, 0.2, least)
            assert np.array_equal(np.where(np.array(got) < ends.bar, got, np.nan), want, equal_nan=True)
            assert sum(last) == ends.bar and all(want[i] == want[i - 1] or last[i - 1] for i in range(1, int(np.isfinite(want).sum())))
