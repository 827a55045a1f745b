"""Further registered queries: structure, chains, econometrics, backtests, strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import Series
from ..operators import backtest, econometrics, markov, portfolio, strategies, structure
from ..sources.tables import hourly_bars, table
from . import shapes
from .queries import PANEL, RETS, SO_FAR, frame, query, r
from .shapes import BARS

c = F.col
PANELS = Series(("symbol",), ("ts",))
EVENTS = Series(("user_id",), ("ts", "event_id"))


def z_sql(x: str, n: int) -> str:
    return f"CASE WHEN rn >= {n} THEN CASE WHEN stddev_pop({x}) OVER z{n} <= 0 THEN 0 ELSE ({x} - avg({x}) OVER z{n}) / stddev_pop({x}) OVER z{n} END END"


@query(f"""WITH {BARS}, a AS (SELECT *, ln(volume + 1) AS e, coalesce(abs(close - open) / nullif(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), 0), 0) AS q FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 b AS (SELECT *, {z_sql('e', 50)} AS ez, {z_sql('q', 50)} AS rz FROM a WINDOW {frame('z50', 50)})
 SELECT symbol, ts, {r('ez AS effort_z', 'rz AS result_z', 'ez - rz AS divergence')}, coalesce(ez >= 1.5 AND rz <= -0.5, false) AS absorption FROM b""")
def effort_vs_result(spark, d):
    return structure.effort_vs_result(hourly_bars(spark, d)).select("symbol", "ts", "effort_z", "result_z", "divergence", "absorption")


@query(f"""WITH {BARS}, a AS (SELECT *, high - low AS rg, CAST(rn AS DOUBLE) AS x FROM n), b AS (SELECT *, {z_sql('volume', 50)} AS vz, {z_sql('rg', 50)} AS gz, CASE WHEN rn >= 20 THEN regr_slope(close, x) OVER f END AS sl, coalesce((close - low) / nullif(rg, 0), 0.5) AS pos FROM a WINDOW {frame('z50', 50)}, {frame('f', 20)})
 SELECT symbol, ts, {r('vz AS volume_z', 'gz AS range_z', 'sl AS trend_slope')}, CASE WHEN vz >= 1.5 AND gz >= 1 AND sl < 0 AND pos >= 1 / 3e0 THEN 'SC' WHEN vz >= 1.5 AND gz >= 1 AND sl > 0 AND pos <= 1 - 1 / 3e0 THEN 'BC' END AS climax FROM b""")
def climaxes(spark, d):
    return structure.climaxes(hourly_bars(spark, d), 1.5, 1.0).select("symbol", "ts", "volume_z", "range_z", "trend_slope", "climax")


@query(f"""WITH {BARS}, a AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS t0 FROM bars) SELECT symbol, count(*) AS n, count(*) FILTER (WHERE high < greatest(open, close) OR low > least(open, close)) AS bad_range, count(*) FILTER (WHERE t0 >= ts) AS bad_order, count(*) FILTER (WHERE volume < 0) AS bad_volume FROM a GROUP BY symbol""")
def validate_bars(spark, d):
    return structure.validate(hourly_bars(spark, d))


@query()
def trading_ranges(spark, d):
    return structure.trading_ranges(hourly_bars(spark, d))


@query()
def preliminary_support(spark, d):
    return structure.preliminary_support(hourly_bars(spark, d))


@query()
def zigzag(spark, d):
    return structure.zigzag(hourly_bars(spark, d), 0.1)


@query()
def point_and_figure(spark, d):
    return structure.point_and_figure(hourly_bars(spark, d))


def _states(spark, d):
    return table(spark, d, "events").select("user_id", "ts", "event_id", c("event_type").alias("state"))


@query(f"""WITH l AS (SELECT event_type AS s, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), k AS (SELECT p, s, count(*) AS n FROM l WHERE p IS NOT NULL GROUP BY 1, 2)
 SELECT p AS context, s AS state, n, {r('n / CAST(sum(n) OVER (PARTITION BY p) AS DOUBLE) AS p')} FROM k""")
def transition_counts(spark, d):
    return markov.transition_counts(_states(spark, d), EVENTS).withColumn("context", c("context")[0])


@query(f"""WITH l AS (SELECT event_type AS s, lag(event_type) OVER w AS p, lag(event_type, 2) OVER w AS pp FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT pp || '>' || p AS context, s, count(*) AS n FROM l WHERE pp IS NOT NULL GROUP BY 1, 2)
 SELECT context, s AS state, n, {r('n / CAST(sum(n) OVER (PARTITION BY context) AS DOUBLE) AS p')} FROM k""")
def transition_tensor(spark, d):
    return markov.transition_counts(_states(spark, d), EVENTS, order=2).withColumn("context", F.array_join("context", ">"))


@query(f"""WITH l AS (SELECT user_id, event_type AS s, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), k AS (SELECT p, s, count(*) AS n FROM l WHERE p IS NOT NULL GROUP BY 1, 2), q AS (SELECT p, s, n / CAST(sum(n) OVER (PARTITION BY p) AS DOUBLE) AS pr FROM k)
 SELECT user_id, {r('sum(ln(pr)) AS log_likelihood')}, count(*) AS n FROM l JOIN q USING (p, s) GROUP BY user_id""")
def chain_log_likelihood(spark, d):
    s = _states(spark, d)
    return markov.log_likelihood(s, markov.transition_counts(s, EVENTS), EVENTS)


@query()
def stationary_distribution(spark, d):
    names = sorted(x[0] for x in _states(spark, d).select("state").distinct().collect())  # the states of the chain
    p = markov.stationary(markov.transition_matrix(_states(spark, d), EVENTS, names))
    return spark.createDataFrame(list(zip(names, map(float, p), strict=True)), "state string, p double")


OU = PANEL + f""", l AS (SELECT symbol, ln(close) AS y, lag(ln(close)) OVER (PARTITION BY symbol ORDER BY ts) AS x FROM panel), f AS (SELECT symbol, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / count(*) AS v, count(*) AS n FROM l WHERE x IS NOT NULL GROUP BY symbol),
 o AS (SELECT *, CASE WHEN b > 0 AND b < 1 THEN -ln(CASE WHEN b > 0 THEN b END) END AS theta FROM f)"""


@query(f"WITH {OU} SELECT symbol, {r('theta', 'a / (1 - b) AS mu', 'sqrt(v * 2 * theta / (1 - b * b)) AS sigma', 'ln(2) / theta AS half_life', 'sqrt(v * 2 * theta / (1 - b * b)) / sqrt(2 * theta) AS stationary_std')}, n FROM o")
def ornstein_uhlenbeck(spark, d):
    return markov.ou_fit(shapes.panel(spark, d).withColumn("x", F.ln("close")), "x", PANELS)


@query()
def gaussian_hmm(spark, d):
    b = hourly_bars(spark, d)
    b = b.withColumns({"_r": F.ln(c("close") / PANELS.lag("close")), "_v": F.ln(c("volume") + 1)})
    return markov.gaussian_hmm(b, ["_r", "_v"], 3, PANELS).select("symbol", "ts", "state")


@query()
def discrete_hmm(spark, d):
    rows = _states(spark, d)
    symbols = markov.symbols(rows, "state")
    return markov.discrete_hmm(rows.join(symbols, "state"), "symbol", 2, symbols.count(), ("user_id",), ("ts", "event_id")).select("user_id", "log_likelihood", F.size("path").alias("n"))




@query(f"""WITH {RETS}, x AS (SELECT symbol, ts, ret - avg(ret) OVER (PARTITION BY symbol) AS z FROM rets WHERE ret IS NOT NULL), k AS (SELECT unnest(range(1, 6)) AS lag), y AS (SELECT symbol, z, list(z) OVER s AS l FROM x WINDOW {SO_FAR}), st AS (SELECT symbol, sum(z * z) AS v, count(*) AS n FROM x GROUP BY symbol),
 a AS (SELECT symbol, lag, sum(z * l[len(l) - lag]) AS g FROM y, k WHERE len(l) > lag GROUP BY 1, 2) SELECT symbol, CAST(lag AS INTEGER) AS lag, {r('g / v AS acf', '1.959963984540054e0 / sqrt(n) AS bound')} FROM a JOIN st USING (symbol)""")
def autocorrelation(spark, d):
    return econometrics.autocorrelation(portfolio.returns(shapes.panel(spark, d)), "ret", 5, PANELS)


@query(f"""WITH {RETS}, x AS (SELECT symbol, ret, ret - avg(ret) OVER (PARTITION BY symbol) AS z FROM rets WHERE ret IS NOT NULL), m AS (SELECT symbol, count(*) AS n, avg(z ** 2) AS m2, avg(z ** 3) AS m3, avg(z ** 4) AS m4 FROM x GROUP BY symbol)
 SELECT symbol, {r('n / 6 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4) / 1000 AS jb_thousands')} FROM m""")
def jarque_bera(spark, d):
    return econometrics.jarque_bera(portfolio.returns(shapes.panel(spark, d)), "ret", ["symbol"]).select("symbol", (c("jb") / 1000).alias("jb_thousands"))


@query(f"WITH {RETS}, x AS (SELECT symbol, ret, lag(ret) OVER (PARTITION BY symbol ORDER BY ts) AS r0 FROM rets WHERE ret IS NOT NULL) SELECT symbol, {r('sum(ret * ret) AS rv', 'pi() / 2 * sum(abs(ret) * abs(r0)) AS bipower')} FROM x GROUP BY symbol")
def realized(spark, d):
    return econometrics.realized(portfolio.returns(shapes.panel(spark, d)), "ret", PANELS)


@query(f"WITH {RETS}, x AS (SELECT symbol, ret, lag(ret) OVER (PARTITION BY symbol ORDER BY ts) AS f FROM rets WHERE ret IS NOT NULL) SELECT symbol, {r('sqrt(avg((ret - f) ** 2)) AS rmse', 'avg(abs(ret - f)) AS mae', 'avg(CASE WHEN abs(ret) > 1e-12 AND f IS NOT NULL THEN abs((ret - f) / ret) END) AS mape')} FROM x GROUP BY symbol")
def forecast_errors(spark, d):
    rows = portfolio.returns(shapes.panel(spark, d))
    return econometrics.forecast_errors(rows.withColumn("f", PANELS.lag("ret")), "ret", "f", ["symbol"])


@query()
def series_diagnostics(spark, d):
    return econometrics.diagnostics(hourly_bars(spark, d).withColumn("x", F.ln("close")), "x", PANELS)


@query()
def volatility_models(spark, d):
    return econometrics.volatility_models(portfolio.returns(hourly_bars(spark, d)), "log_ret", PANELS)


@query()
def arima(spark, d):
    return econometrics.arima(portfolio.returns(hourly_bars(spark, d)), "log_ret", PANELS)


@query()
def har_rv(spark, d):
    return econometrics.har(portfolio.returns(hourly_bars(spark, d)).withColumn("rv", c("log_ret") ** 2), "rv", PANELS)


@query()
def markov_switching(spark, d):
    return econometrics.switching(portfolio.returns(hourly_bars(spark, d)), "log_ret", PANELS)


@query()
def variance_paths(spark, d):
    return econometrics.variance_paths(portfolio.returns(hourly_bars(spark, d)), "log_ret", PANELS)


def _pairs(spark, d):
    """Log prices of every pair of the panel's symbols, the smaller one as y; symbol names the pair."""
    p = shapes.panel(spark, d)
    a = p.select("ts", c("symbol").alias("a"), F.ln("close").alias("y"))
    b = p.select("ts", c("symbol").alias("b"), F.ln("close").alias("x"))
    return a.join(b, "ts").filter("a < b").select("ts", "y", "x", F.concat_ws("-", "a", "b").alias("symbol"))


@query()
def cointegration(spark, d):
    return econometrics.pairs(_pairs(spark, d), "y", "x", PANELS)


@query(f"""WITH {PANEL}, j AS (SELECT a.symbol || '-' || b.symbol AS symbol, ln(a.close) AS y, ln(b.close) AS x FROM panel a JOIN panel b USING (ts) WHERE a.symbol < b.symbol), m AS (SELECT symbol, regr_slope(y, x) AS ols, var_samp(y) AS yy, var_samp(x) AS xx, covar_samp(y, x) AS xy FROM j GROUP BY symbol)
 SELECT symbol, {r('ols', '(yy - xx + sqrt((yy - xx) ** 2 + 4 * xy ** 2)) / (2 * xy) AS tls')} FROM m""")
def hedge_ratio(spark, d):
    return markov.hedge_ratio(_pairs(spark, d), "y", "x", ["symbol"])


@query()
def pairs_strategy(spark, d):
    return strategies.pairs(_pairs(spark, d), "y", "x", PANELS)


@query(f"""WITH {BARS}, a AS (SELECT *, CASE WHEN rn >= 10 THEN avg(close) OVER f END AS fa, CASE WHEN rn >= 50 THEN avg(close) OVER g END AS sl FROM n WINDOW {frame('f', 10)}, {frame('g', 50)}) SELECT symbol, ts, {r('CASE WHEN sl IS NULL THEN NULL WHEN fa > sl THEN 1e0 ELSE 0 END AS weight')} FROM a""")
def sma_cross(spark, d):
    return strategies.sma_cross(hourly_bars(spark, d)).select("symbol", "ts", "weight")


@query()
def hull_trend(spark, d):
    return strategies.hull_trend(hourly_bars(spark, d)).select("symbol", "ts", "hull", "signal")


@query()
def mean_reversion(spark, d):
    return strategies.mean_reversion(hourly_bars(spark, d)).select("symbol", "ts", "z", "weight")


@query()
def confluence(spark, d):
    return strategies.confluence(hourly_bars(spark, d)).select("symbol", "ts", "score", "weight")


def _run(spark, d):
    return strategies.sma_cross(hourly_bars(spark, d)).withColumn("run_id", c("symbol"))


@query()
def backtest_equity(spark, d):
    return backtest.backtest(_run(spark, d), costs=backtest.Costs(1.0, 0.005))


@query()
def backtest_tearsheet(spark, d):
    return backtest.tearsheet(backtest.backtest(_run(spark, d), costs=backtest.Costs(1.0, 0.005)))


@query()
def backtest_pnl(spark, d):
    return backtest.symbol_pnl(backtest.trades(_run(spark, d), costs=backtest.Costs(1.0, 0.005)))


@query()
def grid_search(spark, d):
    make = lambda bars, p: strategies.sma_cross(bars, p["fast"], p["slow"])
    return backtest.grid_search(hourly_bars(spark, d), make, {"fast": [5, 10], "slow": [20, 50]})


