"""Registered queries of the state space models, the models from moments, and the sizing of weights."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.ordering import cut_lineage, shared_folder
from ..functions.windows import Series
from ..operators import learning, multivariate, sizing, statespace, trend
from ..sources import loading, statements
from ..sources.tables import hourly_bars, table
from . import shapes
from .more import PANELS
from . import extra  # noqa: F401  its SQL is built on here
from .queries import OHLCV, RETS, SNAP, SO_FAR, SQL, TW, query, r, smooth_sql
from .shapes import BARS, TICKS

c = F.col
REGIONS = list(range(5))
DRIFT, ERROR, START, SPREAD = 0.02, 0.3, 4.0, 100.0

_AHEAD = f"(f.p + {DRIFT}e0)"
_GAIN = f"({_AHEAD} / ({_AHEAD} + {ERROR}e0))"


def _levels(spark, d):
    """Log closes of the hourly bars; thin bars count as missing."""
    return hourly_bars(spark, d).select("symbol", "ts", F.when(c("volume") >= 20, F.ln("close")).alias("y"))


@query(f"""WITH RECURSIVE {BARS}, o AS (SELECT symbol, ts, rn, CASE WHEN volume >= 20 THEN ln(close) END AS y FROM n),
 f AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS rn, {START}e0 AS x, {SPREAD}e0 AS p, CAST(NULL AS DOUBLE) AS gap, CAST(NULL AS DOUBLE) AS ll FROM o
 UNION ALL SELECT o.symbol, o.rn, CASE WHEN y IS NULL THEN f.x ELSE f.x + {_GAIN} * (y - f.x) END, CASE WHEN y IS NULL THEN {_AHEAD} ELSE (1 - {_GAIN}) * {_AHEAD} END, y - f.x,
 -0.5 * (ln(2 * pi()) + ln({_AHEAD} + {ERROR}e0) + (y - f.x) ** 2 / ({_AHEAD} + {ERROR}e0)) FROM f JOIN o ON o.symbol = f.symbol AND o.rn = f.rn + 1),
 b AS (SELECT f.symbol, f.rn, f.x AS xs, f.p AS ps FROM f JOIN (SELECT symbol, max(rn) AS rn FROM o GROUP BY symbol) USING (symbol, rn)
 UNION ALL SELECT f.symbol, f.rn, f.x + f.p / {_AHEAD} * (b.xs - f.x), f.p + (f.p / {_AHEAD}) ** 2 * (b.ps - {_AHEAD}) FROM b JOIN f ON f.symbol = b.symbol AND f.rn = b.rn - 1 AND f.rn > 0)
 SELECT o.symbol, o.ts, {r('f.x AS level', 'f.p AS level_var', 'f.gap AS innovation', 'f.ll AS log_lik', 'b.xs AS smooth', 'b.ps AS smooth_var')} FROM o JOIN f USING (symbol, rn) JOIN b USING (symbol, rn)""")
def state_space(spark, d):
    out = statespace.smooth(_levels(spark, d), "y", statespace.local_level(DRIFT, ERROR, START, SPREAD), PANELS)
    first = lambda name: F.get(name, 0)
    return out.select("symbol", "ts", first("filtered").alias("level"), first("filtered_var").alias("level_var"), first("innovation").alias("innovation"), "log_lik", first("smoothed").alias("smooth"), first("smoothed_var").alias("smooth_var"))


@query()
def arma_states(spark, d):
    """Smoothed log returns of an ARMA(2, 1), thin bars missing; all states."""
    bars = _levels(spark, d).withColumn("z", c("y") - PANELS.lag("y"))
    out = statespace.smooth(bars, "z", statespace.arma([0.3, -0.1], [-0.5], 0.4), PANELS)
    return out.select("symbol", "ts", *(F.get(name, i).alias(f"{name}_{i}") for name in ("filtered", "smoothed") for i in range(2)), F.get("smoothed_var", 0).alias("smoothed_var"), "log_lik")


MONTHS = """months AS (SELECT o_orderpriority AS grp, CAST(n_regionkey AS BIGINT) AS symbol, date_trunc('month', CAST(o_orderdate AS TIMESTAMP)) AS ts, ln(avg(o_totalprice)) AS close
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""


def _months(spark, d):
    """Log mean prices by order priority, region and month: a panel of five series for each priority."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), c("o_custkey") == c("c_custkey")).join(table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"))
    rows = rows.groupBy(c("o_orderpriority").alias("grp"), c("n_regionkey").cast("bigint").alias("symbol"), F.date_trunc("month", "o_orderdate").alias("ts"))
    return rows.agg(F.ln(F.avg("o_totalprice")).alias("close"))


@query(f"""WITH {MONTHS}, y AS (SELECT grp, ts, list(close ORDER BY symbol) AS y FROM months GROUP BY grp, ts HAVING count(*) = 5),
 l AS (SELECT grp, ts, y, lag(y) OVER w AS y1, lag(y, 2) OVER w AS y2 FROM y WINDOW w AS (PARTITION BY grp ORDER BY ts)),
 v AS (SELECT grp, [1e0] || list_transform(range(1, 6), lambda k: y[k] - y1[k]) || y1 || list_transform(range(1, 6), lambda k: y1[k] - y2[k]) AS v FROM l WHERE y2 IS NOT NULL)
 SELECT grp, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r('sum(v[i + 1] * v[j + 1]) AS s')}, count(*) AS n FROM v, (SELECT unnest(range(16)) AS i), (SELECT unnest(range(16)) AS j) WHERE i <= j GROUP BY grp, i, j""")
def lagged_moments(spark, d):
    rows = multivariate.aligned(_months(spark, d), REGIONS, ["grp"])
    return multivariate.lagged_moments(rows, ["grp"], 1).select("grp", "i", "j", "s", "n")


@query()
def johansen_ranks(spark, d):
    return multivariate.johansen(_months(spark, d), REGIONS, ["grp"])


@query()
def error_correction(spark, d):
    return multivariate.vecm(_months(spark, d), REGIONS, 2, ["grp"], constant=1)


@query()
def vector_autoregression(spark, d):
    return multivariate.var(_months(spark, d), REGIONS, 2, 6, ["grp"])


@query()
def vector_forecast(spark, d):
    return multivariate.forecast(_months(spark, d), REGIONS, 2, 12, ["grp"])


LOOKBACK, EVERY = 120, 21


@query(f"WITH {RETS} SELECT symbol, ts, {r('ret')} FROM rets WHERE ret IS NOT NULL")
def panel_returns(spark, d):
    return sizing.panel_returns(shapes.panel(spark, d))


@query(f"""WITH {RETS}, y AS (SELECT ts, list(ret ORDER BY symbol) AS y, row_number() OVER (ORDER BY ts) - 1 AS k FROM rets WHERE ret IS NOT NULL GROUP BY ts HAVING count(*) = 5),
 e AS (SELECT ts AS day, k AS e FROM y WHERE k >= {LOOKBACK - 1} AND (k - {LOOKBACK - 1}) % {EVERY} = 0), d AS (SELECT day, y FROM e JOIN y ON k > e - {LOOKBACK} AND k <= e), i AS (SELECT unnest(range(1, 6)) AS i),
 m AS (SELECT day, list(mu ORDER BY i) AS mu FROM (SELECT day, i, avg(y[i]) AS mu FROM d, i GROUP BY day, i) GROUP BY day), x AS (SELECT d.day, list_transform(range(1, 6), lambda q: y[q] - mu[q]) AS x FROM d JOIN m ON m.day = d.day),
 s AS (SELECT day, a.i AS i, b.i AS j, avg(x[a.i] * x[b.i]) AS s FROM x, i a, i b GROUP BY 1, 2, 3), t AS (SELECT day, sum(CASE WHEN i = j THEN s ELSE 0 END) / 5 AS centre, sum(s * s) AS ss FROM s GROUP BY day),
 q AS (SELECT day, avg(list_sum(list_transform(x, lambda v: v * v)) ** 2) AS q4, count(*) AS n FROM x GROUP BY day), h AS (SELECT t.day, centre, greatest(least((q4 - ss) / n / 5, (ss - 5 * centre ** 2) / 5), 0) / ((ss - 5 * centre ** 2) / 5) AS share FROM t JOIN q ON q.day = t.day)
 SELECT s.day AS ts, CAST(i - 1 AS BIGINT) AS a, CAST(j - 1 AS BIGINT) AS b, {r('(1 - share) * s + CASE WHEN i = j THEN share * centre ELSE 0 END AS cov', 'share AS shrinkage')} FROM s JOIN h ON h.day = s.day WHERE i <= j""")
def rolling_covariance(spark, d):
    return sizing.rolling_covariance(sizing.panel_returns(shapes.panel(spark, d)), REGIONS, LOOKBACK, EVERY)


def _trades(spark, d):
    """Every stretch of closes below their mean of 10, bought at its first close, sold at the close that ends it."""
    bars = shapes.panel(spark, d)
    bars = bars.withColumn("on", F.coalesce(c("close") < PANELS.rolling(F.avg("close"), 10), F.lit(False)))
    bars = bars.withColumn("before", F.coalesce(PANELS.lag("on"), F.lit(False)))
    turns = bars.filter(c("on") != c("before"))
    by_turn = Series(("symbol",), ("ts",))
    turns = turns.withColumns({"entry": by_turn.lag("close"), "opened": by_turn.lag("on")})
    return turns.filter("opened AND NOT on").select("symbol", c("ts").alias("exit_ts"), (c("close") / c("entry") - 1).alias("ret"))


@query()
def kelly_weights(spark, d):
    limits = sizing.Sizing(lookback=LOOKBACK, sigma_target=2.0, max_name=0.3)
    return sizing.kelly_weights(sizing.panel_returns(shapes.panel(spark, d)), _trades(spark, d), REGIONS, EVERY, limits)


#: (first day, end day) that three loads ask for, of January 2024.
LOADS = ((5, 12), (1, 20), (1, 20))
_ASKED = "(VALUES " + ", ".join(f"({k + 1}, TIMESTAMP '2024-01-{a:02}', TIMESTAMP '2024-01-{b:02}')" for k, (a, b) in enumerate(LOADS)) + ") AS t(load, s, e)"


@query(f"""WITH {BARS}, q AS (SELECT * FROM {_ASKED}), k AS (SELECT load, s, e, min(s) OVER w AS ps, max(e) OVER w AS pe FROM q WINDOW w AS (ORDER BY load ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT load, symbol, CASE WHEN ps IS NULL THEN 1 ELSE CAST(s < ps AS INTEGER) + CAST(e > pe AS INTEGER) END AS n_gaps, count(*) FILTER (WHERE ts >= s AND ts < e) AS n_bars,
 count(*) FILTER (WHERE ts >= s AND ts < e AND (ps IS NULL OR ts < ps OR ts >= pe)) AS n_fetched, {r('sum(CASE WHEN ts >= s AND ts < e THEN close END) AS sum_close')} FROM bars, k GROUP BY load, symbol, s, e, ps, pe""")
def incremental_load(spark, d):
    """Three loads of all symbols into a new store: what each had to fetch, and what it returned."""
    bars = hourly_bars(spark, d)
    store, vendor, out = loading.GapStore(spark, f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"), loading.from_table(bars), None
    for k, (a, b) in enumerate(LOADS):
        when = lambda day: F.lit(f"2024-01-{day:02}").cast("timestamp_ntz")
        asked = bars.select("symbol").distinct().select("symbol", when(a).alias("start"), when(b).alias("end"))
        gaps = cut_lineage(store.gaps(asked, "1h"))
        new = vendor(gaps).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_fetched"))
        got = loading.load(store, vendor, asked, "1h").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.sum("close").alias("sum_close"))
        told = got.join(gaps.groupBy("symbol").agg(F.count(F.lit(1)).cast("int").alias("n_gaps")), "symbol", "left").join(new, "symbol", "left").fillna(0, ["n_gaps", "n_fetched"])
        told = told.select(F.lit(k + 1).alias("load"), "symbol", "n_gaps", "n_bars", "n_fetched", "sum_close")
        out = told if out is None else out.unionByName(told)
    return out


# SQL of queries registered elsewhere ---------------------------------------------------------------


def _adaptive_sql(kinds: str, state: str, start: str, grown: str, size: str, columns: str) -> str:
    """Bars that end when a size reaches a limit that follows past sizes. state: columns of the running sums, start: their
    zeros, grown: with tick k added, size: from the grown ones."""
    return f"""WITH RECURSIVE {TICKS}, d AS (SELECT *, nullif(sign(price - lag(price) OVER w), 0) AS d, row_number() OVER w AS rn FROM ticks {TW}),
 s AS (SELECT symbol, ts, seq, rn, price, size, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) AS side FROM d), k AS ({kinds}),
 walk AS (SELECT DISTINCT symbol, kind, CAST(0 AS BIGINT) AS rn, {start}, CAST(0 AS BIGINT) AS next, CAST(-1 AS BIGINT) AS bar, false AS done, top AS lim FROM k
 UNION ALL SELECT symbol, kind, rn, {', '.join(f'CASE WHEN done THEN 0 ELSE {x} END' for x in state.split(', '))}, next + CAST(done AS BIGINT), next, done,
 CASE WHEN NOT done THEN lim WHEN 0.1e0 * size + 0.9e0 * lim < 1e-9 THEN top ELSE 0.1e0 * size + 0.9e0 * lim END FROM
 (SELECT *, size >= lim AS done FROM (SELECT *, {size} AS size FROM (SELECT k.symbol, k.kind, k.rn, k.top, {grown}, walk.next, walk.lim FROM walk JOIN k ON k.symbol = walk.symbol AND k.kind = walk.kind AND k.rn = walk.rn + 1)))),
 e AS (SELECT symbol, kind, bar FROM walk WHERE done)
 SELECT k.symbol, walk.bar, max(k.ts) AS ts, {OHLCV}{columns} FROM walk JOIN e USING (symbol, kind, bar) JOIN k ON k.symbol = walk.symbol AND k.kind = walk.kind AND k.rn = walk.rn GROUP BY k.symbol, walk.bar, k.kind"""


SQL["imbalance_bars"] = _adaptive_sql(
    "SELECT *, 'tick' AS kind, side AS w, 10e0 AS top FROM s UNION ALL SELECT *, 'volume', side * size, 50e0 FROM s UNION ALL SELECT *, 'dollar', side * size * price, 2000e0 FROM s",
    "total", "0e0 AS total", "walk.total + k.w AS total", "abs(total)", ", k.kind",
)
SQL["runs_bars"] = _adaptive_sql(
    "SELECT *, 'runs' AS kind, 10e0 AS top FROM s",
    "up, down", "CAST(0 AS BIGINT) AS up, CAST(0 AS BIGINT) AS down", "walk.up + CAST(k.side > 0 AS BIGINT) AS up, walk.down + CAST(k.side < 0 AS BIGINT) AS down", "CAST(greatest(up, down) AS DOUBLE)", "",
)


def _wilder_sum_sql(x: str, n: int) -> str:
    """Wilder's running sum of n, from the second row on."""
    return f"CASE WHEN rn > {n} THEN list_reduce(list({x}) OVER s [{n + 2}:], lambda a, y: a + y - a / {n}e0, list_sum(list({x}) OVER s [2:{n + 1}])) END"


_ADX = f"""WITH {BARS}, m AS (SELECT *, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 v AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0e0 END AS pl, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0e0 END AS mi FROM m),
 t AS (SELECT *, {_wilder_sum_sql('tr', 14)} AS total, {_wilder_sum_sql('pl', 14)} AS ps, {_wilder_sum_sql('mi', 14)} AS ms, {smooth_sql('close', 20, '(2e0 / 21)')} AS mid, {smooth_sql('tr', 10, '(1e0 / 10)')} AS a10 FROM v WINDOW {SO_FAR}),
 i AS (SELECT *, CASE WHEN total > 0 THEN 100 * ps / total WHEN total IS NOT NULL THEN 0 END AS p, CASE WHEN total > 0 THEN 100 * ms / total WHEN total IS NOT NULL THEN 0 END AS m FROM t), x AS (SELECT *, CASE WHEN p + m > 0 THEN 100 * abs(p - m) / (p + m) WHEN p IS NOT NULL THEN 0 END AS dx FROM i)
 SELECT symbol, ts, {r(smooth_sql('dx', 14, '(1e0 / 14)', 14) + ' AS adx', 'p AS plus_di', 'm AS minus_di', 'mid + 2 * a10 AS kc_upper', 'mid - 2 * a10 AS kc_lower')} FROM x WINDOW {SO_FAR}"""
SQL["recursive_indicators"] = f"SELECT * FROM ({_ADX}) JOIN " + " JOIN ".join(f"({SQL[name]}) USING (symbol, ts)" for name in ("kama", "layered_averages", "parabolic_sar", "supertrend"))


# Walk-forward learning ------------------------------------------------------------------------------

TRAIN, TEST, EMBARGO, AHEAD_BY, PENALTY = 100, 20, 1, 3, 2.0
_LEARN = f"""WITH {BARS}, x AS (SELECT symbol, ts, rn - 1 AS place, ln(close / lag(close) OVER w) AS x1, CASE WHEN rn >= 5 THEN close / avg(close) OVER f - 1 END AS x2, ln(lead(close, {AHEAD_BY}) OVER w / close) AS y
 FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
 size AS (SELECT symbol, count(*) AS rows FROM x GROUP BY 1), folds AS (SELECT symbol, unnest(range(0, (rows - {TRAIN + EMBARGO + TEST}) // {TEST} + 1)) AS fold FROM size WHERE rows >= {TRAIN + EMBARGO + TEST}),
 t AS (SELECT symbol, fold, count(*) AS m, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y
 FROM folds JOIN x USING (symbol) WHERE place >= {TEST} * fold AND place < {TEST} * fold + least({TRAIN}, {TRAIN + EMBARGO - AHEAD_BY}) AND x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2),
 z AS (SELECT *, m + {PENALTY} AS a, m * c12 / (s1 * s2) AS b, m * c1y / s1 AS r1, m * c2y / s2 AS r2 FROM t),
 k AS (SELECT *, (a * r1 - b * r2) / (a * a - b * b) / s1 AS k1, (a * r2 - b * r1) / (a * a - b * b) / s2 AS k2 FROM z),
 p AS (SELECT x.symbol, x.ts, k.fold, k.m AS n_train, y, my + k1 * (x1 - m1) + k2 * (x2 - m2) AS prediction FROM k JOIN x ON x.symbol = k.symbol AND x.place >= {TRAIN + EMBARGO} + {TEST} * k.fold AND x.place < {TRAIN + EMBARGO + TEST} + {TEST} * k.fold)"""


def _learned(spark, d):
    s = Series()
    rows = hourly_bars(spark, d).withColumn("x1", F.ln(c("close") / s.lag("close"))).withColumn("x2", c("close") / s.rolling(F.avg("close"), 5) - 1)
    rows = rows.withColumn("y", F.ln(s.lead("close", AHEAD_BY) / c("close"))).select("symbol", "ts", "x1", "x2", "y")
    return learning.walk_forward(rows, ["x1", "x2"], "y", learning.Folds(TRAIN, TEST, embargo=EMBARGO, horizon=AHEAD_BY), PENALTY)


@query(_LEARN + f"""SELECT symbol, ts, fold, n_train, {r('prediction', 'CAST(coalesce(last_value(CASE WHEN abs(prediction) < 0.01 THEN 0 WHEN abs(prediction) >= 0.05 THEN sign(prediction) END IGNORE NULLS) OVER s, 0) AS DOUBLE) AS weight')} FROM p WINDOW {SO_FAR}""")
def learned_signals(spark, d):
    return trend.threshold_policy(_learned(spark, d), "prediction", 0.05, 0.01).select("symbol", "ts", "fold", "n_train", "prediction", "weight")


@query(_LEARN + f"""SELECT symbol, fold, count(*) AS n, {r('avg((prediction - y) ** 2) AS mse', 'avg(CASE WHEN prediction * y > 0 THEN 1e0 ELSE 0 END) AS hit_rate', 'covar_pop(prediction, y) / nullif(sqrt(var_pop(prediction) * var_pop(y)), 0) AS correlation')} FROM p WHERE prediction IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2""")
def learned_fold_scores(spark, d):
    return learning.fold_scores(_learned(spark, d), "y")


# Statements ------------------------------------------------------------------------------------------

#: Labelled lines of every issuer and year: (statement, line, label, condition, value).
LINES = (
    ("income", 0, "Total Revenue", "ticker % 3 <> 0", "revenue"), ("income", 1, "Operating Revenue", "true", "0.9D * revenue"), ("income", 2, "Gross Profit", "true", "gross_profit"), ("income", 3, "EBITDA", "period % 2 = 0", "ebitda"),
    ("income", 4, "Normalized EBITDA", "true", "0.95D * ebitda"), ("income", 5, "Other Item", "true", "1D"), ("balance", 0, "Total Assets", "ticker % 5 <> 0 OR period <> 1995", "total_assets"), ("cash_flow", 0, "Capital Expenditure", "ticker % 7 <> 0", "capex"),
)


@query(f"""WITH {SNAP} SELECT ticker, period, {r('CASE WHEN ticker % 3 <> 0 THEN revenue ELSE 0.9e0 * revenue END AS revenue', 'gross_profit', 'CASE WHEN bool_or(period % 2 = 0) OVER (PARTITION BY ticker) THEN CASE WHEN period % 2 = 0 THEN ebitda END ELSE 0.95e0 * ebitda END AS ebitda', 'total_assets', 'CASE WHEN ticker % 7 <> 0 THEN capex END AS capex')}
 FROM snap QUALIFY ticker % 5 <> 0 OR period <> 1995 OR NOT bool_or(period <> 1995) OVER (PARTITION BY ticker)""")
def financial_statements(spark, d):
    """Issuers' statements from labelled lines; some lack a label, a period or a whole statement."""
    listed = F.array(*(F.when(F.expr(when), F.struct(F.lit(s).alias("statement"), F.lit(i).alias("line"), F.lit(label).alias("label"), F.expr(value).alias("value"))) for s, i, label, when, value in LINES))
    lines = shapes.snapshots(spark, d).select("ticker", "period", F.explode(F.array_compact(listed)).alias("l")).select("ticker", "period", "l.*")
    return statements.financial_statements(lines).select("ticker", "period", "revenue", "gross_profit", "ebitda", "total_assets", "capex")
