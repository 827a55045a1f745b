"""The registered queries: each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import Series, exact_sum, rounded, sorted_sum
from ..operators import bars as B
from ..operators import fundamentals as fu
from ..operators import indicators as I
from ..operators import micro, options, portfolio, profile, temporal
from ..sources.tables import hourly_bars, quotes, ticks
from . import shapes
from .shapes import BARS, CHAIN, DAILY, ISSUERS, MEMBERS, PANEL, QUOTES, TICKS

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query; doubles are rounded to six places on both sides."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, d: rounded(f(spark, d))
        QUERIES[key].__doc__ = f.__doc__
        if sql:
            SQL[key] = sql
        return f

    return register


def r(*names: str) -> str:
    """Rounded columns; "expression AS name" or a bare name. Adding zero turns minus zero into zero."""
    parts = []
    for n in names:
        expression, _, alias = n.rpartition(" AS ")
        parts.append(f"round(({expression or n}) * 1000000e0) / 1000000e0 + 0 AS {alias or n}")
    return ", ".join(parts)


W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts), "
SO_FAR = "s AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def frame(name: str, size: int) -> str:
    return f"{name} AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"


# Bars -------------------------------------------------------------------------------------------


@query(f"WITH {BARS} SELECT symbol, ts, {r('open', 'high', 'low', 'close', 'volume')} FROM bars")
def time_bars(spark, d):
    return hourly_bars(spark, d)


@query(f"WITH {BARS} SELECT symbol, date_trunc('day', ts) AS ts, {r('arg_min(open, ts) AS open', 'max(high) AS high', 'min(low) AS low', 'arg_max(close, ts) AS close', 'sum(volume) AS volume')} FROM bars GROUP BY 1, 2")
def resample(spark, d):
    return B.resample(hourly_bars(spark, d), "1 day")


THRESHOLD = """WITH RECURSIVE {ticks}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn FROM ticks),
 walk AS (SELECT symbol, rn, {w} AS acc, 0 AS bar, ({w} >= {limit}) AS done FROM k WHERE rn = 1
 UNION ALL SELECT k.symbol, k.rn, CASE WHEN walk.done THEN 0 ELSE walk.acc END + {w}, walk.bar + CASE WHEN walk.done THEN 1 ELSE 0 END, CASE WHEN walk.done THEN 0 ELSE walk.acc END + {w} >= {limit}
 FROM walk JOIN k ON k.symbol = walk.symbol AND k.rn = walk.rn + 1),
 full_bars AS (SELECT symbol, bar FROM walk WHERE done)
 SELECT k.symbol, CAST(walk.bar AS BIGINT) AS bar, max(k.ts) AS ts, {columns} FROM walk JOIN k USING (symbol, rn) JOIN full_bars f ON f.symbol = walk.symbol AND f.bar = walk.bar GROUP BY 1, 2"""
OHLCV = r("arg_min(price, (k.ts, k.seq)) AS open", "max(price) AS high", "min(price) AS low", "arg_max(price, (k.ts, k.seq)) AS close", "sum(size) AS volume")


@query(THRESHOLD.format(ticks=TICKS, w="k.size", limit=100, columns=OHLCV))
def volume_bars(spark, d):
    return B.volume_bars(ticks(spark, d), 100)


@query(THRESHOLD.format(ticks=TICKS, w="(k.size * k.price)", limit=5000, columns=OHLCV))
def dollar_bars(spark, d):
    return B.dollar_bars(ticks(spark, d), 5000)


@query()
def imbalance_bars(spark, d):
    rows = [B.imbalance_bars(ticks(spark, d), t, kind).withColumn("kind", F.lit(kind)) for kind, t in (("tick", 10.0), ("volume", 50.0), ("dollar", 2000.0))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query()
def runs_bars(spark, d):
    return B.runs_bars(ticks(spark, d), 10.0)


# Indicators -------------------------------------------------------------------------------------


def wma_sql(x: str, n: int, rows: str) -> str:
    return f"CASE WHEN {rows} >= {n} THEN list_sum(list_transform(list({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), lambda v, i: v * i)) / {n * (n + 1) / 2} END"


@query(f"""WITH {BARS}, a AS (SELECT *, {wma_sql('close', 20, 'rn')} AS wma, 2 * ({wma_sql('close', 8, 'rn')}) - ({wma_sql('close', 16, 'rn')}) AS raw FROM n), h AS (SELECT *, {wma_sql('raw', 4, '(rn - 15)')} AS hma FROM a)
 SELECT symbol, ts, {r('CASE WHEN rn >= 20 THEN avg(close) OVER f END AS sma', 'wma', 'hma')} FROM h WINDOW {frame('f', 20)}""")
def moving_averages(spark, d):
    b = I.hma(I.wma(I.sma(hourly_bars(spark, d), "close", 20), "close", 20), "close", 16)
    return b.select("symbol", "ts", "sma", "wma", "hma")


@query(f"""WITH {BARS}, a AS (SELECT *, CASE WHEN rn >= 20 THEN avg(close) OVER f END AS m, CASE WHEN rn >= 20 THEN stddev_pop(close) OVER f END AS sd, CASE WHEN rn >= 20 THEN max(high) OVER f END AS hh, CASE WHEN rn >= 20 THEN min(low) OVER f END AS ll FROM n WINDOW {frame('f', 20)})
 SELECT symbol, ts, {r('m AS bb_mid', 'm + 2 * sd AS bb_upper', 'm - 2 * sd AS bb_lower', '4 * sd / nullif(m, 0) AS bb_width', '(close - m + 2 * sd) / nullif(4 * sd, 0) AS bb_pct', 'hh AS dc_upper', 'll AS dc_lower', '(hh + ll) / 2 AS dc_mid')} FROM a""")
def bands(spark, d):
    return I.donchian_channels(I.bollinger_bands(hourly_bars(spark, d))).drop("open", "high", "low", "close", "volume")


@query(f"""WITH {BARS}, a AS (SELECT *, CASE WHEN rn >= 14 THEN max(high) OVER f END AS hh, CASE WHEN rn >= 14 THEN min(low) OVER f END AS ll, lag(close, 12) OVER w AS c12, (high + low + close) / 3 AS tp FROM n {W}{frame('f', 14)}),
 b AS (SELECT *, CASE WHEN hh = ll THEN 50 ELSE 100 * (close - ll) / (hh - ll) END AS k, CASE WHEN rn >= 20 THEN avg(tp) OVER g END AS mean, list(tp) OVER g AS l FROM a WINDOW {frame('g', 20)}),
 e AS (SELECT *, list_sum(list_transform(l, lambda v: abs(v - mean))) / 20 AS mad FROM b)
 SELECT symbol, ts, {r('CASE WHEN hh IS NOT NULL THEN k END AS stoch_k', 'CASE WHEN rn >= 16 THEN avg(k) OVER t END AS stoch_d', '100 * (close / c12 - 1) AS roc', 'CASE WHEN hh = ll THEN 0 ELSE -100 * (hh - close) / (hh - ll) END AS williams_r', 'CASE WHEN mad = 0 THEN 0 ELSE (tp - mean) / (CAST(0.015 AS DOUBLE) * mad) END AS cci')} FROM e WINDOW {frame('t', 3)}""")
def oscillators(spark, d):
    b = I.cci(I.williams_r(I.roc(I.stochastic(hourly_bars(spark, d)))))
    return b.drop("open", "high", "low", "close", "volume")


@query(f"""WITH {BARS}, a AS (SELECT *, max((high, rn)) OVER f AS u, min((low, -rn)) OVER f AS l FROM n WINDOW {frame('f', 26)}), b AS (SELECT *, CASE WHEN rn > 25 THEN 100e0 * (25 - (rn - u[2])) / 25 END AS up, CASE WHEN rn > 25 THEN 100e0 * (25 - (rn + l[2])) / 25 END AS down FROM a)
 SELECT symbol, ts, {r('up AS aroon_up', 'down AS aroon_down', 'up - down AS aroon_osc')} FROM b""")
def aroon(spark, d):
    return I.aroon(hourly_bars(spark, d)).drop("open", "high", "low", "close", "volume")


def mid_sql(n: int) -> str:
    return f"CASE WHEN rn >= {n} THEN (max(high) OVER f{n} + min(low) OVER f{n}) / 2 END"


@query(f"""WITH {BARS}, a AS (SELECT *, {mid_sql(9)} AS tenkan, {mid_sql(26)} AS kijun, {mid_sql(52)} AS b FROM n WINDOW {frame('f9', 9)}, {frame('f26', 26)}, {frame('f52', 52)})
 SELECT symbol, ts, {r('tenkan', 'kijun', 'lag((tenkan + kijun) / 2, 26) OVER w AS senkou_a', 'lag(b, 26) OVER w AS senkou_b', 'lead(close, 26) OVER w AS chikou')} FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def ichimoku(spark, d):
    return I.ichimoku(hourly_bars(spark, d)).drop("open", "high", "low", "close", "volume")


@query(f"""WITH {BARS}, a AS (SELECT *, ln(high / low) ** 2 / (4 * ln(2)) AS pk, 0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2 AS gk, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs, ln(open / lag(close) OVER w) AS o, ln(close / open) AS cc FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 b AS (SELECT *, avg(pk) OVER f AS p, avg(gk) OVER f AS g, avg(rs) OVER f AS q, var_samp(o) OVER f + (0.34e0 / (1.34e0 + 21 / 19e0)) * var_samp(cc) OVER f + (1 - 0.34e0 / (1.34e0 + 21 / 19e0)) * avg(rs) OVER f AS y FROM a WINDOW {frame('f', 20)})
 SELECT symbol, ts, {r('CASE WHEN rn >= 20 THEN sqrt(252 * greatest(p, 0)) END AS parkinson', 'CASE WHEN rn >= 20 THEN sqrt(252 * greatest(g, 0)) END AS garman_klass', 'CASE WHEN rn >= 20 THEN sqrt(252 * greatest(q, 0)) END AS rogers_satchell', 'CASE WHEN rn >= 21 THEN sqrt(252 * greatest(y, 0)) END AS yang_zhang')} FROM b""")
def volatility(spark, d):
    return I.volatility(hourly_bars(spark, d)).drop("open", "high", "low", "close", "volume")


@query(f"""WITH {BARS}, a AS (SELECT *, coalesce(sign(close - lag(close) OVER w), 0) * volume AS step, (high + low + close) / 3 AS tp, CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) END * volume AS mfv FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 b AS (SELECT *, tp - lag(tp) OVER w AS up FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 e AS (SELECT *, sum(CASE WHEN up > 0 THEN tp * volume ELSE 0 END) OVER m AS pos, sum(CASE WHEN up < 0 THEN tp * volume ELSE 0 END) OVER m AS neg FROM b WINDOW {frame('m', 14)})
 SELECT symbol, ts, {r('sum(step) OVER s AS obv', 'sum(tp * volume) OVER s / sum(volume) OVER s AS vwap', 'round(CASE WHEN rn >= 20 THEN sum(tp * volume) OVER f / sum(volume) OVER f END, 5) AS rolling_vwap', 'sum(mfv) OVER s AS acc_dist', 'CASE WHEN rn >= 20 THEN sum(mfv) OVER f / sum(volume) OVER f END AS cmf', 'CASE WHEN rn < 15 THEN NULL WHEN neg = 0 THEN CASE WHEN pos > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + pos / neg) END AS mfi')} FROM e WINDOW {SO_FAR}, {frame('f', 20)}""")
def volume_flow(spark, d):
    # five places: prices in hundredths over sums of whole volumes often end in a half of the sixth
    return I.volume_flow(hourly_bars(spark, d)).withColumn("rolling_vwap", F.round("rolling_vwap", 5)).drop("open", "high", "low", "close", "volume")


@query(f"""WITH {BARS}, a AS (SELECT *, lag(high) OVER w AS h, lag(low) OVER w AS l, lag(close) OVER w AS cl FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts)), b AS (SELECT *, (h + l + cl) / 3 AS p FROM a)
 SELECT symbol, ts, {r('p AS pivot', '2 * p - l AS r1', '2 * p - h AS s1', 'p + h - l AS r2', 'p - h + l AS s2', 'h + 2 * (p - l) AS r3', 'l - 2 * (h - p) AS s3', 'p + 0.382e0 * (h - l) AS fr1', 'p - 0.618e0 * (h - l) AS fs2')} FROM b""")
def pivot_points(spark, d):
    b = I.pivot_points(hourly_bars(spark, d))
    f = I.pivot_points(hourly_bars(spark, d), "fibonacci").select("symbol", "ts", c("r1").alias("fr1"), c("s2").alias("fs2"))
    return b.drop("open", "high", "low", "close", "volume").join(f, ["symbol", "ts"])


def smooth_sql(x: str, n: int, weight: str, skip: int = 0) -> str:
    first = n + skip
    return f"CASE WHEN rn >= {first} THEN list_reduce(list({x}) OVER s [{first + 1}:], lambda a, y: a + (y - a) * {weight}, list_avg(list({x}) OVER s [{1 + skip}:{first}])) END"


@query(f"""WITH {BARS}, a AS (SELECT *, close - lag(close) OVER w AS ch, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 b AS (SELECT *, greatest(coalesce(ch, 0), 0) AS gain, greatest(-coalesce(ch, 0), 0) AS loss FROM a),
 e AS (SELECT symbol, ts, {smooth_sql('close', 14, '(2e0 / 15)')} AS ema, {smooth_sql('close', 14, '(1e0 / 14)')} AS wilder, {smooth_sql('gain', 14, '(1e0 / 14)', 1)} AS ag, {smooth_sql('loss', 14, '(1e0 / 14)', 1)} AS al, {smooth_sql('tr', 14, '(1e0 / 14)')} AS atr FROM b WINDOW {SO_FAR})
 SELECT symbol, ts, {r('ema', 'wilder', 'CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END AS rsi', 'atr')} FROM e""")
def recursive_averages(spark, d):
    return I.recursive(hourly_bars(spark, d), 14).select("symbol", "ts", "ema", "wilder", "rsi", "atr")


@query()
def recursive_indicators(spark, d):
    """DEMA, TEMA, KAMA, MACD, ADX, SAR, SuperTrend and Keltner channels."""
    return I.recursive(hourly_bars(spark, d), 14).drop("open", "high", "low", "close", "volume", "ema", "wilder", "rsi", "atr")


@query(f"""WITH {BARS}, a AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER b AS nb, count(*) OVER f AS nf, max(high) OVER b AS bh, max(high) OVER f AS fh, min(low) OVER b AS bl, min(low) OVER f AS fl FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts), b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
 e AS (SELECT *, CASE WHEN high > bh AND high > fh THEN 1 WHEN low < bl AND low < fl THEN -1 END AS kind FROM a WHERE nb = 3 AND nf = 3)
 SELECT symbol, ts, CAST(place AS INTEGER) AS place, {r('CASE kind WHEN 1 THEN high ELSE low END AS price', '3e0 AS strength')}, CAST(kind AS INTEGER) AS kind FROM e WHERE kind IS NOT NULL""")
def fractal_swings(spark, d):
    return I.fractal_swings(hourly_bars(spark, d)).withColumn("place", c("place").cast("int"))


@query()
def support_resistance(spark, d):
    return I.cluster_levels(I.fractal_swings(hourly_bars(spark, d)))


# Profiles ---------------------------------------------------------------------------------------

PROFILE = BARS + """, lim AS (SELECT symbol, min(low) AS lo, max(high) AS hi, (max(high) - min(low)) / 50 AS wd FROM bars WHERE volume > 0 GROUP BY symbol), grid AS (SELECT symbol, lo, hi, wd, g AS bin, lo + g * wd AS a FROM lim, range(50) t(g)),
 ov AS (SELECT g.symbol, g.bin, sum(b.volume * CASE WHEN b.high > b.low THEN greatest(least(b.high, a + wd) - greatest(b.low, a), 0) / (b.high - b.low) WHEN least(floor((b.low - lo) / wd), 49) = g.bin THEN 1 ELSE 0 END) AS v FROM grid g JOIN bars b ON b.symbol = g.symbol AND b.volume > 0 GROUP BY 1, 2),
 prof AS (SELECT g.symbol, g.bin, lo + g.bin * ((hi - lo) / 50) AS low, lo + (g.bin + 1) * ((hi - lo) / 50) AS high, coalesce(v, 0) AS volume FROM grid g LEFT JOIN ov USING (symbol, bin))"""


@query(f"WITH {PROFILE} SELECT symbol, bin, {r('low', 'high', 'volume')} FROM prof")
def volume_profile(spark, d):
    return profile.volume_profile(hourly_bars(spark, d))


@query(f"""WITH {PROFILE}, a AS (SELECT *, sum(volume) OVER p AS total, row_number() OVER (PARTITION BY symbol ORDER BY volume, bin) AS rk, (low + high) / 2 AS mid FROM prof WINDOW p AS (PARTITION BY symbol)), b AS (SELECT *, volume / total AS pr, sum(volume / total * mid) OVER (PARTITION BY symbol) AS mean FROM a),
 e AS (SELECT symbol, 2 * sum(rk * volume) / (50 * sum(volume)) - 51 / 50e0 AS gini, -sum(CASE WHEN pr > 0 THEN pr * ln(pr) END) / ln(50) AS entropy, sum(pr * (mid - mean) ** 2) AS m2, sum(pr * (mid - mean) ** 3) AS m3, sum(pr * (mid - mean) ** 4) AS m4, arg_max(mid, (volume, -bin)) AS poc, min(low) AS lo, max(high) AS hi FROM b GROUP BY symbol),
 f AS (SELECT *, m3 / m2 ** 1.5 AS skew, m4 / m2 ** 2 - 3 AS kurtosis, (poc - lo) / (hi - lo) AS pos FROM e)
 SELECT symbol, {r('gini', 'entropy', 'skew', 'kurtosis')}, CASE WHEN pos >= 0.66 AND skew <= -0.2 THEN 'P' WHEN pos <= 0.34 AND skew >= 0.2 THEN 'b' WHEN pos BETWEEN 0.4 AND 0.6 AND abs(skew) < 0.2 THEN 'D' ELSE 'normal' END AS shape FROM f""")
def profile_shape(spark, d):
    return profile.profile_shape(profile.volume_profile(hourly_bars(spark, d)))


@query()
def value_area(spark, d):
    return profile.value_area(profile.volume_profile(hourly_bars(spark, d)))


@query()
def value_area_migration(spark, d):
    return profile.value_area_migration(hourly_bars(spark, d))


@query()
def naked_pocs(spark, d):
    return profile.naked_pocs(hourly_bars(spark, d))


@query()
def tpo_profile(spark, d):
    return profile.tpo_profile(hourly_bars(spark, d), bracket="2 hours")


@query(f"""WITH {BARS}, a AS (SELECT *, date_trunc('day', ts) AS session, (high + low + close) / 3 AS tp, CASE WHEN rn > 100 THEN volume END AS av FROM n)
 SELECT symbol, ts, {r('sum(tp * volume) OVER d / sum(volume) OVER d AS session_vwap', 'sum(tp * av) OVER s / sum(av) OVER s AS anchored_vwap', '(2 * CASE WHEN high = low THEN 0.5 ELSE (close - low) / (high - low) END - 1) * volume AS delta', 'sum(tp * volume) OVER s / sum(volume) OVER s AS vwap', 'sum(tp * volume) OVER s / sum(volume) OVER s + 2 * sqrt(greatest(sum(tp * tp * volume) OVER s / sum(volume) OVER s - (sum(tp * volume) OVER s / sum(volume) OVER s) ** 2, 0)) AS vwap_upper_2')}
 FROM a WINDOW {SO_FAR}, d AS (PARTITION BY symbol, session ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def vwaps(spark, d):
    b = profile.anchored_vwap(profile.bar_delta(profile.session_vwap(I.vwap_bands(hourly_bars(spark, d)))), 100)
    return b.select("symbol", "ts", "session_vwap", "anchored_vwap", "delta", "vwap", "vwap_upper_2")


SIGNED = TICKS + """, ch AS (SELECT *, nullif(sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq)), 0) AS d FROM ticks), sg AS (SELECT *, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 1) AS sgn FROM ch)"""


@query(f"WITH {SIGNED} SELECT symbol, seq, {r('sgn * size AS signed_volume', 'sum(sgn * size) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS cvd')} FROM sg")
def cumulative_delta(spark, d):
    return profile.cumulative_volume_delta(ticks(spark, d)).select("symbol", "seq", "signed_volume", "cvd")


@query(f"""WITH {SIGNED}, lim AS (SELECT symbol, min(price) AS lo, max(price) AS hi FROM ticks GROUP BY 1)
 SELECT symbol, CAST(least(floor((price - lo) * 50 / (hi - lo)), 49) AS BIGINT) AS bin, {r('sum(CASE WHEN sgn > 0 THEN size ELSE 0 END) AS buy', 'sum(CASE WHEN sgn < 0 THEN size ELSE 0 END) AS sell')} FROM sg JOIN lim USING (symbol) GROUP BY 1, 2""")
def delta_profile(spark, d):
    return profile.delta_profile(ticks(spark, d))


# Microstructure ---------------------------------------------------------------------------------

SIGNS = QUOTES + """, ch AS (SELECT *, nullif(sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq)), 0) AS d, sign(price - (bid + ask) / 2) AS qr FROM quotes), t1 AS (SELECT *, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) AS tr FROM ch),
 sg AS (SELECT *, CASE WHEN qr <> 0 THEN qr ELSE tr END AS lr, CASE WHEN price >= ask THEN 1 WHEN price <= bid THEN -1 ELSE tr END AS emo FROM t1)"""
TW = "WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)"


@query(f"""WITH {SIGNS} SELECT symbol, seq, {r('tr AS tick_rule', 'qr AS quote_rule', 'lr AS lee_ready', 'emo', 'ask - bid AS quoted', '(ask - bid) / nullif((bid + ask) / 2, 0) AS relative', '2 * lr * (price - (bid + ask) / 2) AS effective', '2 * lr * (price - lead((bid + ask) / 2, 5) OVER w) AS realized')} FROM sg {TW}""")
def trade_signs_and_spreads(spark, d):
    q = micro.spreads(micro.trade_signs(quotes(spark, d)))
    return q.select("symbol", "seq", "tick_rule", "quote_rule", "lee_ready", "emo", "quoted", "relative", "effective", "realized")


@query(f"""WITH {QUOTES}, a AS (SELECT *, lag(bid) OVER w AS b0, lag(ask) OVER w AS a0, lag(bid_size) OVER w AS s0, lag(ask_size) OVER w AS z0, row_number() OVER w AS rn FROM quotes {TW}),
 o AS (SELECT *, CASE WHEN b0 IS NULL THEN 0 ELSE CASE WHEN bid >= b0 THEN bid_size ELSE 0 END - CASE WHEN bid <= b0 THEN s0 ELSE 0 END - CASE WHEN ask <= a0 THEN ask_size ELSE 0 END + CASE WHEN ask >= a0 THEN z0 ELSE 0 END END AS ofi FROM a)
 SELECT symbol, seq, {r('ofi', 'CASE WHEN rn >= 20 THEN sum(ofi) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS 19 PRECEDING) END AS ofi_sum')} FROM o""")
def order_flow_imbalance(spark, d):
    return micro.order_flow_imbalance(quotes(spark, d), 20).select("symbol", "seq", "ofi", "ofi_sum")


def ols_sql(x: str) -> str:
    return f"""WITH {SIGNS}, p AS (SELECT symbol, price - lag(price) OVER w AS y, {x} AS x FROM sg {TW}), f AS (SELECT symbol, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM p WHERE y IS NOT NULL GROUP BY symbol)
 SELECT symbol, {r('slope', 'intercept', 'r2', 'slope / sqrt((syy - slope ** 2 * sxx) / (n - 2) / sxx) AS t')}, n FROM f"""


@query(ols_sql("lr * size"))
def kyle_lambda(spark, d):
    return micro.kyle_lambda(micro.trade_signs(quotes(spark, d)))


@query(ols_sql("lr * sqrt(size)"))
def hasbrouck_lambda(spark, d):
    return micro.hasbrouck_lambda(micro.trade_signs(quotes(spark, d)))


@query(f"""WITH {BARS}, a AS (SELECT *, close / lag(close) OVER w - 1 AS rr, close * volume AS dv, close - lag(close) OVER w AS dd, (ln(high) + ln(low)) / 2 AS mid, lag(high) OVER w AS h0, lag(low) OVER w AS l0 FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 b AS (SELECT *, lag(dd) OVER w AS d1, lead(mid) OVER w AS nx, (sqrt(2) - 1) * sqrt(ln(high / low) ** 2 + ln(h0 / l0) ** 2) / (3 - 2 * sqrt(2)) - sqrt(ln(greatest(high, h0) / least(low, l0)) ** 2 / (3 - 2 * sqrt(2))) AS al FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 e AS (SELECT symbol, 1000000 * avg(abs(rr) / nullif(dv, 0)) AS amihud, avg(dd * d1) - avg(CASE WHEN d1 IS NOT NULL THEN dd END) * avg(d1) AS cv, avg(CASE WHEN al > 0 THEN 2 * (exp(al) - 1) / (1 + exp(al)) WHEN al IS NOT NULL THEN 0 END) AS cs, avg(2 * sqrt(greatest((ln(close) - mid) * (ln(close) - nx), CASE WHEN nx IS NOT NULL THEN 0 END))) AS ar FROM (SELECT * FROM b) GROUP BY symbol)
 SELECT symbol, {r('amihud', 'cs AS corwin_schultz', 'ar AS abdi_ranaldo', 'CASE WHEN cv < 0 THEN 2 * sqrt(-cv) END AS roll')} FROM e""")
def illiquidity(spark, d):
    return micro.illiquidity(hourly_bars(spark, d))


@query()
def vpin(spark, d):
    return micro.vpin(hourly_bars(spark, d))


@query()
def pin(spark, d):
    t = B.with_tick_sign(ticks(spark, d), first=1)
    days = t.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.when(c("sign") > 0, 1)).cast("double").alias("buys"), F.count(F.when(c("sign") < 0, 1)).cast("double").alias("sells"))
    return micro.pin(days)


# Temporal ---------------------------------------------------------------------------------------


@query(f"WITH {MEMBERS}, {DAILY} SELECT symbol, ts, {r('close')} FROM daily JOIN members USING (symbol) WHERE members.index = 'ASIA' AND \"start\" <= ts AND ts < \"end\"")
def pit_join(spark, d):
    return temporal.pit_join(shapes.daily(spark, d).select("symbol", "ts", "close"), shapes.members(spark, d), "ASIA")


@query(f"WITH {MEMBERS} SELECT DISTINCT symbol FROM members WHERE members.index = 'ASIA' AND \"start\" <= TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-01-01' < \"end\"")
def asof_universe(spark, d):
    return temporal.asof_universe(shapes.members(spark, d), "ASIA", "1998-01-01")


@query(f"WITH {MEMBERS}, m AS (SELECT DISTINCT symbol FROM members WHERE members.index = 'ASIA'), f AS (SELECT DISTINCT l_suppkey AS symbol FROM lineitem) SELECT count(*) AS n_members, count(*) FILTER (WHERE f.symbol IS NULL) AS n_missing, {r('count(*) FILTER (WHERE f.symbol IS NULL) / CAST(count(*) AS DOUBLE) AS missing_ratio')} FROM m LEFT JOIN f USING (symbol)")
def survivorship(spark, d):
    return temporal.survivorship(shapes.daily(spark, d), shapes.members(spark, d), "ASIA")


def _priced(spark, d):
    return shapes.daily(spark, d).withColumn("open", c("close"))


@query(f"WITH {DAILY} SELECT symbol, ts, {r('close / CASE WHEN symbol % 10 = 0 AND ts < TIMESTAMP ' + chr(39) + '1998-06-01' + chr(39) + ' THEN 2 ELSE 1 END AS close', 'volume * CASE WHEN symbol % 10 = 0 AND ts < TIMESTAMP ' + chr(39) + '1998-06-01' + chr(39) + ' THEN 2 ELSE 1 END AS volume')} FROM daily")
def apply_splits(spark, d):
    return temporal.apply_splits(_priced(spark, d), shapes.actions(spark, d)).select("symbol", "ts", "close", "volume")


@query(f"""WITH {DAILY}, pre AS (SELECT symbol, arg_max(close, ts) AS raw FROM daily WHERE ts < TIMESTAMP '1997-03-03' AND symbol % 10 = 1 GROUP BY symbol),
 f AS (SELECT symbol, ts, close, volume, CASE WHEN symbol % 10 = 0 AND ts < TIMESTAMP '1998-06-01' THEN 0.5e0 WHEN symbol % 10 = 1 AND ts < TIMESTAMP '1997-03-03' AND raw > 5 THEN (raw - 5) / raw ELSE 1 END AS fp, CASE WHEN symbol % 10 = 0 AND ts < TIMESTAMP '1998-06-01' THEN 2 ELSE 1 END AS fv FROM daily LEFT JOIN pre USING (symbol))
 SELECT symbol, ts, {r('close * fp AS close', 'volume * fv AS volume')} FROM f""")
def back_adjust(spark, d):
    return temporal.back_adjust(_priced(spark, d), shapes.actions(spark, d)).select("symbol", "ts", "close", "volume")


@query(f"""WITH {DAILY}, t AS (SELECT *, coalesce(ln((close + CASE WHEN symbol % 10 = 1 AND ts = TIMESTAMP '1997-03-03' THEN 5 ELSE 0 END) / lag(close) OVER w), 0) AS tr FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY ts))
 SELECT symbol, ts, {r('tr AS total_return', 'exp(sum(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS total_return_index')} FROM t""")
def total_return(spark, d):
    return temporal.total_return(shapes.daily(spark, d), shapes.actions(spark, d)).select("symbol", "ts", "total_return", "total_return_index")


@query("SELECT p.event_id AS seq, p.ts, v.value AS bid FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT ts, round(value, 6) AS value FROM events WHERE event_type = 'view') v ON p.ts >= v.ts")
def asof_join(spark, d):
    t = ticks(spark, d).withColumn("k", F.lit(1))
    left = t.filter("symbol = 'purchase'").select("k", "seq", "ts")
    right = t.filter("symbol = 'view'").select("k", "ts", c("price").alias("bid"))
    return temporal.asof_join(left, right, ["bid"], ("k",)).drop("k")


COVER = """iv AS (SELECT user_id AS symbol, date_trunc('day', ts) AS "start", date_trunc('day', ts) + INTERVAL 1 DAY AS "end" FROM events), o AS (SELECT *, max("end") OVER (PARTITION BY symbol ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM o), cov AS (SELECT symbol, min("start") AS "start", max("end") AS "end" FROM i GROUP BY symbol, g)"""


def _intervals(spark, d):
    e = shapes.table(spark, d, "events")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return e.select(c("user_id").alias("symbol"), day.alias("start"), (day + F.expr("INTERVAL 1 DAY")).alias("end"))


@query(f'WITH {COVER} SELECT symbol, "start", "end" FROM cov')
def coverage(spark, d):
    return temporal.coverage(_intervals(spark, d))


@query(f'WITH {COVER} SELECT symbol, "end" AS gap_start, nx AS gap_end FROM (SELECT *, lead("start") OVER (PARTITION BY symbol ORDER BY "start") AS nx FROM cov) WHERE nx IS NOT NULL')
def coverage_gaps(spark, d):
    rows = _intervals(spark, d)
    gaps = temporal.missing(rows, "1900-01-01", "2100-01-01")
    return gaps.filter("gap_start > TIMESTAMP_NTZ'1900-01-01' AND gap_end < TIMESTAMP_NTZ'2100-01-01'")


@query()
def nyse_sessions(spark, d):
    from datetime import date

    return temporal.nyse_sessions(spark, date(2020, 1, 1), date(2024, 12, 31))


@query()
def calendar_align(spark, d):
    from datetime import date

    return temporal.align(hourly_bars(spark, d), temporal.nyse_sessions(spark, date(2020, 1, 1), date(2026, 12, 31)), mark=True)


@query(f"""WITH {PANEL}, bench AS (SELECT ts, avg(close) AS bench FROM panel GROUP BY ts), q AS (SELECT symbol, ts, close / bench AS v FROM panel JOIN bench USING (ts)), z AS (SELECT *, v / first_value(v) OVER s AS rs, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) AS DOUBLE) AS rn FROM q WINDOW {SO_FAR}),
 y AS (SELECT *, CASE WHEN rn >= 20 THEN regr_slope(rs, rn) OVER f END AS rs_slope FROM z WINDOW {frame('f', 20)})
 SELECT symbol, ts, {r('rs', 'rs_slope', 'CASE WHEN rs_slope IS NOT NULL THEN row_number() OVER (PARTITION BY ts, rs_slope IS NOT NULL ORDER BY rs_slope, symbol) / CAST(count(*) OVER (PARTITION BY ts, rs_slope IS NOT NULL) AS DOUBLE) END AS rs_rank')} FROM y""")
def relative_strength(spark, d):
    p = shapes.panel(spark, d)
    return temporal.relative_strength(p, p.groupBy("ts").agg(F.avg("close").alias("bench"))).select("symbol", "ts", "rs", "rs_slope", "rs_rank")


# Portfolio --------------------------------------------------------------------------------------

RETS = PANEL + """, rets AS (SELECT symbol, ts, close / first_value(close) OVER s - 1 AS cum_ret, close / lag(close) OVER s - 1 AS ret, ln(close / lag(close) OVER s) AS log_ret FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY ts))"""


@query(f"WITH {RETS} SELECT symbol, ts, {r('ret', 'log_ret', 'cum_ret')} FROM rets WHERE ret IS NOT NULL")
def returns(spark, d):
    return portfolio.returns(shapes.panel(spark, d)).select("symbol", "ts", "ret", "log_ret", "cum_ret")


@query(f"""WITH {RETS}, x AS (SELECT symbol, ts, ret / 20 AS ret FROM rets WHERE ret IS NOT NULL), w AS (SELECT *, exp(sum(ln(1 + ret)) OVER s) AS wealth FROM x WINDOW {SO_FAR}), p AS (SELECT *, greatest(max(wealth) OVER s, 1) AS peak FROM w WINDOW {SO_FAR}),
 q AS (SELECT symbol, quantile_cont(ret, 0.05) AS q FROM x GROUP BY symbol), a AS (SELECT symbol, count(*) AS n, sum(ln(1 + ret)) AS lg, stddev_samp(ret) AS sd, avg(ret) AS m, avg(CASE WHEN ret < 0 THEN ret ** 2 END) AS dn, max(1 - wealth / peak) AS mdd, -any_value(q) AS var, -avg(CASE WHEN ret <= q THEN ret END) AS cvar FROM p JOIN q USING (symbol) GROUP BY symbol)
 SELECT symbol, n, {r('exp(lg) - 1 AS total_return', 'exp(lg * 252 / n) - 1 AS annual_return', 'sd * sqrt(252) AS annual_volatility', 'm / sd * sqrt(252) AS sharpe', 'm / sqrt(dn) * sqrt(252) AS sortino', 'mdd AS max_drawdown', '(exp(lg * 252 / n) - 1) / mdd AS calmar', 'var', 'cvar')} FROM a""")
def metrics(spark, d):
    rows = portfolio.returns(shapes.panel(spark, d)).withColumn("ret", c("ret") / 20)
    return portfolio.metrics(rows)


@query(f"""WITH {RETS} SELECT a.symbol AS i, b.symbol AS j, count(*) AS n, {r('covar_samp(a.ret, b.ret) AS cov', 'corr(a.ret, b.ret) AS corr')} FROM rets a JOIN rets b USING (ts) WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2""")
def covariance(spark, d):
    return portfolio.covariance(portfolio.returns(shapes.panel(spark, d)))


@query()
def ledoit_wolf(spark, d):
    return portfolio.ledoit_wolf(portfolio.returns(shapes.panel(spark, d)))


@query()
def optimal_portfolios(spark, d):
    return portfolio.optimal_portfolios(portfolio.returns(shapes.panel(spark, d)))


@query(f"""WITH {PANEL}, a AS (SELECT *, close / lag(close) OVER w - 1 AS rr, sign(ln(close / lag(close, 100) OVER w)) AS sg, row_number() OVER w AS rn FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY ts)), b AS (SELECT *, stddev_pop(rr) OVER f * sqrt(252) AS sd FROM a WINDOW {frame('f', 60)}),
 e AS (SELECT *, coalesce(CASE WHEN rn > 60 AND sd > 0 THEN sg * least(3, 0.15e0 / sd) END, 0) AS weight FROM b)
 SELECT symbol, ts, {r('sg AS signal', 'weight', 'lag(weight) OVER w * rr AS factor_ret')} FROM e WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def time_series_momentum(spark, d):
    return portfolio.time_series_momentum(shapes.panel(spark, d), 100).select("symbol", "ts", "signal", "weight", "factor_ret")


@query(f"""WITH {PANEL}, t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS t FROM (SELECT DISTINCT ts FROM panel)), a AS (SELECT *, ln(lag(close, 21) OVER w / lag(close, 121) OVER w) AS fm, close / lag(close) OVER w - 1 AS rr FROM panel JOIN t USING (ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 b AS (SELECT *, coalesce(t >= 121 AND (t - 121) % 21 = 0 AND fm IS NOT NULL, false) AS deal FROM a), e AS (SELECT *, row_number() OVER (PARTITION BY ts, deal ORDER BY fm, symbol) AS k, count(*) OVER (PARTITION BY ts, deal) AS m FROM b),
 f AS (SELECT *, CASE WHEN deal AND m >= 2 THEN CASE WHEN k > m - greatest(m // 5, 1) THEN 1e0 / greatest(m // 5, 1) WHEN k <= greatest(m // 5, 1) THEN -1e0 / greatest(m // 5, 1) ELSE 0 END END AS w0 FROM e), g AS (SELECT *, coalesce(last_value(w0 IGNORE NULLS) OVER s, 0) AS weight FROM f WINDOW {SO_FAR})
 SELECT symbol, ts, {r('weight', 'lag(weight) OVER w * rr AS factor_ret')} FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def cross_sectional_momentum(spark, d):
    return portfolio.cross_sectional_momentum(shapes.panel(spark, d), 100)


# Options ----------------------------------------------------------------------------------------


def gamma_sql(s: str) -> str:
    d1 = f"(ln({s} / strike) + (r - q + 0.5 * iv * iv) * tte) / (iv * sqrt(tte))"
    return f"exp(-q * tte - 0.5 * ({d1}) ** 2) / sqrt(2 * pi()) / ({s} * iv * sqrt(tte)) * multiplier * open_interest * CASE option_type WHEN 'C' THEN -1 ELSE 1 END * {s} * {s} * 0.01e0"


GEX = CHAIN + f""", g AS (SELECT *, {gamma_sql('spot')} AS x FROM chain), e AS (SELECT underlying, strike, sum(x) AS gex, coalesce(sum(x) FILTER (WHERE option_type = 'C'), 0) AS call_gex, coalesce(sum(x) FILTER (WHERE option_type = 'P'), 0) AS put_gex, coalesce(sum(open_interest) FILTER (WHERE option_type = 'C'), 0) AS call_oi, coalesce(sum(open_interest) FILTER (WHERE option_type = 'P'), 0) AS put_oi FROM g GROUP BY 1, 2)"""


@query(f"WITH {GEX} SELECT underlying, {r('strike', 'gex', 'call_gex', 'put_gex', 'call_oi', 'put_oi')} FROM e")
def gamma_exposure(spark, d):
    return options.gamma_exposure(shapes.chain(spark, d))


@query(f"WITH {GEX} SELECT underlying, {r('arg_min(strike, (call_gex, strike)) AS call_wall', 'arg_max(strike, (put_gex, -strike)) AS put_wall')} FROM e GROUP BY underlying")
def option_walls(spark, d):
    return options.walls(shapes.chain(spark, d))


@query(f"""WITH {CHAIN}, p AS (SELECT *, spot * (0.85e0 + k * 0.015e0) AS level, k FROM chain, range(21) t(k)), g AS (SELECT underlying, k AS place, level, {gamma_sql('level')} AS x FROM p)
 SELECT underlying, CAST(place AS INTEGER) AS place, {r('any_value(level) AS level', 'sum(x) AS gex')} FROM g GROUP BY 1, 2""")
def gex_profile(spark, d):
    return options.gex_profile(shapes.chain(spark, d), 0.15, 21)


@query(f"""WITH {CHAIN}, p AS (SELECT *, spot * (0.8e0 + k * 0.01e0) AS level, k FROM chain, range(41) t(k)), g AS (SELECT underlying, k, any_value(level) AS level, sum({gamma_sql('level')}) AS gex FROM p GROUP BY 1, 2), e AS (SELECT *, lead(gex) OVER w AS g1, lead(level) OVER w AS l1 FROM g WINDOW w AS (PARTITION BY underlying ORDER BY k)),
 f AS (SELECT underlying, k, CASE WHEN gex = 0 THEN level WHEN gex * g1 < 0 THEN level - gex * (l1 - level) / (g1 - gex) END AS z FROM e) SELECT underlying, {r('arg_min(z, k) FILTER (WHERE z IS NOT NULL) AS zero_gamma')} FROM f GROUP BY 1""")
def zero_gamma(spark, d):
    return options.zero_gamma(shapes.chain(spark, d), 0.2, 41)


@query(f"""WITH {CHAIN}, l AS (SELECT DISTINCT underlying, strike AS level FROM chain) SELECT underlying, {r('level', "sum(CASE option_type WHEN 'C' THEN greatest(level - strike, 0) ELSE greatest(strike - level, 0) END * open_interest) AS pain")} FROM l JOIN chain USING (underlying) GROUP BY underlying, level""")
def max_pain_curve(spark, d):
    return options.max_pain_curve(shapes.chain(spark, d))


@query(f"""WITH {CHAIN}, l AS (SELECT DISTINCT underlying, strike AS level FROM chain), p AS (SELECT underlying, level, round(sum(CASE option_type WHEN 'C' THEN greatest(level - strike, 0) ELSE greatest(strike - level, 0) END * open_interest), 6) AS pain FROM l JOIN chain USING (underlying) GROUP BY underlying, level) SELECT underlying, {r('arg_min(level, (pain, level)) AS max_pain')} FROM p GROUP BY 1""")
def max_pain(spark, d):
    return options.max_pain(shapes.chain(spark, d))


@query()
def option_greeks(spark, d):
    return options.with_greeks(shapes.chain(spark, d))


@query()
def dealer_exposure(spark, d):
    return options.aggregate_exposure(shapes.chain(spark, d))


@query()
def implied_vol(spark, d):
    priced = options.with_greeks(shapes.chain(spark, d)).select("underlying", "strike", "option_type", "tte", "spot", "r", "q", "iv", "price")
    return options.with_implied_vol(priced, c("price"))


# Fundamentals -----------------------------------------------------------------------------------

SNAP = ISSUERS.format(", ".join(f"lag({f}) OVER w AS prev_{f}" for f in fu.FIELDS))


def over(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def av(x: str) -> str:
    return f"CASE WHEN prev_{x} IS NOT NULL THEN ({x} + prev_{x}) / 2 ELSE {x} END"


RATIOS = {
    "gross_margin": over("gross_profit", "revenue"), "operating_margin": over("operating_income", "revenue"), "net_margin": over("net_income", "revenue"), "ebitda_margin": over("ebitda", "revenue"),
    "return_on_assets": over("net_income", av("total_assets")), "return_on_equity": over("net_income", av("equity")), "return_on_invested_capital": over("ebit * (1 - tax_rate)", f"{av('equity')} + {av('total_debt')}"),
    "current_ratio": over("current_assets", "current_liabilities"), "quick_ratio": over("current_assets - inventory", "current_liabilities"), "cash_ratio": over("cash", "current_liabilities"), "debt_to_equity": over("total_debt", "equity"),
    "debt_to_assets": over("total_debt", "total_assets"), "net_debt_to_ebitda": over("total_debt - cash", "ebitda"), "interest_coverage": over("ebit", "interest_expense"), "asset_turnover": over("revenue", av("total_assets")),
    "inventory_turnover": over("cogs", av("inventory")), "receivables_turnover": over("revenue", av("receivables")), "eps": over("net_income", "shares"), "book_value_per_share": over("equity", "shares"), "fcf_per_share": over("operating_cash_flow + capex", "shares"),
}
RATIOS["return_on_invested_capital"] = f"ebit * (1 - tax_rate) / (({av('equity')}) + ({av('total_debt')}))"


@query(f"WITH {SNAP} SELECT ticker, period, {r(*(f'{v} AS {k}' for k, v in RATIOS.items()))} FROM prev")
def fundamental_ratios(spark, d):
    return fu.previous(shapes.snapshots(spark, d)).select("ticker", "period", *(v.alias(k) for k, v in fu.ratios("prev_").items()))


MULTIPLES = {"enterprise_value": "price * shares + total_debt - cash", "pe_ratio": "price * shares / net_income", "pb_ratio": "price * shares / equity", "ps_ratio": "price * shares / revenue", "ev_to_ebitda": "(price * shares + total_debt - cash) / ebitda", "ev_to_sales": "(price * shares + total_debt - cash) / revenue", "earnings_yield": "net_income / (price * shares)", "fcf_yield": "(operating_cash_flow + capex) / (price * shares)", "dividend_yield": "abs(dividends) / (price * shares)",
             "tax_burden": "net_income / (ebit - interest_expense)", "interest_burden": "(ebit - interest_expense) / ebit", "leverage": "total_assets / equity", "revenue_growth": "(revenue - prev_revenue) / abs(prev_revenue)", "dcf": " + ".join(f"(operating_cash_flow + capex) * 1.08e0 ** {i} / 1.1e0 ** {i}" for i in range(1, 6)) + " + (operating_cash_flow + capex) * 1.08e0 ** 5 * 1.02e0 / 0.08e0 / 1.1e0 ** 5"}


@query(f"WITH {SNAP} SELECT ticker, period, {r(*(f'{v} AS {k}' for k, v in MULTIPLES.items()))} FROM prev")
def valuation(spark, d):
    rows = fu.previous(shapes.snapshots(spark, d))
    extra = {k: v for k, v in fu.dupont().items() if k in ("tax_burden", "interest_burden", "leverage")}
    extra |= {"revenue_growth": fu.growth("revenue"), "dcf": fu.two_stage_dcf(fu.free_cash_flow(), 0.08, 5, 0.02, 0.1)}
    return rows.select("ticker", "period", *(v.alias(k) for k, v in (fu.multiples() | extra).items()))


def gm(p: str) -> str:
    return f"({p}gross_profit / {p}revenue)"


PIOTROSKI = {"f_roa": "net_income / total_assets > 0", "f_cfo": "operating_cash_flow > 0", "f_delta_roa": "net_income / total_assets > prev_net_income / prev_total_assets", "f_accruals": "operating_cash_flow > net_income", "f_leverage": "long_term_debt / total_assets < prev_long_term_debt / prev_total_assets", "f_liquidity": "current_assets / current_liabilities > prev_current_assets / prev_current_liabilities", "f_shares": "shares <= prev_shares", "f_margin": f"{gm('')} > {gm('prev_')}", "f_turnover": "revenue / total_assets > prev_revenue / prev_total_assets"}
Z = "1.2e0 * (current_assets - current_liabilities) / total_assets + 1.4e0 * retained_earnings / total_assets + 3.3e0 * ebit / total_assets + 0.6e0 * price * shares / total_liabilities + revenue / total_assets"
Z2 = "6.56e0 * (current_assets - current_liabilities) / total_assets + 3.26e0 * retained_earnings / total_assets + 6.72e0 * ebit / total_assets + 1.05e0 * equity / total_liabilities"


@query(f"""WITH {SNAP}, z AS (SELECT *, {Z} AS zs, {Z2} AS zt FROM prev) SELECT ticker, period, {', '.join(f'coalesce({v}, false) AS {k}' for k, v in PIOTROSKI.items())}, CAST({' + '.join(f'CAST(coalesce({v}, false) AS INTEGER)' for v in PIOTROSKI.values())} AS INTEGER) AS f_score,
 {r('zs AS z_score', 'zt AS z2_score')}, CASE WHEN zs > 2.99 THEN 'safe' WHEN zs > 1.81 THEN 'grey' ELSE 'distress' END AS z_zone, CASE WHEN zt > 2.6 THEN 'safe' WHEN zt > 1.1 THEN 'grey' ELSE 'distress' END AS z2_zone FROM z""")
def scores(spark, d):
    rows = fu.previous(shapes.snapshots(spark, d))
    return rows.select("ticker", "period", *(v.alias(k) for k, v in (fu.piotroski() | fu.altman_z()).items()))


def soft(p: str) -> str:
    return f"(1 - ({p}current_assets + {p}ppe) / {p}total_assets)"


def worn(p: str) -> str:
    return f"({p}depreciation / ({p}depreciation + {p}ppe))"


def owed(p: str) -> str:
    return f"(({p}current_liabilities + {p}long_term_debt) / {p}total_assets)"


MSCORE = {"dsri": "(receivables / revenue) / (prev_receivables / prev_revenue)", "gmi": f"{gm('prev_')} / {gm('')}", "aqi": f"{soft('')} / {soft('prev_')}", "sgi": "revenue / prev_revenue", "depi": f"{worn('prev_')} / {worn('')}", "sgai": "(sga / revenue) / (prev_sga / prev_revenue)", "lvgi": f"{owed('')} / {owed('prev_')}", "tata": "(net_income - operating_cash_flow) / total_assets"}


@query(f"""WITH {SNAP}, m AS (SELECT ticker, period, {', '.join(f'{v} AS {k}' for k, v in MSCORE.items())} FROM prev), s AS (SELECT *, -4.84e0 + 0.92e0 * dsri + 0.528e0 * gmi + 0.404e0 * aqi + 0.892e0 * sgi + 0.115e0 * depi - 0.172e0 * sgai - 0.327e0 * lvgi + 4.679e0 * tata AS ms FROM m)
 SELECT ticker, period, {r(*MSCORE, 'ms AS m_score')}, coalesce(ms > -1.78, false) AS manipulator FROM s""")
def beneish(spark, d):
    return fu.previous(shapes.snapshots(spark, d)).select("ticker", "period", *(v.alias(k) for k, v in fu.beneish_m().items()))


@query(f"""WITH {SNAP}, u AS (SELECT ticker, sum(net_income) / sum(revenue) AS margin, avg(revenue) AS size FROM prev GROUP BY 1), st AS (SELECT avg(margin) AS mm, stddev_samp(margin) AS ms, avg(size) AS sm, stddev_samp(size) AS ss FROM u), z AS (SELECT ticker, margin, size, (margin - mm) / ms AS zm, (size - sm) / ss AS zs, (rank() OVER (ORDER BY margin) + (count(*) OVER (PARTITION BY margin) - 1) / 2e0) / count(*) OVER () AS pr FROM u, st)
 SELECT ticker, {r('zm AS z_margin', 'zs AS z_size', 'pr AS pr_margin', '0.7e0 * zm - 0.3e0 * zs AS score')}, CAST(row_number() OVER (ORDER BY round(0.7e0 * zm - 0.3e0 * zs, 9) DESC, ticker) AS INTEGER) AS rank FROM z""")
def screening(spark, d):
    # sums that don't hang on the order of rows, so that equal issuers rank equally
    u = shapes.snapshots(spark, d, exact_sum).groupBy("ticker").agg((sorted_sum(c("net_income")) / sorted_sum(c("revenue"))).alias("margin"), (sorted_sum(c("revenue")) / F.count("revenue")).alias("size"))
    rows = fu.rank_universe(fu.percentile_rank(u, ["margin"]), {"margin": 0.7, "size": 0.3}, "ticker", ["size"])
    return rows.select("ticker", "z_margin", "z_size", "pr_margin", "score", "rank")
