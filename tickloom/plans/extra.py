"""Further registered queries: state machines as recursive SQL, greeks, ranges, ribbons, valuation models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import econometrics, markov, micro, options, phases, portfolio, profile, structure, trend
from ..operators import fundamentals as fu
from ..operators import indicators as I
from ..sources.tables import hourly_bars, quotes
from . import shapes
from .more import PANELS, z_sql
from .queries import PANEL, RETS, SIGNS, SNAP, SO_FAR, SQL, TW, frame, query, r, smooth_sql, wma_sql
from .shapes import BARS, CHAIN

c = F.col
ORDER = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"

#: Wilder's average range of n, as a further step of a WITH clause over ``n``.
ATR = f"""trs AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM n {ORDER}), atrs AS (SELECT * EXCLUDE (tr), {smooth_sql('tr', 14, '(1e0 / 14)')} AS atr FROM trs WINDOW {SO_FAR})"""


# Queries that had no SQL ------------------------------------------------------------------------

SQL["preliminary_support"] = f"""WITH {BARS}, a AS (SELECT *, {z_sql('volume', 50)} AS vz, CASE WHEN rn >= 30 THEN regr_slope(close, CAST(rn AS DOUBLE)) OVER f END AS sl FROM n WINDOW {frame('z50', 50)}, {frame('f', 30)})
 SELECT symbol, ts, {r('open', 'high', 'low', 'close', 'volume', 'vz AS volume_z', 'sl AS trend_slope')}, coalesce(sl < 0 AND vz >= 1.5 AND close >= (high + low) / 2, false) AS preliminary_support FROM a"""

SQL["zigzag"] = f"""WITH RECURSIVE {BARS}, walk AS (SELECT symbol, rn, 0 AS leg, CAST(0 AS BIGINT) AS place, high AS top, low AS bot, CAST(NULL AS INTEGER) AS ek, CAST(NULL AS BIGINT) AS ep FROM n WHERE rn = 1
 UNION ALL SELECT symbol, rn, CASE WHEN up THEN 1 WHEN dn THEN -1 ELSE leg END, CASE WHEN up OR dn THEN rn - 1 ELSE place END, CASE WHEN up THEN high ELSE top END, CASE WHEN dn THEN low ELSE bot END, CASE WHEN up THEN -1 WHEN dn THEN 1 END, CASE WHEN up OR dn THEN place END FROM
 (SELECT *, leg >= 0 AND NOT up AND fall >= 0.1 AS dn FROM (SELECT *, leg <= 0 AND rise >= 0.1 AND (leg <> 0 OR rise >= fall) AS up FROM
 (SELECT *, CASE WHEN leg <= 0 AND bot > 0 THEN (high - bot) / bot ELSE 0 END AS rise, CASE WHEN leg >= 0 AND top > 0 THEN (top - low) / top ELSE 0 END AS fall FROM
 (SELECT n.symbol, n.rn, n.high, n.low, leg, CASE WHEN leg >= 0 AND n.high > top OR leg <= 0 AND n.low < bot THEN n.rn - 1 ELSE place END AS place, CASE WHEN leg >= 0 THEN greatest(top, n.high) ELSE top END AS top, CASE WHEN leg <= 0 THEN least(bot, n.low) ELSE bot END AS bot FROM walk JOIN n ON n.symbol = walk.symbol AND n.rn = walk.rn + 1)))))
 , found AS (SELECT symbol, ep AS place, ek AS kind FROM walk WHERE ek IS NOT NULL UNION ALL SELECT symbol, arg_max(place, rn), arg_max(leg, rn) FROM walk GROUP BY symbol HAVING arg_max(leg, rn) <> 0)
 SELECT n.symbol, n.ts, CAST(place AS INTEGER) AS place, {r('CASE kind WHEN 1 THEN high ELSE low END AS price', '1e0 AS strength')}, CAST(kind AS INTEGER) AS kind FROM found JOIN n ON n.symbol = found.symbol AND n.rn = place + 1"""

SQL["trading_ranges"] = f"""WITH {BARS}, {ATR}, q AS (SELECT *, rn >= 20 AND median(atr) OVER f > 0 AND max(high) OVER f - min(low) OVER f <= 6 * median(atr) OVER f AS ok FROM atrs WINDOW {frame('f', 20)}),
 m AS (SELECT *, coalesce(bool_or(ok) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING), false) AS inside FROM q), g AS (SELECT *, rn - row_number() OVER (PARTITION BY symbol, inside ORDER BY ts) AS island FROM m),
 e AS (SELECT symbol, island, min(low) AS support, max(high) AS resistance, row_number() OVER (PARTITION BY symbol ORDER BY min(rn)) - 1 AS range FROM g WHERE inside GROUP BY symbol, island HAVING count(*) >= 20 AND max(high) > min(low))
 SELECT g.symbol, ts, {r('open', 'high', 'low', 'close', 'volume', 'support', 'resistance')}, CAST(range AS BIGINT) AS range FROM g LEFT JOIN e ON e.symbol = g.symbol AND inside AND e.island = g.island"""


def cdf_sql(x: str) -> str:
    """The normal distribution function by its series."""
    return f"(0.5 + sign({x}) * exp(-0.5 * ({x}) ** 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 160), lambda k: CASE WHEN {x} = 0 THEN 0 ELSE exp((2 * k + 1) * ln(abs({x})) - ((k + 1) * ln(2) + lgamma(k + 1.5) - 0.5 * ln(pi()))) END)))"


GREEKS = CHAIN + f""", d AS (SELECT *, (ln(spot / strike) + (r - q + 0.5 * iv * iv) * tte) / (iv * sqrt(tte)) AS d1, (ln(spot / strike) + (r - q - 0.5 * iv * iv) * tte) / (iv * sqrt(tte)) AS d2, CASE option_type WHEN 'C' THEN 1 ELSE -1 END AS sg, exp(-q * tte) AS eq, exp(-r * tte) AS er, iv * sqrt(tte) AS sv FROM chain WHERE tte > 0),
 e AS (SELECT *, sg * d1 AS x1, sg * d2 AS x2, exp(-0.5 * d1 ** 2) / sqrt(2 * pi()) AS pdf FROM d), p AS (SELECT *, {cdf_sql('x1')} AS n1, {cdf_sql('x2')} AS n2 FROM e),
 g AS (SELECT *, sg * (spot * eq * n1 - strike * er * n2) AS price, sg * eq * n1 AS delta, eq * pdf / (spot * sv) AS gamma, spot * eq * pdf * sqrt(tte) AS vega, -spot * eq * pdf * iv / (2 * sqrt(tte)) - sg * r * strike * er * n2 + sg * q * spot * eq * n1 AS theta, sg * strike * tte * er * n2 AS rho,
 -eq * pdf * d2 / iv AS vanna, sg * q * eq * n1 - eq * pdf * (2 * (r - q) * tte - d2 * sv) / (2 * tte * sv) AS charm FROM p)"""
SQL["option_greeks"] = f"""WITH {GREEKS} SELECT underlying, option_type, {r('strike', 'open_interest', 'iv', 'tte', 'spot', 'r', 'q', 'multiplier', 'price', 'delta', 'gamma', 'vega', 'theta', 'rho', 'vanna', 'charm', 'vega * d1 * d2 / iv AS vomma', '-gamma / spot * (d1 / sv + 1) AS speed')} FROM g"""
SQL["dealer_exposure"] = f"""WITH {GREEKS}, k AS (SELECT *, multiplier * open_interest * CASE option_type WHEN 'C' THEN -1 ELSE 1 END AS w FROM g) SELECT underlying, {r('strike', 'sum(gamma * w * spot * spot * 0.01) AS gex', 'sum(delta * w * spot) AS dex', 'sum(vanna * w * spot * 0.01) AS vex', 'sum(charm * w * spot / 365.25) AS charm')} FROM k GROUP BY underlying, strike"""
SQL["vpin"] = f"""WITH {BARS}, d AS (SELECT *, close - lag(close) OVER w AS dc FROM n {ORDER}), s AS (SELECT *, dc / nullif(stddev_pop(dc) OVER p, 0) AS z, sum(volume) OVER p / 50 AS size, sum(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS hi FROM d WINDOW p AS (PARTITION BY symbol)),
 b AS (SELECT *, CASE WHEN dc IS NULL OR z IS NULL THEN 0.5 ELSE {cdf_sql('z')} END AS share, hi - volume AS lo FROM s WHERE volume > 0), k AS (SELECT symbol, g AS bucket, share, greatest(least(hi, (g + 1) * size) - greatest(lo, g * size), 0) AS part FROM b, range(50) t(g) WHERE g BETWEEN least(floor(lo / size), 49) AND least(floor(hi / size), 49)),
 a AS (SELECT symbol, CAST(bucket AS BIGINT) AS bucket, sum(part * share) AS buy, sum(part * (1 - share)) AS sell, row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS rn FROM k GROUP BY symbol, bucket)
 SELECT symbol, bucket, {r('buy', 'sell', 'CASE WHEN rn >= 10 THEN avg(abs(buy - sell) / nullif(buy + sell, 0)) OVER (PARTITION BY symbol ORDER BY bucket ROWS 9 PRECEDING) END AS vpin')} FROM a"""
SQL["hull_trend"] = f"""WITH {BARS}, a AS (SELECT *, 2 * ({wma_sql('close', 27, 'rn')}) - ({wma_sql('close', 55, 'rn')}) AS raw FROM n), h AS (SELECT *, {wma_sql('raw', 7, '(rn - 54)')} AS hull FROM a)
 SELECT symbol, ts, {r('hull')}, CAST(CASE WHEN hull > lag(hull, 2) OVER w THEN 1 WHEN hull < lag(hull, 2) OVER w THEN -1 ELSE 0 END AS INTEGER) AS signal FROM h {ORDER}"""


# Recursive indicators one by one ------------------------------------------------------------------


@query(f"""WITH {BARS}, a AS (SELECT *, {smooth_sql('close', 12, '(2e0 / 13)')} AS f, {smooth_sql('close', 26, '(2e0 / 27)')} AS sl, {smooth_sql('close', 14, '(2e0 / 15)')} AS e1, {smooth_sql('close', 20, '(2e0 / 21)')} AS kc_mid FROM n WINDOW {SO_FAR}), b AS (SELECT *, f - sl AS macd, coalesce(e1, 0) AS z1 FROM a),
 d AS (SELECT *, {smooth_sql('macd', 9, '(2e0 / 10)', 25)} AS macd_signal, {smooth_sql('z1', 14, '(2e0 / 15)')} AS e2 FROM b WINDOW {SO_FAR}), f AS (SELECT *, coalesce(e2, 0) AS z2 FROM d), g AS (SELECT *, {smooth_sql('z2', 14, '(2e0 / 15)')} AS e3 FROM f WINDOW {SO_FAR})
 SELECT symbol, ts, {r('CASE WHEN rn > 26 THEN 2 * e1 - e2 END AS dema', 'CASE WHEN rn > 39 THEN 3 * e1 - 3 * e2 + e3 END AS tema', 'macd', 'macd_signal', 'macd - macd_signal AS macd_hist', 'kc_mid')} FROM g""")
def layered_averages(spark, d):
    return I.recursive(hourly_bars(spark, d), 14).select("symbol", "ts", "dema", "tema", "macd", "macd_signal", "macd_hist", "kc_mid")


@query(f"""WITH RECURSIVE {BARS}, p AS (SELECT *, lag(high) OVER w AS h1, lag(high, 2) OVER w AS h2, lag(low) OVER w AS l1, lag(low, 2) OVER w AS l2 FROM n {ORDER}),
 walk AS (SELECT symbol, rn, high >= h1 AS up, CASE WHEN high >= h1 THEN l1 ELSE h1 END AS sar, CASE WHEN high >= h1 THEN high ELSE low END AS ep, 0.02e0 AS af FROM p WHERE rn = 2
 UNION ALL SELECT symbol, rn, CASE WHEN turn THEN NOT up ELSE up END, CASE WHEN turn THEN ep ELSE s1 END, CASE WHEN turn THEN CASE WHEN up THEN low ELSE high END WHEN up THEN greatest(ep, high) ELSE least(ep, low) END, CASE WHEN turn THEN 0.02e0 WHEN up AND high > ep OR NOT up AND low < ep THEN least(af + 0.02e0, 0.2e0) ELSE af END FROM
 (SELECT *, CASE WHEN up THEN low < s1 ELSE high > s1 END AS turn FROM (SELECT p.symbol, p.rn, p.high, p.low, up, ep, af, CASE WHEN up THEN least(sar + af * (ep - sar), l1, l2) ELSE greatest(sar + af * (ep - sar), h1, h2) END AS s1 FROM walk JOIN p ON p.symbol = walk.symbol AND p.rn = walk.rn + 1)))
 SELECT p.symbol, p.ts, {r('sar', 'CASE WHEN up THEN 1e0 ELSE -1 END AS sar_side')} FROM p JOIN walk ON p.symbol = walk.symbol AND greatest(p.rn, 2) = walk.rn""")
def parabolic_sar(spark, d):
    return I.recursive(hourly_bars(spark, d), 14).select("symbol", "ts", "sar", "sar_side")


@query(f"""WITH RECURSIVE {BARS}, trs AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, lag(close) OVER w AS c1 FROM n {ORDER}), a AS (SELECT *, (high + low) / 2 AS mid, 3 * {smooth_sql('tr', 10, '(1e0 / 10)')} AS wd FROM trs WINDOW {SO_FAR}),
 walk AS (SELECT symbol, rn, mid + wd AS up, mid - wd AS lo, 1 AS side FROM a WHERE rn = 10 UNION ALL SELECT symbol, rn, top, bot, CASE WHEN side = 1 AND close < bot THEN -1 WHEN side = -1 AND close > top THEN 1 ELSE side END FROM
 (SELECT a.symbol, a.rn, a.close, side, CASE WHEN mid + wd < up OR c1 > up THEN mid + wd ELSE up END AS top, CASE WHEN mid - wd > lo OR c1 < lo THEN mid - wd ELSE lo END AS bot FROM walk JOIN a ON a.symbol = walk.symbol AND a.rn = walk.rn + 1))
 SELECT n.symbol, n.ts, {r('CASE side WHEN 1 THEN lo WHEN -1 THEN up END AS supertrend', 'CAST(side AS DOUBLE) AS supertrend_side')} FROM n LEFT JOIN walk USING (symbol, rn)""")
def supertrend(spark, d):
    return I.recursive(hourly_bars(spark, d), 14).select("symbol", "ts", "supertrend", "supertrend_side")


@query(f"""WITH RECURSIVE {BARS}, a AS (SELECT *, abs(close - lag(close, 10) OVER w) AS way, abs(close - lag(close) OVER w) AS st FROM n {ORDER}), b AS (SELECT *, CASE WHEN rn > 10 THEN sum(st) OVER f END AS path FROM a WINDOW {frame('f', 10)}),
 walk AS (SELECT symbol, rn, close AS v FROM b WHERE rn = 11 UNION ALL SELECT b.symbol, b.rn, v + (coalesce(b.way / nullif(b.path, 0), 0) * (2e0 / 3 - 2e0 / 31) + 2e0 / 31) ** 2 * (b.close - v) FROM walk JOIN b ON b.symbol = walk.symbol AND b.rn = walk.rn + 1)
 SELECT n.symbol, n.ts, {r('v AS kama')} FROM n LEFT JOIN walk USING (symbol, rn)""")
def kama(spark, d):
    return I.recursive(hourly_bars(spark, d), 14).select("symbol", "ts", "kama")


# Ranges, divergences, phases ------------------------------------------------------------------------


@query(f"""WITH {BARS}, {ATR}, a AS (SELECT *, ln(volume + 1) AS e, coalesce(abs(close - open) / nullif(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), 0), 0) AS q, (lead(close, 5) OVER w - close) AS shift FROM atrs {ORDER}),
 b AS (SELECT *, {z_sql('e', 50)} AS ez, {z_sql('q', 50)} AS rz FROM a WINDOW {frame('z50', 50)}), x AS (SELECT *, shift / nullif(atr, 0) AS sa, coalesce(ez >= 1.5 AND rz <= -0.5, false) AS ab FROM b)
 SELECT symbol, ts, {r('shift', 'sa AS shift_atr')}, CAST(CASE WHEN ab AND sa >= 0.5 THEN 1 WHEN ab AND sa <= -0.5 THEN -1 ELSE 0 END AS INTEGER) AS shift_kind FROM x""")
def shift_divergence(spark, d):
    return phases.shift_divergence(hourly_bars(spark, d)).select("symbol", "ts", "shift", "shift_atr", "shift_kind")


@query(f"""WITH {BARS}, {ATR}, a AS (SELECT *, ln(volume + 1) AS e FROM atrs), b AS (SELECT *, {z_sql('e', 50)} AS vz, CASE WHEN rn >= 20 THEN regr_slope(close, CAST(rn AS DOUBLE)) OVER f END / nullif(atr, 0) AS sa FROM a WINDOW {frame('z50', 50)}, {frame('f', 20)}),
 x AS (SELECT *, CASE WHEN sa >= 0.05 THEN 1 WHEN sa <= -0.05 THEN -1 ELSE 0 END AS t FROM b)
 SELECT symbol, ts, {r('sa AS slope_atr')}, CAST(t AS INTEGER) AS trend_sign, CAST(CASE WHEN t <> 0 AND sign(close - open) = t THEN CASE WHEN vz >= 0.5 THEN 1 WHEN vz <= 0 THEN -1 ELSE 0 END ELSE 0 END AS INTEGER) AS harmony FROM x""")
def harmony(spark, d):
    return phases.harmony(hourly_bars(spark, d)).select("symbol", "ts", "slope_atr", "trend_sign", "harmony")


#: Ranges of 60 bars each, between the means of their lows and highs.
BOXES = "boxes AS (SELECT symbol, (rn - 1) // 60 AS range, min(rn - 1) AS start, max(rn) AS stop, avg(low) AS support, avg(high) AS resistance FROM n GROUP BY 1, 2)"


def _boxes(spark, d):
    rows = hourly_bars(spark, d).withColumn("place", I.BARS.number - 1).withColumn("range", F.floor(c("place") / 60))
    return rows.groupBy("symbol", "range").agg(F.min("place").alias("start"), (F.max("place") + 1).alias("stop"), F.avg("low").alias("support"), F.avg("high").alias("resistance"))


def last_sql(strong: str, last: str, beyond: str, gap: str) -> str:
    return f"""SELECT symbol, range, '{strong}' AS kind, place, close AS price FROM near WHERE place >= stop AND place < stop + 30 AND vz >= 1 AND gz >= 1 AND {beyond}
 UNION ALL SELECT symbol, range, '{last}', place, price FROM (SELECT b.symbol, b.range, s.place AS at0, min(b.place) FILTER (WHERE {gap} >= -1.5 * b.ref AND {gap} <= 1.5 * b.ref AND b.vz < s.vz) AS place, arg_min({'b.low' if strong == 'SOS' else 'b.high'}, b.place) FILTER (WHERE {gap} >= -1.5 * b.ref AND {gap} <= 1.5 * b.ref AND b.vz < s.vz) AS price,
 min(b.place) FILTER (WHERE {gap} < -1.5 * b.ref AND {gap.replace('b.low', 'b.close').replace('b.high', 'b.close')} < -1.5 * b.ref) AS lost FROM near b JOIN near s ON b.symbol = s.symbol AND b.range = s.range AND b.place > s.place AND b.place <= s.place + 30 WHERE s.place >= s.stop AND s.place < s.stop + 30 AND s.vz >= 1 AND s.gz >= 1 AND {beyond.replace('close', 's.close').replace('resistance', 's.resistance').replace('support', 's.support')} AND b.ref > 0 GROUP BY 1, 2, 3) WHERE place IS NOT NULL AND (lost IS NULL OR place < lost)"""


@query(f"""WITH {BARS}, {ATR}, {BOXES}, a AS (SELECT *, rn - 1 AS place, high - low AS rg, coalesce(atr, median(atr) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS ref, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS nx FROM atrs),
 b AS (SELECT *, {z_sql('volume', 50)} AS vz, {z_sql('rg', 50)} AS gz FROM a WINDOW {frame('z50', 50)}), near AS (SELECT b.*, range, start, stop, support, resistance FROM b JOIN boxes USING (symbol) WHERE place >= start AND place < stop + 61),
 ev AS (SELECT symbol, range, 'Spring' AS kind, place, low AS price FROM near WHERE place < stop AND ref > 0 AND support > low AND support - low <= 1.5 * ref AND len(list_filter(nx, lambda x: x > support)) > 0
 UNION ALL SELECT symbol, range, 'UT', place, high FROM near WHERE place < stop AND ref > 0 AND high > resistance AND high - resistance <= 1.5 * ref AND len(list_filter(nx, lambda x: x < resistance)) > 0
 UNION ALL {last_sql('SOS', 'LPS', 'close > resistance', '(b.low - b.resistance)')} UNION ALL {last_sql('SOW', 'LPSY', 'close < support', '(b.support - b.high)')})
 SELECT symbol, CAST(range AS BIGINT) AS range, kind, CAST(place AS INTEGER) AS place, {r('price')} FROM ev""")
def range_events(spark, d):
    return phases.range_events(hourly_bars(spark, d), _boxes(spark, d)).withColumn("place", c("place").cast("int"))


@query()
def wyckoff_phases(spark, d):
    b = hourly_bars(spark, d)
    boxes = _boxes(spark, d)
    return phases.phases(boxes, phases.events_of(b, boxes))


@query()
def secondary_tests(spark, d):
    return phases.secondary_tests(hourly_bars(spark, d))


@query()
def macro_phases(spark, d):
    return phases.defence(phases.macro_phases(hourly_bars(spark, d))).select("symbol", "ts", "macro_phase", "cash_defence")


# Strategies and features ------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {BARS}, a AS (SELECT *, 2 * ({wma_sql('close', 25, 'rn')}) - ({wma_sql('close', 50, 'rn')}) AS raw, coalesce(2 * {smooth_sql('close', 30, '(2e0 / 31)')} - {smooth_sql('close', 60, '(2e0 / 61)')}, 0) AS er FROM n WINDOW {SO_FAR}),
 h AS (SELECT *, {wma_sql('raw', 7, '(rn - 49)')} AS f, CASE WHEN rn > 65 THEN {smooth_sql('er', 7, '(2e0 / 8)')} END AS sl FROM a WINDOW {SO_FAR}), k AS (SELECT symbol, rn, ts, close, f, sl, CAST(sign(f - lag(f) OVER w) AS INTEGER) AS fs, CAST(sign(sl - lag(sl) OVER w) AS INTEGER) AS ss, CASE WHEN f IS NULL OR sl IS NULL THEN NULL WHEN close > greatest(f, sl) THEN 1 WHEN close < least(f, sl) THEN -1 ELSE 0 END AS pos FROM h {ORDER}),
 m AS (SELECT *, lag(pos) OVER w AS p0 FROM k {ORDER}), walk AS (SELECT symbol, rn, 0 AS held FROM m WHERE rn = 1 UNION ALL SELECT symbol, rn, CASE WHEN pos IS NULL THEN old WHEN kept = 0 AND pos <> 0 AND pos IS DISTINCT FROM p0 AND fs = pos AND ss = pos THEN pos ELSE kept END FROM
 (SELECT m.*, held AS old, CASE WHEN pos IS NOT NULL AND (held = 1 AND (close < least(f, sl) OR fs = -1) OR held = -1 AND (close > greatest(f, sl) OR fs = 1)) THEN 0 ELSE held END AS kept FROM walk JOIN m ON m.symbol = walk.symbol AND m.rn = walk.rn + 1))
 SELECT symbol, ts, {r('f AS fast', 'sl AS slow')}, CASE pos WHEN 1 THEN 'above' WHEN -1 THEN 'below' WHEN 0 THEN 'inside' END AS ribbon, CAST(CASE WHEN pos IS NULL THEN 0 ELSE held END AS INTEGER) AS signal FROM m JOIN walk USING (symbol, rn)""")
def hull_ribbon(spark, d):
    return trend.hull_ribbon(hourly_bars(spark, d)).select("symbol", "ts", "fast", "slow", "ribbon", "signal")


@query(f"""WITH {BARS}, a AS (SELECT *, 3 * ({wma_sql('close', 5, 'rn')}) - ({wma_sql('close', 8, 'rn')}) - ({wma_sql('close', 16, 'rn')}) AS raw FROM n), h AS (SELECT *, {wma_sql('raw', 16, '(rn - 15)')} AS thma FROM a) SELECT symbol, ts, {r('thma')} FROM h""")
def triple_hull(spark, d):
    return I.BARS.kernel(hourly_bars(spark, d), ["close"], {"thma": "double"}, lambda x: {"thma": trend.hull(x, 16, "thma")}).select("symbol", "ts", "thma")


@query(f"""WITH RECURSIVE {BARS}, {ATR}, e AS (SELECT *, {smooth_sql('close', 12, '(2e0 / 13)')} AS f, {smooth_sql('close', 26, '(2e0 / 27)')} AS sl FROM atrs WINDOW {SO_FAR}), k AS (SELECT *, coalesce(f > sl, false) AS up, coalesce(lag(f) OVER w > lag(sl) OVER w, false) AS up0 FROM e {ORDER}),
 walk AS (SELECT symbol, rn, false AS held, 0e0 AS top FROM k WHERE rn = 1 UNION ALL SELECT symbol, rn, CASE WHEN held THEN up AND close > t - 3 * atr ELSE rn > 27 AND up AND NOT up0 END, CASE WHEN held THEN t ELSE close END FROM
 (SELECT k.symbol, k.rn, k.close, k.up, k.up0, k.atr, held, greatest(top, k.close) AS t FROM walk JOIN k ON k.symbol = walk.symbol AND k.rn = walk.rn + 1))
 SELECT symbol, ts, {r('CASE WHEN held THEN 1e0 ELSE 0 END AS weight', 'CASE WHEN held THEN top - 3 * atr END AS trail_stop')} FROM k JOIN walk USING (symbol, rn)""")
def ema_cross_atr(spark, d):
    return trend.ema_cross_atr(hourly_bars(spark, d)).select("symbol", "ts", "weight", "trail_stop")


@query()
def long_calls(spark, d):
    return trend.long_calls(hourly_bars(spark, d)).select("symbol", "ts", "event", "strike", "expiry")


@query()
def garch_target(spark, d):
    return trend.garch_target(hourly_bars(spark, d)).select("symbol", "ts", "sigma", "trend", "weight")


@query(f"""WITH {BARS}, {ATR}, a AS (SELECT *, greatest(coalesce(close - lag(close) OVER w, 0), 0) AS gain, greatest(-coalesce(close - lag(close) OVER w, 0), 0) AS loss, CASE WHEN rn >= 50 THEN avg(close) OVER f / nullif(avg(close) OVER g, 0) END AS sr FROM atrs {ORDER}, {frame('f', 10)}, {frame('g', 50)}),
 b AS (SELECT *, {smooth_sql('gain', 14, '(1e0 / 14)', 1)} AS ag, {smooth_sql('loss', 14, '(1e0 / 14)', 1)} AS al FROM a WINDOW {SO_FAR}), x AS (SELECT *, sr - 1 AS p FROM b), y AS (SELECT *, CASE WHEN p IS NULL THEN NULL WHEN abs(p) < 0.01 THEN 0 WHEN abs(p) >= 0.05 THEN sign(p) END AS says FROM x)
 SELECT symbol, ts, {r('CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END AS rsi_14', 'sr AS sma_ratio_10_50', 'atr AS atr_14', 'CAST(coalesce(last_value(says IGNORE NULLS) OVER s, 0) AS DOUBLE) AS weight')} FROM y WINDOW {SO_FAR}""")
def model_features(spark, d):
    rows = trend.features(hourly_bars(spark, d)).withColumn("p", c("sma_ratio_10_50") - 1)
    return trend.threshold_policy(rows, "p", 0.05, 0.01).select("symbol", "ts", "rsi_14", "sma_ratio_10_50", "atr_14", "weight")


@query()
def screen_pairs(spark, d):
    return econometrics.screen_pairs(shapes.panel(spark, d).withColumn("x", F.ln("close")), "x", PANELS, all_pairs=True)


# Operators that no query showed -------------------------------------------------------------------


@query(f"""WITH {SIGNS} SELECT symbol, seq, {r('CASE WHEN row_number() OVER w >= 50 THEN sum(lr * size) OVER f / sum(size) OVER f END AS imbalance')} FROM sg {TW}, f AS (PARTITION BY symbol ORDER BY ts, seq ROWS 49 PRECEDING)""")
def trade_imbalance(spark, d):
    return micro.trade_imbalance(micro.trade_signs(quotes(spark, d)), "lee_ready", "size", 50).select("symbol", "seq", "imbalance")


@query(f"""WITH {RETS}, t AS (SELECT ts, power(2e0, -(row_number() OVER (ORDER BY ts DESC) - 1) / 60e0) AS w FROM (SELECT DISTINCT ts FROM rets WHERE ret IS NOT NULL)), p AS (SELECT a.symbol AS i, b.symbol AS j, count(*) AS n, sum(w) AS sw, sum(w * a.ret) AS x, sum(w * b.ret) AS y, sum(w * a.ret * b.ret) AS xy, sum(w * a.ret ** 2) AS xx, sum(w * b.ret ** 2) AS yy FROM rets a JOIN rets b USING (ts) JOIN t USING (ts) WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2)
 SELECT i, j, n, {r('xy / sw - x * y / sw ** 2 AS cov', '(xy / sw - x * y / sw ** 2) / sqrt((xx / sw - (x / sw) ** 2) * (yy / sw - (y / sw) ** 2)) AS corr')} FROM p""")
def weighted_covariance(spark, d):
    return portfolio.covariance(portfolio.returns(shapes.panel(spark, d)), halflife=60.0)


@query("""WITH o AS (SELECT p_brand, p_partkey, rpad(replace(upper(p_brand), '#', ''), 6, ' ') AS raw, DATE '2024-01-19' + CAST(7 * p_size AS INTEGER) AS expiry, CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS option_type, round(p_retailprice, 0) AS strike FROM part)
 SELECT p_partkey, regexp_replace(raw, '[0-9 ]+$', '') AS root, expiry, option_type, round(strike * 1000000e0) / 1000000e0 + 0 AS strike FROM o""")
def occ_symbols(spark, d):
    p = shapes.table(spark, d, "part")
    root = F.regexp_replace(F.upper("p_brand"), "[^A-Z]+", "")
    day = F.date_add(F.lit("2024-01-19").cast("date"), (7 * c("p_size")).cast("int"))
    symbol = F.concat(F.rpad(root, 6, " "), F.date_format(day, "yyMMdd"), F.when(c("p_partkey") % 2 == 0, "C").otherwise("P"), F.lpad((F.round("p_retailprice", 0) * 1000).cast("bigint").cast("string"), 8, "0"))
    return p.select("p_partkey", *(v.alias(k) for k, v in options.parse_occ(symbol).items()))


@query(f"""WITH {BARS}, a AS (SELECT *, (2 * CASE WHEN high = low THEN 0.5 ELSE (close - low) / (high - low) END - 1) * volume AS delta FROM n) SELECT symbol, ts, {r('delta', 'sum(delta) OVER s AS cum_delta')} FROM a WINDOW {SO_FAR}""")
def running_delta(spark, d):
    rows = profile.bar_delta(hourly_bars(spark, d))
    return rows.withColumn("cum_delta", I.BARS.running(F.sum("delta"))).select("symbol", "ts", "delta", "cum_delta")


@query(f"""WITH {PANEL}, l AS (SELECT symbol, ln(close) AS x, lag(ln(close)) OVER (PARTITION BY symbol ORDER BY ts) AS x0 FROM panel), f AS (SELECT symbol, regr_slope(x - x0, x0) AS b FROM l WHERE x0 IS NOT NULL GROUP BY symbol) SELECT symbol, {r("CASE WHEN b < 0 THEN -ln(2) / b ELSE CAST('inf' AS DOUBLE) END AS half_life")} FROM f""")
def half_life(spark, d):
    return markov.half_life(shapes.panel(spark, d).withColumn("x", F.ln("close")), "x", PANELS)


MODELS = {"sustainable_growth": "net_income / equity * (1 - abs(dividends) / net_income)", "revenue_cagr": "CASE WHEN revenue / prev_revenue > 0 THEN power(revenue / prev_revenue, 0.5e0) - 1 END", "wacc": "price * shares / (price * shares + total_debt) * 0.09e0 + total_debt / (price * shares + total_debt) * 0.05e0 * (1 - 0.21e0)", "gordon": "abs(dividends) / shares * 1.03e0 / (0.09e0 - 0.03e0)"}


@query(f"WITH {SNAP} SELECT ticker, period, {r(*(f'{v} AS {k}' for k, v in MODELS.items()))} FROM prev")
def valuation_models(spark, d):
    rows = fu.previous(shapes.snapshots(spark, d))
    value = c("price") * c("shares")
    made = {"sustainable_growth": fu.sustainable_growth(c("net_income") / c("equity"), F.abs("dividends") / c("net_income")), "revenue_cagr": fu.cagr(c("prev_revenue"), c("revenue"), F.lit(2)), "wacc": fu.wacc(value, c("total_debt"), 0.09, 0.05, 0.21), "gordon": fu.gordon_growth(F.abs("dividends") / c("shares") * 1.03, 0.09, 0.03)}
    return rows.select("ticker", "period", *(v.alias(k) for k, v in made.items()))


@query()
def automatic_rallies(spark, d):
    return structure.automatic_rally(hourly_bars(spark, d))
