"""Registered queries of entries by votes, exits by priority and defence by gamma."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import signals
from ..sources.tables import hourly_bars, ticks
from .extra import ATR, BOXES, ORDER, _boxes
from .queries import SO_FAR, SQL, frame, gamma_sql, query, r, smooth_sql
from .shapes import BARS, TICKS

c = F.col

#: Option chains of each symbol and day: ticks by strike; spot is the day's mean price.
CHAINS = TICKS + f""", t AS (SELECT symbol, CAST(ts AS DATE) AS day, price, seq, avg(price) OVER (PARTITION BY symbol, CAST(ts AS DATE)) AS spot FROM ticks),
 chain AS (SELECT {{'symbol': symbol, 'day': day}} AS underlying, round(price / 25) * 25 AS strike, CASE WHEN seq % 2 = 0 THEN 'C' ELSE 'P' END AS option_type, CAST(count(*) AS DOUBLE) AS open_interest,
 any_value(spot) AS spot, 0.6e0 AS iv, 0.1e0 AS tte, 0.03e0 AS r, 0.01e0 AS q, 100e0 AS multiplier FROM t WHERE round(price / 25) > 0 GROUP BY symbol, day, 2, 3)"""
#: Levels of a chain are known when its day is over.
LEVELS = CHAINS + f""", p AS (SELECT *, spot * (0.8e0 + k * 0.01e0) AS level, k FROM chain, range(41) t(k)), x AS (SELECT underlying, k, any_value(level) AS level, sum({gamma_sql('level')}) AS gex FROM p GROUP BY 1, 2),
 y AS (SELECT *, lead(gex) OVER w AS g1, lead(level) OVER w AS l1 FROM x WINDOW w AS (PARTITION BY underlying ORDER BY k)), zs AS (SELECT underlying, k, CASE WHEN gex = 0 THEN level WHEN gex * g1 < 0 THEN level - gex * (l1 - level) / (g1 - gex) END AS z FROM y),
 u AS (SELECT underlying, strike, coalesce(sum({gamma_sql('spot')}) FILTER (WHERE option_type = 'P'), 0) AS put_gex FROM chain GROUP BY 1, 2), wall AS (SELECT underlying, arg_max(strike, (put_gex, -strike)) AS put_wall FROM u GROUP BY 1),
 levels AS (SELECT underlying.symbol AS symbol, CAST(underlying.day + INTERVAL 1 DAY AS TIMESTAMP) AS since, arg_min(z, k) FILTER (WHERE z IS NOT NULL) AS zero_gamma, any_value(put_wall) AS put_wall FROM zs JOIN wall USING (underlying) GROUP BY underlying)"""
GEX_FLAGS = f"""WITH {LEVELS}, {BARS.removeprefix(TICKS + ', ')}, j AS (SELECT n.*, CASE WHEN since + INTERVAL 2 DAY >= ts THEN zero_gamma END AS zg, CASE WHEN since + INTERVAL 2 DAY >= ts THEN put_wall END AS pw FROM n ASOF LEFT JOIN levels ON n.symbol = levels.symbol AND n.ts >= since),
 k AS (SELECT *, coalesce(close < zg, false) AS expansion, coalesce(coalesce(close < lag(close) OVER w, true) AND abs(close - pw) <= 0.05e0 * greatest(close, 1e-9), false) AS near_put_wall FROM j {ORDER})
 SELECT symbol, ts, {r('zg AS zero_gamma', 'pw AS put_wall', 'CASE WHEN expansion THEN 0.5e0 ELSE 1 END AS size')}, expansion, near_put_wall FROM k"""


def _levels(spark, d):
    day = F.to_date("ts")
    rows = ticks(spark, d).select("symbol", day.alias("day"), "price", "seq", F.avg("price").over(Window.partitionBy("symbol", day)).alias("spot"))
    rows = rows.withColumns({"strike": F.round(c("price") / 25) * 25, "option_type": F.when(c("seq") % 2 == 0, "C").otherwise("P")}).filter("strike > 0")
    chain = rows.groupBy(F.struct("symbol", "day").alias("underlying"), "strike", "option_type").agg(F.count(F.lit(1)).cast("double").alias("open_interest"), F.first("spot").alias("spot"))
    chain = chain.withColumns({name: F.lit(v) for name, v in (("iv", 0.6), ("tte", 0.1), ("r", 0.03), ("q", 0.01), ("multiplier", 100.0))})
    return signals.gex_levels(chain, 0.2, 41).select("underlying.symbol", F.date_add("underlying.day", 1).cast("timestamp_ntz").alias("ts"), "zero_gamma", "put_wall")


def _defended(spark, d, bars):
    return signals.gex_defence(bars, _levels(spark, d), "2 days", 0.05)


@query(GEX_FLAGS)
def gex_defence(spark, d):
    """Dealers' gamma levels of the day before, on hourly bars, until they are two days old."""
    return _defended(spark, d, hourly_bars(spark, d)).select("symbol", "ts", "zero_gamma", "put_wall", "size", "expansion", "near_put_wall")


#: The ranges of ``range_events``, with the edges of the range before, so that they are known at the start.
PAST_BOXES = BOXES.replace("boxes AS (", "boxes AS (SELECT * FROM (SELECT symbol, range, start, stop, lag(support) OVER b AS support, lag(resistance) OVER b AS resistance FROM (") + " WINDOW b AS (PARTITION BY symbol ORDER BY range)) WHERE support IS NOT NULL)"


def _past_boxes(spark, d):
    w = Window.partitionBy("symbol").orderBy("range")
    return _boxes(spark, d).withColumns({x: F.lag(x).over(w) for x in ("support", "resistance")}).filter("support IS NOT NULL")


_VOTES = f"""{BARS}, {PAST_BOXES}, rng AS ({SQL['range_events'].replace(BOXES, PAST_BOXES)}), hull AS ({SQL['hull_ribbon']}), har AS ({SQL['harmony']}), shift AS ({SQL['shift_divergence']}), avgs AS ({SQL['layered_averages']}), rec AS ({SQL['recursive_averages']}), flow AS ({SQL['volume_flow']}), gex AS ({GEX_FLAGS}),
 seen AS (SELECT e.symbol, e.place + ago AS place, bool_or(kind IN ('Spring', 'SOS', 'LPS')) AS bull, bool_or(kind IN ('UT', 'SOW', 'LPSY')) AS bear FROM rng e JOIN boxes b ON e.symbol = b.symbol AND e.range = b.range, range(6) t(ago)
 WHERE kind NOT IN ('Spring', 'UT') OR EXISTS (SELECT 1 FROM n WHERE n.symbol = e.symbol AND n.rn - 1 > e.place AND n.rn - 1 <= e.place + ago AND CASE kind WHEN 'Spring' THEN n.close > b.support ELSE n.close < b.resistance END) GROUP BY 1, 2),
 tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, count(*) OVER before AS nb, count(*) OVER after AS na, max(high) OVER before AS hb, max(high) OVER after AS ha, min(low) OVER before AS lb, min(low) OVER after AS la FROM n
 WINDOW w AS (PARTITION BY symbol ORDER BY ts), before AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), after AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
 q AS (SELECT *, {smooth_sql('tr', 22, '(1e0 / 22)')} AS a22, CASE WHEN nb = 5 AND na = 5 AND low < lb AND low < la AND NOT (high > hb AND high > ha) THEN low END AS swing FROM tr WINDOW {SO_FAR}),
 cash AS (SELECT *, CASE WHEN rn >= 50 THEN close - avg(close) OVER f < -stddev_pop(close) OVER f ELSE false END AS weak FROM q WINDOW {frame('f', 50)}),
 k AS (SELECT q.*, coalesce(bull, false) AS w1, coalesce(bear, false) AS bear, coalesce(lag(shift_kind = 1, 5) OVER w, false) OR coalesce(bool_or(har.harmony = -1 AND trend_sign = -1) OVER back, false) AS w2, ribbon, slow - lag(slow) OVER w AS ds,
 coalesce(macd_hist > 0, false) OR coalesce(rsi >= 50 AND lag(rsi) OVER w < 50, false) AS vm, coalesce(CASE WHEN q.rn >= 20 THEN 20 * sum((q.rn - 1) * obv) OVER roll - sum(q.rn - 1) OVER roll * sum(obv) OVER roll > 0 END, false) OR coalesce(cmf > 0, false) AS vv,
 lag(swing, 5) OVER w AS known, CASE WHEN q.rn >= 22 THEN max(high) OVER top END - 3 * a22 AS trail, near_put_wall, coalesce(weak AND lag(weak) OVER w, false) AS cash
 FROM cash q LEFT JOIN seen ON seen.symbol = q.symbol AND seen.place = q.rn - 1 JOIN hull ON hull.symbol = q.symbol AND hull.ts = q.ts JOIN har ON har.symbol = q.symbol AND har.ts = q.ts JOIN shift ON shift.symbol = q.symbol AND shift.ts = q.ts
 JOIN avgs ON avgs.symbol = q.symbol AND avgs.ts = q.ts JOIN rec ON rec.symbol = q.symbol AND rec.ts = q.ts JOIN flow ON flow.symbol = q.symbol AND flow.ts = q.ts JOIN gex ON gex.symbol = q.symbol AND gex.ts = q.ts
 WINDOW w AS (PARTITION BY q.symbol ORDER BY q.ts), back AS (PARTITION BY q.symbol ORDER BY q.ts ROWS 5 PRECEDING), roll AS (PARTITION BY q.symbol ORDER BY q.ts ROWS 19 PRECEDING), top AS (PARTITION BY q.symbol ORDER BY q.ts ROWS 21 PRECEDING)),
 v AS (SELECT symbol, ts, rn, w1, w2, rn >= 120 AND coalesce(ribbon = 'above' AND ds > 0, false) AS h, vm, vv, bear, rn >= 120 AND coalesce(ds < 0 AND lag(ds) OVER w < 0, false) AS flip, coalesce(close < last_value(known IGNORE NULLS) OVER s, false) AS stop, coalesce(close < trail, false) AS chand, near_put_wall, cash FROM k {ORDER}, {SO_FAR}),
 z AS (SELECT *, w1::INT + w2::INT + h::INT + vm::INT + vv::INT AS confluences, CASE WHEN bear THEN 'wyckoff_bearish' WHEN flip THEN 'hull_flip' WHEN stop THEN 'swing_stop' WHEN chand THEN 'chandelier' WHEN near_put_wall THEN 'gex_defense' WHEN cash THEN 'regime_defense' ELSE 'none' END AS exit_reason FROM v),
 e AS (SELECT *, confluences >= 3 AND rn > 120 AS long_entry FROM z),
 walk AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS rn, false AS held FROM e UNION ALL SELECT e.symbol, e.rn, CASE WHEN held THEN exit_reason = 'none' ELSE long_entry AND NOT near_put_wall AND NOT cash END FROM walk JOIN e ON e.symbol = walk.symbol AND e.rn = walk.rn + 1)"""


@query(f"""WITH RECURSIVE {_VOTES} SELECT e.symbol, e.ts, w1 AS w1_wyckoff_event, w2 AS w2_effort_result, h AS h_hull, vm AS m_momentum, vv AS v_volume, confluences, long_entry, exit_reason, held AS long FROM e JOIN walk ON e.symbol = walk.symbol AND e.rn = walk.rn""")
def confluence_signals(spark, d):
    """Five votes and six exits on hourly bars. A close more than a standard deviation below its mean of 50 bars, twice in a row, stands in
    for the regime's defence."""
    s = I.BARS
    rows = signals.votes(hourly_bars(spark, d), _past_boxes(spark, d))
    rows = rows.withColumn("_weak", F.when(s.number >= 50, c("close") - F.avg("close").over(s.rows(50)) < -F.stddev_pop("close").over(s.rows(50))))
    rows = _defended(spark, d, rows.withColumn("cash_defence", signals.persistent(c("_weak"), 2, s)))
    return signals.decisions(rows).select("symbol", "ts", *signals.VOTES, "confluences", "long_entry", "exit_reason", "long")
