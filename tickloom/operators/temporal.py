"""Calendars, corporate actions, point-in-time membership, as-of joins, coverage intervals, relative strength."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordering import in_order
from ..functions.windows import Series, ratio
from .indicators import BARS, rolling_slope

c = F.col
OPEN_END = "2200-01-01"


# Calendar ---------------------------------------------------------------------------------


def easter(year: int) -> date:
    """Easter Sunday of the Gregorian calendar."""
    golden, century = year % 19, year // 100
    moon = (19 * golden + century - century // 4 - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
    week = (32 + 2 * (century % 4) + 2 * (year % 100 // 4) - moon - year % 100 % 4) % 7
    late = (golden + 11 * moon + 22 * week) // 451
    month, day = divmod(moon + week - 7 * late + 114, 31)
    return date(year, month, day + 1)


def _weekday(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th such weekday of a month; n = -1: the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def nyse_holidays(year: int) -> tuple[set[date], set[date]]:
    """Closed days and half days of the New York Stock Exchange by its rules."""

    def observed(d: date, saturday: bool = True) -> date | None:
        if d.weekday() == 5:
            return d - timedelta(1) if saturday else None
        return d + timedelta(1) if d.weekday() == 6 else d

    thanks = _weekday(year, 11, 3, 4)
    closed = {observed(date(year, 1, 1), False), _weekday(year, 2, 0, 3), easter(year) - timedelta(2), _weekday(year, 5, 0, -1), observed(date(year, 7, 4)), _weekday(year, 9, 0, 1), thanks, observed(date(year, 12, 25))}
    closed |= {_weekday(year, 1, 0, 3)} if year >= 1998 else set()
    closed |= {observed(date(year, 6, 19))} if year >= 2022 else set()
    half = {d for d in (date(year, 7, 3), thanks + timedelta(1), date(year, 12, 24)) if d.weekday() < 5}
    closed.discard(None)
    return closed, half - closed


def nyse_sessions(spark: SparkSession, start: date, end: date, extra_closures: tuple[date, ...] = ()) -> DataFrame:
    """(session, open_utc, close_utc, half_day) from start to end, both in; 09:30 to 16:00 in New York, 13:00 on half days."""
    closed, half = set(extra_closures), set()
    for year in range(start.year, end.year + 1):
        more, early = nyse_holidays(year)
        closed |= more
        half |= early
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS session").filter("dayofweek(session) BETWEEN 2 AND 6")
    days = days.filter(~c("session").isin(*closed)) if closed else days
    days = days.withColumn("half_day", c("session").isin(*half) if half else F.lit(False))
    at = lambda hours: F.to_utc_timestamp(F.concat(c("session").cast("string"), hours), "America/New_York").cast("timestamp_ntz")
    return days.select("session", at(F.lit(" 09:30:00")).alias("open_utc"), at(F.when(c("half_day"), " 13:00:00").otherwise(" 16:00:00")).alias("close_utc"), "half_day")


def align(bars: DataFrame, sessions: DataFrame, mark: bool = False) -> DataFrame:
    """Rows inside a session (open <= ts < close), or all rows with ``in_session``. A session is within one UTC day."""
    day = sessions.select(F.to_date("open_utc").alias("_day"), "open_utc", "close_utc")
    rows = bars.withColumn("_day", F.to_date("ts")).join(day, "_day", "left")
    inside = F.coalesce((c("ts") >= c("open_utc")) & (c("ts") < c("close_utc")), F.lit(False))
    rows = rows.withColumn("in_session", inside).drop("_day", "open_utc", "close_utc")
    return rows if mark else rows.filter("in_session").drop("in_session")


# Corporate actions --------------------------------------------------------------------------


def apply_splits(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Prices divided and volumes multiplied by the ratios of all later splits."""
    splits = actions.filter((c("kind") == "split") & (c("ratio") > 0)).select("symbol", c("ts").alias("ex"), "ratio")
    # one running product over bars and splits together, latest first; bars come first on equal times
    both = bars.select("symbol", "ts", F.lit(0.0).alias("_ln")).unionByName(splits.select("symbol", c("ex").alias("ts"), F.ln("ratio").alias("_ln")))
    w = Window.partitionBy("symbol").orderBy(c("ts").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at = both.groupBy("symbol", "ts").agg(F.sum("_ln").alias("_ln")).withColumn("_factor", F.exp(F.sum("_ln").over(w) - c("_ln")))
    rows = bars.join(at.select("symbol", "ts", "_factor"), ["symbol", "ts"], "left")
    return rows.withColumns({**{x: c(x) / c("_factor") for x in ("open", "high", "low", "close")}, "volume": c("volume") * c("_factor")}).drop("_factor")


def back_adjust(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Prices and volumes adjusted for splits and cash dividends, from the latest action to the earliest.

    A dividend's factor is (C - cash) / C, C the last raw close before it under the later factors;
    it is left out where there is no such close or the result isn't positive. The actions of a
    symbol are few and fold in one array; bars meet the next one by time.
    """
    acts = actions.filter(c("kind").isin("split", "cash_div")).select("symbol", c("ts").alias("ex"), "kind", "ratio", "cash")
    before = asof_join(acts.distinct(), bars.select("symbol", c("ts").alias("ex"), c("close").alias("raw")), ["raw"], on="ex", strict=True)
    listed = before.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("ex", "kind", "ratio", "cash", "raw")), asc=False).alias("acts"))

    def step(state: Column, a: Column) -> Column:
        price = F.element_at(state, -1)["price"]
        volume = F.element_at(state, -1)["volume"]
        held = a["raw"] * price
        factor = F.when(a["kind"] == "split", ratio(F.lit(1.0), a["ratio"])).otherwise(F.when((held > 0) & (held > a["cash"]), (held - a["cash"]) / held).otherwise(1.0))
        new = F.struct(a["ex"].alias("ex"), (price * F.coalesce(factor, F.lit(1.0))).alias("price"), (volume * F.when(a["kind"] == "split", a["ratio"]).otherwise(1.0)).alias("volume"))
        return F.concat(state, F.array(new))

    start = F.array(F.struct(F.lit(None).cast("timestamp_ntz").alias("ex"), F.lit(1.0).alias("price"), F.lit(1.0).alias("volume")))
    folded = listed.select("symbol", F.posexplode(F.aggregate("acts", start, step)).alias("_i", "_f")).filter("_f.ex is not null")
    last = folded.groupBy("symbol", c("_f.ex").alias("ts")).agg(F.max_by("_f", "_i").alias("_f")).select("symbol", "ts", c("_f.price").alias("_p"), c("_f.volume").alias("_v"))
    rows = asof_join(bars, last, ["_p", "_v"], strict=True, forward=True)
    one = lambda x: F.coalesce(c(x), F.lit(1.0))
    return rows.withColumns({**{x: c(x) * one("_p") for x in ("open", "high", "low", "close")}, "volume": c("volume") * one("_v")}).drop("_p", "_v")


def total_return(bars: DataFrame, actions: DataFrame, base: float = 1.0, s: Series = BARS) -> DataFrame:
    """Log return with dividends paid on the very bar, and the index of them."""
    paid = actions.filter(c("kind") == "cash_div").groupBy("symbol", "ts").agg(F.sum("cash").alias("_cash"))
    rows = bars.join(paid, ["symbol", "ts"], "left").withColumn("total_return", F.coalesce(F.ln((c("close") + F.coalesce("_cash", F.lit(0.0))) / F.nullif(s.lag("close"), F.lit(0.0))), F.lit(0.0))).drop("_cash")
    return rows.withColumn("total_return_index", base * F.exp(s.running(F.sum("total_return"))))


# Membership and as-of ------------------------------------------------------------------------


def asof_universe(membership: DataFrame, index: str, asof: str) -> DataFrame:
    t = F.lit(asof).cast("timestamp_ntz")
    return membership.filter((c("index") == index) & (c("start") <= t) & (t < c("end"))).select("symbol").distinct()


def pit_join(features: DataFrame, membership: DataFrame, index: str) -> DataFrame:
    """Feature rows whose symbol was a member at the time; overlapping memberships repeat a row."""
    m = membership.filter(c("index") == index).select("symbol", c("start").alias("_start"), c("end").alias("_end"))
    return covering(features, m, ends=("_start", "_end")).drop("_start", "_end")


def survivorship(features: DataFrame, membership: DataFrame, index: str) -> DataFrame:
    """(n_members, n_missing, missing_ratio): members that no feature row has."""
    members = membership.filter(c("index") == index).select("symbol").distinct()
    have = features.select("symbol").distinct().withColumn("_have", F.lit(1))
    out = members.join(have, "symbol", "left").agg(F.count(F.lit(1)).alias("n_members"), F.count(F.when(c("_have").isNull(), 1)).alias("n_missing"))
    return out.withColumn("missing_ratio", ratio(c("n_missing").cast("double"), c("n_members")))


def covering(points: DataFrame, intervals: DataFrame, keys: tuple[str, ...] = ("symbol",), on: str = "ts", ends: tuple[str, str] = ("start", "end"), most: int = 10_000) -> DataFrame:
    """Each point with each interval [start, end) of its keys that covers it, one row a pair; a sweep, so that no point meets any other interval.

    Points and interval ends go together in the order of time; points without an interval's end between them are a run, of at
    most ``most`` points. The runs of a key are numbered; an interval covers the runs numbered between its start and its end, and meets the
    points by run. Rows are dealt by ranges of key and time, and runs end where a partition ends, so one key may hold any share of the
    rows. Pairs of run and interval are never more than rows of the result.

    Repeated points and intervals repeat rows. Points with a null key or time, and intervals that are empty, reversed or have a null in
    key, start or end, meet nothing. Names other than the keys' must differ between the sides.
    """
    keys, own = list(keys), [x for x in intervals.columns if x not in keys]
    if clash := set(points.columns) & set(own):
        raise ValueError(f"both sides have {sorted(clash)}")
    start, end = (c(x) for x in ends)
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    at = [c(k).alias(n) for k, n in names.items()]
    row, span = F.struct(*points.columns), F.struct(*own)
    p = points.dropna(subset=[*keys, on]).select(*at, c(on).alias("_t"), F.lit(1).alias("_point"), row.alias("_row"))
    i = intervals.dropna(subset=keys).filter(start < end).select(*at, F.explode(F.array(start, end)).alias("_t"), F.lit(0).alias("_point"), span.alias("_span"))
    by = list(names.values())
    rows = in_order(p.unionByName(i, allowMissingColumns=True), [*by, "_t", "_point"]).withColumn("_part", F.shiftright("_id", 33))
    w = Window.partitionBy(*by, "_part").orderBy("_id")
    fresh = (c("_point") == 1) & ((F.coalesce(F.lag("_point").over(w), F.lit(0)) == 0) | (F.row_number().over(w) % most == 0))
    rows = rows.withColumn("_new", fresh.cast("long")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by, "_part").agg(F.sum("_new").alias("_runs")).withColumn("_before", F.coalesce(F.sum("_runs").over(before), F.lit(0)))
    rows = rows.join(counts, [*by, "_part"]).withColumn("_run", c("_run") + c("_before"))
    spans = rows.filter("_point = 0").groupBy(*by, "_span").agg(F.min("_run").alias("_a"), F.max("_run").alias("_b"), (F.count(F.lit(1)) / 2).cast("int").alias("_copies"))
    spans = spans.filter("_a < _b").withColumn("_step", F.explode(F.sequence(c("_a"), c("_b") - 1, F.lit(65_536))))
    spans = spans.withColumn("_run", F.explode(F.sequence(c("_step") + 1, F.least(c("_step") + 65_536, "_b")))).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), c("_copies"))))
    met = rows.filter("_point = 1").select(*by, "_run", "_row").join(spans.select(*by, "_run", "_span"), [*by, "_run"])
    return met.select("_row.*", *(c("_span").getField(x).alias(x) for x in own))


def asof_join(left: DataFrame, right: DataFrame, values: list[str], keys: tuple[str, ...] = ("symbol",), on: str = "ts", strict: bool = False, forward: bool = False, within: str | None = None) -> DataFrame:
    """Left rows with the latest right values at or before their time: one union and one window,
    so each side moves once and no pairs are made.

    strict: before their time only. forward: the earliest at or after (strictly after) it instead. within: an interval such as
    "3 days"; values further away than that are null.
    """
    names = left.columns
    a = left.select(F.struct(*names).alias("_row"), *keys, on, F.lit(1).alias("_side"), *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values))
    b = right.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *keys, on, F.lit(0).alias("_side"), *values)
    side = c("_side").desc() if strict else c("_side").asc()
    w = Window.partitionBy(*keys).orderBy(c(on).desc() if forward else c(on).asc(), side).rowsBetween(Window.unboundedPreceding, 0)
    struct = F.last(F.when(c("_side") == 0, F.struct(*values, c(on).alias("_at"))), ignorenulls=True).over(w)
    if within is not None:
        far = F.expr(f"INTERVAL {within}")
        struct = F.when((c(on) <= struct["_at"] + far) & (struct["_at"] <= c(on) + far), struct)
    return a.unionByName(b).withColumn("_v", struct).filter("_side = 1").select("_row.*", *(c(f"_v.{v}").alias(v) for v in values))


def coverage(intervals: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Disjoint [start, end) of overlapping or touching intervals: islands by the running largest end. Of those that start together
    only the longest goes on, so that the order has no ties."""
    w = Window.partitionBy(*keys).orderBy("start")
    rows = intervals.groupBy(*keys, "start").agg(F.max("end").alias("end")).withColumn("_reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_new", F.when(c("_reach").isNull() | (c("start") > c("_reach")), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def missing(intervals: DataFrame, start: str, end: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The parts of [start, end) that a key's intervals leave open."""
    a, b = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    have = coverage(intervals, keys).filter((c("end") > a) & (c("start") < b))
    w = Window.partitionBy(*keys).orderBy("start")
    gaps = have.select(*keys, F.coalesce(F.lag("end").over(w), a).alias("gap_start"), c("start").alias("gap_end"))
    tail = have.groupBy(*keys).agg(F.max("end").alias("gap_start")).withColumn("gap_end", b)
    none = intervals.select(*keys).distinct().join(have.select(*keys).distinct(), list(keys), "left_anti").withColumns({"gap_start": a, "gap_end": b})
    return gaps.unionByName(tail).unionByName(none).filter("gap_start < gap_end")


def uncovered(asked: DataFrame, have: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, start, end): the parts of the asked [start, end) that no interval of ``have`` covers, disjoint and not touching.

    One sweep over both sides' ends: between two neighbouring ends a part is open if some asked interval and none that we
    have is on. Empty or reversed intervals count as nothing; null keys are a key of their own.
    """
    ends = lambda df, a, b: df.filter("start < end").select(*keys, F.explode(F.array(F.struct(c("start").alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b")), F.struct(c("end").alias("t"), F.lit(-a).alias("a"), F.lit(-b).alias("b")))).alias("e")).select(*keys, "e.*")
    moves = ends(asked, 1, 0).unionByName(ends(have, 0, 1)).groupBy(*keys, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(*keys).orderBy("t")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    parts = moves.select(*keys, c("t").alias("start"), F.lead("t").over(w).alias("end"), ((F.sum("a").over(so_far) > 0) & (F.sum("b").over(so_far) == 0)).alias("_open"))
    return coverage(parts.filter("_open"), keys)


def relative_strength(bars: DataFrame, benchmark: DataFrame, window: int = 20, s: Series = BARS) -> DataFrame:
    """Price over the benchmark's (ts, bench), relative to the first common bar, its slope and rank at each time."""
    rows = bars.select(*s.keys, "ts", "close").join(benchmark, "ts").withColumn("_q", ratio(c("close"), c("bench")))
    rows = rows.withColumn("rs", ratio(c("_q"), F.first("_q").over(s.so_far))).drop("_q")
    rows = rolling_slope(rows, "rs", window, "rs_slope", s)
    at = Window.partitionBy("ts", c("rs_slope").isNotNull())
    rank = F.row_number().over(at.orderBy("rs_slope", *s.keys)) / F.count(F.lit(1)).over(at)
    return rows.withColumn("rs_rank", F.when(c("rs_slope").isNotNull(), rank))
