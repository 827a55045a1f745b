"""Wyckoff events around given ranges, divergences, secondary tests, phases, and phases by a hidden Markov model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hmm
from ..functions import kernels as k
from ..functions.ordering import cut_lineage
from ..functions.windows import Series, ratio
from .indicators import BARS, rolling_slope, rolling_zscore, true_range
from .structure import automatic_rally, climaxes, effort_vs_result
from .temporal import covering

c = F.col


def with_atr(bars: DataFrame, window: int = 14, s: Series = BARS) -> DataFrame:
    return s.kernel(bars, ["high", "low", "close"], {"atr": "double"}, lambda h, lo, x: {"atr": k.atr(h, lo, x, window)})


def shift_divergence(bars: DataFrame, ahead: int = 5, least: float = 0.5, opposing: bool = False, s: Series = BARS) -> DataFrame:
    """Adds shift (the close ``ahead`` bars later less this one), shift_atr and shift_kind: 1 or -1 where an absorption bar is
    followed by a shift of ``least`` ranges up or down; opposing: only against its own body."""
    rows = effort_vs_result(with_atr(bars, s=s), s=s).withColumn("shift", s.lead("close", ahead) - c("close"))
    rows = rows.withColumn("shift_atr", c("shift") / F.when(c("atr") > 0, c("atr")))
    up, down = c("shift_atr") >= least, c("shift_atr") <= -least
    if opposing:
        up, down = up & (c("close") <= c("open")), down & (c("close") >= c("open"))
    return rows.withColumn("shift_kind", F.when(c("absorption") & up, 1).when(c("absorption") & down, -1).otherwise(0))


def harmony(bars: DataFrame, trend: int = 20, window: int = 50, steep: float = 0.05, heavy: float = 0.5, light: float = 0.0, s: Series = BARS) -> DataFrame:
    """Adds slope_atr, trend_sign and harmony: 1 where a bar moves with the trend on heavy volume, -1 on light volume."""
    rows = with_atr(bars, s=s).withColumn("_lv", F.ln(c("volume") + 1))
    rows = rolling_slope(rolling_zscore(rows, "_lv", window, "volume_z", s), "close", trend, "_slope", s)
    rows = rows.withColumn("slope_atr", c("_slope") / F.when(c("atr") > 0, c("atr")))
    rows = rows.withColumn("trend_sign", F.when(c("slope_atr") >= steep, 1).when(c("slope_atr") <= -steep, -1).otherwise(0))
    along = (c("trend_sign") != 0) & (F.signum(c("close") - c("open")) == c("trend_sign"))
    return rows.withColumn("harmony", F.when(along & (c("volume_z") >= heavy), 1).when(along & (c("volume_z") <= light), -1).otherwise(0)).drop("_lv", "_slope")


def range_events(bars: DataFrame, ranges: DataFrame, reach: float = 1.5, recovery: int = 5, volume_z: float = 1.0, range_z: float = 1.0, ahead: int = 30, s: Series = BARS) -> DataFrame:
    """Rows (keys, range, kind, place, price) of the events of given ranges (keys, range, start, stop, support, resistance; places from 0).

    Spring and UT lie inside the range: a low (high) beyond its edge by ``reach`` ranges at most, with a close back inside on one of the
    next ``recovery`` bars. SOS and SOW are wide, heavy bars that close beyond the edge within ``ahead`` bars after it. LPS and LPSY are,
    for each of them, the first bar within ``ahead`` that tests the edge to ``reach`` ranges on less volume, unless a close falls back first.
    """
    rows = rolling_zscore(bars.withColumn("_rg", c("high") - c("low")), "volume", 50, "volume_z", s)
    rows = with_atr(rolling_zscore(rows, "_rg", 50, "range_z", s), s=s)
    # before the average range is there, the median of those so far stands in
    before = F.when(c("atr").isNull(), F.expr("percentile(atr, 0.5)").over(s.so_far))
    next_closes = F.collect_list("close").over(s.window.rowsBetween(1, recovery))
    rows = rows.withColumns({"place": s.number - 1, "_ref": F.coalesce("atr", before), "_next": next_closes})
    rows = rows.select(*s.keys, "place", "high", "low", "close", "volume_z", "range_z", "_ref", "_next")
    reached = ranges.withColumns({"_from": c("start"), "_to": c("stop") + 2 * ahead + 1})
    near = cut_lineage(covering(rows, reached, s.keys, "place", ("_from", "_to")).drop("_from", "_to"))
    inside = near.filter((c("place") < c("stop")) & (c("_ref") > 0))
    below, above = c("support") - c("low"), c("high") - c("resistance")
    back = lambda test: F.exists("_next", test)
    spring = (below > 0) & (below <= reach * c("_ref")) & back(lambda x: x > c("support"))
    thrust = (above > 0) & (above <= reach * c("_ref")) & back(lambda x: x < c("resistance"))
    out = inside.filter(spring).select(*s.keys, "range", F.lit("Spring").alias("kind"), "place", c("low").alias("price"))
    out = out.unionByName(inside.filter(thrust).select(*s.keys, "range", F.lit("UT").alias("kind"), "place", c("high").alias("price")))
    wide = (c("place") >= c("stop")) & (c("place") < c("stop") + ahead) & (c("volume_z") >= volume_z) & (c("range_z") >= range_z)
    for sign, strong, last, edge, extreme, beyond in ((1, "SOS", "LPS", "resistance", "low", c("close") > c("resistance")), (-1, "SOW", "LPSY", "support", "high", c("close") < c("support"))):
        first = near.filter(wide & beyond)
        out = out.unionByName(first.select(*s.keys, "range", F.lit(strong).alias("kind"), "place", c("close").alias("price")))
        signs = first.select(*s.keys, "range", c("place").alias("_at"), c("volume_z").alias("_vz"), (c("place") + 1).alias("_from"), (c("place") + ahead + 1).alias("_to"))
        later = covering(near.filter("_ref > 0"), signs, (*s.keys, "range"), "place", ("_from", "_to")).drop("_from", "_to")
        holds = sign * (c(extreme) - c(edge)) >= -reach * c("_ref")
        hit = holds & (sign * (c(extreme) - c(edge)) <= reach * c("_ref")) & (c("volume_z") < c("_vz"))
        lost = ~holds & (sign * (c("close") - c(edge)) < -reach * c("_ref"))
        found = later.groupBy(*s.keys, "range", "_at").agg(F.min(F.when(hit, F.struct("place", c(extreme).alias("price")))).alias("h"), F.min(F.when(lost, c("place"))).alias("l"))
        out = out.unionByName(found.filter(c("h").isNotNull() & (c("l").isNull() | (c("h.place") < c("l")))).select(*s.keys, "range", F.lit(last).alias("kind"), "h.place", "h.price"))
    return out


def secondary_tests(bars: DataFrame, tolerance: float = 1.0, most: int = 60, s: Series = BARS) -> DataFrame:
    """(keys, climax_place, kind, place, price): after a climax and its automatic rally the first bar, within ``most``, whose extreme comes
    back to the climax's to ``tolerance`` ranges on less volume."""
    rows = with_atr(bars, s=s).withColumns({"place": s.number, "_median": F.expr("percentile(atr, 0.5)").over(Window.partitionBy(*s.keys))})
    rallies = automatic_rally(bars, s=s).select(*s.keys, "climax_place", "kind", c("place").alias("_rally"))
    extreme = F.when(c("kind") == "SC", c("low")).otherwise(c("high"))
    at = rallies.join(rows.withColumnRenamed("place", "climax_place"), [*s.keys, "climax_place"])
    at = at.select(*s.keys, "climax_place", "kind", "_rally", extreme.alias("_edge"), c("volume").alias("_cv"), (tolerance * F.coalesce("atr", "_median")).alias("_tol"))
    near = rows.join(at, list(s.keys)).filter((c("place") > c("_rally")) & (c("place") <= c("_rally") + most) & (c("_tol") > 0) & (c("volume") < c("_cv")))
    gap = F.when(c("kind") == "SC", c("low") - c("_edge")).otherwise(c("_edge") - c("high"))
    hits = near.filter((gap >= -c("_tol")) & (gap < c("_tol")))
    return hits.groupBy(*s.keys, "climax_place", "kind").agg(F.min(F.struct("place", extreme.alias("price"))).alias("_m")).select(*s.keys, "climax_place", "kind", "_m.*")


def phases(ranges: DataFrame, events: DataFrame, s: Series = BARS) -> DataFrame:
    """(keys, range, schematic, phase, start, stop): phases A to D of ranges (keys, range, start, stop) from events (keys, kind, place).

    The first climax in a range says accumulation (SC) or distribution (BC). A ends with the first ST, else AR; C is the last Spring (UT);
    B lies between; D goes from the first SOS (SOW) after the range to the last LPS (LPSY), else the last SOS (SOW). Places count from 0, stops
    are not part of a phase. A range without climax, or without ST and AR, has none.
    """
    e = ranges.join(events.select(*s.keys, "kind", "place"), list(s.keys))
    inside, after = (c("place") >= c("start")) & (c("place") < c("stop")), c("place") >= c("stop")
    at = lambda f, when, *kinds: f(F.when(when & c("kind").isin(*kinds), c("place")))
    out = e.groupBy(*s.keys, "range", "start", "stop").agg(
        F.min(F.when(inside & c("kind").isin("SC", "BC"), F.struct("place", "kind"))).alias("_c"), at(F.min, inside, "ST").alias("_st"), at(F.min, inside, "AR").alias("_ar"),
        *(at(f, inside, kind).alias(f"_{kind}") for f, kind in ((F.max, "Spring"), (F.max, "UT"))),
        *(at(f, after, kind).alias(f"_{name}_{kind}") for kind in ("SOS", "SOW", "LPS", "LPSY") for f, name in ((F.min, "first"), (F.max, "last"))),
    )
    up = c("_c.kind") == "SC"
    pick = lambda a, b: F.when(up, c(a)).otherwise(c(b))
    out = out.withColumns({"_a": F.coalesce("_st", "_ar") + 1, "_t": pick("_Spring", "_UT"), "_d": pick("_first_SOS", "_first_SOW"), "_e": F.coalesce(pick("_last_LPS", "_last_LPSY"), pick("_last_SOS", "_last_SOW")) + 1})
    out = out.filter(c("_c").isNotNull() & c("_a").isNotNull())
    parts = [("A", c("start"), c("_a")), ("B", c("_a"), F.coalesce("_t", "stop")), ("C", c("_t"), c("_t") + 1), ("D", c("_d"), c("_e"))]
    listed = F.array(*(F.struct(F.lit(n).alias("phase"), a.cast("bigint").alias("start"), b.cast("bigint").alias("stop")) for n, a, b in parts))
    out = out.select(*s.keys, "range", F.when(up, "Acc").otherwise("Dist").alias("schematic"), F.explode(listed).alias("p"))
    return out.select(*s.keys, "range", "schematic", "p.*").filter("start < stop")


def events_of(bars: DataFrame, ranges: DataFrame, s: Series = BARS) -> DataFrame:
    """(keys, kind, place) of all events that ``phases`` reads; places from 0."""
    peaks = climaxes(bars, s=s).withColumn("place", s.number - 1).filter("climax is not null").select(*s.keys, c("climax").alias("kind"), "place")
    rally = automatic_rally(bars, s=s).select(*s.keys, F.lit("AR").alias("kind"), (c("place") - 1).alias("place"))
    tests = secondary_tests(bars, s=s).select(*s.keys, F.lit("ST").alias("kind"), (c("place") - 1).alias("place"))
    return peaks.unionByName(rally).unionByName(tests).unionByName(range_events(bars, ranges, s=s).select(*s.keys, "kind", "place"))


def macro_phases(bars: DataFrame, window: int = 50, restarts: int = 5, steps: int = 200, s: Series = BARS) -> DataFrame:
    """Adds macro_phase: states of a Gaussian model of log return and the z-scores of log volume and true range. The state with the largest
    mean return is Markup, with the smallest Markdown; of the others the one with more volume is Accumulation."""
    rows = bars.withColumns({"_r": F.coalesce(F.ln(ratio(c("close"), s.lag("close"))), F.lit(0.0)), "_lv": F.ln(c("volume") + 1), "_tr": F.coalesce(true_range(s), c("high") - c("low"))})
    rows = rolling_zscore(rolling_zscore(rows, "_lv", window, "_vz", s), "_tr", window, "_tz", s)

    def run(r, v, t):
        x = np.column_stack([r, np.nan_to_num(v), np.nan_to_num(t)])
        m = hmm.fit_gaussian(x, 4, restarts=restarts, steps=steps)
        means = m["means"]
        high, low = int(means[:, 0].argmax()), int(means[:, 0].argmin())
        rest = sorted({0, 1, 2, 3} - {high, low}, key=lambda i: means[i, 1])
        names = np.zeros(4)
        names[high], names[low], names[rest[-1]], names[rest[0]] = 0, 1, 2, 3
        emit = hmm.gaussian_emissions(x, means, m["covs"])
        return {"_state": names[hmm.viterbi(emit, hmm._logs(m["step"]), hmm._logs(m["start"]))]}

    rows = s.kernel(rows, ["_r", "_vz", "_tz"], {"_state": "bigint"}, run)
    name = F.element_at(F.array(*map(F.lit, ("Markup", "Markdown", "Accumulation", "Distribution"))), (c("_state") + 1).cast("int"))
    return rows.withColumn("macro_phase", name).drop("_r", "_lv", "_tr", "_vz", "_tz", "_state")


def defence(rows: DataFrame, bars_held: int = 2, s: Series = BARS) -> DataFrame:
    """Adds cash_defence: Markdown or Distribution for ``bars_held`` bars in a row."""
    bear = c("macro_phase").isin("Markdown", "Distribution").cast("int")
    return rows.withColumn("cash_defence", F.coalesce(s.rolling(F.min(bear), bars_held) == 1, F.lit(False)))
