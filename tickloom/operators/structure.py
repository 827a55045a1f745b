"""Structural price events: effort and result, climaxes, springs, ranges, swings, point and figure."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.windows import Series, ratio
from .indicators import BARS, rolling_slope, rolling_zscore, true_range

c = F.col


def validate(bars: DataFrame, s: Series = BARS) -> DataFrame:
    """(keys, n, bad_range, bad_order, bad_volume): how many bars break an invariant."""
    wrong = (c("high") < F.greatest("open", "close")) | (c("low") > F.least("open", "close")) | c("close").isNull() | F.isnan("close")
    rows = bars.withColumn("_before", s.lag("ts"))
    n = lambda x: F.count(F.when(x, 1))
    return rows.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n"), n(wrong).alias("bad_range"), n(c("_before") >= c("ts")).alias("bad_order"), n(c("volume") < 0).alias("bad_volume"))


def effort_vs_result(bars: DataFrame, window: int = 50, effort_z: float = 1.5, result_z: float = -0.5, s: Series = BARS) -> DataFrame:
    """z of log volume, z of body over true range, their difference, and absorption where effort is large and result small."""
    rows = bars.withColumns({"_e": F.ln(c("volume") + 1), "_r": F.coalesce(ratio(F.abs(c("close") - c("open")), true_range(s)), F.lit(0.0))})
    rows = rolling_zscore(rolling_zscore(rows, "_e", window, "effort_z", s), "_r", window, "result_z", s)
    rows = rows.withColumn("divergence", c("effort_z") - c("result_z"))
    return rows.withColumn("absorption", F.coalesce((c("effort_z") >= effort_z) & (c("result_z") <= result_z), F.lit(False))).drop("_e", "_r")


def climaxes(bars: DataFrame, z_volume: float = 2.5, z_range: float = 2.0, trend: int = 20, position: float = 1 / 3, window: int = 50, s: Series = BARS) -> DataFrame:
    """Adds climax: SC after a fall with a close off the low, BC after a rise with a close off the high."""
    rows = bars.withColumn("_rg", c("high") - c("low"))
    rows = rolling_zscore(rolling_zscore(rows, "volume", window, "volume_z", s), "_rg", window, "range_z", s)
    rows = rolling_slope(rows, "close", trend, "trend_slope", s)
    at = F.coalesce(ratio(c("close") - c("low"), c("_rg")), F.lit(0.5))
    big = (c("volume_z") >= z_volume) & (c("range_z") >= z_range)
    return rows.withColumn("climax", F.when(big & (c("trend_slope") < 0) & (at >= position), "SC").when(big & (c("trend_slope") > 0) & (at <= 1 - position), "BC")).drop("_rg")


def preliminary_support(bars: DataFrame, trend: int = 30, least: float = 1.5, window: int = 50, s: Series = BARS) -> DataFrame:
    rows = rolling_slope(rolling_zscore(bars, "volume", window, "volume_z", s), "close", trend, "trend_slope", s)
    upper = c("close") >= (c("high") + c("low")) / 2
    return rows.withColumn("preliminary_support", F.coalesce((c("trend_slope") < 0) & (c("volume_z") >= least) & upper, F.lit(False)))


def _ranges(high, low, atr, least: int, width: float) -> list[tuple[int, int]]:
    inside = np.zeros(len(high), bool)
    for i in range(least - 1, len(high)):
        a = atr[i - least + 1 : i + 1]
        if not np.isnan(a).all() and 0 < np.nanmedian(a) and high[i - least + 1 : i + 1].max() - low[i - least + 1 : i + 1].min() <= width * np.nanmedian(a):
            inside[i - least + 1 : i + 1] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return [(a, b) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= least and high[a:b].max() > low[a:b].min()]


def trading_ranges(bars: DataFrame, least: int = 20, width: float = 6.0, window: int = 14, s: Series = BARS) -> DataFrame:
    """Adds range (number), support and resistance: runs of ``least`` bars or more, every window of ``least`` of which is no wider
    than ``width`` median ranges. ``phases.range_events`` has the events in and after a range."""
    names = {"range": "bigint", "support": "double", "resistance": "double"}

    def run(high, low, close):
        out = {name: np.full(len(close), np.nan) for name in names}
        for number, (a, b) in enumerate(_ranges(high, low, k.atr(high, low, close, window), least, width)):
            out["range"][a:b], out["support"][a:b], out["resistance"][a:b] = number, low[a:b].min(), high[a:b].max()
        return out

    return s.kernel(bars, ["high", "low", "close"], names, run)


def zigzag(bars: DataFrame, share: float = 0.03, s: Series = BARS) -> DataFrame:
    """Rows of swings: keys, ts, place, price, kind, strength 1."""

    def run(high, low):
        # one bar can be both a low and the next high
        out = {1: np.full(len(high), np.nan), -1: np.full(len(high), np.nan)}
        for place, value, sign in k.zigzag(high, low, share):
            out[sign][place] = value
        return {"_top": out[1], "_bottom": out[-1]}

    rows = s.kernel(bars.withColumn("place", (s.number - 1).cast("int")), ["high", "low"], {"_top": "double", "_bottom": "double"}, run)
    both = F.explode(F.array(*(F.struct(c(name).alias("price"), F.lit(sign).alias("kind")) for name, sign in (("_bottom", -1), ("_top", 1)))))
    return rows.select(*s.keys, *s.order, "place", both.alias("_s")).select(*s.keys, *s.order, "place", "_s.*", F.lit(1.0).alias("strength")).filter("price is not null")


def point_and_figure(bars: DataFrame, box: float | None = None, reversal: int = 3, window: int = 14, s: Series = BARS) -> DataFrame:
    """(keys, column, side, low, high, n_boxes, target): columns and the target of a vertical count."""
    keys, order = list(s.keys), list(s.order)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        close = part["close"].to_numpy(float)
        size = box or 0.5 * float(np.nanmedian(k.atr(part["high"].to_numpy(float), part["low"].to_numpy(float), close, min(window, len(close)))))
        columns, side, low, high = [], 0, close[0], close[0]
        for p in close[1:].tolist():
            if side >= 0 and p >= high + size:
                high += int((p - high) / size) * size
                side = 1
            elif side <= 0 and p <= low - size:
                low -= int((low - p) / size) * size
                side = -1
            elif side == 1 and p <= high - reversal * size:
                columns.append((1, low, high))
                low, high, side = high - int((high - p) / size) * size, high - size, -1
            elif side == -1 and p >= low + reversal * size:
                columns.append((-1, low, high))
                low, high, side = low + size, low + int((p - low) / size) * size, 1
        columns.append((side, low, high))
        rows = []
        for i, (d, a, b) in enumerate(columns):
            n = round((b - a) / size) + 1
            rows.append({x: part[x].iloc[0] for x in keys} | {"column": i, "side": d, "low": a, "high": b, "n_boxes": n, "target": a + n * size * reversal if d >= 0 else b - n * size * reversal})
        return pd.DataFrame(rows)

    fields = ", ".join(f"{x} {bars.schema[x].dataType.simpleString()}" for x in keys)
    return bars.groupBy(*keys).applyInPandas(run, f"{fields}, column bigint, side bigint, low double, high double, n_boxes bigint, target double")


def horizontal_counts(columns: DataFrame, box: float, reversal: int = 3, reach: int = 12, s: Series = Series(("symbol",), ("column",))) -> DataFrame:
    """Adds width (columns back that overlap this one's range) and its target, from point-and-figure columns."""
    before = [(s.lag("low", k), s.lag("high", k)) for k in range(1, reach + 1)]
    overlaps = [F.coalesce((low <= c("high")) & (high >= c("low")), F.lit(False)) for low, high in before]
    width, open_ = F.lit(1), F.lit(True)
    columns = columns.withColumns({f"_o{k}": o for k, o in enumerate(overlaps)})
    for k in range(reach):
        open_ = open_ & c(f"_o{k}")
        width = width + open_.cast("int")
    columns = columns.withColumn("width", width).drop(*(f"_o{k}" for k in range(reach)))
    return columns.withColumn("count_target", F.when(c("side") >= 0, c("low") + c("width") * box * reversal).otherwise(c("high") - c("width") * box * reversal))


def automatic_rally(bars: DataFrame, most: int = 30, s: Series = BARS) -> DataFrame:
    """(keys, climax_place, kind, place, price): the highest high after a selling climax (lowest low after a
    buying one) within ``most`` bars, before a bar breaks the climax's own extreme."""
    rows = climaxes(bars, s=s).withColumn("place", s.number)
    events = rows.filter("climax is not null").select(*s.keys, c("place").alias("climax_place"), c("climax").alias("kind"), c("low").alias("_cl"), c("high").alias("_ch"))
    after = rows.select(*s.keys, "place", "high", "low")
    near = events.join(after, list(s.keys)).filter((c("place") > c("climax_place")) & (c("place") <= c("climax_place") + most))
    broken = F.when(c("kind") == "SC", c("low") < c("_cl")).otherwise(c("high") > c("_ch"))
    first = near.groupBy(*s.keys, "climax_place").agg(F.min(F.when(broken, c("place"))).alias("_end"))
    near = near.join(first, [*s.keys, "climax_place"]).filter(c("_end").isNull() | (c("place") < c("_end")))
    best = F.when(c("kind") == "SC", c("high")).otherwise(-c("low"))
    out = near.groupBy(*s.keys, "climax_place", "kind").agg(F.max(F.struct(best.alias("b"), (-c("place")).alias("p"))).alias("_m"))
    return out.select(*s.keys, "climax_place", "kind", (-c("_m.p")).alias("place"), F.when(c("kind") == "SC", c("_m.b")).otherwise(-c("_m.b")).alias("price"))
