"""Volume by price: profiles, value areas, market profile (TPO), session and anchored VWAP, delta."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.windows import Series, ratio
from .bars import TICKS, with_tick_sign
from .indicators import BARS

c = F.col


def volume_profile(bars: DataFrame, n_bins: int = 50, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, bin, low, high, volume): each bar's volume is dealt over the bins that its range overlaps."""
    if n_bins < 1:
        raise ValueError("n_bins must be positive")
    bars = bars.filter("volume > 0")
    bounds = bars.groupBy(*keys).agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"))
    rows = bars.join(bounds, list(keys)).withColumn("_w", (c("_hi") - c("_lo")) / n_bins)
    place = lambda p: F.least(F.greatest(F.floor(ratio(p - c("_lo"), c("_w"))), F.lit(0)), F.lit(n_bins - 1))
    rows = rows.withColumns({"_a": F.coalesce(place(c("low")), F.lit(0)), "_b": F.coalesce(place(c("high")), F.lit(0))})
    rows = rows.withColumn("bin", F.explode(F.sequence("_a", "_b")))
    edge = c("_lo") + c("bin") * c("_w")
    overlap = F.least(c("high"), edge + c("_w")) - F.greatest(c("low"), edge)
    share = F.when(c("high") > c("low"), F.greatest(overlap, F.lit(0.0)) / F.nullif(c("high") - c("low"), F.lit(0.0))).otherwise(1.0)
    out = rows.groupBy(*keys, "bin").agg(F.sum(c("volume") * share).alias("volume"))
    grid = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_bins - 1).cast("bigint"))))
    width = (c("_hi") - c("_lo")) / n_bins
    out = grid.join(out, [*keys, "bin"], "left")
    return out.select(*keys, "bin", (c("_lo") + c("bin") * width).alias("low"), (c("_lo") + (c("bin") + 1) * width).alias("high"), F.coalesce("volume", F.lit(0.0)).alias("volume"))


def value_area(profile: DataFrame, share: float = 0.7, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, poc, val, vah, total) of profiles (keys, bin, low, high, volume)."""
    s = Series(keys, ("bin",))

    def run(volume):
        poc, low, high = kernels.value_area(volume, share)
        n = len(volume)
        return {"_poc": np.full(n, poc), "_low": np.full(n, low), "_high": np.full(n, high)}

    rows = s.kernel(profile, ["volume"], {"_poc": "bigint", "_low": "bigint", "_high": "bigint"}, run)
    at = lambda n, v: F.max(F.when(c("bin") == c(n), v))
    return rows.groupBy(*keys).agg(at("_poc", (c("low") + c("high")) / 2).alias("poc"), at("_low", c("low")).alias("val"), at("_high", c("high")).alias("vah"), F.sum("volume").alias("total"))


def profile_nodes(profile: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Adds node: 1 at strict local peaks of volume, -1 at strict local troughs."""
    s = Series(keys, ("bin",))
    left, right = s.lag("volume"), s.lead("volume")
    node = F.when((c("volume") > left) & (c("volume") > right), 1).when((c("volume") < left) & (c("volume") < right), -1).otherwise(0)
    return profile.withColumn("node", node)


def profile_shape(profile: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Concentration (Gini), normalised entropy, skew and excess kurtosis of price by volume, and a label."""
    whole = Window.partitionBy(*keys)
    rows = profile.withColumns({"_total": F.sum("volume").over(whole), "_n": F.count(F.lit(1)).over(whole), "_rank": F.row_number().over(whole.orderBy("volume", "bin")), "_mid": (c("low") + c("high")) / 2})
    rows = rows.withColumn("_p", ratio(c("volume"), c("_total")))
    rows = rows.withColumn("_mean", F.sum(c("_p") * c("_mid")).over(whole))
    m = lambda k: F.sum(c("_p") * (c("_mid") - c("_mean")) ** k)
    out = rows.groupBy(*keys).agg(
        (2 * F.sum(c("_rank") * c("volume")) / (F.first("_n") * F.nullif(F.sum("volume"), F.lit(0.0))) - (F.first("_n") + 1) / F.first("_n")).alias("gini"),
        (-F.sum(F.when(c("_p") > 0, c("_p") * F.ln(F.when(c("_p") > 0, c("_p"))))) / F.ln(F.first("_n").cast("double"))).alias("entropy"),
        m(2).alias("_m2"), m(3).alias("_m3"), m(4).alias("_m4"),
        F.max_by("_mid", F.struct("volume", (-c("bin")).alias("b"))).alias("_poc"), F.min("low").alias("_lo"), F.max("high").alias("_hi"),
    )
    out = out.withColumns({"skew": c("_m3") / F.nullif(F.pow("_m2", F.lit(1.5)), F.lit(0.0)), "kurtosis": c("_m4") / F.nullif(c("_m2") ** 2, F.lit(0.0)) - 3, "_at": ratio(c("_poc") - c("_lo"), c("_hi") - c("_lo"))})
    label = F.when((c("_at") >= 0.66) & (c("skew") <= -0.2), "P").when((c("_at") <= 0.34) & (c("skew") >= 0.2), "b").when((c("_at") >= 0.4) & (c("_at") <= 0.6) & (F.abs("skew") < 0.2), "D").otherwise("normal")
    return out.select(*keys, "gini", "entropy", "skew", "kurtosis", label.alias("shape"))


def composite_profile(bars: DataFrame, period: str = "day", n_bins: int = 50) -> DataFrame:
    """One profile for each symbol and truncated period."""
    return volume_profile(bars.withColumn("session", F.date_trunc(period, "ts")), n_bins, ("symbol", "session"))


def value_area_migration(bars: DataFrame, period: str = "day", n_bins: int = 50, share: float = 0.7) -> DataFrame:
    return value_area(composite_profile(bars, period, n_bins), share, ("symbol", "session"))


def naked_pocs(bars: DataFrame, period: str = "day", n_bins: int = 50) -> DataFrame:
    """Sessions whose point of control no later session's range holds."""
    poc = value_area_migration(bars, period, n_bins).select("symbol", "session", "poc")
    spans = bars.withColumn("session", F.date_trunc(period, "ts")).groupBy("symbol", "session").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    later = spans.withColumnRenamed("session", "other")
    crossed = (poc["symbol"] == later["symbol"]) & (later["other"] > poc["session"]) & (poc["poc"] >= later["lo"]) & (poc["poc"] <= later["hi"])
    return poc.join(later, crossed, "left_anti")


def tpo_profile(bars: DataFrame, n_bins: int = 24, bracket: str = "30 minutes", period: str = "day") -> DataFrame:
    """(symbol, session, bin, tpo): how many time brackets of a session touched each price bin."""
    rows = bars.withColumns({"session": F.date_trunc(period, "ts"), "bracket": F.window("ts", bracket)["start"]})
    rows = rows.groupBy("symbol", "session", "bracket").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    whole = Window.partitionBy("symbol", "session")
    rows = rows.withColumns({"_lo": F.min("low").over(whole), "_hi": F.max("high").over(whole)})
    width = (c("_hi") - c("_lo")) / n_bins
    place = lambda p: F.coalesce(F.least(F.greatest(F.floor(ratio(p - c("_lo"), width)), F.lit(0)), F.lit(n_bins - 1)), F.lit(0))
    rows = rows.withColumns({"_a": place(c("low")), "_b": place(c("high"))}).withColumn("bin", F.explode(F.sequence("_a", "_b")))
    return rows.groupBy("symbol", "session", "bin").agg(F.count(F.lit(1)).alias("tpo"), F.min(c("_lo") + (c("bin") + 0.5) * width).alias("price"))


def session_vwap(bars: DataFrame, period: str = "day") -> DataFrame:
    w = Window.partitionBy("symbol", "session").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    tp = (c("high") + c("low") + c("close")) / 3
    return bars.withColumn("session", F.date_trunc(period, "ts")).withColumn("session_vwap", ratio(F.sum(tp * c("volume")).over(w), F.sum("volume").over(w)))


def anchored_vwap(bars: DataFrame, anchor: int, s: Series = BARS) -> DataFrame:
    """VWAP from the bar with this number (from 0); null before it."""
    bars = bars.withColumn("_in", s.number > anchor)
    tp = (c("high") + c("low") + c("close")) / 3
    total = lambda v: s.running(F.sum(F.when(c("_in"), v)))
    return bars.withColumn("anchored_vwap", ratio(total(tp * c("volume")), total(c("volume")))).drop("_in")


def cumulative_volume_delta(ticks: DataFrame, s: Series = TICKS) -> DataFrame:
    """Signed volume by the tick rule (the first tick counts as a buy) and its running sum."""
    rows = with_tick_sign(ticks, s, first=1).withColumn("signed_volume", c("sign") * c("size"))
    return rows.withColumn("cvd", s.running(F.sum("signed_volume")))


def bar_delta(bars: DataFrame) -> DataFrame:
    span = c("high") - c("low")
    buy: Column = F.when(span == 0, 0.5).otherwise((c("close") - c("low")) / F.nullif(span, F.lit(0.0)))
    return bars.withColumn("delta", (2 * buy - 1) * c("volume"))


def delta_divergence(df: DataFrame, price: str, cvd: str, window: int = 14, s: Series = BARS) -> DataFrame:
    p, d = F.signum(c(price) - s.lag(price, window)), F.signum(c(cvd) - s.lag(cvd, window))
    return df.withColumn("divergence", F.when(p * d < 0, p).otherwise(F.when(p.isNotNull(), 0.0)))


def delta_profile(ticks: DataFrame, n_bins: int = 50) -> DataFrame:
    """Buy and sell volume by price bin."""
    rows = with_tick_sign(ticks, TICKS, first=1)
    bounds = rows.groupBy("symbol").agg(F.min("price").alias("_lo"), F.max("price").alias("_hi"))
    rows = rows.join(bounds, "symbol").withColumn("bin", F.coalesce(F.least(F.floor(ratio((c("price") - c("_lo")) * n_bins, c("_hi") - c("_lo"))), F.lit(n_bins - 1)), F.lit(0)))
    return rows.groupBy("symbol", "bin").agg(F.sum(F.when(c("sign") > 0, c("size")).otherwise(0.0)).alias("buy"), F.sum(F.when(c("sign") < 0, c("size")).otherwise(0.0)).alias("sell"))


def bracket_letters(n: int) -> list[str]:
    """A..Z, a..z, then pairs."""
    one = [chr(x) for x in (*range(65, 91), *range(97, 123))]
    return [one[i] if i < 52 else one[i // 52 - 1] + one[i % 52] for i in range(n)]


def initial_balance(bars: DataFrame, bracket: str = "30 minutes", n_initial: int = 2, period: str = "day") -> DataFrame:
    """(symbol, session, ib_low, ib_high, extends_up, extends_down) from the first brackets of each session."""
    rows = bars.withColumns({"session": F.date_trunc(period, "ts"), "_b": F.window("ts", bracket)["start"]})
    rows = rows.withColumn("_n", F.dense_rank().over(Window.partitionBy("symbol", "session").orderBy("_b")))
    first = c("_n") <= n_initial
    out = rows.groupBy("symbol", "session").agg(F.min(F.when(first, c("low"))).alias("ib_low"), F.max(F.when(first, c("high"))).alias("ib_high"), F.min("low").alias("_lo"), F.max("high").alias("_hi"))
    return out.select("symbol", "session", "ib_low", "ib_high", (c("_hi") > c("ib_high")).alias("extends_up"), (c("_lo") < c("ib_low")).alias("extends_down"))


def single_prints(tpo: DataFrame) -> DataFrame:
    """Bins that one bracket alone touched."""
    return tpo.filter("tpo = 1")
