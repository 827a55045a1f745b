"""Technical indicators over bars (symbol, ts, open, high, low, close, volume).

Each function adds columns to a frame of many series. What a window can say is a window, so
that all such columns of a series share one sort; recursions run in one kernel per series.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.windows import Series, check_window, ieee_ln, ieee_ratio, ratio

BARS = Series()
c = F.col


def sma(df: DataFrame, value: str, window: int, out: str = "sma", s: Series = BARS) -> DataFrame:
    return df.withColumn(out, s.rolling(F.avg(value), window))


def wma(df: DataFrame, value: str, window: int, out: str = "wma", s: Series = BARS) -> DataFrame:
    """Weights 1..w: the weighted sum follows from a sum of place times value."""
    df = df.withColumns({"_n": s.number, "_nx": s.number * c(value)})
    total = (F.sum("_nx").over(s.rows(window)) - (c("_n") - window) * F.sum(value).over(s.rows(window))) / (window * (window + 1) / 2)
    return df.withColumn(out, F.when((c("_n") >= window) & (F.count(value).over(s.rows(window)) == window), total)).drop("_n", "_nx")


def hma(df: DataFrame, value: str, window: int, out: str = "hma", s: Series = BARS) -> DataFrame:
    check_window(window, 2)
    df = wma(wma(df, value, window // 2, "_half", s), value, window, "_full", s)
    df = df.withColumn("_raw", 2 * c("_half") - c("_full"))
    root = round(math.sqrt(window))
    # warm-up rows of the inner average are null; number the rows from its start
    df = df.withColumn("_m", s.number - (window - 1))
    w = s.rows(root)
    total = (F.sum(c("_m") * c("_raw")).over(w) - (c("_m") - root) * F.sum("_raw").over(w)) / (root * (root + 1) / 2)
    return df.withColumn(out, F.when(c("_m") >= root, total)).drop("_half", "_full", "_raw", "_m")


def true_range(s: Series = BARS) -> Column:
    return F.greatest(c("high") - c("low"), F.abs(c("high") - s.lag("close")), F.abs(c("low") - s.lag("close")))


def bollinger_bands(df: DataFrame, window: int = 20, n_std: float = 2.0, s: Series = BARS) -> DataFrame:
    df = df.withColumns({"bb_mid": s.rolling(F.avg("close"), window), "_sd": s.rolling(F.stddev_pop("close"), window)})
    df = df.withColumns({"bb_upper": c("bb_mid") + n_std * c("_sd"), "bb_lower": c("bb_mid") - n_std * c("_sd")})
    width = c("bb_upper") - c("bb_lower")
    return df.withColumns({"bb_width": ratio(width, c("bb_mid")), "bb_pct": ratio(c("close") - c("bb_lower"), width)}).drop("_sd")


def donchian_channels(df: DataFrame, window: int = 20, s: Series = BARS) -> DataFrame:
    df = df.withColumns({"dc_upper": s.rolling(F.max("high"), window), "dc_lower": s.rolling(F.min("low"), window)})
    return df.withColumn("dc_mid", (c("dc_upper") + c("dc_lower")) / 2)


def stochastic(df: DataFrame, k_window: int = 14, d_window: int = 3, s: Series = BARS) -> DataFrame:
    """%K, and %D as the mean of the last %K that are all defined."""
    high, low = s.rolling(F.max("high"), k_window), s.rolling(F.min("low"), k_window)
    df = df.withColumns({"_hh": high, "_ll": low})
    df = df.withColumn("stoch_k", F.when(c("_hh") == c("_ll"), 50.0).otherwise(100 * ratio(c("close") - c("_ll"), c("_hh") - c("_ll"))))
    return df.withColumn("stoch_d", s.rolling(F.avg("stoch_k"), d_window, k_window + d_window - 1)).drop("_hh", "_ll")


def roc(df: DataFrame, window: int = 12, s: Series = BARS) -> DataFrame:
    check_window(window)
    return df.withColumn("roc", 100 * (ratio(c("close"), s.lag("close", window)) - 1))


def williams_r(df: DataFrame, window: int = 14, s: Series = BARS) -> DataFrame:
    df = df.withColumns({"_hh": s.rolling(F.max("high"), window), "_ll": s.rolling(F.min("low"), window)})
    span = c("_hh") - c("_ll")
    return df.withColumn("williams_r", F.when(span == 0, 0.0).otherwise(-100 * ratio(c("_hh") - c("close"), span))).drop("_hh", "_ll")


def cci(df: DataFrame, window: int = 20, s: Series = BARS) -> DataFrame:
    df = df.withColumn("_tp", (c("high") + c("low") + c("close")) / 3)
    df = df.withColumns({"_mean": s.rolling(F.avg("_tp"), window), "_all": F.collect_list("_tp").over(s.rows(window))})
    df = df.withColumn("_mad", F.aggregate("_all", F.lit(0.0), lambda a, x: a + F.abs(x - c("_mean"))) / window)
    return df.withColumn("cci", F.when(c("_mad") == 0, 0.0).otherwise((c("_tp") - c("_mean")) / (0.015 * F.nullif(c("_mad"), F.lit(0.0))))).drop("_tp", "_mean", "_all", "_mad")


def aroon(df: DataFrame, window: int = 25, s: Series = BARS) -> DataFrame:
    """Bars since the extreme of window + 1 bars, the latest one on ties."""
    df = df.withColumn("_n", s.number)
    w = s.rows(window + 1)
    up = F.max(F.struct("high", "_n")).over(w)["_n"]
    down = F.min(F.struct(c("low"), (-c("_n")).alias("m"))).over(w)["m"]
    ready = c("_n") > window
    df = df.withColumns({"aroon_up": F.when(ready, 100.0 * (window - (c("_n") - up)) / window), "aroon_down": F.when(ready, 100.0 * (window - (c("_n") + down)) / window)})
    return df.withColumn("aroon_osc", c("aroon_up") - c("aroon_down")).drop("_n")


def ichimoku(df: DataFrame, tenkan: int = 9, kijun: int = 26, senkou: int = 52, shift: int = 26, s: Series = BARS) -> DataFrame:
    """The spans are given at the bar that they are drawn on, ``shift`` bars after the one they come from."""
    mid = lambda w: (s.rolling(F.max("high"), w) + s.rolling(F.min("low"), w)) / 2
    df = df.withColumns({"tenkan": mid(tenkan), "kijun": mid(kijun), "_b": mid(senkou)})
    df = df.withColumn("_a", (c("tenkan") + c("kijun")) / 2)
    return df.withColumns({"senkou_a": s.lag("_a", shift), "senkou_b": s.lag("_b", shift), "chikou": s.lead("close", shift)}).drop("_a", "_b")


def volatility(df: DataFrame, window: int = 20, periods: float = 252.0, s: Series = BARS) -> DataFrame:
    """Parkinson, Garman-Klass, Rogers-Satchell and Yang-Zhang, annualised; a price of zero counts as doubles do, so that it makes its windows infinite or not a number."""
    check_window(window, 2)
    ln = lambda a, b: ieee_ln(ieee_ratio(c(a), c(b)))
    df = df.withColumns(
        {
            "_pk": ln("high", "low") ** 2 / (4 * math.log(2)),
            "_gk": 0.5 * ln("high", "low") ** 2 - (2 * math.log(2) - 1) * ln("close", "open") ** 2,
            "_rs": ln("high", "close") * ln("high", "open") + ln("low", "close") * ln("low", "open"),
            "_o": ieee_ln(ieee_ratio(c("open"), s.lag("close"))),
            "_c": ln("close", "open"),
        }
    )
    year = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)) * periods)
    weight = 0.34 / (1.34 + (window + 1) / (window - 1))
    yz = s.rolling(F.var_samp("_o"), window, window + 1) + weight * s.rolling(F.var_samp("_c"), window, window + 1) + (1 - weight) * s.rolling(F.avg("_rs"), window, window + 1)
    out = {"parkinson": year(s.rolling(F.avg("_pk"), window)), "garman_klass": year(s.rolling(F.avg("_gk"), window)), "rogers_satchell": year(s.rolling(F.avg("_rs"), window)), "yang_zhang": year(yz)}
    # greatest() skips nulls, so the warm-up is put back
    ready = {name: s.number >= window + (name == "yang_zhang") for name in out}
    return df.withColumns({name: F.when(ready[name], value) for name, value in out.items()}).drop("_pk", "_gk", "_rs", "_o", "_c")


def volume_flow(df: DataFrame, window: int = 20, mfi_window: int = 14, s: Series = BARS) -> DataFrame:
    """On-balance volume, VWAP so far and rolling, accumulation/distribution, Chaikin and money flow."""
    span = c("high") - c("low")
    df = df.withColumns(
        {
            "_step": F.coalesce(F.signum(c("close") - s.lag("close")), F.lit(0.0)) * c("volume"),
            "_tp": (c("high") + c("low") + c("close")) / 3,
            "_mfv": F.when(span == 0, 0.0).otherwise(((c("close") - c("low")) - (c("high") - c("close"))) / F.nullif(span, F.lit(0.0))) * c("volume"),
        }
    )
    df = df.withColumns({"_pv": c("_tp") * c("volume"), "_up": F.signum(c("_tp") - s.lag("_tp"))})
    run, roll = s.running, s.rolling
    df = df.withColumns(
        {
            "obv": run(F.sum("_step")),
            "vwap": ratio(run(F.sum("_pv")), run(F.sum("volume"))),
            "rolling_vwap": ratio(roll(F.sum("_pv"), window), roll(F.sum("volume"), window)),
            "acc_dist": run(F.sum("_mfv")),
            "cmf": ratio(roll(F.sum("_mfv"), window), roll(F.sum("volume"), window)),
            "_pos": roll(F.sum(F.when(c("_up") > 0, c("_pv")).otherwise(0.0)), mfi_window, mfi_window + 1),
            "_neg": roll(F.sum(F.when(c("_up") < 0, c("_pv")).otherwise(0.0)), mfi_window, mfi_window + 1),
        }
    )
    flow = F.when(c("_neg") == 0, F.when(c("_pos") > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + c("_pos") / F.nullif(c("_neg"), F.lit(0.0))))
    return df.withColumn("mfi", F.when(c("_pos").isNotNull(), flow)).drop("_step", "_tp", "_mfv", "_pv", "_up", "_pos", "_neg")


def vwap_bands(df: DataFrame, mults: tuple[float, ...] = (1.0, 2.0, 3.0), s: Series = BARS) -> DataFrame:
    df = df.withColumn("_tp", (c("high") + c("low") + c("close")) / 3)
    total = s.running(F.sum("volume"))
    df = df.withColumns({"vwap": ratio(s.running(F.sum(c("_tp") * c("volume"))), total), "_sq": ratio(s.running(F.sum(c("_tp") ** 2 * c("volume"))), total)})
    sigma = F.sqrt(F.greatest(c("_sq") - c("vwap") ** 2, F.lit(0.0)))
    bands = {f"vwap_{side}_{m:g}": c("vwap") + sign * m * sigma for m in mults for side, sign in (("upper", 1), ("lower", -1))}
    return df.withColumns(bands).drop("_tp", "_sq")


def pivot_points(df: DataFrame, method: str = "classic", s: Series = BARS) -> DataFrame:
    """Levels from the bar before: classic floor pivots or Fibonacci levels."""
    high, low, close = (s.lag(x) for x in ("high", "low", "close"))
    df = df.withColumns({"pivot": (high + low + close) / 3, "_h": high, "_l": low})
    p, h, low_, span = c("pivot"), c("_h"), c("_l"), c("_h") - c("_l")
    if method == "classic":
        levels = {"r1": 2 * p - low_, "s1": 2 * p - h, "r2": p + span, "s2": p - span, "r3": h + 2 * (p - low_), "s3": low_ - 2 * (h - p)}
    elif method == "fibonacci":
        levels = {f"{side}{i}": p + sign * f * span for i, f in ((1, 0.382), (2, 0.618), (3, 1.0)) for side, sign in (("r", 1), ("s", -1))}
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.withColumns(levels).drop("_h", "_l")


def recursive(df: DataFrame, window: int = 14, s: Series = BARS) -> DataFrame:
    """EMA, Wilder average, DEMA, TEMA, KAMA, RSI, MACD, ATR, ADX, SAR, SuperTrend and Keltner channels at their usual settings."""
    check_window(window)
    names = ["ema", "wilder", "dema", "tema", "kama", "rsi", "macd", "macd_signal", "macd_hist", "atr", "adx", "plus_di", "minus_di", "sar", "sar_side", "supertrend", "supertrend_side", "kc_mid", "kc_upper", "kc_lower"]

    def run(high, low, close):
        first = k.ema(close, window)
        # the second average runs over zeros where the first is not defined
        second = k.ema(np.nan_to_num(first), window)
        third = k.ema(np.nan_to_num(second), window)
        place = np.arange(len(close))
        macd = k.ema(close, 12) - k.ema(close, 26)
        signal = k.ema_tail(macd, 9)
        atr = k.atr(high, low, close, window)
        strength, plus, minus = k.adx(high, low, close, window)
        line, side = k.supertrend(high, low, close, 3.0 * k.atr(high, low, close, 10))
        mid, reach = k.ema(close, 20), 2.0 * k.atr(high, low, close, 10)
        made = [first, k.wilder(close, window), np.where(place >= 2 * (window - 1), 2 * first - second, np.nan), np.where(place >= 3 * (window - 1), 3 * first - 3 * second + third, np.nan)]
        made += [k.kama(close, 10, 2, 30), k.rsi(close, window), macd, signal, macd - signal, atr, strength, plus, minus, *k.parabolic_sar(high, low, 0.02, 0.02, 0.2), line, side, mid, mid + reach, mid - reach]
        return dict(zip(names, made, strict=True))

    return s.kernel(df, ["high", "low", "close"], {n: "double" for n in names}, run)


def rolling_zscore(df: DataFrame, value: str, window: int, out: str, s: Series = BARS) -> DataFrame:
    sd = s.rolling(F.stddev_pop(value), window)
    return df.withColumn(out, F.when(sd <= 0, 0.0).otherwise((c(value) - s.rolling(F.avg(value), window)) / F.when(sd > 0, sd)))


def rolling_slope(df: DataFrame, value: str, window: int, out: str, s: Series = BARS) -> DataFrame:
    df = df.withColumn("_n", s.number.cast("double"))
    return df.withColumn(out, F.when(c("_n") >= window, F.regr_slope(c(value), c("_n")).over(s.rows(window)))).drop("_n")


def cluster_levels(swings: DataFrame, tolerance: float = 0.005, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Support and resistance: prices in order, a cluster reaches ``tolerance`` above its first price."""
    s = Series(keys, ("price", "place"))

    def run(price):
        cluster, anchor, now = np.zeros(len(price)), None, -1
        for i, p in enumerate(price.tolist()):
            if anchor is None or p - anchor > tolerance * abs(anchor):
                anchor, now = p, now + 1
            cluster[i] = now
        return {"cluster": cluster}

    rows = s.kernel(swings, ["price"], {"cluster": "bigint"}, run)
    kind = F.when(F.min("kind") == F.max("kind"), F.when(F.min("kind") > 0, "R").otherwise("S")).otherwise("SR")
    out = rows.groupBy(*keys, "cluster").agg(F.avg("price").alias("price"), kind.alias("kind"), F.count(F.lit(1)).alias("touches"), (F.count(F.lit(1)) * F.avg("strength")).alias("strength"), F.min("place").alias("first_place"), F.max("place").alias("last_place"))
    return out


def fractal_swings(df: DataFrame, left: int = 3, right: int = 3, s: Series = BARS) -> DataFrame:
    """Rows (keys, place, price, kind, strength): strict extremes; a high goes before a low on the same bar."""
    before, after = s.window.rowsBetween(-left, -1), s.window.rowsBetween(1, right)
    full = (F.count("high").over(before) == left) & (F.count("high").over(after) == right)
    high = full & (c("high") > F.max("high").over(before)) & (c("high") > F.max("high").over(after))
    low = full & (c("low") < F.min("low").over(before)) & (c("low") < F.min("low").over(after))
    rows = df.select(*s.keys, *s.order, (s.number - 1).alias("place"), F.when(high, c("high")).when(low, c("low")).alias("price"), F.when(high, 1).when(low, -1).alias("kind"))
    return rows.filter("kind is not null").withColumn("strength", F.lit(float(min(left, right))))
