"""Hull ribbons, moving-average crosses, their filters, and features and policies for models of bars."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions import timeseries as ts
from ..functions.windows import Series, ratio
from .indicators import BARS, sma

c = F.col


def _wma(x: np.ndarray, window: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) >= window:
        out[window - 1 :] = np.convolve(x, np.arange(window, 0, -1.0), "valid") / (window * (window + 1) / 2)
    return out


def hull(x: np.ndarray, window: int, kind: str = "hma") -> np.ndarray:
    """Hull average of a series: "hma" and "thma" by weighted averages, "ehma" by exponential ones (which start in zeros)."""
    half, root = max(1, window // 2), max(1, math.isqrt(window))
    if kind == "ehma":
        raw, last, smooth = 2 * k.ema(x, half) - k.ema(x, window), root, k.ema
    elif kind == "thma":
        raw, last, smooth = 3 * _wma(x, max(1, window // 3)) - _wma(x, half) - _wma(x, window), window, _wma
    elif kind == "hma":
        raw, last, smooth = 2 * _wma(x, half) - _wma(x, window), root, _wma
    else:
        raise ValueError(f"unknown Hull average {kind!r}")
    out = smooth(np.nan_to_num(raw), last)
    out[: window + last - 2] = np.nan
    return out


def hull_ribbon(bars: DataFrame, fast: int = 50, slow: int = 60, fast_kind: str = "hma", slow_kind: str = "ehma", scale: float = 1.0, s: Series = BARS) -> DataFrame:
    """Adds fast, slow, their slopes (1, 0, -1), ribbon (above, inside, below) and signal (1, 0, -1).

    In on the first bar beyond the ribbon with both slopes that way; out where the fast slope turns or
    the price falls through the far edge.
    """
    lengths = [max(2, round(n * scale)) for n in (fast, slow)]
    if min(fast, slow) < 2 or scale <= 0:
        raise ValueError("lengths must be 2 at least, scale above 0")

    def run(close):
        a, b = hull(close, lengths[0], fast_kind), hull(close, lengths[1], slow_kind)
        slope = lambda x: np.sign(np.concatenate([[np.nan], np.diff(x)]))
        up, trend = slope(a), slope(b)
        top, bottom = np.maximum(a, b), np.minimum(a, b)
        where = np.where(np.isnan(top), np.nan, (close > top) * 1.0 - (close < bottom))
        signal, held = np.zeros(len(close)), 0
        for i in range(len(close)):
            if np.isnan(where[i]):
                continue
            if held and (held * up[i] < 0 or (close[i] < bottom[i] if held > 0 else close[i] > top[i])):
                held = 0
            fresh = where[i] and not (i and where[i - 1] == where[i])
            if not held and fresh and up[i] == trend[i] == where[i]:
                held = int(where[i])
            signal[i] = held
        return {"fast": a, "slow": b, "fast_slope": up, "slow_slope": trend, "_where": where, "signal": signal}

    rows = s.kernel(bars, ["close"], {n: "double" for n in ("fast", "slow", "fast_slope", "slow_slope", "_where", "signal")}, run)
    named = F.when(c("_where") > 0, "above").when(c("_where") < 0, "below").when(c("_where") == 0, "inside")
    return rows.withColumns({"ribbon": named, "signal": c("signal").cast("int")}).drop("_where")


def agrees(signal: Column, up: Column, down: Column) -> Column:
    """A signal where the condition of its side holds, else 0."""
    return F.when((signal > 0) & up, 1).when((signal < 0) & down, -1).otherwise(0)


def multi_timeframe_filter(low: Column, high: Column) -> Column:
    return agrees(low, high > 0, high < 0)


def vwap_filter(signal: Column, price: Column, vwap: Column) -> Column:
    return agrees(signal, price > vwap, price < vwap)


def momentum_filter(signal: Column, rsi: Column | None = None, macd: Column | None = None, floor: float = 50.0, ceiling: float = 50.0) -> Column:
    up = down = F.lit(True)
    if rsi is not None:
        up, down = up & (rsi > floor), down & (rsi < ceiling)
    if macd is not None:
        up, down = up & (macd > 0), down & (macd < 0)
    return agrees(signal, up, down)


def ema_cross_atr(bars: DataFrame, fast: int = 12, slow: int = 26, window: int = 14, reach: float = 3.0, weight: float = 1.0, s: Series = BARS) -> DataFrame:
    """Adds fast, slow, atr, weight and trail_stop: long from a cross up of the averages to a cross down, or to a
    close at ``reach`` ranges below the highest close since."""
    if not 2 <= fast < slow or window < 2 or not (0 < reach < math.inf and 0 < weight <= 1):
        raise ValueError("needs 2 <= fast < slow, window >= 2, reach > 0 and a weight in (0, 1]")

    def run(high, low, close):
        a, b, width = k.ema(close, fast), k.ema(close, slow), k.atr(high, low, close, window)
        held, top = np.zeros(len(close)), 0.0
        stop = np.full(len(close), np.nan)
        inside = False
        for i in range(max(slow, window) + 1, len(close)):
            if inside:
                top = max(top, close[i])
                inside = a[i] > b[i] and close[i] > top - reach * width[i]
            elif a[i] > b[i] and not a[i - 1] > b[i - 1]:
                inside, top = True, close[i]
            if inside:
                held[i], stop[i] = weight, top - reach * width[i]
        return {"fast": a, "slow": b, "atr": width, "weight": held, "trail_stop": stop}

    return s.kernel(bars, ["high", "low", "close"], {n: "double" for n in ("fast", "slow", "atr", "weight", "trail_stop")}, run)


def long_calls(bars: DataFrame, fast: int = 12, slow: int = 26, moneyness: float = 1.0, days: int = 30, exit_days: int = 5, step: float = 1.0, s: Series = BARS) -> DataFrame:
    """Adds event (entry, exit_cross, exit_days), strike and expiry of the call that is held: bought at a cross up of the
    averages, ``days`` to run, sold at the cross down or with ``exit_days`` left."""

    def run(close, day):
        a, b = k.ema(close, fast), k.ema(close, slow)
        out = {n: np.full(len(close), np.nan) for n in ("_event", "strike", "_expiry")}
        strike = expiry = np.nan
        for i in range(slow + 1, len(close)):
            up = a[i] > b[i]
            if not np.isnan(strike):
                out["strike"][i], out["_expiry"][i] = strike, expiry
                if not up or expiry - day[i] <= exit_days:
                    out["_event"][i] = 3 if up else 2
                    strike = expiry = np.nan
            elif up and not a[i - 1] > b[i - 1]:
                strike, expiry = round(close[i] * moneyness / step) * step, day[i] + days
                out["_event"][i], out["strike"][i], out["_expiry"][i] = 1, strike, expiry
        return out

    rows = s.kernel(bars.withColumn("_day", F.unix_date(F.to_date("ts")).cast("double")), ["close", "_day"], {"_event": "bigint", "strike": "double", "_expiry": "bigint"}, run)
    event = F.element_at(F.array(*map(F.lit, ("entry", "exit_cross", "exit_days"))), c("_event").cast("int"))
    return rows.withColumns({"event": F.when(c("_event").isNotNull(), event), "expiry": F.date_from_unix_date(c("_expiry").cast("int"))}).drop("_day", "_event", "_expiry")


def garch_target(bars: DataFrame, fast: int = 20, slow: int = 100, target: float = 0.10, cap: float = 4.0, band: float = 0.10, window: int = 250, every: int = 25, periods: float = 252.0, s: Series = BARS) -> DataFrame:
    """Adds sigma (one-step forecast of a GARCH(1,1) fitted to the last ``window`` returns every ``every`` bars, rolled on
    between), trend (fast less slow average of log prices over sigma) and weight: its sign beyond ``band``, scaled to the target."""

    def run(close):
        x = np.log(close)
        r = np.diff(x)
        smooth = [np.empty(len(x)) for _ in range(2)]
        for y, span in zip(smooth, (fast, slow), strict=True):
            y[0] = x[0]
            for i in range(1, len(x)):
                y[i] = y[i - 1] + 2 / (span + 1) * (x[i] - y[i - 1])
        out = {n: np.full(len(x), np.nan) for n in ("sigma", "trend", "weight")}
        model, variance = None, 0.0
        for i in range(window, len(x)):
            if (i - window) % every == 0:
                past = r[i - window : i]
                model = ts.garch_fit(past, "garch")
                last = ts.garch_filter(past, model["omega"], model["alpha"], model["beta"])[-1]
                variance = model["omega"] + model["alpha"] * past[-1] ** 2 + model["beta"] * last
            else:
                variance = max(model["omega"] + model["alpha"] * r[i - 1] ** 2 + model["beta"] * variance, 1e-14)
            sigma = math.sqrt(variance)
            trend = (smooth[0][i] - smooth[1][i]) / sigma
            size = min(cap, target / (sigma * math.sqrt(periods)))
            out["sigma"][i], out["trend"][i], out["weight"][i] = sigma, trend, math.copysign(size, trend) if abs(trend) > band else 0.0
        return out

    return s.kernel(bars, ["close"], {n: "double" for n in ("sigma", "trend", "weight")}, run)


def features(bars: DataFrame, rsi: int = 14, short: int = 10, long: int = 50, atr: int = 14, s: Series = BARS) -> DataFrame:
    """Adds rsi_<n>, sma_ratio_<short>_<long> and atr_<n>; null while warming up."""
    rows = sma(sma(bars, "close", short, "_short", s), "close", long, "_long", s)
    rows = rows.withColumn(f"sma_ratio_{short}_{long}", ratio(c("_short"), c("_long"))).drop("_short", "_long")
    names = [f"rsi_{rsi}", f"atr_{atr}"]
    return s.kernel(rows, ["high", "low", "close"], {n: "double" for n in names}, lambda h, lo, x: dict(zip(names, (k.rsi(x, rsi), k.atr(h, lo, x, atr)), strict=True)))


def threshold_policy(rows: DataFrame, prediction: str, enter: float = 0.0005, leave: float = 0.0, most: float = 1.0, s: Series = BARS) -> DataFrame:
    """Adds weight: flat below ``leave``, the prediction's side from ``enter`` on, between them what was held."""
    p = c(prediction)
    says = F.when(p.isNull(), None).when(F.abs(p) < leave, 0.0).when(F.abs(p) >= enter, F.when(p > 0, most).otherwise(-most))
    return rows.withColumn("weight", F.coalesce(s.carried(says), F.lit(0.0)))
