"""Strategies: target weights from bars; a weight at a bar uses nothing after it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions import timeseries as ts
from ..functions.windows import Series
from .indicators import BARS, hma, sma

c = F.col


def sma_cross(bars: DataFrame, fast: int = 10, slow: int = 50, s: Series = BARS) -> DataFrame:
    """Long while the fast average is above the slow one, else flat."""
    if fast >= slow:
        raise ValueError("fast must be shorter than slow")
    rows = sma(sma(bars, "close", fast, "_fast", s), "close", slow, "_slow", s)
    return rows.withColumn("weight", F.when(c("_slow").isNull(), None).when(c("_fast") > c("_slow"), 1.0).otherwise(0.0)).drop("_fast", "_slow")


def hull_trend(bars: DataFrame, window: int = 55, s: Series = BARS) -> DataFrame:
    """1 where the Hull average rises over two bars, -1 where it falls; changes only at a turn."""
    rows = hma(bars, "close", window, "hull", s)
    return rows.withColumn("signal", F.when(c("hull") > s.lag("hull", 2), 1).when(c("hull") < s.lag("hull", 2), -1).otherwise(0))


def mean_reversion(bars: DataFrame, window: int = 60, enter: float = 2.0, leave: float = 0.5, stop: float = 4.0, s: Series = BARS) -> DataFrame:
    """Against the z-score of the log price: in beyond ``enter``, out within ``leave`` or beyond ``stop``."""

    def run(close):
        x = np.log(close)
        z, weight, held = np.full(len(x), np.nan), np.zeros(len(x)), 0.0
        for i in range(window - 1, len(x)):
            part = x[i - window + 1 : i + 1]
            sd = part.std()
            z[i] = (x[i] - part.mean()) / sd if sd > 1e-12 else 0.0
            if held == 0 and enter <= abs(z[i]) < stop:
                held = -np.sign(z[i])
            elif held and (abs(z[i]) <= leave or abs(z[i]) >= stop or held * z[i] > 0):
                held = 0.0
            weight[i] = held
        return {"z": z, "weight": weight}

    return s.kernel(bars, ["close"], {"z": "double", "weight": "double"}, run)


def pairs(panel: DataFrame, y: str, x: str, s: Series, enter: float = 2.0, leave: float = 0.5, window: int = 60) -> DataFrame:
    """Adds beta, spread_z and position of a Kalman-hedged pair of columns."""

    def run(a, b):
        beta, alpha, gap = ts.kalman_hedge(a, b)
        z, position, held = np.full(len(a), np.nan), np.zeros(len(a)), 0.0
        for i in range(window, len(a)):
            part = gap[i - window : i]
            z[i] = gap[i] / part.std() if part.std() > 1e-12 else 0.0
            held = -np.sign(z[i]) if held == 0 and abs(z[i]) >= enter else 0.0 if held and abs(z[i]) <= leave else held
            position[i] = held
        return {"beta": beta, "spread_z": z, "position": position}

    return s.kernel(panel, [y, x], {"beta": "double", "spread_z": "double", "position": "double"}, run)


def confluence(bars: DataFrame, trend: int = 50, pull: int = 14, s: Series = BARS) -> DataFrame:
    """Score of trend (SuperTrend), momentum (RSI), volume flow and volatility; weight where enough agree."""

    def run(high, low, close, volume):
        _, side = k.supertrend(high, low, close, 3.0 * k.atr(high, low, close, 10))
        rsi, slow, width = k.rsi(close, pull), k.ema(close, trend), k.atr(high, low, close, pull)
        flow = np.cumsum(np.sign(np.diff(close, prepend=close[0])) * volume)
        votes = np.stack([side, np.sign(rsi - 50), np.sign(close - slow), np.sign(flow - k.ema(flow, trend))])
        score = np.where(np.isnan(votes).any(axis=0), np.nan, np.nansum(votes, axis=0) / 4)
        weight = np.where(np.isnan(score), 0.0, np.where(np.abs(score) >= 0.75, np.sign(score), 0.0))
        return {"score": score, "weight": weight * np.clip(0.02 / np.where(width > 0, width / close, 1.0), 0, 1)}

    return s.kernel(bars, ["high", "low", "close", "volume"], {"score": "double", "weight": "double"}, run)
