"""Streams: bars with a watermark, and per-symbol state in event order that ends equal to the batch result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streaming_time_bars(ticks: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling bars of a stream of ticks (symbol, ts, seq, price, size); later ticks than ``late`` are dropped."""
    at = F.struct("ts", "seq")
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", every).alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def streaming_ema(ticks: DataFrame, window: int = 20, late: str = "1 day") -> DataFrame:
    """(symbol, n, ema) after each micro-batch: the exponential average of the symbol's prices so far in order of
    event time, whatever order they arrived in; seeded with the first window's mean.

    Rows that the watermark has passed are folded into (n, value); later ones wait in the state and are
    folded anew for each answer, so it holds the rows of ``late`` at most. Rows that arrive behind the watermark are dropped.
    """
    weight = 2.0 / (window + 1)

    def folded(n: int, value: float, prices: list[float]) -> tuple[int, float]:
        for price in prices:
            n += 1
            value += (price - value) / n if n <= window else weight * (price - value)
        return n, float(value)

    def update(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, value, *held = state.get if state.exists else (0, 0.0, [], [], [])
        rows = pd.concat(list(parts))
        mark = state.getCurrentWatermarkMs() * 1000
        at = rows["ts"].astype("datetime64[us]").astype("int64")
        fresh = at >= mark
        waiting = sorted([*zip(*held, strict=True), *zip(at[fresh].tolist(), rows["seq"][fresh].tolist(), rows["price"][fresh].tolist(), strict=True)])
        done = sum(row[0] < mark for row in waiting)
        n, value = folded(n, value, [row[2] for row in waiting[:done]])
        waiting = waiting[done:]
        state.update((n, value, *([row[k] for row in waiting] for k in range(3))))
        count, ema = folded(n, value, [row[2] for row in waiting])
        yield pd.DataFrame({"symbol": [key[0]], "n": [count], "ema": [ema]})

    held = "n long, value double, ts array<long>, seq array<long>, price array<double>"
    return ticks.withWatermark("ts", late).groupBy("symbol").applyInPandasWithState(update, "symbol string, n long, ema double", held, "update", GroupStateTimeout.NoTimeout)
