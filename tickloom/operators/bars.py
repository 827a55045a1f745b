"""Bars from ticks: time bars in SQL, threshold bars by a scan over blocks, adaptive bars by a stream of batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import cut_lineage, in_order, join_on, whole_blocks
from ..functions.windows import Series

TICK = ("symbol", "ts", "seq", "price", "size")
TICKS = Series(("symbol",), ("ts", "seq"))
#: Ticks of a block, and blocks up to which their open sums are broadcast; beyond, they meet the ticks in a shuffle join.
BLOCK_ROWS, BROADCAST_BLOCKS = 65_536, 100_000


def time_bars(ticks: DataFrame, every: str, offset: str | None = None) -> DataFrame:
    """Tumbling bars, closed and labelled left; windows without ticks are not emitted."""
    window = F.window("ts", every, every, offset) if offset else F.window("ts", every)
    at = F.struct("ts", "seq")
    out = ticks.groupBy("symbol", window.alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def resample(bars: DataFrame, every: str) -> DataFrame:
    """Coarser bars from bars."""
    window = F.window("ts", every).alias("w")
    out = bars.groupBy("symbol", window).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


#: A fixed value: adaptive limits below it start anew.
SMALLEST_LIMIT = 1e-9


def with_tick_sign(ticks: DataFrame, series: Series = TICKS, first: int = 0) -> DataFrame:
    """Adds ``sign``; windows can't be nested, so the change is a column first."""
    ticks = ticks.withColumn("_change", F.nullif(F.signum(F.col("price") - series.lag("price")), F.lit(0.0)))
    return ticks.withColumn("sign", F.coalesce(series.carried(F.col("_change")), F.lit(float(first)))).drop("_change")


def _units(threshold: float, rows: int) -> tuple[float, int]:
    """(scale, limit): weights count in whole units, as fine as sums over so many rows allow, so that a sum doesn't depend on where it begins."""
    scale = 10.0 ** math.floor(math.log10(2**62 / (threshold * (rows + 1))))
    return scale, round(threshold * scale)


def _totals(weight: np.ndarray, threshold: float, scale: float, limit: int) -> np.ndarray:
    """Running sums in units, from 0; weights that are missing or negative are 0, and none is above the limit."""
    known = np.clip(np.nan_to_num(weight.astype(float), nan=0.0, posinf=threshold, neginf=0.0), 0.0, threshold)
    return np.concatenate([[0], np.cumsum(np.minimum(np.rint(known * scale).astype("int64"), limit))])


def block_map(total: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a block of ticks does to the sum of the bar that is open before it: (least, bars, open), rising in least.

    The last entry whose least is not above that sum tells how many bars end in the block and the sum that stays open; if there
    is none, no bar ends and the block's total is added. A step leads from each place to where the next bar begins; steps are
    joined pairwise until all stand still. Entries are at most as many as the ticks of the block or, where chains of bars meet, far fewer.
    """
    n = len(total) - 1
    to = np.searchsorted(total, total + limit)
    bars = (to <= n).astype("int64")
    last = np.where(to <= n, to, np.arange(n + 1))
    while not np.array_equal(further := last[last], last):
        bars, last = bars + bars[last], further
    at = np.arange(n, 0, -1)
    at = at[total[at] > 0]
    made, left = bars[at] + 1, total[n] - total[last[at]]
    new = np.ones(len(at), bool)
    new[1:] = (made[1:] != made[:-1]) | (left[1:] != left[:-1])
    return (limit - total[at])[new], made[new], left[new]


def block_bars(total: np.ndarray, limit: int, open_sum: int, first: int) -> np.ndarray:
    """Number of the bar of each tick of a block, then that of the bar after it, given the sum that is open before it and that bar's number."""
    to, at, begins = np.searchsorted(total, total + limit).tolist(), int(np.searchsorted(total, limit - open_sum)), np.zeros(len(total), "int64")
    while at < len(total):
        begins[at] = 1
        at = to[at]
    return first + np.cumsum(begins)


def threshold_ends(weight: np.ndarray, threshold: float) -> np.ndarray:
    """Number of the bar each tick belongs to; NaN for a bar that stays open."""
    scale, limit = _units(_positive(threshold), len(weight))
    *bar, after = block_bars(_totals(weight, threshold, scale, limit), limit, 0, 0)
    return np.where(np.array(bar) < after, bar, np.nan)


def threshold_bars(ticks: DataFrame, weight: Column, threshold: float, s: Series = TICKS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``bar``: the number of the bar each tick belongs to, null in a bar that stays open. A bar ends with the tick that brings
    its weight to the threshold; the overshoot is dropped. Weights that are null, not a number or negative count as nothing.

    Ticks are dealt by ranges and cut into blocks, whatever their symbol; each block yields its map from open sum to open sum, the maps
    are followed along each symbol, then every block numbers its own ticks. So one symbol may hold any share of all ticks; only the
    maps of its blocks meet in one task. The result is the same for any block size, up to the units' fineness.
    """
    keys, shift = list(s.keys), max(block_rows, 1).bit_length() - 1
    scale, limit = _units(_positive(threshold), 1 << shift)
    keep = [x for x in ticks.columns if x != "bar"]
    rows = in_order(ticks.select(*keep, weight.cast("double").alias("_weight")), [*keys, *s.order]).withColumn("_block", F.shiftright("_id", shift))
    heads = [*keys, "_block"]
    fields = lambda names: "".join(f"`{x}` {ticks.schema[x].dataType.simpleString()}, " for x in names)

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        for frame, at in whole_blocks(frames, heads):
            for a, b in zip(at, [*at[1:], len(frame)], strict=True):
                part = frame.iloc[a:b]
                yield part, _totals(part["_weight"].to_numpy(float, na_value=np.nan), threshold, scale, limit)

    def maps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, total in parts(frames):
            out = part[heads].head(1).reset_index(drop=True)
            for name, a in zip(("_least", "_made", "_left"), block_map(total, limit), strict=True):
                out[name] = [a]
            yield out.assign(_whole=total[-1])

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_block").reset_index(drop=True)
        carry, bar, carries, firsts = 0, 0, [], []
        for least, made, left, whole in zip(*(part[x] for x in ("_least", "_made", "_left", "_whole")), strict=True):
            carries.append(carry)
            firsts.append(bar)
            i = int(np.searchsorted(least, carry, "right")) - 1
            carry, bar = (carry + whole, bar) if i < 0 else (left[i], bar + made[i])
        return part[heads].assign(_carry=carries, _first=firsts, _bars=bar)

    def numbers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, total in parts(frames):
            bar = block_bars(total, limit, int(part["_carry"].iloc[0]), int(part["_first"].iloc[0]))[:-1]
            out = part[keep].copy()
            out["bar"] = pd.array(bar, dtype="Int64")
            out.loc[bar >= int(part["_bars"].iloc[0]), "bar"] = pd.NA
            yield out

    summed = rows.select(*heads, "_weight").mapInPandas(maps, f"{fields(keys)}_block bigint, _least array<bigint>, _made array<bigint>, _left array<bigint>, _whole bigint")
    starts = cut_lineage(summed.groupBy(*keys).applyInPandas(follow, f"{fields(keys)}_block bigint, _carry bigint, _first bigint, _bars bigint"))
    if starts.count() <= BROADCAST_BLOCKS:
        met = join_on(rows, F.broadcast(starts), heads)
    else:
        met = join_on(rows, starts, heads).sortWithinPartitions(*heads, "_id")
    return met.mapInPandas(numbers, f"{fields(keep)}bar bigint")


class AdaptiveEnds:
    """Numbers bars by a limit that follows the sizes of past bars; ticks pass in batches, and only sums are held between them.

    measure(sums): how large a bar would be by the sums of its sides up to each tick. The next end is searched in steps that
    double, so the loop goes over bars, not ticks. A limit that dies out starts anew.
    """

    def __init__(self, measure: Callable[[np.ndarray], np.ndarray], sides: int, threshold: float, alpha: float, least: int) -> None:
        self.measure, self.threshold, self.alpha, self.least = measure, threshold, alpha, max(least, 1)
        self.limit, self.bar, self.held = threshold, 0, 0
        self.total = self.base = np.zeros(sides)

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bar, whether it ends there) of each tick, given what it adds to each side."""
        n = values.shape[1]
        total = np.cumsum(np.concatenate([self.total[:, None], values], axis=1), axis=1)
        out, ends, start, a, step = np.empty(n, "int64"), np.zeros(n, bool), 0, max(self.least - 1 - self.held, 0), 64
        while a < n:
            sizes = self.measure(total[:, a + 1 : a + step + 1] - self.base[:, None])
            hit = int(np.argmax(sizes >= self.limit)) if (sizes >= self.limit).any() else -1
            if hit < 0:
                a, step = a + step, 2 * step
                continue
            end = a + hit + 1
            out[start:end], ends[end - 1], self.base = self.bar, True, total[:, end]
            self.limit += self.alpha * (float(sizes[hit]) - self.limit)
            if self.limit < SMALLEST_LIMIT:
                self.limit = self.threshold
            self.bar, self.held, start = self.bar + 1, 0, end
            a, step = start + self.least - 1, 64
        out[start:] = self.bar
        self.held, self.total = self.held + n - start, total[:, -1]
        return out, ends


def imbalance(threshold: float, alpha: float, least: int) -> AdaptiveEnds:
    """A bar ends when the imbalance, of either sign, reaches the limit."""
    return AdaptiveEnds(lambda sums: np.abs(sums[0]), 1, threshold, alpha, least)


def runs(threshold: float, alpha: float, least: int) -> AdaptiveEnds:
    """A bar ends when the ticks of one side reach the limit."""
    return AdaptiveEnds(lambda sums: sums.max(axis=0), 2, threshold, alpha, least)


def _signed(weight: np.ndarray) -> np.ndarray:
    return weight[None]


def _sides(sign: np.ndarray) -> np.ndarray:
    return np.stack([sign > 0, sign < 0]).astype(float)


def _whole_ends(ends: AdaptiveEnds, values: np.ndarray) -> np.ndarray:
    """Number of the bar each tick belongs to, NaN in a bar that stays open."""
    bar, _ = ends(values)
    return np.where(bar < ends.bar, bar, np.nan)


def imbalance_ends(signed: np.ndarray, threshold: float, alpha: float, least: int) -> np.ndarray:
    return _whole_ends(imbalance(threshold, alpha, least), _signed(signed))


def runs_ends(sign: np.ndarray, threshold: float, alpha: float, least: int) -> np.ndarray:
    return _whole_ends(runs(threshold, alpha, least), _sides(sign))


def _bars_of(ticks: DataFrame, ended: Column | None = None) -> DataFrame:
    """Bars by the ticks' numbers; ``ended``: an aggregate that tells which bars count."""
    at = F.struct("ts", "seq")
    out = ticks.filter("bar is not null").groupBy("symbol", "bar").agg(F.max("ts").alias("ts"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"), *([] if ended is None else [ended.alias("_ended")]))
    return (out if ended is None else out.filter("_ended")).select("symbol", "bar", "ts", "open", "high", "low", "close", "volume")


def _ended(ticks: DataFrame, weight: Column, start: Callable[[], AdaptiveEnds], values: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Adaptive bars of signed ticks. Each limit hangs on all bars before, so a symbol's ticks pass through one task, in order and
    batch by batch; a task holds one batch and the sums of the open bar."""
    rows = with_tick_sign(ticks.select(*TICK).repartition("symbol")).select(*TICK, weight.cast("double").alias("_weight")).sortWithinPartitions("symbol", "ts", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, ends = None, start()
        for frame in frames:
            for at in np.split(np.arange(len(frame)), np.flatnonzero(_changes(frame["symbol"]))):
                if not len(at):
                    continue
                part = frame.iloc[at[0] : at[-1] + 1]
                own = part["symbol"].iloc[0]
                if own != symbol and not (pd.isna(own) and pd.isna(symbol)):
                    symbol, ends = own, start()
                bar, last = ends(values(part["_weight"].to_numpy(float, na_value=np.nan)))
                yield part[list(TICK)].assign(bar=bar, _ends=last)

    fields = ", ".join(f"{x} {rows.schema[x].dataType.simpleString()}" for x in TICK)
    return _bars_of(rows.mapInPandas(run, f"{fields}, bar bigint, _ends boolean"), F.max("_ends"))


def _changes(values: pd.Series) -> np.ndarray:
    """Where a value differs from the one before it; null equals null."""
    before = values.shift()
    out = ((values != before) & ~(values.isna() & before.isna())).to_numpy(bool)
    out[:1] = False
    return out


def _positive(threshold: float) -> float:
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    return float(threshold)


def volume_bars(ticks: DataFrame, threshold: float) -> DataFrame:
    return _bars_of(threshold_bars(ticks.select(*TICK), F.col("size"), threshold))


def dollar_bars(ticks: DataFrame, threshold: float) -> DataFrame:
    return _bars_of(threshold_bars(ticks.select(*TICK), F.col("size") * F.col("price"), threshold))


def imbalance_bars(ticks: DataFrame, threshold: float, kind: str = "tick", alpha: float = 0.1, least: int = 1) -> DataFrame:
    """kind: tick, volume or dollar imbalance."""
    weight, threshold = {"tick": F.lit(1.0), "volume": F.col("size"), "dollar": F.col("size") * F.col("price")}[kind], _positive(threshold)
    return _ended(ticks, F.col("sign") * weight, lambda: imbalance(threshold, alpha, least), _signed)


def runs_bars(ticks: DataFrame, threshold: float, alpha: float = 0.1, least: int = 1) -> DataFrame:
    threshold = _positive(threshold)
    return _ended(ticks, F.col("sign"), lambda: runs(threshold, alpha, least), _sides)
