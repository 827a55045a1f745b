"""Loading by gaps: a store of bars with a manifest of the ranges that have been asked for.

A load fetches only what no earlier load has asked for, and records what it asked for, not what came, so that an empty
range is not fetched again. Bars are written first, each load into a folder of its own; a single file in the manifest
then makes them count. A load that dies before leaves bars that nothing reads, and its gaps stay open. Two loads at once
don't touch each other's files; where both fetched the same bars, the later commit's stand.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordering import cut_lineage
from ..operators.temporal import coverage, uncovered

c = F.col

MANIFEST = "symbol string, interval string, start timestamp_ntz, end timestamp_ntz, batch string, committed bigint"
BARS = "ts timestamp_ntz, open double, high double, low double, close double, volume double, batch string, interval string, symbol string, year int"
FETCHED = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
#: Gaps beyond so many days are fetched in parts, which tasks share.
PART_DAYS = 366

Vendor = Callable[[DataFrame], DataFrame]


def by_gap(fetch: Callable[[str, object, object, str], pd.DataFrame]) -> Vendor:
    """A vendor from a function (symbol, start, end, interval) -> frame with ts, open, high, low, close and volume.
    Gaps are dealt over the tasks; long ones are cut."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for gap in frame.itertuples(index=False):
                got = fetch(gap.symbol, gap.start, gap.end, gap.interval)
                yield got.assign(symbol=gap.symbol)[["symbol", "ts", "open", "high", "low", "close", "volume"]]

    def vendor(gaps: DataFrame) -> DataFrame:
        step = F.make_dt_interval(F.lit(PART_DAYS))
        cuts = F.filter(F.sequence("start", c("end"), step), lambda t: t < c("end"))
        parts = gaps.select("symbol", "interval", "end", F.explode(cuts).alias("start"))
        parts = parts.withColumn("end", F.least(c("end"), c("start") + step)).select("symbol", "start", "end", "interval")
        return parts.repartition("symbol", "start").mapInPandas(run, FETCHED)

    return vendor


def from_table(bars: DataFrame) -> Vendor:
    """A vendor whose bars are a table: of each gap those with start <= ts < end."""

    def vendor(gaps: DataFrame) -> DataFrame:
        # gaps of a symbol are disjoint: the last one that starts at or before a bar is the only one that may hold it
        bar = F.struct("open", "high", "low", "close", "volume")
        both = bars.select("symbol", "ts", bar.alias("_bar"), F.lit(None).cast("timestamp_ntz").alias("_end")).unionByName(gaps.select("symbol", c("start").alias("ts"), F.lit(None).cast(bars.select(bar.alias("b")).schema[0].dataType).alias("_bar"), c("end").alias("_end")))
        w = Window.partitionBy("symbol").orderBy("ts", c("_bar").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_until", F.last("_end", ignorenulls=True).over(w))
        return found.filter(c("_bar").isNotNull() & (c("ts") < c("_until"))).select("symbol", "ts", "_bar.*")

    return vendor


class GapStore:
    """Bars and manifest under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> DataFrame:
        """(symbol, interval, start, end, batch, committed), one row for each range of each commit."""
        try:
            return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.root}/manifest")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def covered(self, interval: str) -> DataFrame:
        """(symbol, start, end): disjoint ranges that have been asked for."""
        return coverage(self.manifest().filter(c("interval") == interval))

    def gaps(self, asked: DataFrame, interval: str) -> DataFrame:
        """(symbol, start, end): the parts of ``asked`` that no commit has."""
        return uncovered(asked.select("symbol", "start", "end"), self.manifest().filter(c("interval") == interval).select("symbol", "start", "end"))

    def put(self, bars: DataFrame, interval: str) -> str:
        """Writes bars that don't count yet; returns their batch."""
        batch = uuid.uuid4().hex
        rows = bars.select("ts", "open", "high", "low", "close", "volume", F.lit(batch).alias("batch"), F.lit(interval).alias("interval"), "symbol", F.year("ts").alias("year"))
        # one folder a batch, by interval, symbol and year as readers look for them
        dealt = rows.repartition("symbol", "year").sortWithinPartitions("symbol", "ts").drop("batch", "interval")
        dealt.write.partitionBy("symbol", "year").parquet(f"{self.root}/bars/batch={batch}/interval={interval}")
        return batch

    def commit(self, ranges: DataFrame, interval: str, batch: str) -> None:
        """Makes a batch count, for these ranges: one file, which appears as a whole or not at all."""
        rows = ranges.select("symbol", F.lit(interval).alias("interval"), "start", "end", F.lit(batch).alias("batch"), F.lit(time.time_ns()).alias("committed"))
        rows.coalesce(1).write.parquet(f"{self.root}/manifest/{batch}")

    def get(self, asked: DataFrame, interval: str) -> DataFrame:
        """(symbol, ts, open, high, low, close, volume) of the committed bars within the asked ranges, each once."""
        # the batches are named one by one: what is not committed is not listed, and Spark takes two reads of one folder for
        # the same within a plan, whatever has been added between them
        commits = self.manifest().filter(c("interval") == interval).groupBy("batch").agg(F.max("committed").alias("committed")).collect()  # one row a load
        if not commits:
            return self.spark.createDataFrame([], FETCHED)
        paths = [f"{self.root}/bars/batch={r.batch}/interval={interval}" for r in commits]
        bars = self.spark.read.schema(BARS).option("basePath", f"{self.root}/bars").parquet(*paths)
        bars = bars.join(F.broadcast(self.spark.createDataFrame(commits)), "batch")  # one row a load
        newest = bars.groupBy("symbol", "ts").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), F.struct("committed", "batch")).alias("_bar"))
        rows = newest.select("symbol", "ts", "_bar.*")
        return from_table(rows)(coverage(asked.select("symbol", "start", "end").filter("start < end")))


def load(store: GapStore, vendor: Vendor, asked: DataFrame, interval: str) -> DataFrame:
    """Bars of the asked ranges (symbol, start, end); only what no load has asked for before is fetched."""
    gaps = cut_lineage(store.gaps(asked, interval))
    if gaps.head(1):
        batch = store.put(vendor(gaps.withColumn("interval", F.lit(interval))), interval)
        store.commit(gaps, interval, batch)
    return store.get(asked, interval)


def load_adjusted(store: GapStore, vendor: Vendor, asked: DataFrame, interval: str, actions: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """``load``, back-adjusted for (symbol, ts, kind, ratio, cash) and kept to the dates of ``sessions`` where given."""
    from ..operators.temporal import back_adjust

    bars = load(store, vendor, asked, interval)
    if actions is not None:
        bars = back_adjust(bars, actions)
    if sessions is not None:
        bars = bars.join(sessions.select(c("date").alias("_date")).distinct(), F.to_date("ts") == c("_date"), "left_semi")
    return bars
