"""Places in a global order without a window over everything, and lineage cut in the shared folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; only a local session that names none gets a
    temporary one, as no other machine could read it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tickloom-"))
    return named or sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null meets null; the left keys stay."""
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    on = F.lit(True)
    for k, name in names.items():
        on = on & F.col(k).eqNullSafe(F.col(name))
    return left.join(right, on, how).drop(*names.values())


def in_order(df: DataFrame, order: Sequence[str], column: str = "_id") -> DataFrame:
    """The rows dealt by ranges of ``order``, sorted, with an id that rises in that order (with gaps between
    partitions); written, so that all that follows sees the same partitions."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(dealt.withColumn(column, F.monotonically_increasing_id()))


def numbered(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), column: str = "_n") -> DataFrame:
    """Adds the row's number in ``order``, from 0, within each group of ``keys``.

    Rows are dealt by ranges and counted by partition; only the counts of the partitions (and groups in
    them) meet in one task. So one group may hold all rows. Ties of ``order`` are numbered in any way.
    """
    rows = in_order(df, [*keys, *order]).withColumn("_part", F.shiftright("_id", 33))
    counts = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    joined = join_on(rows, counts, [*keys, "_part"])
    return joined.withColumn(column, F.col("_before") + F.col("_id") - F.col("_first")).drop("_id", "_part", "_before", "_first")


def lagged(df: DataFrame, value: str, lags: int, number: str, keys: Sequence[str] = (), block: int = 100_000) -> DataFrame:
    """Adds ``<value>_1`` to ``<value>_<lags>``: the values that many numbers before, null where there is none.

    Windows stand on blocks of numbers; the rows that a block looks back to are sent to it as well.
    """
    own = F.floor(F.col(number) / block)
    rows = df.withColumn("_own", own).withColumn("_block", F.explode(F.array_distinct(F.array(own, F.floor((F.col(number) + lags) / block)))))
    w = Window.partitionBy(*keys, "_block").orderBy(number)
    rows = rows.withColumns({f"{value}_{k}": F.lag(value, k).over(w) for k in range(1, lags + 1)})
    return rows.filter(F.col("_own") == F.col("_block")).drop("_own", "_block")


def whole_blocks(frames: Iterator[pd.DataFrame], heads: Sequence[str], rows: int = 65_536) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of about ``rows`` rows made of whole blocks (rows equal in ``heads``, which lie together), and where the blocks begin in them."""
    held: list[pd.DataFrame] = []

    def starts(f: pd.DataFrame) -> np.ndarray:
        first = np.zeros(len(f), bool)
        first[:1] = True
        for h in heads:
            v = f[h]
            first[1:] |= ((v != v.shift()) & ~(v.isna() & v.shift().isna())).to_numpy(bool)[1:]
        return np.flatnonzero(first)

    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= rows:
            whole = pd.concat(held, ignore_index=True)
            at = starts(whole)
            if len(at) > 1:
                yield whole.iloc[: at[-1]], at[:-1]
                whole = whole.iloc[at[-1] :]
            held = [whole]
    if held and sum(map(len, held)):
        whole = pd.concat(held, ignore_index=True)
        yield whole, starts(whole)
