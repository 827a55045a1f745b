"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Characters that one vectorised step handles; bounds the arrays' memory, not the texts.
STEP_CHARS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``. Only a local session that names none
    (tests) gets a temporary one; on a cluster no other machine could read it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
    return named or sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables of one run in the shared folder. Written ones cut the lineage, outlive lost executors
    and can be dropped as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.base = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            remove_folder(self.spark, self.paths[id(table)][1])


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare_name(df: DataFrame, wish: str) -> str:
    """A column name that the frame does not use yet (case-insensitively)."""
    used = {c.lower() for c in df.columns}
    while wish.lower() in used:
        wish += "_"
    return wish


def tidy(run: Callable) -> Callable:
    """``run`` over a task's batches; at the task's end its freed memory goes back, as workers are used again
    and stay beside those of later stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def steps(column: pa.Array, limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with at most about ``limit`` bytes each; a longer row stands alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def joined(column: pa.Array) -> tuple[str, np.ndarray]:
    """All texts as one string, and the code point offsets of the texts in it (null: empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return "".join(column.to_pylist()), np.concatenate([[0], np.cumsum(lengths)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n + 1 of each."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, STEP_CHARS + 1)
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            have = tuple(
                np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64), dtype=np.uint64)])
                for b in (base, inverse)
            )
        if size <= 8 * STEP_CHARS:
            _POWERS[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hashes of the spans values[start:end], by a polynomial prefix hash."""
    up, down = powers(base, len(values))
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes_at(values: np.ndarray, starts: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """``span_hashes`` of short spans that all have n values."""
    up, _ = powers(base, n)
    with np.errstate(over="ignore"):
        h = np.zeros(len(starts), np.uint64)
        for k in range(n):
            h += (values[starts + k].astype(np.uint64) + np.uint64(1)) * up[k]
        return mix(h + np.uint64(n) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs outside [\\x20\\x09-\\x0D]."""
    inside = ~((points == 32) | ((points >= 9) & (points <= 13)))
    edge = np.zeros(len(points) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[: len(points)]))
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1
