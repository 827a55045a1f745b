"""Removal of passages of many words that occur anywhere else, exactly.

A window is a number of consecutive words. With blocks of half a window, rounded up, every
window holds a whole one of its document's non-overlapping blocks. So a window can only
repeat if that block does:

1. the non-overlapping blocks of all texts are the index, and every rolling window of block
   length probes it: a block is live if its words start anywhere else as well;
2. live blocks are extended to both sides, to all windows around them, and these are counted;
   neighbouring windows that repeat make up the maximal exact repeats, whose words go.

Equal means equal by hashes: 32 bits and more for blocks, which only choose candidates, and
96 bits for windows, from two polynomials over 128-bit BLAKE2b hashes of words. Among the
10 billion windows of 60 GB of text, the chance of a single false pair is below 10⁻⁸.

Scale: texts are written once as a table of chunks of about ``CHUNK_BYTES``. A chunk sends
each of its hashes once, however often it has it, packed by range of hashes; a range's task
answers each chunk with one bit a hash. So no hash, however frequent, has more than one entry
a chunk, and what comes back is a bitmap of a 144th of a byte a word for blocks, an eighth for
candidate windows. Answers within ``BROADCAST_BYTES`` meet their chunks by broadcast, larger
ones in a shuffle join. Nothing else reaches the driver. No pairs are made anywhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bytes of text of a chunk; a longer text stands alone.
CHUNK_BYTES = 4_000_000
#: Bytes of text whose words one range of hashes holds, about, and the least number of ranges.
RANGE_BYTES, LEAST_RANGES = 64_000_000, 64
BROADCAST_BYTES = 64_000_000
#: Bytes of a text that are split at once.
SEGMENT = 1 << 22

_WHITE = re.compile(rb"[ \t-\r]")
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_BITS = "array<struct<bucket: int, n: int, bits: binary>>"


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, in lists of bounded size; bytes.split() cuts at [\\x20\\x09-\\x0D]."""
    start = 0
    while start < len(raw):
        stop = len(raw)
        if stop - start > SEGMENT and (end := _WHITE.search(raw, start + SEGMENT)):
            stop = end.start()
        yield raw[start:stop].split()
        start = stop


class _Hashes(dict):
    def __init__(self) -> None:
        self.raw: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.raw)
        self.raw.append(hashlib.blake2b(word, digest_size=16).digest())
        return n


class Chunk:
    """Word hashes of a chunk's texts, and the places of blocks and windows in them."""

    def __init__(self, texts: list[bytes | None], window: int) -> None:
        table, parts, sizes = _Hashes(), [], []
        for raw in texts:
            ids = [np.fromiter(map(table.__getitem__, w), np.int32, len(w)) for w in words_of(raw or b"")]
            parts += ids
            sizes.append(sum(map(len, ids)))
        ids = np.concatenate([np.zeros(0, np.int32), *parts])
        self.words = np.frombuffer(b"".join(table.raw), np.uint64).reshape(-1, 2)[ids]
        self.window, self.block = window, (window + 1) // 2
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        owner = np.repeat(np.arange(len(sizes)), self.sizes)
        self.local = np.arange(len(ids)) - self.starts[owner]
        left = self.sizes[owner] - self.local
        long = self.sizes[owner] >= window
        self.rolling = np.flatnonzero(long & (left >= self.block))
        self.aligned = long & (left >= self.block) & (self.local % self.block == 0)
        self.windows = np.flatnonzero(left >= window)

    def _hash(self, at: np.ndarray, n: int, k: int) -> np.ndarray:
        return shared.span_hashes(self.words[:, k], at, at + n, _BASES[k])

    def blocks(self, power: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different hashes of ``power`` + 32 bits of the rolling windows, in order; whether there are several of
        each; whether one is a block's; and for each block, in order of place, its hash's number."""
        keys = self._hash(self.rolling, self.block, 0) >> np.uint64(32 - power)
        unique, first = np.unique(keys, return_inverse=True)
        is_block = self.aligned[self.rolling]
        indexed = np.zeros(len(unique), bool)
        indexed[first[is_block]] = True
        return unique, np.bincount(first, minlength=len(unique)) > 1, indexed, first[is_block]

    def candidates(self, live: np.ndarray) -> np.ndarray:
        """Starts of the windows whose first whole block is live."""
        at = np.zeros(len(self.words) + 1, bool)
        at[self.rolling[self.aligned[self.rolling]][live]] = True
        block = self.windows + (-self.local[self.windows]) % self.block
        return self.windows[at[block]]

    def extended(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different windows among those that start at ``at``: both hashes, in order; whether there are several
        of each; and each start's number among them."""
        x, y = self._hash(at, self.window, 0), self._hash(at, self.window, 1) >> np.uint64(32)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(x)]
        number = np.zeros(len(at), np.int64)
        number[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        return x[first], y[first].astype(np.uint32), np.diff(np.append(first, len(x))) > 1, number

    def covered(self, at: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(self.words) + 1, np.int64)
        edge[at] += 1
        np.add.at(edge, at + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def pack(values: np.ndarray) -> bytes:
    """Differences of rising values, byte plane by byte plane: the shuffle's compression drops the empty ones."""
    return np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unpack(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(kind), dtype=kind)


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _answers(rows: list[dict] | None) -> np.ndarray:
    """The bits of all ranges, in order."""
    rows = sorted(rows or [], key=lambda r: r["bucket"])
    return np.concatenate([np.zeros(0, bool), *(_flags(r["bits"], r["n"]) for r in rows)])


def _chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, size, ids, texts): consecutive documents of a task."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        base, n = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0

        def row():
            types = pa.list_(kind), pa.list_(pa.string())
            columns = [pa.array([base + n]), pa.array([size]), pa.array([ids], types[0]), pa.array([texts], types[1])]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "size", "ids", "texts"])

        for batch in batches:
            kind = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(key)
                texts.append(text)
                size += 4 * len(text or "") if text and not text.isascii() else len(text or "")
                if size >= CHUNK_BYTES:
                    yield row()
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield row()

    return docs.mapInArrow(shared.tidy(run), f"chunk bigint, size bigint, ids array<{id_type}>, texts array<string>")


def _rows(batches) -> Iterator[tuple]:
    """Chunk by chunk: its other columns and the texts as bytes."""
    for batch in batches:
        at = batch.schema.get_field_index("texts")
        for i in range(batch.num_rows):
            texts = batch.column(at)[i].values.cast(pa.binary()).to_pylist()
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names) if k != at}, texts


def _by_bucket(batches) -> Iterator[tuple[int, list[dict]]]:
    """Rows in order of ``bucket``, one bucket at a time."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield held[0]["bucket"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["bucket"], held


def _ranges(keys: np.ndarray, shift: int, power: int) -> Iterator[tuple[int, int, int]]:
    """(range, start, stop) of the ranges that sorted keys fall into."""
    edges = np.searchsorted(keys >> np.uint64(shift), np.arange((1 << power) + 1).astype(np.uint64))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, int(edges[b]), int(edges[b + 1])


_ANSWER = "chunk bigint, bucket int, n int, bits binary"


def _answer(rows: list[dict], chosen: list[np.ndarray]) -> pa.RecordBatch:
    bits = [np.packbits(c).tobytes() for c in chosen]
    columns = [pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([r["bucket"] for r in rows], pa.int32()), pa.array([len(c) for c in chosen], pa.int32()), pa.array(bits, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", "n", "bits"])


def _live_blocks(chunks: DataFrame, window: int, power: int) -> DataFrame:
    """(chunk, live): whether each different block's words occur elsewhere."""

    def probe(batches):
        for row, texts in _rows(batches):
            keys, several, indexed, _ = Chunk(texts, window).blocks(power)
            low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            found = list(_ranges(keys, 32, power))
            columns = [pa.array([b for b, _, _ in found], pa.int32()), pa.array([row["chunk"]] * len(found), pa.int64()), pa.array([j - i for _, i, j in found], pa.int32())]
            columns += [pa.array([pack(low[i:j]) for _, i, j in found], pa.binary())]
            columns += [pa.array([np.packbits(f[i:j]).tobytes() for _, i, j in found], pa.binary()) for f in (several, indexed)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "n", "keys", "several", "indexed"])

    def meet(batches):
        for _, rows in _by_bucket(batches):
            keys = np.concatenate([unpack(r["keys"], np.uint32) for r in rows])
            several = np.concatenate([_flags(r["several"], r["n"]) for r in rows])
            order = np.argsort(keys, kind="stable")
            ranked = keys[order]
            twice = np.concatenate([ranked[1:] == ranked[:-1], [False]])
            twice[1:] |= twice[:-1].copy()
            live = several.copy()
            live[order] |= twice
            indexed = np.concatenate([_flags(r["indexed"], r["n"]) for r in rows])
            ends = np.cumsum([r["n"] for r in rows])
            yield _answer(rows, [live[e - r["n"] : e][indexed[e - r["n"] : e]] for r, e in zip(rows, ends)])

    probes = chunks.select("chunk", "texts").mapInArrow(shared.tidy(probe), "bucket int, chunk bigint, n int, keys binary, several binary, indexed binary")
    met = probes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared.tidy(meet), _ANSWER)
    return met.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("live"))


def _live(chunk: Chunk, power: int, answer: list[dict] | None) -> np.ndarray:
    """For each block of the chunk, whether it is live."""
    unique, _, indexed, number = chunk.blocks(power)
    out = np.zeros(len(unique), bool)
    out[np.flatnonzero(indexed)] = _answers(answer)
    return out[number]


def _repeated_windows(chunks: DataFrame, window: int, power: int) -> DataFrame:
    """(chunk, twice): whether each different candidate window occurs elsewhere."""

    def extend(batches):
        for row, texts in _rows(batches):
            chunk = Chunk(texts, window)
            x, y, several, _ = chunk.extended(chunk.candidates(_live(chunk, power, row["live"])))
            found = list(_ranges(x, 64 - power, power))
            columns = [pa.array([b for b, _, _ in found], pa.int32()), pa.array([row["chunk"]] * len(found), pa.int64()), pa.array([j - i for _, i, j in found], pa.int32())]
            columns += [pa.array([pack(x[i:j]) for _, i, j in found], pa.binary()), pa.array([y[i:j].tobytes() for _, i, j in found], pa.binary())]
            columns += [pa.array([np.packbits(several[i:j]).tobytes() for _, i, j in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "n", "x", "y", "several"])

    def meet(batches):
        for _, rows in _by_bucket(batches):
            x = np.concatenate([unpack(r["x"], np.uint64) for r in rows])
            y = np.concatenate([np.frombuffer(r["y"], np.uint32) for r in rows])
            twice = np.concatenate([_flags(r["several"], r["n"]) for r in rows])
            order = np.lexsort((y, x))
            same = (x[order][1:] == x[order][:-1]) & (y[order][1:] == y[order][:-1])
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            ends = np.cumsum([r["n"] for r in rows])
            yield _answer(rows, [twice[e - r["n"] : e] for r, e in zip(rows, ends)])

    probes = chunks.select("chunk", "texts", "live").mapInArrow(shared.tidy(extend), "bucket int, chunk bigint, n int, x binary, y binary, several binary")
    met = probes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared.tidy(meet), _ANSWER)
    return met.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("twice"))


def _with(chunks: DataFrame, answers: DataFrame, column: str) -> DataFrame:
    """``chunks`` with their answers; the answers must be a written table."""
    size = answers.agg(F.sum(F.aggregate(column, F.lit(0), lambda s, a: s + F.octet_length(a["bits"]) + 16))).first()[0] or 0
    return chunks.join(F.broadcast(answers) if size <= BROADCAST_BYTES else answers, "chunk", "left")


def dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, text): each document without the words of repeated windows.

    A word goes if any run of ``window`` words that holds it starts anywhere else too, in the
    same or another document; all occurrences go. Words are maximal runs outside
    [\\x20\\x09-\\x0D]; the kept ones are joined by one space. A null text has no words and gives
    an empty text. Rows with equal id and text are documents of their own, so that each makes the other's
    windows repeat. Null ids stay null. Empty tables give no rows.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    scratch = shared.Scratch(docs.sparkSession)
    chunks = scratch.keep(_chunks(docs, id_col, text_col))
    total = chunks.agg(F.sum("size")).first()[0] or 0
    power = max(LEAST_RANGES - 1, -(-total // RANGE_BYTES) - 1).bit_length()
    live = scratch.keep(_live_blocks(chunks, window, power))
    twice = scratch.keep(_repeated_windows(_with(chunks, live, "live"), window, power))
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def remove(batches):
        for row, texts in _rows(batches):
            chunk = Chunk(texts, window)
            at = chunk.candidates(_live(chunk, power, row["live"]))
            *_, number = chunk.extended(at)
            stays = ~chunk.covered(at[_answers(row["twice"])[number]])
            kept, place = [], 0
            for raw in texts:
                words: list[bytes] = []
                for part in words_of(raw or b""):
                    words += compress(part, stays[place : place + len(part)].tolist())
                    place += len(part)
                kept.append(b" ".join(words))
            removed = chunk.sizes - np.diff(np.concatenate([[0], np.cumsum(stays)])[chunk.starts])
            columns = [pa.array(row["ids"], kind), pa.array(chunk.sizes), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "text"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.select(F.col(id_col)).schema[0].dataType)
    answered = _with(_with(chunks, live, "live"), twice, "twice").select("chunk", "ids", "texts", "live", "twice")
    return answered.mapInArrow(shared.tidy(remove), f"id {id_type}, n_words bigint, n_removed bigint, text string")
