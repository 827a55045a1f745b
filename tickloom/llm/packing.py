"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised once into narrow piece rows (no text, no ids); these are dealt out
evenly over tasks of bounded size, whatever their keys, and each task packs its pieces by
best-fit decreasing: pieces in falling length, each into the open bin with the least room
that still holds it. A segment tree over the remaining capacities finds that bin in
logarithmic time. A task's packing depends only on its rows, not on their order.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, shared

#: Pieces that one task packs; a task holds some tens of bytes for each.
PIECES_PER_TASK = 100_000

_LIBRARY: dict[str, bpe.Encoder] = {}


def library_encoder(path: str) -> bpe.Encoder:
    """Splits like the file's own pre-tokeniser; the tokenizers library encodes each new pre-token."""
    if path not in _LIBRARY:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        _LIBRARY[path] = bpe.Encoder(special, lambda pieces: [e.ids for e in batch(pieces, add_special_tokens=False)])
    return _LIBRARY[path]


class CapacityTree:
    """Segment tree over remaining capacities 0..size; each leaf holds the open bins with that room."""

    def __init__(self, size: int) -> None:
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        node = self.leaves + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes a bin with the least room of at least ``need``; its room and number."""
        count, node = self.count, self.leaves + need
        if not count[node]:
            # up to the first right sibling with a bin, then down its left-most path
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; lengths must fall."""
    tree, bins, offsets, opened = CapacityTree(size), [], [], 0
    for n in lengths:
        found = tree.take(n)
        if found is None:
            room, bin_ = size, opened
            opened += 1
        else:
            room, bin_ = found
        bins.append(bin_)
        offsets.append(size - room)
        if room > n:
            tree.add(room - n, bin_)
    return bins, offsets


def pieces_of(docs: DataFrame, path: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each piece: id, piece, start, length, CRC-32 of its ids."""

    def run(batches):
        encoder = library_encoder(path)
        for batch in batches:
            for a, b in shared.steps(batch.column(1)):
                ids, offsets = encoder.encode(batch.column(1)[a:b])
                rows, numbers, starts, lengths, sums = [], [], [], [], []
                for row, (i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    own = np.append(ids[i:j], end_id).astype("<u4")
                    first = len(own) % size or size
                    cuts = [0, *range(first, len(own) + 1, size)] if len(own) > size else [0, len(own)]
                    for piece, (p, q) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(a + row)
                        numbers.append(piece)
                        starts.append(p)
                        lengths.append(q - p)
                        sums.append(zlib.crc32(own[p:q]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(shared.tidy(run), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``size`` tokens.

    A document is its ids and ``end_id``; only one longer than ``size`` is cut, into pieces of
    ``size`` of which the first may be shorter. Null and empty texts are one piece of one id.
    Repeated rows are packed each for itself; null ids stay null; other columns are not read;
    an empty table gives no rows. ``sequence_id`` has the packing task in its upper bits.
    """
    pieces = shared.cut_lineage(pieces_of(docs, path, size, end_id, id_col, text_col))
    tasks = max(1, -(-pieces.count() // per_task))

    def run(batches):
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        table = pa.Table.from_batches(batches).sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_fit_decreasing(table.column("length").to_pylist(), size)
        place = TaskContext.get().partitionId() << 40
        table = table.append_column("sequence_id", pa.array(np.array(bins, np.int64) + place)).append_column("offset", pa.array(offsets, pa.int64()))
        yield from table.combine_chunks().to_batches(max_chunksize=50_000)

    kind = docs.schema[id_col].dataType.simpleString()
    out = pieces.repartition(tasks).mapInArrow(shared.tidy(run), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
