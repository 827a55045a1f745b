"""Removal of runs of lines that repeat across documents.

A text is cut into lines; long lines are first wrapped after sentence ends, so that a passage
within one line has several. Every least run of two or more lines and ``MIN_CHARS``
characters is a chunk, one from each line on and one up to each line; chunks overlap, and
any longer run is covered by those inside it, wherever it stands. A chunk that occurs again,
in the same or another document, is removed there; so all of a repeated run goes, up to its
first and last whole line. Chunks are equal if 128 bits are: a rolling hash and, of the
bytes, BLAKE2b, 64 bits each.
Each removed line has an equal one that stays: the one in the first occurrence, or that
line's own. An occurrence that overlaps the first one stays.

Scale: the chunks (no text) are written once as a table in the shared folder; their hashes
are counted with partial aggregation and meet the repeated ones in a shuffle join. Chunks
that make up more than one in ``HOT_SHARE`` of all, fewer than that many, are joined by
broadcast instead, so that no partition of the shuffle holds a hot one. No chunk reaches the
driver but these. No bytes of chunks move; the texts move once, to meet their list of removals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Shorter chunks are left alone.
MIN_CHARS = 40
#: A chunk that makes up more than one in this many of all occurrences is hot; there are fewer than this many.
HOT_SHARE = 1_000


def chunk_spans(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends, text numbers, hashes and ends without closing white space of the least runs of two or more
    lines. Hashes leave that white space out, so that a text's last line has equals within texts."""
    n = len(points)
    empty = np.zeros(0, np.int64)
    if not n:
        return empty, empty, empty, empty.astype(np.uint64), empty
    start = np.zeros(n + 1, bool)
    start[offsets] = True
    start[1:] |= points == 10
    stop = (points == 46) | (points == 33) | (points == 63)
    start[2:] |= stop[:-1] & (points[1:] == 32)
    lines = np.flatnonzero(start[:n])
    ends = np.append(lines[1:], n)
    owner = np.searchsorted(offsets, lines, side="right") - 1
    index = np.arange(len(lines))
    last = np.maximum(index + 1, np.searchsorted(ends, lines + MIN_CHARS))
    head = np.minimum(index - 1, np.searchsorted(lines, ends - MIN_CHARS, side="right") - 1)
    on = last < len(lines)
    on[on] = owner[index[on]] == owner[last[on]]
    back = head >= 0
    back[back] = owner[head[back]] == owner[index[back]]
    # both ways mostly give the same runs
    runs = np.unique(np.concatenate([index[on] * len(lines) + last[on], head[back] * len(lines) + index[back]]))
    heads, stops = runs // len(lines), runs % len(lines)
    a, b = lines[heads], ends[stops]
    black = np.maximum.accumulate(np.where((points == 32) | (points == 10) | (points == 13), -1, np.arange(n)))
    close = black[b - 1] + 1
    close = np.where(close > a, close, b)
    return a, b, owner[heads], shared.span_hashes(points, a, close), close


def _chunks(docs: DataFrame) -> DataFrame:
    """Rows (h, g, rk, id, start, size) of all chunks; start and size in bytes."""

    def run(batches):
        for batch in batches:
            for first, stop in shared.steps(batch.column(2)):
                text, offsets = shared.joined(batch.column(2)[first:stop])
                points = shared.code_points(text)
                a, b, owner, h, close = chunk_spans(points, offsets)
                widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
                place = np.concatenate([[0], np.cumsum(widths)])
                raw = memoryview(text.encode())
                g = b"".join([hashlib.blake2b(raw[i:j], digest_size=8).digest() for i, j in zip(place[a].tolist(), place[close].tolist(), strict=True)])
                rows = pa.array(owner + first, pa.int64())
                columns = [pa.array(h.view(np.int64)), pa.array(np.frombuffer(g, np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((place[a] - place[offsets[owner]]).astype(np.int64)), pa.array((place[b] - place[a]).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "g", "rk", "id", "start", "size"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("rk", "id", "text").mapInArrow(shared.tidy(run), f"h bigint, g bigint, rk bigint, id {kind}, start bigint, size bigint")


def removals(docs: DataFrame) -> DataFrame:
    """(rk, spans): the byte spans to remove from each row key's text, in order; they do not touch."""
    scratch = shared.Scratch(docs.sparkSession)
    chunks = scratch.keep(_chunks(docs))
    counted = chunks.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "rk", "start")).alias("first"))
    repeated = scratch.keep(counted.filter(F.col("n") > 1).select("h", "g", "n", F.col("first.rk").alias("first_rk"), F.col("first.start").alias("first_start")))
    is_hot = F.col("n") * HOT_SHARE > chunks.count()
    hot, places = F.broadcast(repeated.filter(is_hot).drop("n")), chunks.drop("id")
    rest = places.join(hot.select("h", "g"), ["h", "g"], "left_anti").join(repeated.filter(~is_hot).drop("n"), ["h", "g"])
    met = rest.unionByName(places.join(hot, ["h", "g"]))
    again = met.filter((F.col("rk") != F.col("first_rk")) | (F.col("start") >= F.col("first_start") + F.col("size")))
    spans = again.groupBy("rk").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("s"))
    # chunks are least runs, so that in order of starts the ends are in order too
    end = lambda x: x["start"] + x["size"]
    starts = F.transform(F.filter("s", lambda x, i: (i == 0) | (x["start"] > end(F.get("s", i - 1)))), lambda x: x["start"])
    ends = F.transform(F.filter("s", lambda x, i: (i == F.size("s") - 1) | (end(x) < F.get("s", i + 1)["start"])), end)
    out = scratch.keep(spans.select("rk", F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("size"))).alias("spans")))
    scratch.drop(chunks, repeated)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, the text without repeated runs, and ``n_removed`` runs.

    The occurrence with the smallest (id, text hash, place) stays. Null texts stay null with 0
    removed; a null id comes first in the order. Rows equal in id and text are one document
    and stay alike. A text may become empty; no row is dropped. Empty tables give no rows.
    A column of ``docs`` named ``n_removed`` is replaced.
    """
    held = [c for c in docs.columns if c.lower() != "n_removed"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in held)).alias("row"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rk"))
    keyed = rows.select("rk", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").alias("text"))
    joined = rows.join(removals(keyed), "rk", "left").withColumn("b", F.col(f"row.`{text_col}`").cast("binary"))
    end = lambda i: F.coalesce(F.get("spans", i)["start"] + F.get("spans", i)["size"], F.lit(0))
    piece = lambda i: F.substring("b", (end(i - 1) + 1).cast("int"), (F.coalesce(F.get("spans", i)["start"], F.octet_length("b").cast("bigint")) - end(i - 1)).cast("int")).cast("string")
    text = F.when(F.col("spans").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.size("spans")), piece), ""))
    columns = [text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in held]
    return joined.select(*columns, F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_removed"))
