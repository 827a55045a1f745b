"""Near-duplicate documents by ProbMinHash.

Shingles of five words are weighted by how often a text has them. Each shingle is a Poisson
process with its weight as rate; its arrivals fall on random registers, a register keeps the
earliest arrival, and a shingle stops as soon as it can't be the earliest anywhere. Two
texts agree on a register with the probability Jaccard similarity of their weights. Bands of
registers give candidates, which are verified by the exact probability Jaccard.

Exact copies are first folded into one node. Texts that share a bucket (a band with its
registers) are candidates. Buckets with the same members count once. Each member is verified
against its bucket's smallest node, which ties most copies; a bucket whose members are not one
class by then is compared exactly, block by block. So every two candidates are compared, or
are in one class already; no link between candidates is lost. What leaves a task is a tie of
two classes, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .graph import connected_components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
REGISTERS = 128
#: Members and shingles of a block; a larger bucket has several, each of which meets each.
BLOCK, BLOCK_KEYS = 512, 1_000_000
#: Columns of the matrices that are multiplied at a time.
COLUMNS = 4_096
#: Rows of integers up to which a side is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def shingles(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of the distinct shingles, in order of text and hash; a text
    of one to four words has one shingle of all its words."""
    starts, ends, owner = shared.word_spans(points, offsets)
    words = shared.span_hashes(points, starts, ends)
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    stops = np.cumsum(counts)
    heads = stops - counts
    full = np.flatnonzero(np.arange(len(words)) + WORDS <= np.repeat(stops, counts))
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    h = np.concatenate([shared.span_hashes_at(words, full, WORDS), shared.span_hashes(words, heads[short], stops[short])])
    text = np.concatenate([owner[full], short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def signatures(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The shingle that is first in each register, for each of n texts (0 where there is none)."""
    first = np.full(n * REGISTERS, np.inf)
    who = np.zeros(n * REGISTERS, np.uint64)
    latest = np.full(n, np.inf)
    now = np.zeros(len(h))
    live, turn = np.arange(len(h)), 0
    while len(live):
        k = int(np.clip(30_000 // len(live), 1, 64))
        with np.errstate(over="ignore"):
            draw = shared.mix(h[live, None] ^ shared.mix(np.arange(turn + 1, turn + k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live, None]
        time = now[live, None] + np.cumsum(gap, axis=1)
        slot = text[live, None] * REGISTERS + (draw & np.uint64(REGISTERS - 1)).astype(np.int64)
        early = time < first[slot]
        where, when = slot[early], time[early]
        names = np.broadcast_to(h[live, None], slot.shape)[early]
        np.minimum.at(first, where, when)
        won = first[where] == when
        who[where[won]] = names[won]
        now[live] = time[:, -1]
        turn += k
        touched = np.unique(text[live])
        latest[touched] = first.reshape(n, REGISTERS)[touched].max(axis=1)
        live = live[now[live] < latest[text[live]]]
    return who.reshape(n, REGISTERS)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets with sorted keys."""
    keys = np.union1d(a, b)
    u, v = np.zeros(len(keys)), np.zeros(len(keys))
    u[np.searchsorted(keys, a)], v[np.searchsorted(keys, b)] = x, y
    if (u == v).all():
        return 1.0
    if set(np.unique(x)) <= {1} and set(np.unique(y)) <= {1}:
        return float(((u > 0) & (v > 0)).sum() / len(keys)) if len(keys) else 0.0
    with np.errstate(divide="ignore"):
        ratio = np.where(u > 0, v / np.where(u > 0, u, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    u, v, ratio = u[order], v[order], ratio[order]
    # for a shared key: keys with a smaller ratio count by u, the others by v
    stop = np.searchsorted(ratio, ratio, side="right")
    below, above = np.concatenate([[0], np.cumsum(u)]), np.concatenate([[0], np.cumsum(v)])
    both = (u > 0) & (v > 0)
    return float((1 / (below[stop[both]] / u[both] + (above[-1] - above[stop[both]]) / v[both])).sum())


def _band_rows(rows: DataFrame) -> DataFrame:
    """(node, id, digest, size, bands): number of distinct shingles, 64-bit hash of each band with its number; null where a text has no word."""

    def run(batches):
        for batch in batches:
            for a, b in shared.steps(batch.column(2)):
                for c in range(a, b, 2000):
                    part = batch.slice(c, min(2000, b - c))
                    text, offsets = shared.joined(part.column(2))
                    owner, h, count = shingles(shared.code_points(text), offsets)
                    sig = signatures(owner, h, count, len(part))
                    with np.errstate(over="ignore"):
                        bands = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(part), BANDS))
                        for r in range(ROWS):
                            bands = shared.mix(bands + sig[:, np.arange(BANDS) * ROWS + r] + np.uint64(r + 1))
                    size = np.bincount(owner, minlength=len(part))
                    flat = pa.array(bands.view(np.int64).ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat, mask=pa.array(size == 0))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(size, pa.int64()), lists], ["node", "id", "digest", "size", "bands"])

    return rows.select("node", "id", "text", "digest").mapInArrow(shared.tidy(run), "node bigint, id bigint, digest binary, size bigint, bands array<bigint>")


def _sets(rows: DataFrame) -> DataFrame:
    """(node, keys, counts): shingle hashes in order with their counts (null: all one)."""

    def run(batches):
        for batch in batches:
            for a, b in shared.steps(batch.column(1)):
                part = batch.slice(a, b - a)
                text, offsets = shared.joined(part.column(1))
                owner, h, count = shingles(shared.code_points(text), offsets)
                stops = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(part)))])
                at = pa.array(stops, pa.int32())
                ones = np.array([bool((count[i:j] == 1).all()) for i, j in zip(stops[:-1], stops[1:], strict=True)])
                counts = pa.ListArray.from_arrays(at, pa.array(count, pa.int32()), mask=pa.array(ones))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(h.view(np.int64))), counts], ["node", "keys", "counts"])

    return rows.select("node", "text").mapInArrow(shared.tidy(run), "node bigint, keys array<bigint>, counts array<int>")


def _small(side: DataFrame, rows: int | None = None) -> DataFrame:
    """The side, marked for broadcast if it is a table of few rows."""
    return F.broadcast(side) if (side.count() if rows is None else rows) <= BROADCAST_ROWS else side


def _members(part: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], list[bool]]:
    """Keys, counts and whether all counts are one, of the rows of a group."""
    keys = [x.values.to_numpy().view(np.uint64) for x in part.column("keys")]
    counts = [x.values.to_numpy() if x.is_valid else np.ones(len(k), np.int64) for x, k in zip(part.column("counts"), keys, strict=True)]
    return keys, counts, [not x.is_valid for x in part.column("counts")]


def _alike(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, plain: bool, threshold: float) -> bool:
    if plain:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= (threshold - 1e-12) * (len(a) + len(b) - both)
    return probability_jaccard(a, x, b, y) >= threshold - 1e-12


def _shares(keys: list[np.ndarray], mass: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For members of side 0 (rows) and side 1 (columns): the row's and the column's mass on shared keys."""
    sizes = [len(k) for k in keys]
    owner = np.repeat(np.arange(len(keys)), sizes)
    names, column, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]  # a key of one member is shared with none
    value = np.concatenate(mass)
    rows = [np.flatnonzero(side != 1), np.flatnonzero(side != 0)]
    place = [np.full(len(keys), -1) for _ in rows]
    for p, r in zip(place, rows, strict=True):
        p[r] = np.arange(len(r))
    order = np.argsort(column, kind="stable")
    column, owner, value = column[order], owner[order], value[order]
    left, right = (np.zeros((len(rows[0]), len(rows[1]))) for _ in range(2))
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [c, c + COLUMNS])
        made = []
        for p, r in zip(place, rows, strict=True):
            mine = p[owner[a:b]] >= 0
            at = p[owner[a:b]][mine], column[a:b][mine] - c
            full, flag = (np.zeros((len(r), COLUMNS), np.float32) for _ in range(2))
            full[at], flag[at] = value[a:b][mine], 1
            made.append((full, flag))
        left += made[0][0] @ made[1][1].T
        right += made[0][1] @ made[1][0].T
    return left, right


def _ties(part: pa.Table, b1: int, b2: int, threshold: float) -> list[tuple[int, int]]:
    """Pairs of classes of two blocks, or of one, that a link ties into one."""
    part = part.sort_by("node").combine_chunks()
    group, own = (part.column(n).to_pylist() for n in ("g", "own"))
    keys, counts, plain = _members(part)
    side = np.array([2 if b1 == b2 else 0 if o == b1 else 1 for o in own])
    left, right = _shares(keys, [n / n.sum() for n in counts], side)
    rows, columns = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    # no pair is more alike than the smaller of its shared masses
    i, j = np.nonzero(np.minimum(left, right) >= threshold - 1e-4)
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    out = []
    for a, b in zip(rows[i].tolist(), columns[j].tolist(), strict=True):
        x, y = find(group[a]), find(group[b])
        if x != y and _alike(keys[a], counts[a], keys[b], counts[b], plain[a] and plain[b], threshold):
            up[max(x, y)] = min(x, y)
            out.append((group[a], group[b]))
    return out


def _led(member: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) of members to the smallest node of a bucket of theirs. A large bucket's members are dealt over blocks; its smallest node goes to each."""
    pairs = member.filter("node != v").groupBy("node", "v").agg(F.max("blocks").alias("blocks"))
    pairs = pairs.select("node", "v", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("own"))
    leaders = pairs.select(F.col("v").alias("node"), "v", "blocks", "own").distinct()
    rows = pairs.union(leaders).join(sets, "node")

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        node, v = part.column("node").to_pylist(), part.column("v")[0].as_py()
        keys, counts, plain = _members(part)
        one = node.index(v)
        found = [n for i, n in enumerate(node) if i != one and _alike(keys[one], counts[one], keys[i], counts[i], plain[one] and plain[i], threshold)]
        return pa.table({"u": pa.array(found, pa.int64()), "v": pa.array([v] * len(found), pa.int64())})

    return rows.groupBy("v", "blocks", "own").applyInArrow(run, "u bigint, v bigint")


def _block_ties(mixed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Ties (u, v) of classes in the rows (h, node, g, blocks) of mixed buckets, each block of a bucket against each."""
    rows = mixed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).join(sets, "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = rows.select("h", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "node", "g", "keys", "counts")

    def run(key, part):
        found = _ties(part, key[1].as_py(), key[2].as_py(), threshold)
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("h", "b1", "b2").applyInArrow(run, "u bigint, v bigint")


def _digest(text) -> F.Column:
    """Of a text; an empty one for null."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, digest, n, class_id, kept) of every distinct document, that is id and text.

    n counts the rows of the document, class_id is the smallest id of its class, and one document of
    a class is kept: that with the smallest id, of several the one with the smallest digest. Null texts
    and texts without a word are alone. Different texts under one id are different documents. Null
    ids come last: class_id is null only in a class without any id.
    """
    scratch = shared.Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).withColumn("digest", _digest(F.col("text")))
    bands = scratch.keep(_band_rows(rows.withColumn("node", F.monotonically_increasing_id())))
    copies = bands.filter("bands is not null").groupBy("digest").agg(F.min("node").alias("node"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.min("size").alias("size"), F.min("bands").alias("bands"))
    copies = scratch.keep(copies)
    hashes = copies.select(F.explode("bands").alias("h"), "node", "size")
    buckets = hashes.groupBy("h").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"), F.sum("size").alias("keys"))
    buckets = buckets.filter("n > 1").groupBy("v", "n", "x", "y", "keys").agg(F.min("h").alias("h"))  # equal members, told by 128 bits, once
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("keys") / BLOCK_KEYS)).alias("blocks")
    buckets = scratch.keep(buckets.select("h", "v", blocks))
    member = scratch.keep(hashes.select("h", "node").join(_small(buckets), "h"))
    wanted = scratch.keep(copies.select("node", "rep", F.col("digest").alias("d")).join(member.select("node").distinct(), "node", "left_semi"))
    found = rows.join(_small(wanted), F.col("id").eqNullSafe(F.col("rep")) & (F.col("digest") == F.col("d")))
    sets = scratch.keep(_sets(found))
    if not sets.groupBy("node").count().filter("count > 1").isEmpty():  # repeated rows
        sets = scratch.keep(sets.dropDuplicates(["node"]))
    edges = scratch.keep(_led(member, sets, threshold))
    groups = scratch.keep(connected_components(edges).withColumnRenamed("component", "g"))
    placed = scratch.keep(member.join(_small(groups), "node", "left").select("h", "node", "blocks", F.coalesce("g", "node").alias("g")))
    mixed = scratch.keep(placed.groupBy("h").agg(F.min("g").alias("low"), F.max("g").alias("high")).filter("low != high").select("h"))
    ties = scratch.keep(_block_ties(placed.join(_small(mixed), "h"), sets, threshold))
    joint = scratch.keep(connected_components(ties).toDF("g", "c"))
    scratch.drop(sets, edges, mixed, ties, member, wanted)
    # a node that the second step ties first of all has no place in groups yet
    grouped = placed.select("node", "g").distinct().join(_small(joint), "g", "left").select("node", F.coalesce("c", "g").alias("c"))
    named = scratch.keep(copies.select("node", "rep", "digest", "rows").join(grouped, "node", "left").filter("c is not null or rows > 1").select("rep", "digest", F.coalesce("c", "node").alias("c")))
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "digest"))
    heads = named.groupBy("c").agg(F.min("rep").alias("class_id"), first.alias("first")).select("c", "class_id", "first.rep", F.col("first.digest").alias("head"))
    named = scratch.keep(named.select("c", F.col("digest").alias("d")).join(heads, "c").select("d", "class_id", "rep", "head"))
    out = bands.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")).join(_small(named), F.col("digest") == F.col("d"), "left")
    kept = F.col("d").isNull() | F.col("id").eqNullSafe(F.col("rep")) & (F.col("digest") == F.col("head"))
    return out.select("id", "digest", "n", F.when(F.col("d").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each distinct id and text: id, class_id, kept (one of each class).

    See ``classes`` for empty texts, copies, repeated and null ids. An empty table gives no rows; other
    columns are not read.
    """
    return classes(docs, id_col, text_col, threshold).select(F.col("id").alias(id_col), "class_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with their columns, one document of each class.

    Rows with equal id and text are one document: of them the one whose other columns are least stays.
    """
    scratch = shared.Scratch(docs.sparkSession)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names.values()).withColumn("k", _digest(F.col(names[text_col])))
    found = scratch.keep(classes(docs, id_col, text_col, threshold))
    same = F.col(names[id_col]).cast("bigint").eqNullSafe(F.col("id")) & (F.col("k") == F.col("digest"))
    kept = rows.join(_small(scratch.keep(found.filter("not kept").select("id", "digest"))), same, "left_anti")
    repeated = scratch.keep(found.filter("kept and n > 1").select("id", "digest"))
    if (n := repeated.count()) == 0:
        return kept.select(*names.values()).toDF(*docs.columns)
    side = _small(repeated, n)
    one = kept.join(side, same).groupBy("id", "digest").agg(F.min(F.struct(*names.values())).alias("row")).select("row.*")
    return kept.join(side, same, "left_anti").select(*names.values()).unionByName(one).toDF(*docs.columns)
