"""Near-duplicate vectors by a pivot-permutation index.

Each vector is described by the ordered list of its nearest pivots (reference points drawn from
the vectors by hash). Inverted lists hold, for a label and a pivot, the vectors that have the pivot
among theirs. Two vectors are candidates if they share enough pivots; so many shared ones mean that
the rarest of them is among the rarest few of both, and a vector stands in the lists of those few
only. In a list the shared pivots of all pairs are counted first; pairs that reach the count, and
whose rarest shared pivot is the list's own, are then verified by cosine in double precision, so
each link is found once. What leaves a task is a sum and one tie for each vector, never the pairs.
Long lists are cut into blocks that meet block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .graph import connected_components, roots

THRESHOLD = 0.93
#: Pivots grow with the root of the number of vectors; the nearest NEAREST describe a vector, SHARED of them make candidates.
NEAREST = 8
SHARED = 3
#: Ranks of pivots that one number holds.
PACKED = 4
#: Bound on the sample of vectors that pivots are drawn from.
PIVOT_SAMPLE = 4_096
BLOCK = 2_048
#: Inverted lists up to which their block counts are broadcast.
BROADCAST_LISTS = 200_000


#: Pivots lie at least this far apart (cosine below it), so that a dense group has one at most.
APART = 0.7


def pivots_for(n: int) -> int:
    return int(min(PIVOT_SAMPLE, max(16, 2 * np.sqrt(n))))


def _pivots(nodes: DataFrame) -> np.ndarray:
    """Unit vectors of the pivots, drawn from a bounded sample in the order of a hash."""
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(PIVOT_SAMPLE).select("v").toArrow().column("v").to_pylist()
    if not sample:
        return np.zeros((0, 0))
    size = max(map(len, sample), key=[len(x) for x in sample].count)
    units = np.array([x for x in sample if len(x) == size], float).reshape(-1, size)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    most, chosen, nearest = pivots_for(nodes.count()), [], np.full(len(units), -1.0)
    for i in range(len(units)):
        if len(chosen) < most and nearest[i] < APART:
            chosen.append(i)
            nearest = np.maximum(nearest, units @ units[i])
    return units[chosen]


def _describe(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(label, node, copies, near, wide, data): the nearest pivots' numbers, and the bytes of the vector as floats if they hold it, else (wide) as doubles.

    A vector whose length isn't the pivots' has the first pivots' numbers."""

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                vectors = [np.array(v) for v in part.column(3).to_pylist()]
                units = [_unit(v) for v in vectors]
                same = [k for k, u in enumerate(units) if len(u) == pivots.shape[1]]
                near = np.tile(np.arange(min(NEAREST, len(pivots))), (len(units), 1))
                if same:
                    near[same] = np.argsort(-(np.stack([units[k] for k in same]) @ pivots.T), axis=1, kind="stable")[:, : near.shape[1]]
                with np.errstate(over="ignore"):
                    small = [v.astype(np.float32) for v in vectors]
                wide = [not (v == w).all() for v, w in zip(vectors, small, strict=True)]
                data = [(v if x else w).tobytes() for v, w, x in zip(vectors, small, wide, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(near.tolist(), pa.list_(pa.int32())), pa.array(wide, pa.bool_()), pa.array(data, pa.binary())], ["label", "node", "copies", "near", "wide", "data"])

    return nodes.select("label", "node", "copies", "v").mapInArrow(shared.tidy(run), "label string, node bigint, copies bigint, near array<int>, wide boolean, data binary")


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def _links(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None, own: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the links of two blocks, or of one with itself, that belong to the list of the pivot with rank ``own``; blocks have units and ranks."""
    (x, p), (y, q) = left, right or left
    names, at = np.unique(np.concatenate([p.ravel(), q.ravel()]), return_inverse=True)
    has = np.zeros((len(p) + len(q), len(names)), np.float32)
    has[np.repeat(np.arange(len(has)), p.shape[1]), at] = 1
    mine, other = has[: len(p)], has[len(p) :]
    rarer = names < own
    near = (mine @ other.T >= min(SHARED, p.shape[1])) & (mine[:, rarer] @ other[:, rarer].T == 0)
    i, j = np.nonzero(np.triu(near, 1) if right is None else near)
    keep = np.zeros(len(i), bool)
    for a in range(0, len(i), 16_384):  # bounds the arrays of both sides
        part = slice(a, a + 16_384)
        keep[part] = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= threshold
    return i[keep], j[keep]


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each distinct id: id, n_links, component_id, kept.

    Only vectors with equal, non-null labels are compared. Vectors that are null, zero or hold a
    null or non-finite component link with nothing, nor do vectors of different lengths. Equal
    vectors of different ids link. If an id is repeated, its row with the smallest (label,
    vector) counts. Rows with a null id are not part of the result; empty tables give no rows.
    """
    floats = table.schema[vector_col].dataType.simpleString() == "array<float>"
    vector = F.col(vector_col) if floats else F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("v")).filter("id is not null")
    good = F.col("v").isNotNull() & F.col("label").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    scratch = shared.Scratch(table.sparkSession)
    # 128 bits tell vectors apart, so that they need not move to be compared
    rows = scratch.keep(rows.withColumns({"good": F.coalesce(good, F.lit(False)), "x": F.xxhash64("v"), "y": F.xxhash64(F.lit(1), "v")}))
    if not rows.groupBy("id").count().filter("count > 1").isEmpty():
        rows = scratch.keep(rows.groupBy("id").agg(F.min(F.struct("label", "v", "good", "x", "y")).alias("r")).select("id", "r.*"))
    # equal vectors are one node with a weight
    nodes = rows.filter("good").groupBy("label", "x", "y").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.min_by("v", "id").alias("v"))
    nodes = scratch.keep(nodes)
    pivots = _pivots(nodes)
    described = scratch.keep(_describe(nodes, pivots))
    # pivots in order of the lengths of their lists: PIVOT_SAMPLE rows at most
    common = described.select(F.explode("near").alias("p")).groupBy("p").count().orderBy("count", "p").collect()
    place = {r["p"]: k for k, r in enumerate(common)}
    rank = F.split(F.lit(",".join(str(place.get(p, 0)) for p in range(max(place, default=0) + 1))), ",").cast("array<int>")
    width = min(NEAREST, max(len(pivots), 1))
    pack = lambda first, n: F.aggregate(F.slice("ranks", first, n), F.lit(0).cast("bigint"), lambda a, r: a * PIVOT_SAMPLE + r)
    listed = described.withColumn("ranks", F.array_sort(F.transform("near", lambda p: F.get(rank, p))))
    listed = listed.withColumns({"head": pack(1, PACKED), "tail": pack(PACKED + 1, PACKED), "own_rank": F.explode(F.slice("ranks", 1, max(width - SHARED + 1, 1)))})
    sizes = listed.groupBy("label", "own_rank").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).toDF("l", "p", "blocks")
    side = F.broadcast(sizes) if sizes.count() <= BROADCAST_LISTS else sizes
    entries = listed.join(side, (F.col("label") == F.col("l")) & (F.col("own_rank") == F.col("p")))
    entries = entries.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    entries = entries.select("label", "own_rank", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "node", "copies", "head", "tail", "wide", "data")

    def run(key, part):
        _, pivot, b1, b2 = (k.as_py() for k in key)
        part = part.combine_chunks()
        node, own = part.column("node").to_numpy(), part.column("own").to_numpy()
        copies = part.column("copies").to_numpy()
        packed = [(part.column(name).to_numpy(), n) for name, n in (("head", min(width, PACKED)), ("tail", max(width - PACKED, 0)))]
        ranks = np.column_stack([x // PIVOT_SAMPLE ** (n - 1 - k) % PIVOT_SAMPLE for x, n in packed for k in range(n)])
        units = [_unit(np.frombuffer(x, float if wide else np.float32).astype(float)) for x, wide in zip(part.column("data").to_pylist(), part.column("wide").to_pylist(), strict=True)]
        first, second = [np.zeros(0, int)], [np.zeros(0, int)]
        for size in {len(u) for u in units}:
            at = np.array([i for i, u in enumerate(units) if len(u) == size])
            side = [at[own[at] == b] for b in (b1, b2)]
            if len(side[0]) and len(side[1]):
                block = [(np.stack([units[i] for i in rows]), ranks[rows]) for rows in side]
                i, j = _links(block[0], None if b1 == b2 else block[1], pivot, threshold)
                first.append(side[0][i])
                second.append(side[1][j])
        i, j = np.concatenate(first), np.concatenate(second)
        counts = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
        some = np.flatnonzero(counts)
        order = np.argsort(node, kind="stable")  # the tie is to the smallest node
        place = np.argsort(order, kind="stable")
        low = node[order][roots(len(node), place[i], place[j])][place]
        return pa.table({"node": pa.array(node[some], pa.int64()), "links": pa.array(counts[some].astype(np.int64)), "other": pa.array(low[some], pa.int64())})

    found = scratch.keep(entries.groupBy("label", "own_rank", "b1", "b2").applyInArrow(run, "node bigint, links bigint, other bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    groups = nodes.select("label", "x", "y", "node", "copies").join(links, "node", "left").join(groups, "node", "left")
    member = rows.filter("good").select("id", "label", "x", "y").join(groups, ["label", "x", "y"], "left")
    member = member.select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    alone = rows.filter("not good").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = member.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
