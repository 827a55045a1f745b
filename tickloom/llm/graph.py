"""Connected components of an edge list: alternating stars, and one task once few edges are left."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import Scratch

#: Edges that one task solves alone (16 bytes each); more take rounds of stars.
ONE_TASK = 1_000_000


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position of each position's component, of n positions tied by the pairs (i, j)."""
    up = np.arange(n)
    while True:
        a, b = up[i], up[j]
        apart = a != b
        if not apart.any():
            return up
        np.minimum.at(up, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (up != (higher := up[up])).any():
            up = higher


def _solved(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [b for b in batches if len(b)]
        if parts:
            u, v = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (0, 1))
            names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            low = roots(len(names), at[: len(u)], at[len(u) :])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[low])], ["node", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(shared.tidy(run), "node bigint, component bigint")


def _stars(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Ties each node's neighbours (larger ones, or smaller ones and itself) to the smallest of them."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))) if large else edges
    # written, so that both sides of the join are plain exchanges: a hub's rows can then be split over tasks
    least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    tied = both.join(least, "u")
    tied = tied.filter(F.col("v") > F.col("u")).select("v", "m") if large else tied.select("v", "m").union(least.select("u", "m"))
    out = scratch.keep(tied.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    scratch.drop(least)
    return out


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of every node with an edge; component is its smallest node.

    ``edges`` has integer columns u and v; loops and repeated edges do no harm. Up to ``one_task``
    distinct edges are one task's work. More take rounds of large and small stars, each written
    to the shared folder; rounds grow with the logarithm of the components' diameter. The result
    is the same either way.
    """
    scratch = Scratch(edges.sparkSession)
    edges = scratch.keep(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").cast("bigint").alias("u"), F.least("u", "v").cast("bigint").alias("v")).distinct())
    if edges.count() <= one_task:
        return _solved(edges)
    state = None
    while True:
        middle = _stars(edges, True, scratch)
        after = _stars(middle, False, scratch)
        scratch.drop(edges, middle)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    out = edges.groupBy("u").agg(F.min("v").alias("component"))
    return out.select(F.col("u").alias("node"), "component").union(edges.select("v", "v").distinct())
