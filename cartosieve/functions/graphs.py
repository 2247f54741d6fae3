"""Connected groups of a graph."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartosieve.functions.storage import checkpointed

#: So many edges are one task's.
TASK_EDGES = 1 << 20


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> (vertex, smallest vertex of its component), by hooking and halving."""
    vertices = np.unique(np.concatenate((a, b)))
    small = np.int32 if len(vertices) < 1 << 31 else np.int64
    u, v = (np.searchsorted(vertices, side).astype(small) for side in (a, b))
    parent = np.arange(len(vertices), dtype=small)
    while True:
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        if not apart.any():
            return vertices, vertices[parent]
        np.minimum.at(parent, np.maximum(pu, pv)[apart], np.minimum(pu, pv)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars, each vertex with the smallest that it reaches there."""
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if found:
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        del found
        v, g = smallest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(g)], names=["u", "v"])


def groups(edges: DataFrame, near: Sequence[str] = ()) -> DataFrame:
    """edges(a, b) of longs -> (v, g): the smallest vertex of each vertex's component.

    Each task first contracts TASK_EDGES of the edges to stars, those in the order of the columns `near` if there are any; where there is more than one task, the stars that have a vertex in common are themselves a graph,
    the less of it the more `near` keeps components together. Alternating large-star and small-star steps join them.
    """
    ends = checkpointed(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), *near))
    tasks = max(1, -(-ends.count() // TASK_EDGES))
    dealt = ends.repartitionByRange(tasks, *near) if near and tasks > 1 else ends.repartition(tasks)
    stars = checkpointed(dealt.select("a", "b").mapInArrow(_contracted, "u long, v long"))
    if tasks < 2:
        return stars.select(F.col("u").alias("v"), F.col("v").alias("g"))
    several = stars.groupBy("u").agg(F.min("v").alias("least"), F.collect_set("v").alias("all")).where(F.size("all") > 1)
    now = checkpointed(several.select(F.explode("all").alias("u"), F.col("least").alias("v")).where("u != v").distinct())
    mark, before = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first(), None
    while mark != before:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v"))).distinct()
        now = checkpointed(small)
        mark, before = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first(), mark
    own = stars.groupBy("u").agg(F.min("v").alias("m"))
    return own.join(now.select(F.col("u").alias("m"), F.col("v").alias("g")), "m", "left").select(F.col("u").alias("v"), F.coalesce("g", "m").alias("g"))
