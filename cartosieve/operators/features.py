"""Issues as features for learning: per-feature summaries, indicator columns, annotated layers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartosieve.plans.issues import SEVERITY_PENALTY, lookup, score

RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def by_feature(issues: DataFrame) -> DataFrame:
    """(feature_id, issue_count, problem_names, max_severity, quality_score)."""
    rank = lookup(RANK, F.col("severity"), 0)
    grouped = issues.where("feature_id is not null").groupBy("feature_id").agg(
        F.count(F.lit(1)).alias("issue_count"), F.array_sort(F.collect_set("problem_name")).alias("problem_names"), F.max_by("severity", rank).alias("max_severity"),
    )
    return grouped.withColumn("quality_score", score(lookup(SEVERITY_PENALTY, F.col("max_severity"), 0.35), F.col("issue_count")))


def indicators(issues: DataFrame, problems: list[str]) -> DataFrame:
    """One column qa_problem_<name> of 0 or 1 for each problem."""
    return issues.where("feature_id is not null").groupBy("feature_id").agg(*[F.max((F.col("problem_name") == p).cast("int")).alias(f"qa_problem_{p}") for p in problems])


def annotated(layer: DataFrame, issues: DataFrame) -> DataFrame:
    """The layer with qa_ columns; features without issues have a score of 1."""
    marks = by_feature(issues).select(
        "feature_id", F.lit(True).alias("qa_has_issue"), F.col("issue_count").alias("qa_issue_count"), F.col("problem_names").alias("qa_problem_names"),
        F.col("max_severity").alias("qa_max_severity"), F.col("quality_score").alias("qa_quality_score"),
    )
    joined = layer.join(marks, "feature_id", "left")
    return joined.withColumns({
        "qa_has_issue": F.coalesce("qa_has_issue", F.lit(False)), "qa_issue_count": F.coalesce("qa_issue_count", F.lit(0)),
        "qa_problem_names": F.coalesce("qa_problem_names", F.array().cast("array<string>")), "qa_quality_score": F.coalesce("qa_quality_score", F.lit(1.0)),
    })


def softmax(values: Column) -> Column:
    """The greatest value and the sum are found once, as fields beside the array."""
    shifted = F.transform(F.array(F.struct(values.alias("v"), F.array_max(values).cast("double").alias("most"))), lambda t: F.transform(t["v"], lambda v: F.exp(v.cast("double") - t["most"])))
    summed = F.transform(shifted, lambda p: F.struct(p.alias("p"), F.aggregate(p, F.lit(0.0), lambda s, q: s + q).alias("total")))
    return F.get(F.transform(summed, lambda t: F.transform(t["p"], lambda p: p / t["total"])), F.lit(0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, d: s + d)


#: So many vectors and queries are one group's.
BLOCK_ROWS, CHUNK_QUERIES, TILE = 2_000, 512, 32


def _matrix(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(one row for each list, filled up with zeros; its length, -1 where it or something in it is null)."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, of = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    first = np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0)
    out = np.zeros((len(n), max(n.max(initial=0), 0)))
    out[of, np.arange(len(of)) - first[of]] = flat.to_numpy(zero_copy_only=False).astype(float)
    n[of[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = -1
    return out, n


def _block_distances(block: pa.Table) -> pa.Table:
    rows, asked = block.filter(pc.invert(block.column("asked"))), block.filter(block.column("asked"))
    (v, nv), (q, nq) = _matrix(rows.column("vector")), _matrix(asked.column("vector"))
    width = min(v.shape[1], q.shape[1])  # where lengths differ there is no distance
    distance = np.zeros((len(q), len(v)))
    columns = np.ascontiguousarray(v.T[:width])
    for k in range(0, len(q), TILE):
        for d in range(width):  # in order, as a sum over the lists would be
            step = q[k : k + TILE, d, None] - columns[d]
            distance[k : k + TILE] += step * step
    none = (nq[:, None] != nv) | (nq[:, None] < 0)
    ids = [asked.column("id").take(pa.array(np.repeat(np.arange(len(q)), len(v)))), rows.column("id").take(pa.array(np.tile(np.arange(len(v)), len(q))))]
    return pa.table([*ids, pa.array(distance.ravel(), mask=none.ravel())], names=["query_id", "vec_id", "distance"])


def squared_distances(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """rows(id, vector), asked(id, vector) -> (query_id, vec_id, distance): all of one against all of the other; null where a vector is null, holds one, or lengths differ.

    Blocks of rows meet chunks of queries, a group each, of bounded size; the result has the product of both counts by its nature.
    """
    blocks, chunks = max(1, -(-rows.count() // BLOCK_ROWS)), max(1, -(-asked.count() // CHUNK_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = rows.withColumn("block", part(blocks)).withColumn("chunk", every(chunks))
    right = asked.withColumn("chunk", part(chunks)).withColumn("block", every(blocks))
    kind = rows.schema["id"].dataType.simpleString()
    both = left.withColumn("asked", F.lit(False)).unionByName(right.withColumn("asked", F.lit(True)))
    return both.groupBy("block", "chunk").applyInArrow(_block_distances, f"query_id {kind}, vec_id {kind}, distance double")
