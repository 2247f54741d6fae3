"""Centroid clustering with heap-ordered bounds, in whole numbers.

A vector's upper bound is its distance to its own centroid, its lower bound that to the second nearest. When centroids move, the gap
between the two shrinks by at most its centroid's drift and the largest drift of the others. Each cluster of a block of vectors
keeps a heap of gaps, each written down plus what had accumulated of that drift when it was measured; in a round only the vectors
whose gap the accumulated drift has reached are popped and measured anew against all centroids. All others keep their cluster
without a distance. Measurements are exact; gaps are made smaller by GIVE for what the square roots lose.

Blocks are the batches of the table as it is read (no shuffle). A round reads the blocks, writes them back to the shared folder
with their heaps and with what the moved vectors change in the sums, and adds those changes up in Spark; the driver sees k * (width + 1) numbers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartosieve.llm.shared import batches_of, staged

GIVE = 1e-9
LIMIT = 1 << 27  # of a component, so that squared distances of 64 fit a long
EXACT = 1 << 21  # components up to this are exact in doubles, squares of 64 added up
BLOCK_ROWS = 8192
BLOCK = "ids array<long>, vectors binary, bytes int, sizes array<int>, keys binary, rows binary, moved binary, measured long"


def kept_vectors(vectors: DataFrame, width: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the vectors with exactly `width` components, none null or not finite, as whole numbers floor(scale * x)."""
    sound = (F.size(vec_col) == width) & ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vec_col, lambda x: F.least(F.greatest(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(-LIMIT)), F.lit(LIMIT)).cast("long"))
    return vectors.where(F.col(vec_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, one row for each vector."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        v, c = vectors.astype(float), centroids.astype(float)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    v = vectors.astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids.astype(np.int64)], axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (of equally near ones the first), and the gap to the second nearest."""
    found = squared(vectors, centroids)
    own = found.argmin(1)
    upper = np.sqrt(found[np.arange(len(found)), own].astype(float))
    if found.shape[1] == 1:
        return own, np.full(len(found), np.inf)
    lower = np.sqrt(np.partition(found, 1, axis=1)[:, 1].astype(float))
    return own, lower - upper - GIVE * (lower + upper + 1)


class Block:
    """Some vectors and, for each cluster, a heap of (gap plus the drift accumulated when it was measured, row)."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.ids, self.vectors, self.heaps = ids, vectors, heaps

    @classmethod
    def read(cls, row: dict, width: int) -> Block:
        keys, rows, at, heaps = np.frombuffer(row["keys"]).tolist(), np.frombuffer(row["rows"], "<i4").tolist(), 0, []
        for size in row["sizes"]:
            heaps.append(list(zip(keys[at : at + size], rows[at : at + size], strict=True)))  # written in heap order
            at += size
        return cls(row["ids"], np.frombuffer(row["vectors"], f"<i{row['bytes']}").reshape(-1, width), heaps)

    def expired(self, drift: np.ndarray) -> tuple[list[int], list[int]]:
        """Pops the vectors whose gap the drift has reached: (rows, their clusters)."""
        rows, clusters = [], []
        for cluster, (heap, reached) in enumerate(zip(self.heaps, drift.tolist(), strict=True)):
            while heap and heap[0][0] <= reached:
                rows.append(heapq.heappop(heap)[1])
                clusters.append(cluster)
        return rows, clusters

    def assign(self, rows: list[int], before: list[int], centroids: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Measures these rows, pushes them where they belong, and gives what changes in each cluster's sums (the count last)."""
        k, width = centroids.shape
        change = np.zeros((k, width + 1), np.int64)
        if rows:
            at, old = np.array(rows), np.array(before)
            now, gap = nearest(self.vectors[at], centroids)
            for key, row, cluster in zip((gap + drift[now]).tolist(), rows, now.tolist(), strict=True):
                heapq.heappush(self.heaps[cluster], (key, row))
            went = np.flatnonzero(now != old)
            counted = np.concatenate((self.vectors[at[went]].astype(np.int64), np.ones((len(went), 1), np.int64)), axis=1)
            np.add.at(change, now[went], counted)
            left = old[went] >= 0
            np.subtract.at(change, old[went][left], counted[left])
        return change

    def written(self, change: np.ndarray, measured: int) -> dict:
        flat = [entry for heap in self.heaps for entry in heap]
        return {
            "ids": self.ids, "vectors": self.vectors.tobytes(), "bytes": self.vectors.dtype.itemsize, "sizes": [len(heap) for heap in self.heaps], "keys": np.array([key for key, _ in flat], "<f8").tobytes(),
            "rows": np.array([row for _, row in flat], "<i4").tobytes(), "moved": change.tobytes(), "measured": measured,
        }

    def clusters(self) -> np.ndarray:
        own = np.zeros(len(self.vectors), np.int64)
        for cluster, heap in enumerate(self.heaps):
            own[[row for _, row in heap]] = cluster
        return own


WRITTEN = pa.schema([
    ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("bytes", pa.int32()), ("sizes", pa.list_(pa.int32())), ("keys", pa.binary()), ("rows", pa.binary()), ("moved", pa.binary()), ("measured", pa.int64()),
])


def first_blocks(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Blocks of the vectors as they are read, each assigned to its nearest centroid."""
    k, width = centroids.shape

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                found = batch.column("v").flatten().to_numpy().reshape(n, width)
                small = next(kind for kind in ("<i2", "<i4") if np.abs(found).max() <= np.iinfo(kind).max)
                block = Block(batch.column("id").to_pylist(), found.astype(small), [[] for _ in range(k)])
                change = block.assign(list(range(n)), [-1] * n, centroids, np.zeros(k))
                yield pa.RecordBatch.from_pylist([block.written(change, n)], WRITTEN)

    return vectors.mapInArrow(blocks, BLOCK)


def next_blocks(blocks: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The blocks after their expired vectors have been measured against the centroids."""

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row, centroids.shape[1])
                rows, before = block.expired(drift)
                yield pa.RecordBatch.from_pylist([block.written(block.assign(rows, before, centroids, drift), len(rows))], WRITTEN)

    return blocks.mapInArrow(stepped, BLOCK)


def changes(blocks: DataFrame, k: int, width: int) -> np.ndarray:
    """What the blocks' moved vectors change in each cluster's sums and (last) count."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * (width + 1), np.int64)
        for batch in batches:
            for moved in batch.column(0).to_pylist():
                total += np.frombuffer(moved, np.int64)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "amount"])

    total = np.zeros(k * (width + 1), np.int64)
    for row in blocks.select("moved").mapInArrow(added, "cell long, amount long").groupBy("cell").agg(F.sum("amount").alias("amount")).collect():  # k * (width + 1) rows at most
        total[row["cell"]] = row["amount"]
    return total.reshape(k, width + 1)


def centroid_clusters(
    vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(id, cluster, squared distance) of every kept vector, the final centroids, and how many vectors each assignment measured.

    Kept are vectors with exactly `width` components, none null, NaN or infinite; components beyond 2**27 after scaling count as that. The first centroids are the vectors with the smallest
    SHA-256 of seed and identifier (null: nothing after the seed; of equal identifiers the smaller vector first); fewer vectors give fewer
    centroids, none give none and an empty result. Equally near centroids: the smaller number. Repeated rows and identifiers are vectors of their own. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, width, scale, id_col, vec_col)
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = [row["v"] for row in kept.orderBy(order, "v").limit(k).collect()]  # k rows
    if not first:
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long"), np.zeros((0, width), np.int64), []
    centroids = np.array(first, np.int64)
    sums, drift, measured = np.zeros((len(first), width + 1), np.int64), np.zeros(len(first)), []
    with batches_of(spark, BLOCK_ROWS):
        blocks = staged(first_blocks(kept, centroids), "blocks")
    for i in range(rounds):
        sums += changes(blocks, *centroids.shape)
        counts = sums[:, -1:]
        moved = np.where(counts > 0, sums[:, :-1] // np.maximum(counts, 1), centroids)
        step = np.sqrt(((moved - centroids) ** 2).sum(1).astype(float)) * (1 + GIVE)
        others = np.array([np.delete(step, c).max(initial=0) for c in range(len(step))])
        centroids, drift = moved, drift + step + others
        with batches_of(spark, 1):
            blocks = staged(next_blocks(blocks, centroids, drift), f"blocks-{i + 1}")
        measured.append(blocks.agg(F.sum("measured")).first()[0])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row, centroids.shape[1])
                own = block.clusters()
                away = ((block.vectors.astype(np.int64) - centroids[own]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(own, pa.int32()), pa.array(away)], names=[id_col, "cluster", "distance"])

    with batches_of(spark, 1):
        return staged(blocks.mapInArrow(members, f"{id_col} long, cluster int, distance long"), "members"), centroids, measured
