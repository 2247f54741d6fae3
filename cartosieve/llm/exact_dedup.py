"""Exact deduplication by a tree merge of sorted digest runs.

Each row gets a SHA-256 digest of its text. Rows are dealt to `radix ** rounds` runs; a run holds one row for each
digest in it: the smallest (or largest) identifier and the count. In each of `rounds` rounds, runs whose numbers differ
in one digit only exchange rows: a digest goes to the run with that digit of the digest's own prefix, and the sorted
rows that arrive are merged. After the last round every digest is in one run. A digest that a third of all rows share
is never more than `radix` rows in a merge, and no row of the corpus is compared in one task.

Equal digests are verified: a second hash and the length in bytes are part of the key at every level, so that texts
merge only if all three agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartosieve.llm.shared import shuffle_partitions, staged

RADIX = 16
KEY = ["digest", "proof", "n_bytes"]


def _digest_number(digest: Column) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")


def _merged(runs: DataFrame, keep: str) -> DataFrame:
    """One row for each run and digest. Spark sorts what arrives in a run again, a merge of the sorted pieces of its shuffle; the struct makes it fold the sorted rows rather than hash them."""
    pick = F.max(F.struct("keep_id")) if keep == "largest" else F.min(F.struct(F.col("keep_id").isNull().alias("none"), "keep_id"))  # nulls lose
    return (
        runs.repartition("run")
        .sortWithinPartitions("run", *KEY)
        .groupBy("run", *KEY)
        .agg(pick.getField("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    )


def tree_merge(runs: DataFrame, keep: str, radix: int, rounds: int) -> DataFrame:
    """runs(run, digest, proof, n_bytes, keep_id, n), a row for each run and digest -> a row for each digest."""
    for r in range(rounds):
        place = radix**r
        own = F.col("run").cast("long")
        digit = F.floor(own / place) % radix
        wanted = F.floor(_digest_number(F.col("digest")) / place) % radix
        runs = _merged(runs.withColumn("run", own + (wanted - digit) * place), keep)
    return runs.drop("run")


def exact_groups(rows: DataFrame, id_col: str, digest: Column, proof: Column, n_bytes: Column, keep: str = "smallest", radix: int = RADIX) -> DataFrame:
    """(id_col, digest, keep_id, group_size, kept), a row for each row of `rows`.

    keep: "smallest" or "largest" identifier of each group stays. Null identifiers lose against others; a group without
    any has a null keep_id and its rows stay. Rows with equal identifier and text are marked alike. No rows: no rows.
    """
    spark = rows.sparkSession
    rounds, parts = 1, shuffle_partitions(spark)
    while radix**rounds < parts:
        rounds += 1
    dealt = staged(
        rows.select(
            F.col(id_col).alias("row_id"), digest.alias("digest"), proof.alias("proof"), n_bytes.cast("long").alias("n_bytes"),
            (F.monotonically_increasing_id() % (radix**rounds)).alias("run"),
        ),
        "digests",
    )
    pick = F.max if keep == "largest" else F.min
    level0 = dealt.groupBy("run", *KEY).agg(pick("row_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    whole = tree_merge(level0, keep, radix, rounds)
    answer = level0.select("run", *KEY).join(whole, KEY)
    return dealt.join(answer, ["run", *KEY]).select(
        F.col("row_id").alias(id_col), "digest", "keep_id", F.col("n").alias("group_size"),
        F.col("row_id").eqNullSafe(F.col("keep_id")).alias("kept"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", radix: int = RADIX) -> DataFrame:
    """Groups of equal texts (null: empty), a row for each document: id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = exact_groups(docs, id_col, F.unhex(F.sha2(text.cast("binary"), 256)), F.xxhash64(text), F.octet_length(text), keep, radix)
    return found.select(id_col, "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
