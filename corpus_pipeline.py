"""The corpus pipeline: language ID, exact deduplication, near-duplicate removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartosieve.llm.exact_dedup import exact_dedup
from cartosieve.llm.language_id import fit, guess
from cartosieve.llm.near_dups import near_groups
from cartosieve.llm.packing import pack
from cartosieve.llm.queries import public_tokenizer
from cartosieve.llm.shared import batches_of, staged, table


#: The languages whose documents stay; None: all.
LANGUAGES: frozenset[str] | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and those without any letter, and with LANGUAGES those of others. Where lang is null it becomes the predicted one.

    What is learned from is documents with a lang. Without any such row languages are not known: then lang stays as it is and letters alone decide. Of languages with equal
    counts the first by name is taken. Repeated rows stay, equal ones alike; an empty table stays empty.
    """
    model = fit(docs)
    with batches_of(spark, 512):
        told = staged(docs.withColumn("_guess", guess(spark, model, F.col("text"))).where("_guess.letters"), "languages")
    if not model.languages:
        return told.drop("_guess")
    found = told.withColumn("lang", F.coalesce("lang", "_guess.lang")).drop("_guess")
    return found if LANGUAGES is None else found.where(F.col("lang").isin(*sorted(LANGUAGES)))


def _rest(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs without the rows that groups(id, sha256, goes), a row for each document, marks; of rows that repeat an id and its text one stays."""
    keys = staged(groups.toDF("gone_id", "gone_sha256", "goes").groupBy("gone_id", "gone_sha256").agg(F.max("goes").alias("goes"), F.count(F.lit(1)).alias("n")).where("goes or n > 1"), "gone")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    same = docs["doc_id"].eqNullSafe(F.col("gone_id")) & (digest == F.col("gone_sha256"))
    rest = docs.join(keys.hint("merge"), same, "left_anti")  # both grow with the documents
    repeated = keys.where("not goes")
    return rest if repeated.isEmpty() else rest.union(docs.join(repeated.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) the document with the smallest id stays, null ids last; of rows with the same id and text one. An empty table stays empty."""
    return _rest(docs, exact_dedup(docs).select("doc_id", "text_sha256", ~F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8.

    It is that with the smallest id, null ids last, of equal ids that with the smallest digest; of rows with the same id and text one stays. Texts
    without words (null, empty, white space) are near nothing and stay, but for such repeated rows. An empty table stays empty.
    """
    return _rest(docs, near_groups(docs, width=5, percent=80).select("row_id", "text_sha256", ~F.col("first")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences of at most 1024 ids. Null texts are empty (the end id alone); null ids come first; an empty table gives no pieces."""
    return pack(docs, public_tokenizer("byte_bpe_50k.json"), end_id=0, window=1024)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]
#: SQL can express neither the language model nor the tokeniser; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
