"""Language identification by bit-sliced Bloom filters of character n-grams.

One filter for each language, stored by slices: slot i of the table is a word whose bit l is bit i of language l's filter, a further
word for each further 64 languages. Looking an n-gram up in its slots and ANDing the words gives at once the mask of all languages that contain it. A text's
n-grams are counted by language; the counts are corrected for each filter's measured rate of false positives, and the
largest decides.

A language contains an n-gram if at least `min_share` of its fitted documents do and if it is at least 1/`contrast` times
as common in it as in the language where it is most common. Fitting reads a sample of about `fit_rows` labelled
rows of each language, chosen by a hash of the identifier; the model's size is bounded by `slots`. The n-grams are counted and chosen in
Spark; only those chosen, fewer than 1 / min_share times those of a document for each language, come to the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartosieve.llm.shared import batches_of, slices, staged

GRAM = 3
HASHES = 2
UNDETERMINED = "und"


@dataclass
class LanguageFilters:
    languages: list[str]
    table: np.ndarray  # uint64, (words, slots)
    fp_rate: np.ndarray = field(default=None)
    fallback: int = 0

    def __post_init__(self):
        fill = np.array([(self.table[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(self.languages))])
        self.fp_rate = np.minimum(fill**HASHES, 0.99)


@lru_cache(1)
def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, the text it is from, whether each text has a letter). Case is folded; what is no letter parts words."""
    texts = [f"\n{t.lower()}\n" for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    of = np.repeat(np.arange(len(texts)), sizes)
    letter = _letter_table()[points]
    has = np.bincount(of[letter], minlength=len(texts)) > 0
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # one mark after each word,
    kept[:-1] |= np.concatenate(([True], of[1:] != of[:-1]))[:-1] & letter[1:]  # and one before the first
    code = np.where(letter, points, 0)[kept].astype(np.uint64)
    of = of[kept]
    if len(code) < GRAM:
        return np.array([], np.uint64), np.array([], np.int64), has
    h = code[: 1 - GRAM].copy()
    for k in range(1, GRAM):
        h = h * np.uint64(0x100000001B3) + code[k : len(code) - GRAM + 1 + k] + np.uint64(1)
    same = of[: 1 - GRAM] == of[GRAM - 1 :]
    h, of = h[same], of[: 1 - GRAM][same]
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h, of, has


def _slots(h: np.ndarray, n_slots: int) -> list[np.ndarray]:
    mask = np.uint64(n_slots - 1)
    return [(h >> np.uint64(31 * i) & mask).astype(np.int64) for i in range(HASHES)]


def predict(texts: list[str | None], model: LanguageFilters) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language and score of each text, and whether it has a letter, which holds without any language too."""
    h, of, has = gram_hashes([t or "" for t in texts])
    n, k = len(texts), len(model.languages)
    if not k:
        return [UNDETERMINED] * n, np.zeros(n), has
    masks = np.bitwise_and.reduce([model.table[:, s] for s in _slots(h, model.table.shape[1])])
    total = np.bincount(of, minlength=n).astype(float)
    hits = np.stack([np.bincount(of, masks[i // 64] >> np.uint64(i % 64) & np.uint64(1), minlength=n) for i in range(k)], axis=1)
    real = np.maximum(0, (hits - model.fp_rate * total[:, None]) / (1 - model.fp_rate))
    best = np.where(real.max(axis=1) > 0, real.argmax(axis=1), model.fallback)
    score = real[np.arange(n), best] / np.maximum(real.sum(axis=1), 1e-9)
    return [model.languages[b] if has[i] else UNDETERMINED for i, b in enumerate(best.tolist())], np.where(has, np.clip(score, 0, 1), 0.0), has


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 4000, slots: int = 1 << 20, min_share: float = 0.02, contrast: float = 3.0) -> LanguageFilters:
    """docs: the rows that may be learned from; those without text or language are left out. No rows: no languages."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # a row for each language
    languages = sorted(counts)
    if not languages:
        return LanguageFilters([], np.zeros((1, 1), np.uint64))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, fit_rows / counts[lang]))])[F.col(lang_col)]
    chosen = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                h, of, _ = gram_hashes(part["text"].tolist())
                grams, at, uses = np.unique(h, return_inverse=True, return_counts=True)
                in_docs = np.bincount(np.unique(at * len(part) + of) // len(part), minlength=len(grams))
                yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "uses": uses, "in_docs": in_docs, "n_docs": 0})
                yield pd.DataFrame({"lang": [lang], "gram": [0], "uses": [0], "in_docs": [0], "n_docs": [len(part)]})

    counted = chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInPandas(count, "lang string, gram long, uses long, in_docs long, n_docs long")
    with batches_of(docs.sparkSession, 512):
        sums = staged(counted.groupBy("lang", "gram").agg(*[F.sum(c).alias(c) for c in ("uses", "in_docs", "n_docs")]), "grams")
    totals = sums.groupBy("lang").agg(F.sum("uses").alias("all_uses"), F.sum("n_docs").alias("all_docs"))  # a row for each language
    rated = sums.where("uses > 0").join(F.broadcast(totals), "lang").withColumn("rate", F.col("uses") / F.col("all_uses"))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    often = (F.col("in_docs") > 1) & (F.col("in_docs") >= min_share * F.col("all_docs"))
    grams = rated.where(often).join(top, "gram").where(F.col("rate") * contrast >= F.col("top")).select("lang", "gram").toPandas()
    table = np.zeros((-(-len(languages) // 64), slots), np.uint64)
    for i, lang in enumerate(languages):
        for at in _slots(grams.loc[grams["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64), slots):
            table[i // 64, at] |= np.uint64(1 << i % 64)
    return LanguageFilters(languages, table, fallback=languages.index(max(languages, key=lambda x: (counts[x], x))))


def guess(spark: SparkSession, model: LanguageFilters, text: Column) -> Column:
    """A struct (lang, score, letters). Null texts and texts without a letter: und, 0, false. No languages: und, 0 for all. A text with letters but no known n-gram gets the most frequent language with score 0."""
    shared = spark.sparkContext.broadcast(model)  # 8 * slots bytes for each 64 languages

    @F.pandas_udf("lang string, score double, letters boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        found = [pd.DataFrame(dict(zip(("lang", "score", "letters"), predict(some, shared.value), strict=True))) for some in slices(texts.tolist())]
        return pd.concat(found) if found else pd.DataFrame({"lang": [], "score": [], "letters": []})

    return judge.asNondeterministic()(text)  # evaluated once, not again in a filter


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether a row is kept from fitting; a null identifier is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def fit_and_identify(docs: DataFrame, **options: float) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document, learned from those not held out.

    Null texts and texts without a letter: und, 0. Of languages with equal counts the first by name is taken; a text without any known n-gram gets
    the language with most rows, score 0. A null id is not held out; null languages are not learned from; without any labelled row all is und.
    Repeated rows give equal rows, an empty table gives none; other columns are not looked at.
    """
    model = fit(docs.where(~held_out()), **options)
    found = docs.select("doc_id", guess(docs.sparkSession, model, F.col("text")).alias("guess"))
    with batches_of(docs.sparkSession, 512):
        found = staged(found, "languages")
    return found.select("doc_id", held_out().alias("held_out"), F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))
