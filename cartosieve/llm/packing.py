"""Packing documents into training sequences by order-preserving dynamic programming.

Documents stand in ascending order of identifier; each is its ids and an end id. A sequence is a window of that row of
ids, at most `window` long. Cuts are allowed at ends of documents (free), of sentences or lines (SENTENCE_PENALTY) and,
in runs of over WIDE_GAP ids without either, every HARD_STEP ids (HARD_PENALTY). The cuts chosen minimise padding plus penalties plus
SEQUENCE_PENALTY for each sequence: cost(j) = window - P(j) + penalty(j) + min over i of (cost(i) + P(i)), where i runs
over the cuts at most `window` before j, a minimum that a monotone queue gives in constant time. A sequence whose length
is a power of two needs no padding, so those lengths are tried as well.

Each task packs its own range of identifiers, in chunks of whole documents of CHUNK_IDS ids or more, so that memory is
bounded by that and the longest document; no sequence spans two chunks. Null texts are empty (the end id alone).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartosieve.llm.shared import batches_of, staged
from cartosieve.llm.tokens import encoder, ends_sentence

SENTENCE_PENALTY = 2.0
HARD_PENALTY = 6.0
SEQUENCE_PENALTY = 6.0
WIDE_GAP = 64
HARD_STEP = 16
CHUNK_IDS = 1 << 19
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_points(sentence_ends: np.ndarray, doc_ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end (0 first, the last is the end) and their penalties."""
    soft = np.union1d(sentence_ends, doc_ends)
    soft = np.concatenate(([0], soft[soft > 0])).astype(np.int64)
    gap = np.diff(soft)
    steps = np.where(gap > WIDE_GAP, (gap - 1) // HARD_STEP, 0) + 1  # the cuts of each gap, its end last
    ends = np.cumsum(steps)
    at = np.repeat(soft[:-1], steps) + HARD_STEP * (np.arange(int(steps.sum())) - np.repeat(ends - steps, steps) + 1)
    at[ends - 1] = soft[1:]
    penalty = np.full(len(at), HARD_PENALTY)
    penalty[ends - 1] = SENTENCE_PENALTY
    penalty[np.searchsorted(at, doc_ends)] = 0
    return np.concatenate(([0], at)), np.concatenate(([0.0], penalty))


def shorter_windows(at: np.ndarray, window: int) -> tuple[list[int], list[int], list[int]]:
    """(begin, i, size): for the cut j, i[begin[j]:begin[j + 1]] are the cuts a power of two below `window` before it, and size those lengths."""
    index = np.full(int(at[-1]) + 1, -1, np.int64)
    index[at] = np.arange(len(at))
    found, size = [], 1
    while size < window:
        has = np.flatnonzero(at >= size)
        back = index[at[has] - size]
        found.append(np.stack((has[back >= 0], back[back >= 0], np.full(int((back >= 0).sum()), size))))
        size *= 2
    to, back, size = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.argsort(to, kind="stable")
    return np.searchsorted(to[order], np.arange(len(at) + 1)).tolist(), back[order].tolist(), size[order].tolist()


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int) -> np.ndarray:
    """The cheapest cuts, the first (0) and the last included.

    With g(j) = cost(j) + P(j): g(j) = penalty(j) + the least of g(i) + window over the cuts i within `window`, and of g(i) + P(j) - P(i)
    where that length is a power of two.
    """
    begin, backs, sizes = shorter_windows(at, window)
    where, penalties = at.tolist(), (penalty + SEQUENCE_PENALTY).tolist()
    g, came = [0.0] * len(where), [0] * len(where)
    queue, head = [0], 0  # cuts that are the cheapest of all after them, by g
    for j in range(1, len(where)):
        low = where[j] - window
        while where[queue[head]] < low:
            head += 1
        i = queue[head]
        best = g[i] + window
        for k in range(begin[j], begin[j + 1]):
            if g[backs[k]] + sizes[k] < best:
                i = backs[k]
                best = g[i] + sizes[k]
        best += penalties[j]
        g[j], came[j] = best, i
        while len(queue) > head and g[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    cuts = [len(where) - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return at[cuts[::-1]]


def packed_chunk(doc_ids: list, tokens: list[bytes], sentence: np.ndarray, window: int, first_sequence: int) -> tuple[pd.DataFrame, int]:
    """The pieces of one chunk and the number of its sequences."""
    raw = b"".join(tokens)
    ids = np.frombuffer(raw, "<u4")
    sizes = np.array([len(t) // 4 for t in tokens], np.int64)
    doc_ends = np.cumsum(sizes)
    known = ids < len(sentence)
    ends = np.flatnonzero(sentence[np.where(known, ids, 0)] & known) + 1
    at, penalty = cut_points(ends, doc_ends, window)
    cuts = best_cuts(at, penalty, window)
    edges = np.union1d(cuts, doc_ends)
    edges = np.concatenate(([0], edges[edges > 0]))
    begin, end = edges[:-1], edges[1:]
    doc = np.searchsorted(doc_ends, begin, side="right")
    sequence = np.searchsorted(cuts, begin, side="right") - 1
    crcs = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
    pieces = pd.DataFrame({
        "doc_id": pd.array([doc_ids[i] for i in doc.tolist()], "Int64"), "start": begin - (doc_ends - sizes)[doc], "length": end - begin, "ids_crc32": np.array(crcs, np.int64),
        "doc_tokens": sizes[doc], "sequence_id": first_sequence + sequence, "offset": begin - cuts[sequence],
    })
    return pieces, len(cuts) - 1


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 1024, id_col: str = "doc_id", text_col: str = "text", cut: str = "spaces") -> DataFrame:
    """A row for each piece of a document; the columns are SCHEMA's. sequence_id is unique, not gapless.

    Null and empty texts are the end id alone. Null ids come first and stay null; rows with equal ids follow each other in the order of a hash of
    their texts, and each is packed. Of equally cheap cuts the earliest begin is taken. An empty table gives no pieces; other columns are not looked at.
    """

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_all, sentence, end = encoder(tokenizer_path, cut).encode_all, ends_sentence(tokenizer_path), np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        doc_ids, tokens, n = [], [], 0
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"], encode_all(batch["text"].tolist()), strict=True):
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                tokens.append(ids + end)
                n += len(tokens[-1]) // 4
                if n >= CHUNK_IDS:
                    pieces, made = packed_chunk(doc_ids, tokens, sentence, window, first)
                    yield pieces
                    doc_ids, tokens, n, first = [], [], 0, first + made
        if tokens:
            yield packed_chunk(doc_ids, tokens, sentence, window, first)[0]

    order = ["doc_id", F.xxhash64("text")]  # rows of one id may fill several ranges
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    with batches_of(docs.sparkSession, 512):
        return staged(ordered.mapInPandas(packed, SCHEMA), "packed").withColumnRenamed("doc_id", id_col)
