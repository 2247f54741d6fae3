"""Token ids in binary files: ids ranked by frequency, in byte-aligned variable length with separate control bytes.

A file is a sequence of blocks. In a block, ids are replaced by their rank among the block's own ids (the most frequent is
0, ties by id); a rank takes one to four bytes, whose number less one stands in two bits of the control bytes. A reader
turns each control byte into four lengths by a table, so that decoding is numpy lookups only. Blocks hold whole
documents, at least BLOCK_IDS ids but for the last; memory is bounded by that and the longest document.

Files are written by the tasks, one for each partition of a range partitioning by identifier, under names that hold the
attempt; the manifest that Spark commits says which count. Null identifiers come first, null texts are empty.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartosieve.llm.shared import batches_of, shared_path, shuffle_partitions, staged
from cartosieve.llm.tokens import encoder

MAGIC = b"RANKVB01"
HEAD = struct.Struct("<IIIQI")  # documents, ids, table entries, data bytes, crc32 of the rest
BLOCK_IDS = 1 << 21
NO_ID = -(1 << 63)
#: For each control byte, the lengths of its four values.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_ranks(ids: np.ndarray) -> tuple[np.ndarray, bytes, bytes]:
    """ids -> (the id of each rank, control bytes, data bytes)."""
    counts = np.bincount(ids)
    table = np.flatnonzero(counts)
    table = table[np.lexsort((table, -counts[table]))].astype("<u4")
    rank = np.zeros(len(counts), "<u4")
    rank[table] = np.arange(len(table), dtype="<u4")
    ranks = rank[ids]
    code = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    quads = np.zeros((len(ids) + 3) // 4 * 4, np.uint8)
    quads[: len(ids)] = code
    quads = quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    return table, np.bitwise_or.reduce(quads, axis=1).tobytes() if len(ids) else b"", data.tobytes()


def decode_ranks(n: int, table: np.ndarray, control: bytes, data: bytes) -> np.ndarray:
    """The ids again, as '<u4'."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    at = ends - lengths
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        ranks[more] |= raw[at[more] + k].astype(np.uint32) << (8 * k)
    return table[ranks].astype("<u4")


def pack_block(doc_ids: list[int], sizes: list[int], ids: np.ndarray) -> bytes:
    table, control, data = encode_ranks(ids)
    body = np.array(doc_ids, "<i8").tobytes() + np.array(sizes, "<u4").tobytes() + table.tobytes() + control + data
    return HEAD.pack(len(doc_ids), len(ids), len(table), len(data), zlib.crc32(body)) + body


def read_blocks(source) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, numbers of tokens, ids) of each block of an open file."""
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while head := source.read(HEAD.size):
        n_docs, n, n_table, n_data, crc = HEAD.unpack(head)
        n_control = (n + 3) // 4
        body = source.read(12 * n_docs + 4 * n_table + n_control + n_data)
        if zlib.crc32(body) != crc:
            raise ValueError("a block of the token file is damaged")
        at = 12 * n_docs
        table = np.frombuffer(body, "<u4", n_table, at)
        at += 4 * n_table
        ids = decode_ranks(n, table, body[at : at + n_control], body[at + n_control :])
        yield np.frombuffer(body, "<i8", n_docs), np.frombuffer(body, "<u4", n_docs, 8 * n_docs), ids


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", cut: str = "words") -> DataFrame:
    """Writes the files in ascending order of id_col and returns the manifest (part, file, n_docs, n_ids), already written."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, end = TaskContext.get(), np.array([end_id], "<u4").tobytes()
        encode_all = encoder(tokenizer_path, cut).encode_all
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.tok"
        fs, path = _open(folder)
        n_docs = n_ids = 0
        out = None
        ids, sizes, held, n_held = [], [], [], 0

        def flush():
            nonlocal held, n_held, ids, sizes
            out.write(pack_block(ids, sizes, np.frombuffer(b"".join(held), "<u4")))
            ids, sizes, held, n_held = [], [], [], 0

        for batch in batches:
            for doc_id, found in zip(batch["doc_id"], encode_all(batch["text"].tolist()), strict=True):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}")
                    out.write(MAGIC)
                tokens = found + end
                ids.append(doc_id)
                sizes.append(len(tokens) // 4)
                held.append(tokens)
                n_held += sizes[-1]
                n_docs += 1
                n_ids += sizes[-1]
                if n_held >= BLOCK_IDS:
                    flush()
        if out is not None:
            if held:
                flush()
            out.close()
            yield pd.DataFrame({"part": [task.partitionId()], "file": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]  # rows of one id may fill several ranges
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    with batches_of(docs.sparkSession, 512):
        return staged(ordered.mapInPandas(write, "part int, file string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files that the manifest names."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _open(folder)
        for batch in batches:
            for file, start in zip(batch["file"], batch["start"], strict=True):
                with fs.open_input_stream(f"{path}/{file}") as source:
                    for doc_ids, sizes, ids in read_blocks(source):
                        ends = np.cumsum(sizes, dtype=np.int64)
                        raw = ids.tobytes()
                        crcs = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                        yield pd.DataFrame({"doc_id": doc_ids, "start": start + ends - sizes, "n_tokens": sizes.astype(np.int64), "ids_crc32": np.array(crcs, np.int64)})
                        start += int(ends[-1])

    files, start = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r["part"]):  # a row for each file
        files.append((row["file"], start))
        start += row["n_ids"]
    listed = spark.createDataFrame(files, "file string, start long").repartition(max(1, min(len(files), 4 * shuffle_partitions(spark))))
    found = listed.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, **columns: str) -> DataFrame:
    """Writes the documents' ids to files and reads them back: (doc_id, start, n_tokens, ids_crc32), a row for each document.

    Null and empty texts are the end id alone. Null ids come first and stay null; rows with equal ids stand next to each other, in the order of a
    hash of their texts, and each counts. An empty table gives no file and no row; other columns are not looked at.
    """
    folder = folder or shared_path(docs.sparkSession, "tokens")
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, folder, tokenizer_path, end_id, **columns))
