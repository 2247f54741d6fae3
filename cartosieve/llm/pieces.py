"""Encoding to and decoding from SentencePiece pieces by unigram Viterbi over a double-array trie.

White space is written as the marker U+2581, and one is put before the text. The best segmentation is that with the
largest sum of log scores; of equal sums, that whose last piece is longest, and so on from the end. Characters that no piece covers score
UNKNOWN_PENALTY less than the least piece and are written as byte pieces. No piece of the vocabulary has a marker after another character
or a line break, so the best segmentation of a text is those of its chunks, joined; chunks met before are remembered,
and the new ones of a batch are segmented together, one position at a time.

The vocabulary files of merge-based tokenisers hold ranks, not probabilities; `zipf_scores` gives the piece of rank r the log
probability -ln(r + 1) - ln(sum of 1 / r), Zipf's law.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartosieve.llm.shared import batches_of, staged

MARK = "▁"
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
LONG_CHUNK = 48


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            at += 8
            yield key >> 3, raw[at - 8 : at]
        elif kind == 2:
            n = varint()
            at += n
            yield key >> 3, raw[at - n : at]
        else:
            at += 4
            yield key >> 3, raw[at - 4 : at]


def read_vocabulary(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each piece of a SentencePiece model file, by id."""
    with open(path, "rb") as f:
        raw = f.read()
    pieces = []
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
    return pieces


def zipf_scores(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """The same pieces with log probabilities by the rank of their scores, ties by id."""
    ranked = sorted((i for i, p in enumerate(pieces) if p[2] == NORMAL), key=lambda i: (-pieces[i][1], i))
    total = sum(1 / (r + 1) for r in range(len(ranked)))
    score = {i: float(np.float32(-np.log(r + 1) - np.log(total))) for r, i in enumerate(ranked)}
    return [(p, score.get(i, s), t) for i, (p, s, t) in enumerate(pieces)]


@dataclass
class PieceTrie:
    """Double-array trie over UTF-8 bytes: the child of state s by byte b is t = base[s] + b + 1 if check[t] == s."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  # id of the piece that ends in the state, or -1
    scores: np.ndarray  # by id
    byte_ids: np.ndarray  # id of each byte's piece
    spelled: list[bytes]  # what each id decodes to
    unknown_score: float

    @classmethod
    def build(cls, pieces: list[tuple[str, float, int]]) -> PieceTrie:
        byte_ids = np.full(256, -1)
        spelled = []
        root: dict = {}
        scores = np.array([s for _, s, _ in pieces], np.float64)
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                byte_ids[int(text[3:5], 16)] = i
                spelled.append(bytes([int(text[3:5], 16)]))
                continue
            spelled.append(text.encode() if kind in (NORMAL, USER_DEFINED) else b"")
            if kind not in (NORMAL, USER_DEFINED):
                continue
            if MARK in text.lstrip(MARK) or "\n" in text:
                raise ValueError(f"the piece {text!r} would span chunks")
            node = root
            for b in text.encode():
                node = node.setdefault(b, {})
            node[-1] = i
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        size = 1 << 12
        base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        lone_from = many_from = 1  # no free cell before them is tried again
        queue = [(0, root)]
        for state, node in queue:
            piece[state] = node.get(-1, -1)
            codes = np.array(sorted(b + 1 for b in node if b >= 0), np.int64)
            if not len(codes):
                continue
            if max(lone_from, many_from) + 2048 > size:
                base, check, piece = (np.concatenate((x, np.full(size, fill, np.int32))) for x, fill in ((base, 0), (check, -1), (piece, -1)))
                size *= 2
            first = int(codes[0])
            if len(codes) == 1:
                while check[lone_from] >= 0 or lone_from <= first:
                    lone_from += 1
                at = lone_from - first
            else:
                while True:
                    cells = many_from + np.flatnonzero(check[many_from : many_from + 512] < 0)
                    tries = cells[cells > first] - first
                    fits = (check[tries[:, None] + codes] < 0).all(axis=1)
                    if fits.any():
                        at = int(tries[fits.argmax()])
                        break
                    many_from += 512
                    if many_from + 2048 > size:
                        base, check, piece = (np.concatenate((x, np.full(size, fill, np.int32))) for x, fill in ((base, 0), (check, -1), (piece, -1)))
                        size *= 2
            base[state] = at
            for c in codes.tolist():
                check[at + c] = state
                queue.append((at + c, node[c - 1]))
        normal = [s for _, s, t in pieces if t == NORMAL]
        return cls(base, check, piece, scores, byte_ids, spelled, min(normal) - UNKNOWN_PENALTY)

    def segment_one(self, raw: bytes) -> list[int]:
        """Viterbi over one chunk of UTF-8."""
        n = len(raw)
        best, came, by = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, piece, scores = self.base, self.check, self.piece, self.scores
        for i in range(n):
            if raw[i] & 0xC0 == 0x80:
                continue
            end = i + 1
            while end < n and raw[end] & 0xC0 == 0x80:
                end += 1
            state, whole = 0, False
            for j in range(i, n):
                t = base[state] + raw[j] + 1
                if check[t] != state:
                    break
                state = t
                if piece[t] >= 0:
                    whole |= j + 1 == end
                    value = best[i] + scores[piece[t]]
                    if value > best[j + 1]:
                        best[j + 1], came[j + 1], by[j + 1] = value, i, int(piece[t])
            if not whole and best[i] + self.unknown_score > best[end]:
                best[end], came[end], by[end] = best[i] + self.unknown_score, i, -1
        out, at = [], n
        while at:
            out.append([by[at]] if by[at] >= 0 else self.byte_ids[list(raw[came[at] : at])].tolist())
            at = came[at]
        return [i for part in reversed(out) for i in part]

    def segment_many(self, chunks: list[bytes]) -> list[bytes]:
        """The ids ('<u4') of each chunk, one position of all chunks at a time."""
        n, sizes = len(chunks), np.array([len(c) for c in chunks])
        width = int(sizes.max())
        text = np.zeros((n, width + 1), np.int32)
        flat = np.frombuffer(b"".join(chunks), np.uint8)
        text[np.arange(width + 1) < sizes[:, None]] = flat
        starts = (text & 0xC0 != 0x80) & (np.arange(width + 1) < sizes[:, None])
        best, came, by = np.full((n, width + 1), -np.inf), np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        best[:, 0] = 0
        for i in range(width):
            rows = np.flatnonzero(starts[:, i])
            state, live, whole = np.zeros(len(rows), np.int32), rows, np.zeros(n, bool)
            stop = np.where(text[rows, i] < 0x80, 1, np.where(text[rows, i] < 0xE0, 2, np.where(text[rows, i] < 0xF0, 3, 4))) + i
            for j in range(i, width):
                t = self.base[state] + text[live, j] + 1
                ok = (self.check[t] == state) & (j < sizes[live])
                live, state = live[ok], t[ok]
                if not len(live):
                    break
                found = self.piece[state]
                hit = found >= 0
                r, p = live[hit], found[hit]
                value = best[r, i] + self.scores[p]
                better = value > best[r, j + 1]
                r, p = r[better], p[better]
                best[r, j + 1], came[r, j + 1], by[r, j + 1] = value[better], i, p
                if j - i < 4:
                    whole[live[hit]] |= (j + 1) == stop[np.searchsorted(rows, live[hit])]
            lone = ~whole[rows]
            r, end = rows[lone], stop[lone]
            better = best[r, i] + self.unknown_score > best[r, end]
            r, end = r[better], end[better]
            best[r, end], came[r, end], by[r, end] = best[r, i] + self.unknown_score, i, -1
        out: list[list[int]] = []
        came_rows, by_rows = came.tolist(), by.tolist()
        for raw, size, c, b in zip(chunks, sizes.tolist(), came_rows, by_rows, strict=True):
            ids, at = [], size
            while at:
                if b[at] >= 0:
                    ids.append(b[at])
                else:
                    ids.extend(self.byte_ids[list(raw[c[at] : at])[::-1]].tolist())
                at = c[at]
            out.append(ids[::-1])
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in out]


class PieceEncoder:
    """encode(texts) -> ids ('<u4') of each; room bounds the chunks that are remembered."""

    def __init__(self, trie: PieceTrie, room: int = 500_000):
        self.trie, self.room, self.memo = trie, room, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        chunks = [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*chunks).difference(self.memo)
        short: dict[int, list[str]] = {}
        fresh: dict[str, bytes] = {}
        for c in new:
            n = len(c.encode())
            if n > LONG_CHUNK:
                fresh[c] = np.array(self.trie.segment_one(c.encode()), "<u4").tobytes()
            else:
                short.setdefault((n + 7) // 8, []).append(c)
        for group in short.values():
            for i in range(0, len(group), 8192):
                part = group[i : i + 8192]
                fresh.update(zip(part, self.trie.segment_many([c.encode() for c in part]), strict=True))
        if len(self.memo) + len(fresh) <= self.room:
            self.memo.update(fresh)
            return [b"".join(map(self.memo.__getitem__, c)) for c in chunks]
        known = {c: self.memo[c] for part in chunks for c in part if c in self.memo} | fresh
        return [b"".join(map(known.__getitem__, c)) for c in chunks]


def decode(ids: bytes, trie: PieceTrie) -> str:
    """Pieces and byte pieces to text, markers to spaces, without the one put before it. Bytes that are no UTF-8 become U+FFFD."""
    spelled = trie.spelled
    text = b"".join([spelled[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


_ENCODERS: dict[int, PieceEncoder] = {}  # by broadcast; a Python worker keeps the last one between its tasks


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, n_byte_pieces, ids_crc32, decoded_sha256, round_trip), a row for each document.

    round_trip: decoding the ids gives the text, with U+2581 in it read as a space. Null and empty texts have no ids. Of segmentations
    with equal sums that with the longest last piece is taken. Null ids stay null, repeated rows give equal rows, an empty table gives none;
    other columns are not looked at.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(PieceTrie.build(zipf_scores(read_vocabulary(model_path))))  # as large as the vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        if id(trie) not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[id(trie)] = PieceEncoder(trie)
        encoder = _ENCODERS[id(trie)]
        is_byte = np.zeros(len(trie.spelled), bool)
        is_byte[trie.byte_ids] = True
        for batch in batches:
            texts = batch["text"].tolist()
            rows = []
            for text, ids in zip(texts, encoder.encode(texts), strict=True):
                back = decode(ids, trie)
                rows.append((len(ids) // 4, int(is_byte[np.frombuffer(ids, "<u4")].sum()), zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == text.replace(MARK, " ")))
            found = pd.DataFrame(rows, columns=["n_ids", "n_byte_pieces", "ids_crc32", "decoded_sha256", "round_trip"])
            found.insert(0, "doc_id", batch["doc_id"])
            yield found

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with batches_of(spark, 512):
        found = staged(rows.mapInPandas(run, "doc_id long, n_ids long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"), "pieces")
    return found.withColumnRenamed("doc_id", id_col)
