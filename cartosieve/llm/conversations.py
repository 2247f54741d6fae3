"""Conversation structure repair by a checkpointed dynamic program.

A conversation's rows stand by turn. Repaired, the first letters of its roles are nothing or an optional s and then ua, once or more. Keeping a row
costs 0, giving it the role user or assistant REROLE, deleting it DELETE, inserting an empty user or assistant INSERT, and an undeleted truncated row TRUNCATED; blank
and repeated rows must go. Where a conversation stands is one of four states (nothing yet, after s, u, a); a state-cost vector says what the
rest costs from each of them. Vectors are computed backward and kept only at checkpoints; walking forward, each block between two
checkpoints is recomputed and the tight edit whose letter is the least in ASCII (D, I, K, R) is taken.

In Spark the checkpoints are on two levels. Rows without their texts are sorted by range and cut into chunks of CHUNK rows, wherever
conversations begin and end; a chunk of a conversation that goes on in another task or chunk has its costs from each state to each state computed
(a matrix of 16 numbers). These matrices, one for each CHUNK rows, give the vector at each such chunk's end, from the last chunk back. Then the texts,
sorted, meet their chunks: one pass in order walks each chunk, within it with checkpoints every square root of its rows, and feeds the digest
of the repaired conversation, which can only be computed in order. It holds one chunk and the letters of one conversation's audit at a time.
Which rows repeat earlier ones is found by aggregation, so that a conversation that holds a third of all rows is never held in one place.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartosieve.llm.shared import batches_of, staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
CHUNK = 4096
#: States: nothing yet, after s, after u, after a. What stands for a role's first letter when it is another one, or there is none: 3.
LETTERS = "sua"
AFTER = ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))
#: The only role that can be inserted or given in each state, as the state after it.
NEXT = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Codes of rows: must go since blank, since repeated, then 2 + letter, 4 more where truncated.
BLANK, REPEATED, FIRST_CODE = 0, 1, 2
SPACE = "\\x20\\x09-\\x0D"
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGES = "conv_id long, place long, edit string, role string, text string"
KEY = ["conv_id", "turn", "role", "digest"]


def closed(costs: tuple[int, ...]) -> tuple[int, ...]:
    """The same costs where rows may be inserted first."""
    return tuple(min(costs[q], INSERT + costs[NEXT[q]], 2 * INSERT + costs[NEXT[NEXT[q]]]) for q in range(4))


#: What it costs to end in each state: nothing, or as many inserted rows as it takes.
LAST = closed((0, 1 << 20, 1 << 20, 0))


def edges(after: tuple[int, ...], code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """The edits of a row in a state, but for insertion: letter, cost of all that is left, state after it."""
    yield "D", DELETE + after[state], state
    if code >= FIRST_CODE:
        letter, truncated = (code - FIRST_CODE) % 4, (code - FIRST_CODE) // 4
        kept = AFTER[state][letter] if letter < 3 else None
        if kept is not None:
            yield "K", KEEP + TRUNCATED * truncated + after[kept], kept
        yield "R", REROLE + TRUNCATED * truncated + after[NEXT[state]], NEXT[state]


@lru_cache(maxsize=1 << 16)
def backward(after: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """The vector before a row from that after it, both less their smallest cost, and that difference. There are few such vectors."""
    costs = closed(tuple(min(cost for _, cost, _ in edges(after, code, q)) for q in range(4)))
    least = min(costs)
    return tuple(c - least for c in costs), least


@lru_cache(maxsize=1 << 16)
def walked(after: tuple[int, ...], code: int, state: int) -> tuple[str, int]:
    """The letters of a row, insertions before it included, from a state: of the tight edits the least each time."""
    costs = closed(tuple(min(cost for _, cost, _ in edges(after, code, q)) for q in range(4)))
    letters = ""
    while True:
        options = [(letter, to) for letter, cost, to in edges(after, code, state) if cost == costs[state]]
        if INSERT + costs[NEXT[state]] == costs[state]:
            options.append(("I", NEXT[state]))
        letter, to = min(options)
        letters, state = letters + letter, to
        if letter != "I":
            return letters, state


def tight_edits(codes: bytes, after: tuple[int, ...], state: int) -> Iterator[str]:
    """The letters of each row of a chunk, whose end has these costs, walking from a state."""
    step = max(1, math.isqrt(len(codes)))
    least = min(after)
    vector = tuple(c - least for c in after)
    checkpoints = {}
    for i in range(len(codes) - 1, -1, -1):
        if (i + 1) % step == 0 or i + 1 == len(codes):
            checkpoints[i // step] = vector
        vector, _ = backward(vector, codes[i])
    for block in range(-(-len(codes) // step)):
        begin, end = block * step, min(len(codes), (block + 1) * step)
        vector, vectors = checkpoints.pop(block), []
        for i in range(end - 1, begin - 1, -1):
            vectors.append(vector)
            vector, _ = backward(vector, codes[i])
        for i in range(begin, end):
            letters, state = walked(vectors[begin - i - 1 + end - begin], codes[i], state)
            yield letters


def matrix(codes: bytes) -> list[int]:
    """What a chunk costs from each state (rows) to each state at its end: 16 numbers."""
    far = 1 << 40
    columns = []
    for q in range(4):
        vector, total = closed(tuple(0 if i == q else far for i in range(4))), 0
        for code in reversed(codes):
            vector, least = backward(vector, code)
            total += least
        columns.append([min(far, total + c) for c in vector])
    return [columns[j][i] for i in range(4) for j in range(4)]


def faults(rows: DataFrame) -> DataFrame:
    """KEY, copies and the code of each distinct row; its copies but the first are repeated rows. A row that is not there (no copies) goes at no cost."""
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    truncated = ~F.col("text").rlike(f"[.!?][{SPACE}]*\\z")
    distinct = rows.groupBy(*KEY).agg(F.sum("copies").alias("copies"), F.min(blank).alias("blank"), F.min(truncated).alias("truncated"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    repeated = (
        rows.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first != last")
        .select(F.col("conv_id").alias("r_conv"), F.col("role").alias("r_role"), F.col("digest").alias("r_digest"), "first")
    )
    joined = distinct.join(repeated, distinct["conv_id"].eqNullSafe(F.col("r_conv")) & (distinct["role"] == F.col("r_role")) & (distinct["digest"] == F.col("r_digest")), "left")
    letter = F.coalesce(*(F.when(F.col("role").startswith(c), i) for i, c in enumerate(LETTERS)), F.lit(3))
    code = F.when(F.col("blank"), BLANK).when((F.col("copies") == 0) | F.coalesce(at != F.col("first"), F.lit(False)), REPEATED).otherwise(FIRST_CODE + letter + F.when(F.col("truncated"), 4).otherwise(0))
    return joined.select(*KEY, "copies", code.cast("int").alias("code"))


def chunks(coded: DataFrame, chunk_rows: int) -> DataFrame:
    """Chunks of rows in order, under the key of their first row: codes and copies of each, a matrix where a conversation may go on in another."""
    schema = "conv_id long, turn long, role string, digest binary, chunk long, codes binary, copies binary, matrix array<long>"
    kinds = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "digest": pa.binary(), "chunk": pa.int64(), "codes": pa.binary(), "copies": pa.binary(), "matrix": pa.list_(pa.int64())}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made, head, codes, copies, partial = TaskContext.get().partitionId() << 40, [], None, bytearray(), [], True

        def close(goes_on: bool) -> None:
            nonlocal number
            made.append([*head, number, bytes(codes), np.array(copies, "<i8").tobytes(), matrix(bytes(codes)) if partial or goes_on else None])
            number += 1

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*KEY, "copies", "code")), strict=True):
                same = head is not None and row[0] == head[0]
                if head is not None and (not same or len(codes) == chunk_rows):
                    close(same)
                    partial, codes, copies, head = same, bytearray(), [], None
                if head is None:
                    head = row[:4]
                codes.append(row[5])
                copies.append(row[4])
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*made, strict=True), kinds.values(), strict=True)], names=list(kinds))
                made.clear()
        if head is not None:
            close(True)
            yield pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*made, strict=True), kinds.values(), strict=True)], names=list(kinds))

    return coded.repartitionByRange(*KEY).sortWithinPartitions(*KEY).mapInArrow(cut, schema)


def chunk_ends(cut: DataFrame) -> DataFrame:
    """(chunk, costs at its end) of the chunks with a matrix, from each conversation's last one back; it reads the matrices alone."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, vector = object(), LAST
        for batch in batches:
            numbers, ends = [], []
            for conv, number, m in zip(batch.column("conv_id").to_pylist(), batch.column("chunk").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
                if conv != conversation:
                    conversation, vector = conv, LAST
                numbers.append(number)
                ends.append(vector)
                costs = [min(m[4 * q + to] + vector[to] for to in range(4)) for q in range(4)]
                vector = tuple(c - min(costs) for c in costs)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["number", "ends"])

    partial = cut.where("matrix is not null").select("conv_id", "chunk", "matrix")
    return partial.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk")).mapInArrow(chained, "number long, ends array<long>")


class Repair:
    """One conversation on its way: what it was, its edits, its repaired rows."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state, self.place, self.cost = conv_id, 0, 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.letter = None
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def line(self, edit: str, role: str, text: str) -> tuple:
        self.digest.update((b"\n" if self.place else b"") + f"{role}:{text}".encode())
        self.place += 1
        return self.conv_id, self.place - 1, edit, role, text

    def row(self, letters: str, code: int, copies: int, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        """Takes a row and its copies; gives the repaired rows that come of it."""
        if not copies:
            return
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        first = role[:1]
        self.illegal += copies - 1 + (self.letter is not None and self.letter + first not in LEGAL)
        self.letter = first
        if code < FIRST_CODE:
            self.blank, self.duplicate = self.blank + copies * (code == BLANK), self.duplicate + copies * (code == REPEATED)
            letters = "D"
        else:
            truncated = (code - FIRST_CODE) // 4
            self.duplicate, self.truncated = self.duplicate + copies - 1, self.truncated + truncated
            if letters[-1] != "D":
                self.cost += TRUNCATED * truncated
        for edit in letters:
            if edit == "D":
                self.cost += DELETE
            elif edit == "K":
                self.state = AFTER[self.state][LETTERS.index(first)]
                yield self.line(edit, role, text)
            else:
                self.state = NEXT[self.state]
                self.cost += INSERT if edit == "I" else REROLE
                yield self.line(edit, NAMES[self.state], "" if edit == "I" else text)
        self.cost += DELETE * (copies - 1)
        self.audit.append(letters + "D" * (copies - 1))

    def end(self) -> Iterator[tuple]:
        """The rows inserted at the end."""
        while self.state not in (0, 3):
            self.state = NEXT[self.state]
            self.cost += INSERT
            self.audit.append("I")
            yield self.line("I", NAMES[self.state], "")

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def walk(placed: DataFrame, messages: bool) -> DataFrame:
    """Sorted chunks and texts -> the conversations' summaries, or their repaired rows."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()] if messages else [*[pa.int64()] * 7, pa.string(), pa.string()]
    names = [field.split()[0] for field in (MESSAGES if messages else SUMMARY).split(", ")]
    full, room = 512, 8 << 20

    def walking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, plan, last, out, size = None, iter(()), None, [], 0

        def taken(rows: Iterator[tuple]) -> None:
            nonlocal size
            for row in rows:
                if messages:
                    out.append(row)
                    size += len(row[4])

        def ended() -> None:
            nonlocal size
            taken(now.end())
            if not messages:
                out.append(now.summary())
                size += len(out[-1][7])

        def batch_of() -> pa.RecordBatch:
            nonlocal size
            made = pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            size = 0
            return made

        for batch in batches:
            for conv, turn, role, digest, kind, codes, copies, ends, text in zip(*(batch.column(c).to_pylist() for c in (*KEY, "kind", "codes", "copies", "ends", "text")), strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        ended()
                    now, last = Repair(conv), None
                if kind == 0:
                    plan = zip(tight_edits(codes, tuple(ends), now.state), codes, np.frombuffer(copies, "<i8").tolist(), strict=True)
                elif (turn, role, digest) != last:
                    last = turn, role, digest
                    letters, code, n = next(plan)
                    taken(now.row(letters, code, n, turn, role, text))
                if len(out) >= full or size >= room:
                    yield batch_of()
        if now is not None:
            ended()
        if out:
            yield batch_of()

    return placed.mapInArrow(walking, MESSAGES if messages else SUMMARY)


def repair(rows: DataFrame, messages: bool = False, chunk_rows: int = CHUNK) -> DataFrame:
    """rows(conv_id, turn, role, text, copies) -> a row for each conversation (SUMMARY), or with messages its repaired rows (MESSAGES).

    `copies` says how often a row stands (0: its conversation is named, but the row is not there). Rows go by turn, nulls first; of one turn by role, then by the SHA-256 of the
    text, copies adjacent. Null roles and texts are one space; null conversation ids are one conversation. An empty role has no letter: it can be reroled
    or deleted only. Conversations without rows have zeros, an empty audit and the digest of nothing; empty tables give no rows. Other columns are not looked at.
    """
    full = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("copies").cast("long").alias("copies"),
    ).withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    spark = rows.sparkSession
    with batches_of(spark, 4096):
        cut = staged(chunks(faults(full), chunk_rows), "chunks")
    ends = chunk_ends(cut)
    last = F.array(*(F.lit(c).cast("long") for c in LAST))
    heads = cut.join(ends, cut["chunk"] == ends["number"], "left").select(*KEY, F.lit(0).alias("kind"), "codes", "copies", F.coalesce("ends", last).alias("ends"), F.lit(None).cast("string").alias("text"))
    none = F.lit(None)
    texts = full.select(*KEY, F.lit(1).alias("kind"), none.cast("binary").alias("codes"), none.cast("binary").alias("copies"), none.cast("array<long>").alias("ends"), F.when(F.col("copies") > 0, F.col("text")).alias("text"))
    placed = heads.union(texts).repartition("conv_id").sortWithinPartitions(*KEY, "kind")
    with batches_of(spark, 512):
        return staged(walk(placed, messages), "repaired")


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with a tenth or so of their turns damaged, by the CRC-32 of conv_id:turn modulo 20: 0 drops the rows, 1 empties their texts, 2 removes full stops, exclamation
    and question marks, 3 repeats them, 4 makes them a user's. Nulls are one space, in conv_id and turn too where they make the CRC."""
    blank = F.lit(" ")
    how: Column = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text = F.coalesce("text", blank)
    return conversations.select(
        "conv_id", "turn", F.when(how == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(how == 1, "").when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("copies"),
    )
