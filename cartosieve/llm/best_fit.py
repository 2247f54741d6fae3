"""Best-fit packing by linear grouping: as few sequences as can be found, over counts of lengths.

No piece is longer than the window, so how many pieces there are of each length is a table of at most `window` rows, whatever the
corpus; the whole plan is made over these counts. Large lengths (over `window // LARGE`) are sorted and put into GROUPS groups of
equal cardinality, each rounded up to its longest. Which few-size configurations fill the windows best is a linear program over
the rounded sizes, solved by column generation (the simplex method, its columns priced by a knapsack). Whole multiples of its
configurations are used. Actual pieces stand in for the rounded ones: for each slot the longest that is left and not longer than
it, for the last of a window the longest that fits what room the others have left; then some slot of that length gets a shorter piece
instead, so that there is a piece for every slot. Where the pieces leave over a TIGHTth of a window (rounding took too much), the rest of that configuration is not
used. What is left over, and then the small pieces, longest first, go where they fit best: into the window with the least room that holds them.

The plan consists of runs: pieces of one length, by their rank among all of that length, onto windows in a row. Windows in a row differ
where a length runs out (LARGE times at most, for each) or a configuration ends; later each length cuts one such row in two or three. What room a row has at least halves whenever it is
used, so that there are at most log2(window) * (LARGE + 2) * window runs: 16 MB at the very most. Ranks come from counts by task and length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartosieve.llm.shared import batches_of, staged
from cartosieve.llm.tokens import encoder

LARGE = 8
GROUPS = 32
TIGHT = 16
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
RANK_BITS = 46  # ranks of one length; lengths take the rest of a key


class Run(NamedTuple):
    """`count` pieces of one length from rank `rank` on, `each` to a sequence from `sequence` on, the first of each at `offset`."""

    length: int
    rank: int
    count: int
    each: int
    sequence: int
    offset: int


def best_configuration(sizes: list[int], worth: np.ndarray, window: int) -> tuple[float, list[int]]:
    """The most that sizes of these worths, each as often as wanted, make up within the window, and how often each stands in it."""
    best, chosen = np.zeros(window + 1), []
    for _ in range(window // min(sizes)):
        better, by = best.copy(), np.full(window + 1, -1)
        for i, size in enumerate(sizes):
            value = best[: window + 1 - size] + worth[i]
            wins = value > better[size:] + 1e-12
            better[size:][wins] = value[wins]
            by[size:][wins] = i
        chosen.append(by)
        best = better
    times, room = [0] * len(sizes), window
    for by in reversed(chosen):
        if by[room] >= 0:
            times[by[room]] += 1
            room -= sizes[by[room]]
    return float(best[window]), times


def configurations(sizes: list[int], demand: list[int], window: int) -> list[tuple[list[int], float]]:
    """The configurations of an optimal solution of the linear program, and how often it uses each: times of every size add up to the demand."""
    columns = np.diag([float(window // size) for size in sizes])
    wanted = np.array(demand, float)
    for _ in range(100 * len(sizes)):
        amounts = np.linalg.solve(columns, wanted)
        worth = np.linalg.solve(columns.T, np.ones(len(sizes)))
        value, times = best_configuration(sizes, worth, window)
        if value <= 1 + 1e-7:
            break
        change = np.linalg.solve(columns, np.array(times, float))
        ratio = np.where(change > 1e-9, np.maximum(amounts, 0) / np.where(change > 1e-9, change, 1), np.inf)
        columns[:, int(ratio.argmin())] = times
    amounts = np.linalg.solve(columns, wanted)
    return [(columns[:, j].astype(int).tolist(), float(amounts[j])) for j in range(len(sizes))]


def equal_groups(counts: list[tuple[int, int]], groups: int) -> dict[int, int]:
    """(length, count), longest first -> how many pieces are rounded up to which length: groups of equal cardinality (the last may be smaller), each as long as its longest."""
    size = max(1, -(-sum(count for _, count in counts) // groups))
    made: dict[int, int] = {}
    rounded, room = 0, 0
    for length, count in counts:
        while count:
            if not room:
                rounded, room = length, size
            take = min(room, count)
            made[rounded] = made.get(rounded, 0) + take
            count, room = count - take, room - take
    return made


class Pool:
    """The pieces that are left of each length; those of one length go by rank."""

    def __init__(self, counts: list[tuple[int, int]]):
        self.left, self.rank, self.lengths = dict(counts), dict.fromkeys(dict(counts), 0), sorted(dict(counts))

    def longest(self, room: int, used: dict[int, int]) -> int | None:
        """The greatest length of which a piece is left beside those `used` and which fits."""
        at = bisect.bisect_right(self.lengths, room) - 1
        while at >= 0 and self.left[self.lengths[at]] <= used.get(self.lengths[at], 0):
            at -= 1
        return self.lengths[at] if at >= 0 else None

    def take(self, length: int, n: int) -> int:
        """The first rank of n pieces."""
        rank = self.rank[length]
        self.rank[length] += n
        self.left[length] -= n
        if not self.left[length]:
            self.lengths.remove(length)
        return rank


def packing_plan(histogram: dict[int, int], window: int, groups: int = GROUPS) -> list[Run]:
    """Where the pieces of each length go."""
    runs: list[Run] = []
    rooms: list[int] = []  # the room left of the windows begun, ascending, and those windows: first, how many
    windows: dict[int, list[tuple[int, int]]] = {}
    sequence = 0

    def begun(first: int, n: int, room: int) -> None:
        if n and room:
            if room not in windows:
                bisect.insort(rooms, room)
                windows[room] = []
            windows[room].append((first, n))

    def best_fit(length: int, rank: int, count: int) -> None:
        nonlocal sequence
        while count:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = window // length
                first, n, room = sequence, max(1, count // each), window
                sequence += n
            else:
                room = rooms[at]
                first, n = windows[room].pop()
                if not windows[room]:
                    del windows[room], rooms[at]
            each = min(room // length, count)
            used = min(n, count // each)
            runs.append(Run(length, rank, used * each, each, first, window - room))
            begun(first, used, room - each * length)
            begun(first + used, n - used, room)
            rank, count = rank + used * each, count - used * each

    if histogram.get(window):
        runs.append(Run(window, 0, histogram[window], 1, 0, 0))
        sequence = histogram[window]
    counts = sorted(((length, n) for length, n in histogram.items() if n and length < window), reverse=True)
    pool = Pool([c for c in counts if c[0] > window // LARGE])
    if pool.lengths:
        rounded = equal_groups([c for c in counts if c[0] > window // LARGE], groups)
        sizes = list(rounded)
        for times, amount in configurations(sizes, list(rounded.values()), window):
            slots, whole = [size for size, k in zip(sizes, times, strict=True) for _ in range(k)], int(amount + 1e-6)
            while whole and slots:
                used: dict[int, int] = {}
                room, chosen = window, []
                for i, slot in enumerate(slots):
                    length = pool.longest(room if i + 1 == len(slots) else slot, used)
                    if length is None:
                        break
                    chosen.append(length)
                    used[length] = used.get(length, 0) + 1
                    room -= length
                if not chosen or room > window // TIGHT:
                    break
                n = min(whole, *(pool.left[length] // k for length, k in used.items()))
                offset = 0
                for length in chosen:
                    runs.append(Run(length, pool.take(length, n), n, 1, sequence, offset))
                    offset += length
                begun(sequence, n, room)
                sequence, whole = sequence + n, whole - n
    for length in reversed(list(pool.lengths)):
        best_fit(length, pool.rank[length], pool.left[length])
    for length, n in counts:
        if length <= window // LARGE:
            best_fit(length, 0, n)
    return runs


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, window: int, id_col: str, text_col: str, cut: str, with_ids: bool) -> DataFrame:
    """The pieces of each document; nth counts those of the same length in the same task."""
    schema = PIECE + (", ids binary" if with_ids else "")
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "part": pa.int32(), "ids": pa.binary()}

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, end, part = encoder(tokenizer_path, cut).encode_all, np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_all(batch.column(1).to_pylist()), strict=True):
                raw = ids + end
                for piece, at in enumerate(range(0, len(raw), 4 * window)):
                    own = raw[at : at + 4 * window]
                    n = len(own) // 4
                    row = (doc_id, piece, at // 4, n, zlib.crc32(own), part, seen[n], own)
                    seen[n] += 1
                    for name, value in zip(names, row, strict=False):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[name], kinds.get(name, pa.int64())) for name in names], names=names)

    shown = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with batches_of(docs.sparkSession, 512):
        return staged(shown.mapInArrow(cut_up, schema), "pieces")


def best_fit_packing(
    docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 4096, id_col: str = "doc_id", text_col: str = "text", cut: str = "words", with_ids: bool = False
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with_ids the ids themselves ('<u4').

    Null and empty texts are the end id alone. Only documents of over `window` ids are cut, into pieces of `window`, the last one as long as it comes;
    very long texts are many such pieces. Null and repeated ids are packed like any others, row by row. Pieces of equal length are interchangeable: which of them goes
    where depends on the task that read them. Sequence numbers are gapless from 0. An empty table gives no pieces; other columns are not looked at.
    """
    pieces = token_pieces(docs, tokenizer_path, end_id, window, id_col, text_col, cut, with_ids)
    counts = staged(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    runs = sorted(packing_plan(histogram, window))
    plan = np.array(runs, np.int64).reshape(-1, 6)
    begins = (plan[:, 0] << RANK_BITS) + plan[:, 1]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = pieces.join(counts.select(F.col("part"), F.col("length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), ["part", "length"])
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.searchsorted(begins, (length << RANK_BITS) + rank, side="right") - 1
            nth, each = rank - plan[run, 1], plan[run, 3]
            sequence, offset = plan[run, 4] + nth // each, plan[run, 5] + nth % each * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*kept, (F.col("before") + F.col("nth")).alias("rank")).mapInArrow(placed, schema).withColumnRenamed("doc_id", id_col)
