"""Near-duplicate groups by an LSH forest over MinHash signatures.

Every document is its set of hashed word shingles; documents with equal sets are one node. A forest has `trees` orders of
nodes, each sorted by its own run of min-hashes; the longer the prefix that two nodes have in common, the nearer they stand
and the more alike they are. Candidates are neighbours in such an order: the two next to a node, which share its longest
common prefixes, and all of its region, the nodes with the same first min-hashes. How many of these must be the same adapts
to the region: MIN_DEPTH where that leaves up to LEAF nodes, more where the order is crowded. A group of thousands of near
copies so costs its size, not the square of it.

Candidates whose signatures estimate a similarity far below the threshold are dropped (MARGIN, over four standard
deviations), all others confirmed on the full sets: first the nearest neighbours, then of the others those that these links
have not put in one component. Crowded regions that hold several components after that are finished exactly (see
all_candidates), so that no link is left out there. Components follow by alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartosieve.llm.shared import batches_of, shuffle_partitions, slices, staged

TREES = 16
DEPTH = 8
MIN_DEPTH = 3
LEAF = 6
MARK_BITS = 1 << 24
MARGIN = 0.15
SALT_ROWS = 2048
SLICE_CHARS = 1 << 19  # hashed at once
BASE = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64."""
    up, down = np.full(n, BASE, U64), np.full(n, pow(BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of UTF-8 bytes: runs without space and control white space, A-Z lower-cased."""
    if not len(raw):
        return np.array([], U64), np.array([], np.int64)
    b = raw + ((raw >= 65) & (raw <= 90)) * np.uint8(32)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(1 << max(16, int(len(b)).bit_length()))
    total = np.concatenate((np.zeros(1, U64), np.cumsum((b.astype(U64) + U64(1)) * up[: len(b)])))
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)), start


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, of none the empty set."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raws])
    words, start = word_hashes(np.frombuffer(b"\n".join(raws), np.uint8))
    first = np.searchsorted(start, np.concatenate(([0], ends)))
    mixed = np.zeros(max(0, len(words) - width + 1), U64)
    for k in range(width):
        mixed = _mix(mixed * U64(3) + words[k : k + len(mixed)] + U64(k + 1))
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(mixed[a : b - width + 1]))
        elif b > a:
            h = np.array([b - a], U64)
            for k in range(a, b):
                h = _mix(h * U64(5) + words[k : k + 1])
            sets.append(h)
        else:
            sets.append(np.array([], U64))
    return sets


def set_key(hashes: np.ndarray) -> bytes | None:
    """128 bits that stand for the whole set."""
    if not len(hashes):
        return None
    with np.errstate(over="ignore"):
        a = _mix(hashes * U64(0xA24BAED4963EE407)).sum(dtype=U64)
        b = np.bitwise_xor.reduce(_mix(hashes + U64(0x9FB21C651E98DF25)))
    return a.tobytes() + b.tobytes()


@lru_cache(1)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, n, np.uint32)[:, None], rng.integers(0, 1 << 31, n, np.uint32)[:, None] * np.uint32(2) + np.uint32(1)


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    flip, factor = _permutations(n)
    return ((((hashes >> U64(32)).astype(np.uint32) ^ flip) * factor)).min(axis=1)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, trees: int, depth: int) -> DataFrame:
    """(row_id, text_sha256, node, n_shingles, signature) of each row; node and signature are null for the empty set.

    A signature is trees * depth min-hashes of two bytes each, a run of `depth` for each tree.
    """
    n_hashes = trees * depth

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [s for some in slices(batch["text"].tolist(), chars=SLICE_CHARS) for s in shingle_sets(some, width)]
            yield pd.DataFrame({
                "row_id": batch["row_id"], "text_sha256": batch["text_sha256"], "node": [set_key(s) for s in sets], "n_shingles": [len(s) for s in sets],
                "signature": [signature(s, n_hashes).astype("<u2").tobytes() if len(s) else None for s in sets],
            })

    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    return rows.mapInPandas(sketch, "row_id long, text_sha256 string, node binary, n_shingles long, signature binary")


PAIR, CROWDED, BORDER = 0, 1, 2
FOREST = "kind byte, a binary, b binary, step int, place long"


def shared_runs(keys: np.ndarray) -> np.ndarray:
    """keys (n, 1 + 2 * depth) in sorted order, a tree's number and its run -> how many min-hashes each key shares, from the first, with the next."""
    if len(keys) < 2:
        return np.zeros(0, np.int64)
    runs = np.ascontiguousarray(keys[:, 1:]).view("<u2")
    same = (runs[1:] == runs[:-1]) & (keys[1:, :1] == keys[:-1, :1])
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


def region_sizes(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, first) of the region of `depth` around each key, from shared_runs."""
    first = np.concatenate(([0], np.flatnonzero(common < depth) + 1))
    size = np.diff(np.concatenate((first, [len(common) + 1])))
    return np.repeat(size, size), np.repeat(first, size)


def neighbour_pairs(common: np.ndarray, depth: int, leaf: int) -> Iterator[tuple[int, np.ndarray]]:
    """(step, at): the keys at and at + step are candidates.

    The two next to each other in the order are, if they share MIN_DEPTH min-hashes: each is the other's longest common
    prefix on that side. So are all within a region of at most `leaf` keys, where the depth of the region is as small as
    can be: it adapts to how crowded the order is there.
    """
    adapted = np.full(len(common) + 1, depth + 1)
    for d in range(depth, MIN_DEPTH - 1, -1):
        adapted[region_sizes(common, d)[0] <= leaf] = d
    within = common
    for step in range(1, leaf):
        if step > 1:
            within = np.minimum(within[:-1], common[step - 1 :])
        near = within >= MIN_DEPTH
        if step > 1:
            near &= within >= np.minimum(adapted[:-step], adapted[step:])
        yield step, np.flatnonzero(near)


def _frame(kind: int, a: list, b: list, step=0, place=0) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(a), kind, np.int8), "a": a, "b": b, "step": np.full(len(a), step, np.int32), "place": np.zeros(len(a), np.int64) + place})


def _pairs(keys: np.ndarray, nodes: np.ndarray, depth: int, leaf: int, fresh: int, common: np.ndarray) -> Iterator[pd.DataFrame]:
    """The candidates whose later key stands at `fresh` or after it."""
    for step, at in neighbour_pairs(common, depth, leaf):
        at = at[at + step >= fresh]
        if len(at):
            a, b = nodes[at], nodes[at + step]
            less = np.array([x < y for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
            yield _frame(PAIR, np.where(less, a, b), np.where(less, b, a), step)


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def forest(nodes: DataFrame, trees: int, depth: int, leaf: int = LEAF) -> DataFrame:
    """nodes(node, signature) -> FOREST rows: candidates (a, b), and (region, node) of the crowded regions of the first depth.

    The orders of all trees are one sort by (tree, run, node), dealt by range: a region however large is spread over the tasks that
    its keys fill. A task walks its part in batches, carrying `leaf` - 1 keys from one to the next. What its last keys and the
    first of the next task have in common is found afterwards, from those border keys alone (2 * leaf a task). A region that
    touches the edge of a batch counts as crowded, as more of it may follow.
    """
    key_bytes, prefix = 1 + 2 * depth, 1 + 2 * MIN_DEPTH

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seen = TaskContext.get().partitionId() << 36, 0
        keys, nodes = np.zeros((0, key_bytes), np.uint8), _objects([])
        for batch in batches:
            fresh = len(keys)
            new = np.frombuffer(b"".join(batch["key"]), np.uint8).reshape(-1, key_bytes)
            keys, nodes = np.concatenate((keys, new)), np.concatenate((nodes, _objects(batch["node"].tolist())))
            if seen < leaf:
                head = slice(fresh, fresh + leaf - seen)
                shown = keys[head]
                yield _frame(BORDER, [k.tobytes() for k in shown], nodes[head], place=task + seen + np.arange(len(shown)))
            seen += len(new)
            common = shared_runs(keys)
            yield from _pairs(keys, nodes, depth, leaf, fresh, common)
            size, first = region_sizes(common, MIN_DEPTH)
            at = np.flatnonzero((size > leaf) | (first == 0) | (first + size == len(keys)))
            at = at[at >= fresh]
            yield _frame(CROWDED, [keys[i, :prefix].tobytes() for i in at.tolist()], nodes[at])
            keys, nodes = keys[max(0, len(keys) - leaf) :], nodes[max(0, len(nodes) - leaf) :]
        last = min(len(keys), seen - leaf)
        if last > 0:  # the others are among the first
            yield _frame(BORDER, [k.tobytes() for k in keys[-last:]], nodes[-last:], place=task + seen - last + np.arange(last))

    def stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, nodes, places = np.zeros((0, key_bytes), np.uint8), _objects([]), np.zeros(0, np.int64)
        for batch in batches:
            fresh = len(keys)
            keys = np.concatenate((keys, np.frombuffer(b"".join(batch["a"]), np.uint8).reshape(-1, key_bytes)))
            nodes, places = np.concatenate((nodes, _objects(batch["b"].tolist()))), np.concatenate((places, batch["place"].to_numpy(np.int64)))
            common = shared_runs(keys)
            jump = (places[1:] != places[:-1] + 1) & (places[1:] >> 36 == places[:-1] >> 36)  # keys of this task between the two are not here
            yield from _pairs(keys, nodes, depth, leaf, fresh, np.where(jump, 0, common))
            keys, nodes, places = keys[-leaf:], nodes[-leaf:], places[-leaf:]

    spark = nodes.sparkSession
    at = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    rows = nodes.select("node", "signature", at).select(F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.expr(f"substring(signature, tree * {2 * depth} + 1, {2 * depth})")).alias("key"), "node")
    in_order = rows.repartitionByRange(shuffle_partitions(spark), "key", "node").sortWithinPartitions("key", "node")
    with batches_of(spark, 1 << 15):
        walked = staged(in_order.mapInPandas(walk, FOREST), "forest")
        borders = walked.where(F.col("kind") == BORDER).repartition(1).sortWithinPartitions("place")
        stitched = staged(borders.mapInPandas(stitch, FOREST), "borders")
    return walked.where(F.col("kind") != BORDER).union(stitched)


def unsettled(members: DataFrame, known: DataFrame) -> DataFrame:
    """members(region, node) -> the distinct (node, component) of the regions that hold several components of known(node, component)."""
    inside = members.join(known, "node")
    several = inside.groupBy("region").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most")
    return inside.join(several.select("region"), "region", "left_semi").select("node", "component").distinct()


def prefixes(sets: DataFrame, open_nodes: DataFrame, percent: int) -> DataFrame:
    """sets(node, hashes), open_nodes(node, component) -> (node, component, n, at, h, indexed, largest): the hashes by which similar sets of different components must meet.

    In any one order of all hashes, two such sets have a hash in common among the first n - ceil(percent * n / 100) + 1 of the larger one, which looks it
    up, and the first n - ceil(2 * percent * n / (100 + percent)) + 1 of the smaller one, which alone stands in the index (prefix filtering). Hashes stand in ascending order
    of how many of the sets hold them, so that what many hold, a passage that all have in common, is in no index unless a set has hardly anything else. Those of one set alone take places at
    the front but meet nothing; nor do those that only one component holds. `largest` is the component that most sets with the hash are of.
    """
    rows = staged(sets.join(open_nodes, "node").select("node", "component", F.size("hashes").alias("n"), F.explode("hashes").alias("h")), "open-hashes")
    held = rows.groupBy("h").agg(F.count(F.lit(1)).alias("held"), F.min("component").alias("least"), F.max("component").alias("most")).where("held > 1")
    ordered = rows.join(held, "h").groupBy("node").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("held", "h", (F.col("least") != F.col("most")).alias("meets")))).alias("common"))
    alone = F.col("n") - F.size("common")
    reach = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)).cast("int") + 1 - alone
    first = ordered.where(reach > 0).select("node", "component", "n", alone.alias("alone"), F.posexplode(F.slice("common", F.lit(1), reach)).alias("at", "c")).where("c.meets")
    first = first.select("node", "component", "n", (F.col("alone") + F.col("at")).alias("at"), F.col("c.h").alias("h"))
    first = first.withColumn("indexed", F.col("at") <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / F.lit(100 + percent)).cast("int"))
    share = first.groupBy("h", "component").agg(F.count(F.lit(1)).alias("share"))
    largest = share.groupBy("h").agg(F.max_by("component", F.struct("share", "component")).alias("largest"))
    return first.join(largest, "h")


def all_candidates(sets: DataFrame, open_nodes: DataFrame, percent: int) -> DataFrame:
    """sets(node, hashes), open_nodes(node, component) -> every pair (a, b) of different components that can be similar enough.

    They meet at a hash of their prefixes, the smaller set (of equal ones that with the smaller node) from the index; what follows that hash in
    either must still be long enough for the whole overlap (positions). Where a hash is common, the nodes of its largest component are met by those of
    the others alone, not by each other, and the side that looks up is dealt over SALT_ROWS rows each.
    """
    first = staged(prefixes(sets, open_nodes, percent), "prefixes")
    pieces = first.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("pieces")).where("pieces > 1")
    dealt = first.join(pieces, "h", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    side = lambda c, rows, *more: rows.select("h", *more, *[F.col(x).alias(f"{x}_{c}") for x in ("node", "component", "n", "at")])
    index = side("a", dealt.where("indexed"), (F.col("component") == F.col("largest")).alias("large_a"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("salt"))
    probe = side("b", dealt, (F.col("component") == F.col("largest")).alias("large_b"), F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int").alias("salt"))
    met = index.where("not large_a").join(probe, ["h", "salt"]).unionByName(index.where("large_a").join(probe.where("not large_b"), ["h", "salt"]))
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    smaller = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b"))
    fits = (F.col("component_a") != F.col("component_b")) & smaller & (100 * F.col("n_a") >= percent * F.col("n_b")) & ((100 + percent) * room >= percent * (F.col("n_a") + F.col("n_b")))
    return met.where(fits).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, step) whose sizes allow, and whose signatures make likely, a similarity of the threshold."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), "<u2").reshape(len(batch), -1) for c in ("signature_a", "signature_b"))
                yield batch.loc[(a == b).mean(axis=1) >= threshold - MARGIN, ["a", "b", "step"]]

    of = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"signature_{c}"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b").where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (threshold - 1e-9))
    return sized.select("a", "b", "step", "signature_a", "signature_b").mapInPandas(judge, "a binary, b binary, step int")


def _marks(nodes: DataFrame) -> np.ndarray:
    """A bitmap of MARK_BITS bits, of fixed size, with the bit set that each node's first three bytes name."""
    at = F.conv(F.hex(F.substring("node", 1, 3)), 16, 10).cast("long")
    words = nodes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    found, marks = words.toPandas(), np.zeros(MARK_BITS // 64, np.int64)  # at most MARK_BITS / 64 rows
    marks[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return marks


def _full_sets(nodes: DataFrame, docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(node, hashes) of the given nodes, made again from the texts. A bitmap drops most others before the shuffle, the join the rest."""
    marks = docs.sparkSession.sparkContext.broadcast(_marks(nodes))

    def full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = marks.value
        for batch in batches:
            rows = {}
            for some in slices(batch["text"].tolist(), chars=SLICE_CHARS):
                for s in shingle_sets(some, width):
                    key = set_key(s)
                    if key is not None:
                        at = int.from_bytes(key[:3], "big")
                        if int(wanted[at >> 6]) >> (at & 63) & 1:
                            rows[key] = s.view(np.int64)
            yield pd.DataFrame({"node": _objects(list(rows)), "hashes": _objects(list(rows.values()))})

    sets = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(full_sets, "node binary, hashes array<long>")
    return staged(sets.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "full-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["hashes_a"], batch["hashes_b"], strict=True):
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    of = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"hashes_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "hashes_a", "hashes_b").mapInPandas(compare, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of any orderable type -> (node, component), the smallest node of each component, for every node of an edge."""
    edges = staged(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    now, before = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first(), None
    while now != before and now[0]:  # the rounds grow with the logarithm of a component
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v"))).distinct()
        edges = staged(small, "edges")
        now, before = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first(), now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _between(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components of known(node, component), and these as in_a and in_b."""
    of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"in_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where("in_a != in_b")


def _merged(known: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """known(node, component) with the components joined that the links (a, b) join."""
    found = components(_between(links, known).select(F.col("in_a").alias("a"), F.col("in_b").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("into"))
    return staged(known.join(found, "component", "left").select("node", F.coalesce("into", "component").alias("component")), tag)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(row_id, text_sha256, n_shingles, component_id, kept, first), a row for each document: near_duplicates, and whether the row is its component's first.

    The first has the smallest id, null ids last, and of equal ids the smallest digest. Rows with an empty set are firsts.
    """
    with batches_of(docs.sparkSession, 512):
        rows = staged(sketches(docs, id_col, text_col, width, trees, depth), "sketches")
        place = F.struct(F.col("row_id").isNull().alias("last"), "row_id", "text_sha256")
        nodes = rows.where("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.min(place).alias("least"))
        nodes = staged(nodes, "nodes")
        found = forest(nodes, trees, depth)
        pairs = found.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.min("step").alias("step"))
        likely = staged(_likely(pairs, nodes, percent / 100), "likely")
        ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node"))
        nearest = likely.where("step = 1")
        links = staged(_confirmed(nearest, _full_sets(ends(nearest).distinct(), docs, text_col, width), percent), "links")
        known = _merged(nodes.select("node", F.col("node").alias("component")), links, "known")
        others = staged(_between(likely.where("step > 1"), known).select("a", "b"), "others")
        crowded = found.where(F.col("kind") == CROWDED).select(F.col("a").alias("region"), F.col("b").alias("node"))
        sets = _full_sets(ends(others).union(unsettled(crowded, known).select("node")).distinct(), docs, text_col, width)
        known = _merged(known, staged(_confirmed(others, sets, percent), "links"), "known")
        known = _merged(known, staged(_confirmed(all_candidates(sets, unsettled(crowded, known), percent), sets, percent), "links"), "known")
    member = nodes.select("node", "least").join(known, "node")
    smallest = member.groupBy("component").agg(F.min("least").alias("smallest"))
    by_node = member.join(smallest, "component").select("node", "smallest")
    answer = rows.select("row_id", "text_sha256", "node", "n_shingles").join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("row_id")).otherwise(F.col("smallest.row_id"))
    first = F.col("node").isNull() | place.eqNullSafe(F.col("smallest"))
    return answer.select("row_id", "text_sha256", "n_shingles", component.alias("component_id"), F.col("row_id").eqNullSafe(component).alias("kept"), first.alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(id, n_shingles, component_id, kept), a row for each document.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest id
    reachable. Null and empty texts, and texts without words, have an empty set and are linked with nothing. Rows with a null id take
    part; a component of such rows alone has a null component_id. Of repeated rows with equal id all are marked alike. An empty table gives no rows.
    """
    return near_groups(docs, id_col, text_col, width, percent, trees, depth).select(F.col("row_id").alias(id_col), "n_shingles", "component_id", "kept")
