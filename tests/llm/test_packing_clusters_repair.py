"""Best-fit packing, centroid clustering and conversation repair against plain Python."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from cartosieve.llm import best_fit, centroids, conversations

P = pytest.importorskip("public_tokenizers")


def bins(runs):
    """Every piece's place: sequence -> [(offset, length)], and (length, rank) -> how often."""
    sequences, seen = {}, {}
    for r in runs:
        for i in range(r.count):
            sequences.setdefault(r.sequence + i // r.each, []).append((r.offset + i % r.each * r.length, r.length))
            seen[r.length, r.rank + i] = seen.get((r.length, r.rank + i), 0) + 1
    return sequences, seen


def best_fit_decreasing(lengths, window):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        room = min(fit) if fit else window
        if fit:
            rooms.remove(room)
        rooms.append(room - n)
    return len(rooms)


@pytest.mark.parametrize("low,high,n", [(1, 65, 400), (9, 33, 300), (20, 24, 500), (1, 8, 300), (33, 64, 90), (64, 65, 5), (5, 6, 1), (17, 40, 31)])
def test_plans_are_whole_and_tight(low, high, n):
    window, rng = 64, np.random.default_rng(low)
    for _ in range(5):
        lengths = rng.integers(low, high, n)
        histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        sequences, seen = bins(best_fit.packing_plan(histogram, window, groups=12))
        assert seen == {(k, rank): 1 for k, v in histogram.items() for rank in range(v)}
        assert set(sequences) == set(range(len(sequences)))
        for pieces in sequences.values():
            assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *(k for _, k in sorted(pieces))])[:-1].tolist() and sum(k for _, k in pieces) <= window
        assert len(sequences) <= 1.05 * best_fit_decreasing(lengths.tolist(), window) + 1


def test_plans_beat_best_fit_where_configurations_matter():
    """Thirds that best fit, longest first, pairs badly: 31 + 22 + 11 fills the window."""
    histogram = {31: 60, 22: 60, 11: 60}
    sequences, _ = bins(best_fit.packing_plan(histogram, 64))
    assert len(sequences) == 60
    found = best_fit.configurations([31, 22, 11], [60, 60, 60], 64)
    assert abs(sum(x for _, x in found) - 60) < 1e-6


def test_configuration_is_the_best_of_all():
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes, worth = sorted({int(x) for x in rng.integers(9, 50, 5)}, reverse=True), None
        worth = rng.random(len(sizes))
        value, times = best_fit.best_configuration(sizes, worth, 64)
        all_times = [t for t in itertools.product(range(8), repeat=len(sizes)) if sum(a * b for a, b in zip(t, sizes, strict=True)) <= 64]
        assert abs(value - max(sum(a * b for a, b in zip(t, worth, strict=True)) for t in all_times)) < 1e-9
        assert abs(value - sum(a * b for a, b in zip(times, worth, strict=True))) < 1e-9 and sum(a * b for a, b in zip(times, sizes, strict=True)) <= 64


def test_best_fit_rows(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids_of = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    rng = random.Random(2)
    words = "the of water house green summer unbelievable x 12 naïve".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(60)] + [(70, None), (71, ""), (72, "word " * 9000), (None, "null id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(i, t, 0, "clash") for i, t in rows], "doc_id long, text string, start int, part string").repartition(3)
    got = best_fit.best_fit_packing(docs, P.path("word_bpe_49k.json"), 1, window=64, with_ids=True).collect()
    want = sorted(((i, p, 64 * p, len(own), zlib.crc32(own.tobytes()), own.tobytes()) for i, t in rows for ids in [ids_of(t)] for p in range(-(-len(ids) // 64)) for own in [ids[64 * p : 64 * p + 64]]), key=repr)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got), key=repr) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *(k for _, k in sorted(pieces))])[:-1].tolist() and sum(k for _, k in pieces) <= 64
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 64) + 2
    assert best_fit.best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), P.path("word_bpe_49k.json"), 1).count() == 0


def lloyd(rows, k, rounds, width):
    """rows of (id, components or None) -> Counter-like list of (id, cluster, distance) and the centroids."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for i in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda c: (apart(v, centroids[c]), c)) for _, v in kept]
        if i < rounds:
            for c in range(len(centroids)):
                members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
                if members:
                    centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return sorted(((i, o, apart(v, centroids[o])) for (i, v), o in zip(kept, own, strict=True)), key=repr), centroids


@pytest.mark.parametrize("k,spread", [(7, 0.02), (3, 1.0), (1, 1.0), (400, 0.1)])
def test_clusters_against_plain_lloyd(spark, k, spread):
    rng = np.random.default_rng(k)
    middles = rng.normal(size=(9, 6))
    rows = [(i, (middles[i % 9] + spread * rng.normal(size=6)).astype(np.float32).tolist()) for i in range(250)]
    rows += [(300, rows[0][1]), (300, rows[0][1]), (None, rows[1][1]), (None, rows[2][1]), (301, None), (302, [1.0] * 5), (303, [1.0] * 7), (304, [1.0, 2.0, None, 1.0, 1.0, 1.0])]
    rows += [(305, [float("nan")] + [0.0] * 5), (306, [float("inf")] + [0.0] * 5), (307, []), (308, [0.0] * 6), (309, [-0.0] * 6), (310, [9000.0, -9000.0, 1.0, 2.0, 3.0, 4.0])]
    table = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, cluster string").repartition(3)
    members, found, measured = centroids.centroid_clusters(table, k=k, rounds=5, width=6)
    want, last = lloyd(rows, k, 5, 6)
    assert sorted((tuple(r) for r in members.collect()), key=repr) == want
    assert found.tolist() == last
    if k == 7:
        assert sum(measured) < 0.5 * 5 * len(want)  # most vectors keep their cluster unmeasured


def test_clusters_of_nothing(spark):
    members, found, _ = centroids.centroid_clusters(spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>"))
    assert members.count() == 0 and len(found) == 0


def test_far_components_are_exact():
    v = np.array([[1 << 27, -(1 << 27)] * 32], np.int64)
    assert centroids.squared(v, -v)[0, 0] == 64 << 56


def damage(rows):
    """conv_id -> its rows after damage."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else "".join(c for c in text if c not in ".!?") if how == 2 else text
        role = "user" if how == 4 else role
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(how, 1))
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())) for c, own in out.items()}


def plain_repair(rows):
    """The cheapest, then ASCII-least edits by trying all, from the last row back over (row, roles so far)."""
    space = " \t\n\v\f\r"
    blank = duplicate = truncated = illegal = 0
    kinds, seen = [], set()
    for i, (_, role, text) in enumerate(rows):
        solid = text.strip(space)
        kind = "blank" if not solid else "again" if (role, text) in seen else "cut" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
        blank, duplicate, truncated = blank + (kind == "blank"), duplicate + (kind == "again"), truncated + (kind == "cut")
        illegal += i > 0 and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {q: min((3 * n, "I" * n, add) for n in range(4) for add in [[(r, "") for r in itertools.islice(itertools.cycle(["user", "assistant"] if q != "u" else ["assistant", "user"]), n)]] if (add[-1][0][0] if add else q) in ("a", "")) for q in follows}
    for (_, role, text), kind in zip(reversed(rows), reversed(kinds), strict=True):
        more = 3 * (kind == "cut")
        now = {}
        for q in follows:
            options = [(4 + best[q][0], "D" + best[q][1], best[q][2])]
            if kind not in ("blank", "again"):
                if role[:1] and role[:1] in follows[q]:
                    c, a, lines = best[role[:1]]
                    options.append((more + c, "K" + a, [(role, text), *lines]))
                for given in ("user", "assistant"):
                    if given[0] in follows[q]:
                        c, a, lines = best[given[0]]
                        options.append((3 + more + c, "R" + a, [(given, text), *lines]))
            now[q] = min(options)
        for _ in range(3):
            now = {q: min([now[q]] + [(3 + now[g[0]][0], "I" + now[g[0]][1], [(g, ""), *now[g[0]][2]]) for g in ("user", "assistant") if g[0] in follows[q]]) for q in follows}
        best = now
    cost, audit, lines = best[""]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(), lines


def some_conversations(rng):
    roles, texts = ["user", "assistant", "system", "tool", "", None, "unknown", "User"], ["Yes.", "No", "", " \t", None, "Well! ", "a.b", "Ünicode?", "x:y\nz.", "one ", "two. "]
    rows = []
    for conv in [*range(120), None]:
        order = sorted(rng.sample(range(-5, 30), rng.randrange(1, 9)))
        rows += [(conv, t, rng.choices(roles, [6, 6, 2, 1, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}.") for t in order]
        if conv is not None and conv % 7 == 0:
            rows += [rows[-1], rows[-1], (conv, None, "user", "null turn."), (conv, order[0], "assistant", "same turn.")]
    rows += [(500, t, ["user", "assistant"][t % 2] if rng.random() < 0.8 else rng.choice(roles), rng.choice(["Yes.", "No"]) if rng.random() < 0.1 else f"row {t}" + "." * (t % 5)) for t in range(700)]  # one holds a third and more
    rows += [(600 + i, i % 3, "user", "long " * 60_000 + ".") for i in range(2)]
    return rows


@pytest.mark.parametrize("chunk_rows", [5, 64, 4096])
def test_conversations_against_plain_repair(spark, chunk_rows):
    rows = some_conversations(random.Random(3))
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, digest string").repartition(3)
    found = conversations.repair(conversations.damaged(table), chunk_rows=chunk_rows).collect()
    want = {c: plain_repair(own) for c, own in damage(rows).items()}
    assert len(found) == len(want)
    for r in found:
        assert tuple(r)[1:] == want[r["conv_id"]][:-1], r["conv_id"]
    if chunk_rows == 5:
        lines = {}
        for r in sorted(conversations.repair(conversations.damaged(table), messages=True, chunk_rows=chunk_rows).collect(), key=lambda r: r["place"]):
            lines.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
        assert lines == {c: w[-1] for c, w in want.items() if w[-1]}


def test_conversations_all_dropped_or_none(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(dropped, 0, "user", "hello.")], "conv_id long, turn long, role string, text string")
    assert tuple(conversations.repair(conversations.damaged(table)).first()) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair(conversations.damaged(table.where("false"))).count() == 0
