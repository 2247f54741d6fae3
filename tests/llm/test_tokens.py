import hashlib

import zlib

import numpy as np
import pytest

from cartosieve.llm import packing, pieces
from cartosieve.llm.token_files import decode_ranks, encode_ranks, token_files
from cartosieve.llm.tokens import SegmentEncoder

P = pytest.importorskip("public_tokenizers")
TEXTS = [
    "Hello, World's  end.", "", "  lead", "trail ", "a\n\nb\tc", "\n", "naïve café — “quoted” №5 x²", "漢字とかな text", "a\x1cb", "it's I'LL don't", "<|endoftext|> x", "Ὀδυσσεύς ΣΑΣ İ", "x" * 5000,
    "one.Two!three\nFour five_six 123,456.7 e\u0301", "🎉🎉 ok", "\u00a0nbsp\u2003em", "'s's '' 's'", "É\u0301", "a\r\nb",
]


@pytest.mark.parametrize("name,cut", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaces")])
def test_segments_give_the_librarys_ids(name, cut):
    encoder = SegmentEncoder(P.path(name), cut, room=5)
    for text in TEXTS * 2:
        assert encoder.encode(text) == encoder.whole(text), text


def test_rank_coding_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000, 100_000):
        ids = (rng.zipf(1.2, n) % 70_000).astype("<u4")
        assert (decode_ranks(n, *encode_ranks(ids)) == ids).all()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, file string, start int").repartition(3)


def library_ids(name, text, end):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(P.path(name)).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files(spark):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(1, None), (None, "null id"), (3, "same id"), (3, "same id"), (3, ""), (None, None)]
    got = sorted((tuple(r) for r in token_files(docs(spark, rows), P.path("word_bpe_49k.json"), 1).collect()), key=lambda r: r[1])
    coded = [(i, len(ids), zlib.crc32(ids.tobytes())) for i, t in rows for ids in [library_ids("word_bpe_49k.json", t, 1)]]
    assert sorted(((r[0], *r[2:]) for r in got), key=repr) == sorted(coded, key=repr)
    assert [-1 if r[0] is None else r[0] for r in got] == sorted(-1 if i is None else i for i, _ in rows)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert token_files(docs(spark, []), P.path("word_bpe_49k.json"), 1).count() == 0


def test_packing(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1000, None), (1001, "word " * 9000), (None, "null id"), (7, TEXTS[7])]
    got = packing.pack(docs(spark, rows), P.path("byte_bpe_50k.json"), 0, window=64).toPandas()
    for i in {i for i, _ in rows}:
        own = got[got["doc_id"].isna() if i is None else got["doc_id"] == i]
        wanted = [library_ids("byte_bpe_50k.json", t, 0) for j, t in rows if j == i]
        assert len(own) == sum(any(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for ids in wanted) for r in own.itertuples())
        covered = sorted((r.start, r.start + r.length) for r in own.itertuples())
        for ids in wanted:  # each of them from its first id to its last, over pieces that follow each other
            at = 0
            while at < len(ids):
                piece = next(p for p in covered if p[0] == at)
                covered.remove(piece)
                at = piece[1]
        assert not covered
    sizes = got.groupby("sequence_id")["length"].sum()
    assert sizes.max() <= 64
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.cumsum([0, *s["length"]])[:-1]).all()
    assert packing.pack(docs(spark, []), P.path("byte_bpe_50k.json"), 0).count() == 0


def test_cuts_are_the_cheapest():
    """Against a plain quadratic program."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        at = np.concatenate(([0], np.cumsum(rng.integers(1, 9, 40))))
        penalty = rng.choice([0.0, 2.0, 6.0], len(at))
        window = 16
        cost = [0.0] + [np.inf] * (len(at) - 1)
        total = lambda cuts: sum((0 if (n := b - a) & (n - 1) == 0 else window - n) + penalty[np.searchsorted(at, b)] + packing.SEQUENCE_PENALTY for a, b in zip(cuts, cuts[1:], strict=False))
        for j in range(1, len(at)):
            for i in range(j):
                n = at[j] - at[i]
                if n <= window:
                    cost[j] = min(cost[j], cost[i] + (0 if n & (n - 1) == 0 else window - n) + penalty[j] + packing.SEQUENCE_PENALTY)
        cuts = packing.best_cuts(at, penalty, window)
        assert abs(total(cuts) - cost[-1]) < 1e-9


@pytest.fixture(scope="module")
def trie():
    return pieces.PieceTrie.build(pieces.zipf_scores(pieces.read_vocabulary(P.path("piece_bpe_32k.model"))))


def brute_score(trie, raw):
    known = {s: trie.scores[i] for i, s in enumerate(trie.spelled) if s and i not in set(trie.byte_ids.tolist())}
    best = [0.0] + [-np.inf] * len(raw)
    for i in range(len(raw)):
        if raw[i] & 0xC0 == 0x80 or best[i] == -np.inf:
            continue
        end = i + 1
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        for j in range(i + 1, len(raw) + 1):
            if raw[i:j] in known:
                best[j] = max(best[j], best[i] + known[raw[i:j]])
        if raw[i:end] not in known:
            best[end] = max(best[end], best[i] + trie.unknown_score)
    return best[-1]


def test_pieces(trie):
    encoder = pieces.PieceEncoder(trie, room=40)
    texts = [t for t in TEXTS if len(t) < 200]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert pieces.decode(ids, trie) == text
    is_byte = set(trie.byte_ids.tolist())
    for word in ("▁hello", "▁unbelievably", "▁naïve", "漢字", "▁▁▁x"):
        ids = trie.segment_one(word.encode())
        assert np.array(ids, "<u4").tobytes() == trie.segment_many([word.encode()])[0]
        if not is_byte & set(ids):
            assert abs(sum(trie.scores[i] for i in ids) - brute_score(trie, word.encode())) < 1e-9


def test_pieces_query_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (None, "▁ marked")]
    found = pieces.encode_and_decode(docs(spark, rows), P.path("piece_bpe_32k.model")).collect()
    assert len(found) == len(rows) and all(r["round_trip"] for r in found)
    assert {r["n_ids"] for r in found if r["doc_id"] in (1, 99)} == {0}
    assert pieces.encode_and_decode(docs(spark, []), P.path("piece_bpe_32k.model")).count() == 0


def brute_ids(trie, text):
    """The ids of a whole text by trying every piece at every character, in strings; of equal sums the longest last piece."""
    is_byte = set(trie.byte_ids.tolist())
    known = {s.decode(): i for i, s in enumerate(trie.spelled) if s and i not in is_byte}
    longest = max(map(len, known))
    shown = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""
    best = [(0.0, [])] + [None] * len(shown)
    for j in range(1, len(shown) + 1):
        for i in range(max(0, j - longest), j):
            if shown[i:j] in known:
                option = (best[i][0] + trie.scores[known[shown[i:j]]], i, [known[shown[i:j]]])
            elif j == i + 1:
                option = (best[i][0] + trie.unknown_score, i, trie.byte_ids[list(shown[i].encode())].tolist())
            else:
                continue
            if best[j] is None or option[0] > best[j][0] + 1e-9:
                best[j] = option
    parts, at = [], len(shown)
    while at:
        parts.append(best[at][2])
        at = best[at][1]
    return [i for part in reversed(parts) for i in part]


def test_pieces_query_against_brute_force(spark, trie):
    """Every column of every row, byte pieces, ties, null and repeated rows included."""
    import zlib

    rng = np.random.default_rng(12)
    alphabet = list("abcdefghijklmnopqrstuvwxyz    .,'éüß漢字😀\n\t▁0123")
    texts = [t for t in TEXTS if len(t) < 3000] + ["".join(rng.choice(alphabet, rng.integers(0, 120))) for _ in range(60)] + ["unbelievable unbelievable", "aaaa aaaa"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "x y"), (500, None)]
    got = {(r["doc_id"], r["n_ids"], r["n_byte_pieces"], r["ids_crc32"], r["decoded_sha256"], r["round_trip"]) for r in pieces.encode_and_decode(docs(spark, rows), P.path("piece_bpe_32k.model")).collect()}
    want = set()
    for i, t in rows:
        ids = brute_ids(trie, t or "")
        shown = (t or "").replace(pieces.MARK, " ")
        want.add((i, len(ids), sum(x in set(trie.byte_ids.tolist()) for x in ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(shown.encode()).hexdigest(), True))
    assert got == want
