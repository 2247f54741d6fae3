import hashlib
import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartosieve.llm import language_id as L
from cartosieve.llm import near_dups as N
from cartosieve.llm import simhash as S
from cartosieve.llm.html_text import extract_pages, main_text

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="no-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and so on, and on, and on.</p></div><!-- <p>no</p> --><div id=wrap><div class="side-bar sidebar"><p>Beside, beside, beside, beside the point.</p></div>
<div class=post><h2>Title &amp; more</h2><p>First   paragraph, with text,
and more of it.<p>Second <b>para</b>graph &lt;x&gt; with, commas, and text to fill it.</p><script>var x = "</p><p>bad";</script><ul><li>one point, that counts<li>another</ul>
<div class="comments"><p>Reader says: great, great, great, great article indeed.</p></div></div></div><form><p>Your name, please, and the rest of it.</p></form><footer><p>foot, foot, foot and more foot</p></footer>"""


def test_main_text():
    assert main_text(PAGE) == "Title & more\n\nFirst paragraph, with text, and more of it.\n\nSecond paragraph <x> with, commas, and text to fill it.\n\none point, that counts\n\nanother"
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("plain &amp; simple") == "plain & simple"
    assert main_text("<article><p>short<p>shorter</article><p>after</p>") == "short\n\nshorter"
    assert len(main_text("<p>" + "word, " * 100_000)) == 600_000 - 1
    assert main_text("<p>unclosed <a href='x") == "unclosed"


SAID = "A sentence of the article, long enough to count, with commas, and more."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><form><article><p>{SAID}</p><p>More.</p></article></form></body>", f"{SAID}\n\nMore."),
        (f"<body><form id=aspnet><div><p>{SAID}</p><p>{SAID}</p></div></form></body>", f"{SAID}\n\n{SAID}"),
        (f"<article><p>{SAID}<section class=refs><h2>Sources</h2><ul><li><a href=1>One paper</a><li><a href=2>Another</a></ul></section></article>", f"{SAID}\n\nSources\n\nOne paper\n\nAnother"),
        (f'<article><div class="share-analysis"><p>{SAID}</div><div class="tags-explained"><p>Tags, explained.</div><div class="share-buttons">Share</div></article>', f"{SAID}\n\nTags, explained."),
        (f"<div><article><p>{SAID}</article><article><p>Second, {SAID}</article><article class=comment><p>I say, {SAID}</article></div>", f"{SAID}\n\nSecond, {SAID}"),
        (f"<article><p>{SAID} <math><mi>x</mi></math> <button>Press</button> <object>it</object></p><button>Subscribe</button></article>", f"{SAID} x Press it"),
        (f"<article><p>{SAID}</p><ol class=comment-list><li>Great, great, great, great, great article, really.</ol><div id=comments>{SAID}</div></article>", SAID),
        (f"<main><h1>Head</h1><div class=ad>Buy, buy, buy.</div><p>{SAID}</p><form><label>Name</label><input></form></main>", f"Head\n\n{SAID}"),
    ],
)
def test_main_text_keeps_the_article_whole(page, text):
    assert main_text(page) == text


LONG = "A plain statement without the marks that other texts are rich in but of some length all the same and then some more. "


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><section><h2>One</h2><p>{SAID * 5}</p></section><section><h2>Two</h2><p>{LONG * 10}</p></section></body>", f"One\n\n{SAID * 5}\n\nTwo\n\n{(LONG * 10).strip()}"),
        (f"<body><div><p>{SAID}</p></div><div><p>{SAID}</p></div></body>", f"{SAID}\n\n{SAID}"),
        (f"<body><article><p>{SAID * 3}</p></article><article><p>{LONG * 3}</p></article></body>", f"{SAID * 3}\n\n{(LONG * 3).strip()}"),
        (f"<main><section><article><p>{SAID}</article></section><section><article><p>{LONG}</article></section></main>", f"{SAID}\n\n{LONG.strip()}"),
        *[(f'<body><div><p>{SAID}</p><div class="{name}"><p>{LONG}</p></div></div></body>', f"{SAID}\n\n{LONG.strip()}") for name in ("related-work", "header-files", "comment-on-law", "rail-transport", "social-policy", "hidden-gem")],
        *[(f'<body><div><p>{SAID}</p><div class="{name}"><p>{LONG}</p></div></div></body>', SAID) for name in ("sidebar", "post-comments", "widget-area", "siteFooter", "cookie-notice", "ad")],
        (f"<body><div class=x><p>{SAID}</p><ul><li><a href=1>One paper</a><li><a href=2>Another</a></ul><p>{SAID}</p></div></body>", f"{SAID}\n\nOne paper\n\nAnother\n\n{SAID}"),
        (f"<body><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul><h1>Title</h1><p>{SAID}</p><ul><li>short<li>points</ul><p>Yes.</p><h2>Sources</h2><ul><li><a href=1>One paper</a></ul><p>© 2024 Us</p></body>", f"Title\n\n{SAID}\n\nshort\n\npoints\n\nYes.\n\nSources\n\nOne paper"),
        (f'<p>{SAID} <span style="display:none">No <b>no</b> <span>no</span> no</span>yes <a hidden href=1>no</a></p><p hidden>{SAID}</p><p>So <i hidden>unclosed</p><p>{SAID}</p>', f"{SAID} yes\n\nSo\n\n{SAID}"),
        (f"<body>Loose text, and more.<div><p>{SAID}</p><p>{SAID}</p></div>More of it.<br><a href=1>Top</a></body>", f"Loose text, and more.\n\n{SAID}\n\n{SAID}\n\nMore of it. Top"),
    ],
)
def test_main_text_outside_articles(page, text):
    assert main_text(page) == text


def generated_page(rng):
    """A page without an article element of a random make, and the text that it was made from."""
    words = "water house green summer window related header comment social notice hidden tree".split()
    sentence = lambda: " ".join(rng.choice(words, rng.integers(3, 25))).capitalize() + rng.choice([".", ", and so on.", "!"])
    blocks = []

    def part(depth):
        out = []
        for _ in range(rng.integers(1, 5)):
            kind = rng.integers(0, 7 if depth < 3 else 5)
            if kind <= 2:
                blocks.append(" ".join(sentence() for _ in range(rng.integers(1, 6))))
                out.append(f"<p>{blocks[-1].replace('green', '<b>green</b>')}</p>")
            elif kind == 3:
                blocks.append(sentence()[:-1])
                out.append(f"<h2>{blocks[-1]}</h2>")
                blocks.append(sentence())
                out.append(f"<p>{blocks[-1]}</p>")
            elif kind == 4:
                items = [sentence() for _ in range(rng.integers(1, 4))]
                blocks.extend(items)
                out.append("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
            else:
                name = rng.choice(["", ' class="entry-content"', ' class="header-files"', ' id="comments-explained"', ' class="wp-block-group related-work"', ' class="thread post"', " class=col"])
                tag = rng.choice(["div", "section"])
                out.append(f"<{tag}{name}>{part(depth + 1)}</{tag}>")
        return "".join(out)

    junk = ['<div class="sidebar"><p>Beside, beside, beside, beside the point.</p></div>', "<nav><a href=1>Home</a></nav>", '<ul class="menu"><li><a href=1>Home</a></ul>', '<div id="comments"><p>Great, great, great article, really.</p></div>',
            '<div class="ad">Buy, buy, buy, buy, buy this now.</div>', "<footer><p>foot, foot, foot and more foot</p></footer>", "<form><p>Your name, please, and the rest of it.</p></form>", "<script>var p = '<p>x</p>'</script>", "<aside><p>Aside, aside.</p></aside>"]
    some = lambda: "".join(rng.choice(junk, rng.integers(0, 3)))
    body = "".join(some() + f"<div>{part(0)}</div>" if rng.random() < 0.5 else some() + part(0) for _ in range(rng.integers(1, 4)))
    blocks.append(" ".join(sentence() for _ in range(12)))
    return f"<html><body>{body}<p>{blocks[-1]}</p>{some()}</body></html>", "\n\n".join(blocks)


def test_generated_pages_without_articles():
    rng = np.random.default_rng(8)
    for i in range(400):
        page, text = generated_page(rng)
        assert main_text(page) == text, (i, page)


def test_extracted_pages_against_a_plain_reading(spark):
    """The given pages have one article element each: its text, block by block, read with two patterns."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_pages(pages).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>)", row["html"] or "", re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?(b|i|a|em)\b[^>]*>", "", block))).split()) for block in re.split(r"</?(?:p|h1|h2|ul|li|div)\b[^>]*>", article[1])] if article else []
        want = "\n\n".join(b for b in blocks if b)
        assert got[row["page_id"]] == (want, len(want)), row["page_id"]


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (None, "v", "<p>x", 5)], "page_id long, url string, html string, n_chars int")
    got = {r["page_id"]: r for r in extract_pages(df).collect()}
    assert got[1]["n_chars"] == len(main_text(PAGE)) and got[2]["text"] == "" and got[None]["text"] == "x"
    assert extract_pages(df.where("false")).count() == 0


WORDS = {"en": "the of and with house water tree window", "de": "der und mit haus wasser baum fenster straße", "fr": "le et avec maison eau arbre fenêtre été"}


def language_docs(spark, n=240):
    rng, rows = np.random.default_rng(2), []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), 30)), lang, 0.5))
    return spark.createDataFrame(rows + [(n, None, "en", 0.5), (n + 1, "123 !!", "en", 0.5), (n + 2, "", None, 0.5), (n + 3, "漢字", "de", 0.5), (None, "der baum und das haus", "de", 0.5)], "doc_id long, text string, lang string, score double")


def test_language_id(spark):
    docs = language_docs(spark)
    got = {r["doc_id"]: r for r in L.fit_and_identify(docs, slots=1 << 12).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    import zlib

    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i]["held_out"] == (i in held) for i in range(240))
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.95
    assert [got[240 + k]["lang_pred"] for k in range(3)] == ["und"] * 3
    assert got[243]["lang_pred"] in WORDS and got[243]["score"] == 0
    assert got[None]["lang_pred"] == "de" and not got[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert L.fit_and_identify(docs.where("false")).count() == 0


def test_language_rows_against_brute_force(spark):
    """Every row of the query from its filters, gram by gram in plain Python: ties, nulls, repeated rows and a very long text."""
    docs_ = language_docs(spark).union(spark.createDataFrame([(3, "the house", None, 0.5), (3, "the house", None, 0.5), (900, "wasser baum " * 20000, None, 0.5), (901, "xx yy", None, 0.5)], "doc_id long, text string, lang string, score double"))
    model = L.fit(docs_.where(~L.held_out()), slots=1 << 12)
    mask = (1 << 64) - 1

    def grams(text):
        marked = "\n".join(["", *re.findall(r"[^\W\d_]+", text.lower()), ""])
        for i in range(len(marked) - 2):
            codes = [0 if c == "\n" else ord(c) for c in marked[i : i + 3]]
            h = codes[0]
            for c in codes[1:]:
                h = (h * 0x100000001B3 + c + 1) & mask
            h = h * 0x9E3779B97F4A7C15 & mask
            h ^= h >> 29
            h = h * 0xBF58476D1CE4E5B9 & mask
            yield h ^ h >> 32

    want = []
    for source in docs_.collect():
        found, counts = list(grams(source["text"] or "")), []
        if not re.search(r"[^\W\d_]", source["text"] or ""):
            want.append((source["doc_id"], "und", 0.0))
            continue
        for i in range(len(model.languages)):
            hits = sum(all(int(model.table[0, h >> 31 * k & len(model.table[0]) - 1]) >> i & 1 for k in range(2)) for h in found)
            counts.append(max(0, (hits - model.fp_rate[i] * len(found)) / (1 - model.fp_rate[i])))
        best = counts.index(max(counts)) if max(counts) > 0 else model.fallback
        want.append((source["doc_id"], model.languages[best], round(counts[best] / max(sum(counts), 1e-9), 7)))
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 7)) for r in L.fit_and_identify(docs_, slots=1 << 12).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_more_languages_than_bits_in_a_word(spark):
    rng, rows = np.random.default_rng(4), []
    for lang in range(70):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)]
        rows += [(100 * lang + k, " ".join(rng.choice(words, 20)), f"l{lang:02d}") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in L.fit_and_identify(df, slots=1 << 14).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.95


def test_grams_do_not_cross_texts():
    h, of, has = L.gram_hashes(["abc", "", "1", "abc"])
    assert has.tolist() == [True, False, False, True]
    assert (h[of == 0] == h[of == 3]).all() and len(h[of == 0]) == 3


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_rows():
    rng, rows = np.random.default_rng(7), []
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 80)]
        rows.append((3 * i, " ".join(words)))
        if i % 3 == 0:
            words[int(rng.integers(80))] = "changed"
            rows.append((3 * i + 1, " ".join(words).upper() if i % 2 else " ".join(words)))
    base = [f"b{x}" for x in rng.integers(0, 5000, 120)]
    for k in range(60):
        words = list(base)
        for at in rng.integers(0, 120, k % 5):
            words[at] = f"n{k}"
        rows.append((1000 + k, " ".join(words)))
    return rows + [(2000, None), (2001, ""), (2002, " \t"), (2003, "one two"), (2004, "One  two"), (2005, "one"), (2006, "long " * 20000), (2007, "x\u00a0y z q")]


def all_pairs(sets, percent):
    """id -> smallest id reachable, by comparing all pairs."""
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


def test_near_duplicates_match_all_pairs(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "x", b"y") for i, t in rows], "doc_id long, text string, component string, node binary")
    got = {r["doc_id"]: r for r in N.near_duplicates(df, width=3, percent=85).collect()}
    sets = {i: plain_set(t) for i, t in rows}
    want = all_pairs(sets, 85)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_in_a_crowded_group_near_the_threshold(spark):
    """900 copies of one text, each with 3 to 10 words replaced: few pairs are linked, most just fail to be."""
    rng, rows = np.random.default_rng(5), []
    base = [f"b{x}" for x in rng.integers(0, 5000, 200)]
    for i in range(900):
        words = list(base)
        for at in rng.choice(200, rng.integers(3, 11), replace=False):
            words[at] = f"r{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()}
    assert got == all_pairs({i: plain_set(t) for i, t in rows}, 85)


def test_forest_does_not_depend_on_where_its_orders_are_cut(spark):
    """Whatever the batches and tasks, the nearest neighbours are the same."""
    rng = np.random.default_rng(4)
    nodes = [(i.to_bytes(2, "big"), rng.integers(0, 2, 16).astype("<u2").tobytes()) for i in range(300)]
    df = spark.createDataFrame(nodes, "node binary, signature binary")
    want = set()
    for tree in range(2):
        order = sorted((s[16 * tree : 16 * tree + 16], n) for n, s in nodes)
        want |= {tuple(sorted((bytes(a[1]), bytes(b[1])))) for a, b in zip(order, order[1:], strict=False) if a[0][:6] == b[0][:6]}
    for parts in ("1", "7", "150"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found = N.forest(df, 2, 8).where("kind = 0 and step = 1").select("a", "b").distinct().collect()
        assert {(bytes(r["a"]), bytes(r["b"])) for r in found} == want, parts
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def passage_rows(n):
    """Pairs, alike only with the words that both add to a passage all share."""
    passage = [f"c{x}" for x in range(200)]
    return [(i, " ".join(passage + [f"g{i // 2}x{x}" for x in range(6)] + [f"u{i}x{x}" for x in range(25)])) for i in range(n)]


def test_near_duplicates_behind_a_common_passage(spark):
    """Every region is crowded, and few pairs hold a hub."""
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(passage_rows(300), "doc_id long, text string"), width=3, percent=80).collect()}
    assert got == {i: i // 2 * 2 for i in range(300)}


def test_pairs_met_behind_a_common_passage_grow_with_the_rows(spark):
    """What meets at a hash (index times look-up), all sets open: four times the rows may meet five times as often at most, and still gives every pair."""
    met = {}
    for n in (300, 1200):
        sets = [(i.to_bytes(4, "big"), s.view(np.int64).tolist()) for (i, _), s in zip(passage_rows(n), N.shingle_sets([t for _, t in passage_rows(n)], 3), strict=True)]
        nodes = spark.createDataFrame(sets, "node binary, hashes array<long>")
        own = nodes.selectExpr("node", "node AS component")
        met[n] = N.prefixes(nodes, own, 80).groupBy("h").agg((F.count(F.when(F.col("indexed"), 1)) * F.count(F.lit(1))).alias("met")).agg(F.sum("met")).first()[0]
        found = {(int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")) for r in N.all_candidates(nodes, own, 80).collect()}
        assert {(i, i + 1) for i in range(0, n, 2)} <= found and len(found) <= n
    assert met[1200] < 5 * met[300] and met[1200] < 20 * 1200


@pytest.mark.parametrize("percent,salt_rows", [(80, 2048), (85, 3), (60, 5), (100, 2)])
def test_candidates_of_sets_of_all_sizes_lose_no_pair(spark, percent, salt_rows, monkeypatch):
    """Random sets with few distinct hashes, ties in size included, against all pairs."""
    monkeypatch.setattr(N, "SALT_ROWS", salt_rows)
    rng = np.random.default_rng(percent)
    base = rng.choice(40, 30, replace=False)
    sets = [set(rng.choice(base, rng.integers(1, 28), replace=False).tolist()) if i % 3 else set(base[: rng.integers(18, 30)].tolist()) ^ set(rng.choice(40, 2).tolist()) for i in range(150)]
    nodes = spark.createDataFrame([(i.to_bytes(2, "big"), sorted(s)) for i, s in enumerate(sets) if s], "node binary, hashes array<long>")
    own = nodes.select("node", F.when(F.substring("node", 2, 1) < F.lit(b"\x28"), F.lit(b"\0\0")).otherwise(F.col("node")).alias("component"))
    component = lambda i: 0 if i < 40 else i
    found = {(int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")) for r in N.all_candidates(nodes, own, percent).collect()}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and component(i) != component(j) and 100 * len(a & b) >= percent * len(a | b)}
    assert want and want <= found


def test_near_duplicates_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in N.near_duplicates(df, width=3, percent=85).collect()), key=repr)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 0, None, True)], key=repr)
    assert N.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [2, 17])
def test_components(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7000, 7000)]
    got = {r["node"]: r["component"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}


def test_simhash(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"word{x}" for x in rng.integers(0, 900, 60)) for _ in range(40)]
    rows = [(10 * i, t) for i, t in enumerate(texts)] + [(400, texts[0]), (500, None), (600, ""), (700, "é漢字x"), (800, "z " * 50000)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, range string, uid int")
    got = {r["doc_id"]: r for r in S.fingerprint_documents(df).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, following = t or "", following or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert got[0]["fingerprint"] == got[400]["fingerprint"] and got[500]["fingerprint"] == "0" * 32
    bits = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    prints = [got[i]["fingerprint"] for i, _ in rows]
    for k, (i, _) in enumerate(rows):
        assert got[i]["near_next"] == bits(prints[k], prints[(k + 1) % len(rows)])
        assert got[i]["near_edited"] == bits(prints[k], got[i]["edited_fingerprint"])
        near = sum((int(prints[k], 16) ^ int(p, 16)).bit_count() <= 3 for p in prints)
        assert got[i]["n_within"] == (near if i % 100 == 0 else None)
    assert S.fingerprint_documents(df.where("false")).count() == 0


def test_simhash_votes_by_brute_force(spark):
    """One term: the fingerprint is the term's own hash."""
    df = spark.createDataFrame([(1, "alone"), (2, "alone alone")], "doc_id long, text string")
    a, b = (r["fingerprint"] for r in S.fingerprint_documents(df).orderBy("doc_id").collect())
    own = spark.sql("select lower(concat(lpad(hex(xxhash64('alone', 1)), 16, '0'), lpad(hex(xxhash64('alone')), 16, '0')))").first()[0]
    assert a == b == own


def test_simhash_votes_of_many_terms(spark):
    """Each bit by the weighted votes of the terms, added up in Python; null and equal ids."""
    rng = np.random.default_rng(8)
    words = ["a", "of", "tree", "Window", "summertime", "extraordinarily"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 9)))) for i in range(25)] + [(None, "tree tree of"), (3, "window a"), (None, None)]
    found = S.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hashes = {r["t"]: (r["h0"] & (1 << 64) - 1, r["h1"] & (1 << 64) - 1) for r in spark.createDataFrame([(w.lower(),) for w in words], "t string").selectExpr("t", "xxhash64(t) h0", "xxhash64(t, 1) h1").collect()}

    def fingerprint(text):
        terms, bits = (text or "").lower().split(), 0
        weigh = [min(len(t), 12) ** 2 for t in terms]
        for bit in range(128):
            votes = sum(w for t, w in zip(terms, weigh, strict=True) if hashes[t][bit // 64] >> bit % 64 & 1)
            bits |= (2 * votes > sum(weigh)) << bit
        return f"{bits:032x}"

    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in found) == sorted((str(i), fingerprint(t)) for i, t in rows)
    assert {r["n_within"] for r in found if r["doc_id"] is None} == {None}
