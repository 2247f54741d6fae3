import base64
import hashlib
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartosieve.llm import url_filters as U
from cartosieve.llm import warc
from cartosieve.llm.exact_dedup import exact_dedup
from cartosieve.llm.warc import LoserTree, archive_pages, read_record, record, url_key


def docs(spark, rows):
    """The second column clashes with names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, keep_id string, run int")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("radix", [2, 16])
def test_exact_dedup(spark, keep, radix):
    rows = [(5, "a"), (2, "a"), (9, "b"), (1, None), (7, ""), (3, "a "), (4, "long " * 30000), (8, "long " * 30000), (5, "a")] + [(100 + i, "hot") for i in range(300)]
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(docs(spark, rows), keep=keep, radix=radix).collect()}
    pick, want = (min if keep == "smallest" else max), set()
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        want.add((i, pick(same), len(same), i == pick(same), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert exact_dedup(docs(spark, rows), keep=keep, radix=radix).count() == len(rows)


def test_exact_dedup_null_ids_and_empty_table(spark):
    got = {r["doc_id"]: r for r in exact_dedup(docs(spark, [(None, "a"), (3, "a")])).collect()}
    assert (got[None]["keep_id"], got[None]["kept"], got[3]["kept"]) == (3, False, True)
    assert exact_dedup(docs(spark, [])).count() == 0


def test_null_ids_lose_in_every_run(spark):
    """Nulls in runs of their own meet the others only when runs are merged."""
    df = docs(spark, [(None, "t")] * 40 + [(8, "t")] + [(None, "t")] * 40 + [(None, "u")] * 3).repartition(20)
    for keep in ("smallest", "largest"):
        got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(df, keep=keep).collect()}
        assert got == {(None, 8, 81, False), (8, 8, 81, True), (None, None, 3, True)}


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", True) for r in rows], "page_id long, url string, html string, rule string, key boolean")


def test_cascade_is_exact(spark):
    keys = [f"host{i}.example" for i in range(3000)]
    listed = spark.createDataFrame([(k,) for k in keys[::7]], "key string")
    universe = spark.createDataFrame([(k,) for k in keys + [None]], "key string")
    levels = U.build_cascade(listed, universe, first_fp_rate=0.3)
    assert len(levels) > 2
    got = {r["key"] for r in universe.where(U.listed_in(F.col("key"), levels)).collect()}
    assert got == set(keys[::7])
    for shards in (1, 7, 64):
        cascade = U.sharded_cascade(U.keyed(listed, universe), shards, first_fp_rate=0.3)
        assert cascade.count() == shards and {r["host"] for r in U.hosts_listed(universe.where("key is not null").select(F.col("key").alias("host"), "key"), cascade, shards).collect()} == set(keys[::7])
    assert U.shards_for(10**9, 10**10, 0.02, 0.5, 1 << 20) > 900 and U.shards_for(18, 10**6, 0.02, 0.5, 1 << 20) == 1


def test_judged_urls_of_a_long_list(spark):
    """More keys than one shard holds, the rules beside them, against plain Python; ties of rules go to the last by name."""
    rules = [U.Rule("allow", "b.com", "/aa"), U.Rule("block", "b.com", "/a"), U.Rule("block", "x.b.com", ""), U.Rule("allow", "com", "/abcd/")]
    rows = [(i, f"http://{['x.', 'y.', ''][i % 3]}h{i % 90}.{['com', 'org'][i % 2]}/{'abcd/'[: i % 6]}") for i in range(400)] + [(900, "http://x.b.com/aa"), (901, "http://b.com/aa"), (902, None), (None, "http://h4.org")]
    listed = [f"h{i}.org" for i in range(0, 90, 4)] + [f"y.h{i}.com" for i in range(0, 90, 5)]
    found = U.judge_urls(pages(spark, [(*r, None) for r in rows]), rules, spark.createDataFrame([(k,) for k in listed + listed[:3]] + [(None,)], "key string"), shard_bytes=8)
    want = []
    for i, url in rows:
        host, _, path = (url or "://").split("://")[1].partition("/")
        path = "/" + path if url and "/" in url.split("://")[1] else ""
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: (len(r.name), r.name)) if fits else None
        suffixes = {host.split(".", k)[k] for k in range(host.count(".") + 1)}
        want.append((i, host, path, rule and rule.name, rule.action if rule else "block" if suffixes & set(listed) else "allow"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert {w[4] for w in want} == {"allow", "block"} and U.shards_for(len(listed), 100, 0.02, 0.5, 8) > 3


def test_judged_urls(spark):
    rules = [U.Rule("block", "net", "/"), U.Rule("allow", "example.net", "/en/")]
    rows = [(1, "HTTP://A.Example.NET/en/x?q"), (2, "http://a.example.net/fr/"), (3, "http://a.example.net?x"), (4, None), (5, "no scheme"), (6, "http://evil.org/a"), (7, "http://notevil.org"), (8, "x://Sub.evil.org#f"), (9, "http://ünet/")]
    rows += [(10, "http://" + "a" * 300_000 + ".evil.org/" + "p" * 300_000), (6, "http://evil.org/a"), (None, "http://evil.org/")]
    listed = spark.createDataFrame([("evil.org",), ("evil.org",), (None,)], "key string")
    judged = U.judge_urls(pages(spark, [(*r, None) for r in rows]), rules, listed)
    joined = U.judge_urls(pages(spark, [(*r, None) for r in rows]), rules, listed, shard_bytes=1)
    assert sorted(map(repr, judged.collect())) == sorted(map(repr, joined.collect())) and judged.count() == len(rows)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge_urls(pages(spark, [(*r, None) for r in rows]), rules, listed).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("a.example.net", "/fr/", "net/", "block")
    assert got[3] == ("a.example.net", "", None, "allow")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert [got[i][3] for i in (6, 7, 8, 9)] == ["block", "allow", "block", "allow"]
    assert U.judge_urls(pages(spark, []), rules, listed).count() == 0
    empty = spark.createDataFrame([], "key string")
    assert {r["verdict"] for r in U.judge_urls(pages(spark, [(6, "http://evil.org/a", None)]), rules, empty).collect()} == {"allow"}


def test_archive_round_trip(spark):
    rows = [(1, "http://b.org/x", "same"), (2, "http://a.org/", "same"), (3, None, None), (4, "http://a.org/", "é" * 50000), (6, "http://a.org/?q=1 2\n3", "")]
    got = {r["page_id"]: r for r in archive_pages(pages(spark, rows)).collect()}
    assert len(got) == 5
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 6), 4: ("response", None), 6: ("response", None)}
    assert got[1]["payload_bytes"] == 4 and got[4]["payload_bytes"] == 100000
    assert (got[2]["capture_no"], got[4]["capture_no"]) == (1, 2)
    assert {r["record_type"] for r in archive_pages(pages(spark, rows), min_bytes=1000).collect()} == {"response"}
    assert archive_pages(pages(spark, [])).count() == 0


def test_archives_against_brute_force(spark, monkeypatch):
    """Every column, from the rows alone: many runs merged two at a time in small ranges, one URL with a third of all captures, repeated and null ids."""
    rng = np.random.default_rng(6)
    rows = [(int(i), None if i % 50 == 9 else "http://hot.org/" if i % 3 == 0 else f"http://s{rng.integers(30)}.org/{rng.integers(5)}", f"body {rng.integers(80)}") for i in range(600)]
    rows += [(None, "http://hot.org/", "body 1"), (None, None, "no id"), (7, "http://hot.org/", "body 2"), (3, "http://hot.org/", rows[3][2])]
    monkeypatch.setattr(warc, "RANGE_ENTRIES", 50)
    df = pages(spark, rows).repartition(7)
    got = [tuple(r) for r in archive_pages(df, fan_in=2).collect()]
    largest, captures = {}, {}
    for i, _, body in rows:
        largest[body] = max(largest.get(body, -1), -1 if i is None else i)
    stamp = lambda i: f"{warc.EPOCH + timedelta(seconds=i or 0):%Y%m%d%H%M%S}"
    want = []
    for i, url, body in rows:
        first = largest[body] in (-1, -1 if i is None else i)
        digest = base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
        want.append((i, len(body), digest, "response" if first else "revisit", None if first else largest[body], url_key(url), stamp(i)))
        captures.setdefault(url_key(url), []).append(stamp(i))
    assert sorted((g[:7] for g in got), key=repr) == sorted(want, key=repr)
    for key, stamps in captures.items():
        own = sorted((g[7], g[6]) for g in got if g[5] == key)
        assert [n for n, _ in own] == list(range(1, len(stamps) + 1)) and [t for _, t in own] == sorted(stamps)


def test_record_ids_are_unique(spark, tmp_path):
    import glob
    import zlib

    rows = [(1, "http://a.org/", "x"), (1, "http://a.org/", "x"), (None, None, "y"), (None, None, "y")]
    assert archive_pages(pages(spark, rows), folder=f"file://{tmp_path}/w").count() == 4
    ids = []
    for name in glob.glob(f"{tmp_path}/w/*.warc.gz"):
        raw = open(name, "rb").read()
        while raw:
            member = zlib.decompressobj(31)
            ids += [line for line in member.decompress(raw).split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
            raw = member.unused_data
    assert len(ids) == len(set(ids)) == 4


def test_record_and_key():
    raw = record(7, "http://x.org/a b", b"\r\n\r\npayload", "bad", "2024-01-01T00:00:00Z", None, False)
    with pytest.raises(ValueError):
        read_record(raw)
    assert url_key("https://www.Example.org:80/A/b?c#d") == "org,example)/a/b?c"
    assert url_key(None) == ""


def test_loser_tree():
    import random

    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.choices(range(40), k=rng.randint(0, 30))) for _ in range(k)]
        assert list(LoserTree([iter(r) for r in runs])) == sorted(sum(runs, []))
