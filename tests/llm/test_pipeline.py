import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    rng, rows = np.random.default_rng(9), []
    for i in range(40):
        rows.append((i, " ".join(f"{w}" for w in rng.choice("the house of water and tree with a window in summer rain over green hills".split(), 90)) + f" number {i}", "en", f"s{i % 3}", 1))
    words = rows[0][1].split()
    words[40] = "other"
    rows += [(50, rows[1][1], "en", None, 1), (51, " ".join(words), "en", "s", 1), (52, None, None, None, None), (53, "123 456", "en", "s", 7), (54, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(pieces["doc_id"]) == set(range(40))
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")), {r[0]: r[1] for r in rows}
    for doc_id, own in pieces.sort_values("start").groupby("doc_id"):  # every row: all ids of a document once, in order, under their checksums
        ids = np.array([*library.encode(texts[doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert own["start"].tolist() == np.cumsum([0, *own["length"]])[:-1].tolist() and own["length"].sum() == len(ids) and set(own["doc_tokens"]) == {len(ids)}
        assert [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own.itertuples()] == own["ids_crc32"].tolist()
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == np.cumsum([0, *own["length"]])[:-1].tolist() and own["length"].sum() <= 1024
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_near_copies_with_repeated_and_null_ids(spark, tmp_path):
    text = lambda k: [f"{k}w{i}" for i in range(90)]
    near = lambda k, word: " ".join([*text(k)[:40], word, *text(k)[41:]])
    plain = [" ".join(text(k)) for k in "abcd"]
    rows = [(1, plain[0]), (5, near("a", "x")), (5, plain[1]), (None, near("b", "y")), (7, plain[2]), (7, near("c", "z")), (None, plain[3]), (None, near("d", "v")), (9, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = lambda *texts: min(texts, key=digest)
    want = [(1, plain[0]), (5, plain[1]), (7, first(plain[2], near("c", "z"))), (None, first(plain[3], near("d", "v"))), (9, None), (None, "")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_repeated_rows_leave_one(spark, tmp_path):
    """Rows that stand twice, with a clashing extra column and null cells, go through both stages once."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, "x"), (1, a, "x"), (2, a, "y"), (3, b, None), (3, b, "z"), (None, None, None), (None, None, None), (None, b, None), (8, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, goes string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_exact_copies(spark, docs, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, a), (3, b), (8, "")], key=repr)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, a), (3, b), (None, None), (8, "")], key=repr)
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies):
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_language_stage_keeps_texts_of_a_table_without_labels(spark, tmp_path):
    rows = [(1, "some words", None), (2, "123 456", None), (3, None, None), (4, "", None), (5, "слова", None), (None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()}
    assert got == {1, 5, None}


def test_language_stage_fills_in_what_it_predicts(spark, tmp_path, monkeypatch):
    rows = [(i, "der baum und das haus am wasser" if i % 2 else "the house and the tree by water", None if i > 30 else ["en", "de"][i % 2]) for i in range(40)] + [(50, "12", "en"), (51, None, None), (52, "the house " * 50_000, None), (30, "the tree", "en"), (30, "the tree", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r["doc_id"], r["lang"]) for r in corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect())
    assert got == sorted([(i, ["en", "de"][i % 2]) for i in range(40)] + [(52, "en"), (30, "en"), (30, "en")])
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", frozenset(["de"]))
    assert {r["lang"] for r in corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()} == {"de"}
