"""The operators' queries with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartosieve.llm import sql
from cartosieve.llm.best_fit import best_fit_packing
from cartosieve.llm.centroids import centroid_clusters
from cartosieve.llm.conversations import damaged, repair
from cartosieve.llm.exact_dedup import exact_dedup
from cartosieve.llm.html_text import extract_pages
from cartosieve.llm.language_id import fit_and_identify
from cartosieve.llm.near_dups import near_duplicates
from cartosieve.llm.packing import pack
from cartosieve.llm.pieces import encode_and_decode
from cartosieve.llm.shared import table
from cartosieve.llm.simhash import fingerprint_documents
from cartosieve.llm.token_files import token_files
from cartosieve.llm.url_filters import Rule, judge_urls
from cartosieve.llm.warc import archive_pages

URL_RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]
LISTED_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_HOSTS = [f"{site}.example.{top}" for site in LISTED_SITES for top in ("com", "net", "org")]


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"), end_id=1)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(host,) for host in LISTED_HOSTS], "key string")
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, listed)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), end_id=0, window=1024)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_and_identify(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"), min_bytes=0)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"), end_id=1, window=4096)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, centroids, _ = centroid_clusters(table(spark, sf_dir, "embeddings"), k=40, rounds=5)
    inertia = {r["cluster"]: r["inertia"] for r in members.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # 40 rows
    digests = [(c, n, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in inertia.items()]
    clusters = spark.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(clusters), "cluster")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_sentence_pieces": op3_sentence_pieces,
    "op4_url_filters": op4_url_filters,
    "op5_html_text": op5_html_text,
    "op6_near_dups": op6_near_dups,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_warc": op9_warc,
    "op10_simhash": op10_simhash,
    "op11_best_fit": op11_best_fit,
    "op12_centroids": op12_centroids,
    "op13_conversations": op13_conversations,
}

ORACLES = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op4_url_filters": f"""
        WITH parts AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages),
        ruled AS (
            SELECT *, CASE WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                           WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                           WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                           WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
            FROM parts)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                    WHEN regexp_matches(host, '(^|\\.)({'|'.join(LISTED_SITES)})\\.example\\.(com|net|org)$') THEN 'block'
                    ELSE 'allow' END AS verdict
        FROM ruled""",
    "op12_centroids": sql.centroids(),
    "op13_conversations": sql.conversations(),
}
