"""URL filters: explicit host and path rules, then exact membership in a list of hosts by a cascade of Bloom filters.

The cascade's levels encode in turn the listed keys, those other keys of the corpus that pass the level before, those
listed keys that pass this one, and so on until none passes. For any key of the universe it was built over, the number
of levels that it passes before it misses one is odd if and only if the key is listed. All of it is DataFrame
expressions. Keys are dealt to shards by a hash, as many as keep a shard's filters at about `shard_bytes`, and each shard has a cascade of its
own: with one shard its levels are literals in the plan; with more they are a table by shard, where each distinct host of the corpus looks its keys up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartosieve.llm.shared import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Level:
    bits: bytes
    hashes: int
    seed: int


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Null or no ://: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL_PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and the domains above it: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _positions(key: Column, n_bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 64 + i)), F.lit(n_bits)) for i in range(hashes)]


def passes(key: Column, level: Level) -> Column:
    """Whether the level's filter holds the key."""
    held = F.lit(True)
    bits = F.lit(level.bits)
    for at in _positions(key, len(level.bits) * 8, level.hashes, level.seed):
        byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = held & (F.getbit(byte.cast("long"), (at % 8).cast("int")) == 1)
    return held


def _level(keys: DataFrame, n: int, fp_rate: float, seed: int) -> Level:
    n_bytes, hashes = 8 * _words(n, fp_rate), max(1, round(math.log2(1 / fp_rate)))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), n_bytes * 8, hashes, seed))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(_bit(F.col("at"))).alias("bits"))
    bits = bytearray(n_bytes)
    for word, value in words.collect():  # at most n_bytes / 8 rows
        bits[8 * word : 8 * word + 8] = value.to_bytes(8, "little", signed=True)
    return Level(bytes(bits), hashes, seed)


def _words(n: int, fp_rate: float) -> int:
    """The 64-bit words of a filter of n keys."""
    return max(1, math.ceil(n * math.log2(1 / fp_rate) / math.log(2) / 64))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))


def keyed(listed: DataFrame, universe: DataFrame) -> DataFrame:
    """(key, is_listed) of both, each key once; null keys are no keys."""
    both = listed.select("key", F.lit(True).alias("is_listed")).unionByName(universe.select("key", F.lit(False).alias("is_listed")))
    return staged(both.where("key is not null").groupBy("key").agg(F.max("is_listed").alias("is_listed")), "url-keys")


def shards_for(n_listed: int, n_others: int, first_fp_rate: float, fp_rate: float, shard_bytes: int) -> int:
    """How many shards keep the largest level at about shard_bytes each."""
    words = max(_words(n_listed, first_fp_rate), _words(math.ceil(n_others * first_fp_rate), fp_rate))
    return max(1, math.ceil(8 * words / shard_bytes))


def build_cascade(listed: DataFrame, universe: DataFrame, first_fp_rate: float = 0.02, fp_rate: float = 0.5) -> list[Level]:
    """The levels of one shard for listed(key), exact for every key of universe(key). Null keys are no keys; an empty list has no level; repeated keys count once.

    The two sides swap at each level and shrink by its rate of false positives, so the levels grow with the logarithm of the keys.
    """
    return cascade_of(keyed(listed, universe), first_fp_rate, fp_rate)


def cascade_of(keys: DataFrame, first_fp_rate: float, fp_rate: float) -> list[Level]:
    """build_cascade for keyed(...)."""
    encode, against = keys.where("is_listed").select("key"), keys.where("not is_listed").select("key")
    levels: list[Level] = []
    while n := encode.count():
        levels.append(_level(encode, n, first_fp_rate if not levels else fp_rate, len(levels) + 1))
        encode, against = staged(against.where(passes(F.col("key"), levels[-1])), "url-level"), encode
    return levels


LEVEL = "struct<bits:array<bigint>,hashes:int,seed:bigint>"


def _passes_level(key: Column, level: Column) -> Column:
    """Whether a level of a sharded cascade holds the key; the seed names the level."""

    def held(i: Column) -> Column:
        at = F.pmod(F.xxhash64(key, level["seed"] * 64 + i), F.size(level["bits"]).cast("long") * 64)
        return F.getbit(F.element_at(level["bits"], F.floor(at / 64).cast("int") + 1), (at % 64).cast("int")) == 1

    return F.forall(F.sequence(F.lit(0).cast("long"), (level["hashes"] - 1).cast("long")), held)


def sharded_cascade(keys: DataFrame, shards: int, first_fp_rate: float = 0.02, fp_rate: float = 0.5) -> DataFrame:
    """keyed(...) -> (shard, levels): a cascade for the keys of each shard, as build_cascade makes one for all. Shards without a listed key are missing."""
    place = F.pmod(F.xxhash64(F.col("key"), F.lit(0)), F.lit(shards)).cast("int")
    keys = keys.withColumn("shard", place)
    encode, against = keys.where("is_listed").select("shard", "key"), keys.where("not is_listed").select("shard", "key")
    done, number = None, 0
    while not encode.isEmpty():
        number += 1
        rate = first_fp_rate if number == 1 else fp_rate
        hashes, seed = max(1, round(math.log2(1 / rate))), F.lit(number).cast("long")
        sized = encode.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * (math.log2(1 / rate) / math.log(2) / 64))).cast("long").alias("words"))
        positions = F.array(*[F.pmod(F.xxhash64("key", seed * 64 + F.lit(i).cast("long")), F.col("words") * 64) for i in range(hashes)])
        at = encode.join(sized, "shard").select("shard", F.explode(positions).alias("at")).select("shard", F.floor(F.col("at") / 64).alias("word"), _bit(F.col("at")).alias("bits"))
        blank = sized.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("words") - 1)).alias("word"), F.lit(0).cast("long").alias("bits"))
        words = at.union(blank).groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
        bits = F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"])
        level = staged(words.groupBy("shard").agg(F.array(F.struct(bits.alias("bits"), F.lit(hashes).alias("hashes"), seed.alias("seed"))).alias("level")), "url-shards")
        next_ = against.join(level, "shard").where(_passes_level(F.col("key"), F.element_at("level", 1))).select("shard", "key")
        encode, against = staged(next_, "url-level"), encode
        done = level.withColumnRenamed("level", "levels") if done is None else staged(done.join(level, "shard", "left").select("shard", F.concat("levels", F.coalesce("level", F.array().cast(f"array<{LEVEL}>"))).alias("levels")), "url-shards")
    return keys.sparkSession.createDataFrame([], f"shard int, levels array<{LEVEL}>") if done is None else done


def hosts_listed(hosts: DataFrame, cascade: DataFrame, shards: int) -> DataFrame:
    """hosts(host, key) -> the hosts of which a key is listed: an odd number of levels in a row hold it."""
    shown = hosts.withColumn("shard", F.pmod(F.xxhash64(F.col("key"), F.lit(0)), F.lit(shards)).cast("int")).join(cascade, "shard")
    first_miss = F.array_position(F.transform("levels", lambda level: _passes_level(F.col("key"), level)), F.lit(False)).cast("int")
    passed = F.when(first_miss > 0, first_miss - 1).otherwise(F.size("levels"))
    return shown.where(passed % 2 == 1).select("host").distinct()


def listed_in(key: Column, levels: list[Level]) -> Column:
    """Exact membership of a key of the universe; null is no key."""
    found = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        found = F.when(~passes(key, levels[i]), F.lit(i % 2 == 1)).otherwise(found)
    return key.isNotNull() & found


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """A struct (name, action) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<name:string,action:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.action).alias("action"))).otherwise(found)
    return found


def judge_urls(
    pages: DataFrame, rules: list[Rule], listed: DataFrame, id_col: str = "page_id", url_col: str = "url", first_fp_rate: float = 0.02, fp_rate: float = 0.5, shard_bytes: int = 1 << 20
) -> DataFrame:
    """(id, host, path, rule, verdict), a row for each page.

    listed(key): hosts that are blocked with all their subdomains, any number of them. A null url or one without :// has an empty host and
    path and is allowed. Verdict: the rule's, else block if the host or a domain above it is listed, else allow. Of rules of equal length that
    fit, the last by name counts. Null ids stay null, repeated rows give equal rows, an empty table gives none; other columns are not looked at.
    """
    parts = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    hosts = parts.select("host").distinct().select("host", F.explode(host_suffixes(F.col("host"))).alias("key"))
    rule = rule_for(F.col("host"), F.col("path"), rules)
    keys = keyed(listed, hosts.select("key"))
    size = keys.agg(F.count(F.when(F.col("is_listed"), 1)).alias("listed"), F.count(F.lit(1)).alias("all")).first()
    shards = shards_for(size["listed"], size["all"] - size["listed"], first_fp_rate, fp_rate, shard_bytes)
    if shards == 1:
        levels = cascade_of(keys, first_fp_rate, fp_rate)
        by_list = F.exists(host_suffixes(F.col("host")), lambda key: listed_in(key, levels)) if levels else F.lit(False)
    else:
        blocked = staged(hosts_listed(hosts, sharded_cascade(keys, shards, first_fp_rate, fp_rate), shards), "url-hosts").withColumn("by_list", F.lit(True))
        parts, by_list = parts.join(blocked, "host", "left"), F.coalesce("by_list", F.lit(False))
    return parts.select(
        id_col, "host", "path", rule.getField("name").alias("rule"),
        F.coalesce(rule.getField("action"), F.when(by_list, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
