"""Document fingerprints by SimHash, and the fingerprints within a Hamming radius by permuted block tables.

Terms are words (runs without white space, case folded); each has 128 hash bits and a weight, by which it votes for or
against each bit of the fingerprint. A term's weight is its count in the text times `least(length, 12) ** 2`, as long words tell texts
apart and short ones do not. The votes of two bits share one 64-bit sum, so that a text's 128 votes are 64 sums
that Spark computes in generated code, partial sums before the shuffle; a sum holds 2 ** 31 of weight.

Everything here is DataFrame expressions.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartosieve.llm.shared import shuffle_partitions, staged

BITS = 128
LANES = 0x0000000100000001
WORDS = r"[\s]+"
NO_ID = -(1 << 63)


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORDS), lambda w: w != "")


def term_weight(term: Column) -> Column:
    """No term: 0."""
    n = F.least(F.char_length(term), F.lit(12)).cast("long")
    return F.when(term.isNull(), F.lit(0)).otherwise(n * n).cast("long")


def votes(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, f0, f1), 64 bits each, for each distinct keys. Texts without terms: all bits 0."""
    words = texts.select(*keys, F.explode_outer(terms(F.col(text_col))).alias("term"))
    hashed = words.select(*keys, term_weight(F.col("term")).alias("w"), F.xxhash64("term").alias("h0"), F.xxhash64("term", F.lit(1)).alias("h1"))
    sums = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"{h}_{i}") for h in ("h0", "h1") for i in range(32)]
    sums = hashed.groupBy(*keys).agg(F.sum("w").alias("total"), *sums)

    def folded(h: str) -> Column:
        bits = []
        for i in range(32):
            both = F.col(f"{h}_{i}")
            low, high = both.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(both, 32)
            bits += [F.when(low * 2 > F.col("total"), F.lit(1 << i)).otherwise(F.lit(0)), F.when(high * 2 > F.col("total"), F.lit((1 << (i + 32)) - (1 << 64 if i == 31 else 0))).otherwise(F.lit(0))]
        return reduce(lambda a, b: a.bitwiseOR(b), [b.cast("long") for b in bits])

    return sums.select(*keys, folded("h0").alias("f0"), folded("h1").alias("f1"))


def hex_of(f0: Column, f1: Column) -> Column:
    """32 lowercase hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f0), 16, "0")))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Bits that agree, of BITS."""
    return 1 - distance(a0, a1, b0, b1) / BITS


def block_tables(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(f0, f1, block_key): fingerprints within the radius agree on at least blocks - radius of the equal blocks, so one table for each choice of so many."""
    width = BITS // blocks

    def block(i: int) -> Column:
        at = i * width
        part = F.shiftrightunsigned(F.col("f0" if at < 64 else "f1"), at % 64)
        return part.bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else part

    keys = [F.xxhash64(F.lit(n), *[block(i) for i in chosen]) for n, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    return prints.select("f0", "f1", F.explode(F.array(*keys)).alias("block_key"))


def count_within(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """prints(f0, f1, is_query) -> (f0, f1, n_within) for each fingerprint of a query row: the rows within the radius, itself included."""
    counted = staged(prints.groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("n"), F.max("is_query").alias("is_query")), "prints")
    asked = block_tables(counted.where("is_query"), radius, blocks).select(F.col("f0").alias("q0"), F.col("f1").alias("q1"), "block_key")
    near = distance(F.col("q0"), F.col("q1"), F.col("f0"), F.col("f1")) <= radius
    found = asked.join(block_tables(counted.select("f0", "f1"), radius, blocks), "block_key").where(near).select("q0", "q1", "f0", "f1").distinct()
    return found.join(counted.select("f0", "f1", "n"), ["f0", "f1"]).groupBy(F.col("q0").alias("f0"), F.col("q1").alias("f1")).agg(F.sum("n").alias("n_within"))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(range, uid, id, text, next_uid, next_text): the next row in ascending order of id; the last one's is the first one.

    Rows are dealt to ranges of identifiers; each range also gets a copy of the first row of the next one, so that no
    row needs more than its own range. Nulls count as the smallest identifier; rows with equal ids are ordered by text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    wanted = 2 * shuffle_partitions(spark)
    cuts = sorted(set(rows.agg(F.percentile_approx("id", [i / wanted for i in range(1, wanted)], 100 * wanted)).first()[0] or []))  # fewer than wanted
    number = F.size(F.filter(F.lit(cuts), lambda c: F.col("id") > c)) if cuts else F.lit(0)
    numbered = rows.withColumn("own", number.cast("long"))
    heads = {r["own"]: r["least"] for r in numbered.groupBy("own").agg(F.min("id").alias("least")).collect()}
    used = sorted(heads)
    before = {own: used[i - 1] for i, own in enumerate(used)}
    head = F.create_map(*[F.lit(x) for pair in heads.items() for x in pair]) if heads else F.lit(None).cast("map<bigint,bigint>")
    previous = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if heads else F.lit(None).cast("map<bigint,bigint>")
    itself = F.struct(F.col("own").alias("range"), F.lit(False).alias("copied"))
    copy = F.struct(F.get(F.map_values(F.map_filter(previous, lambda k, v: k == F.col("own"))), F.lit(0)).alias("range"), F.lit(True).alias("copied"))
    is_head = F.get(F.map_values(F.map_filter(head, lambda k, v: k == F.col("own"))), F.lit(0)) == F.col("id")
    dealt = numbered.select("id", "text", "own", F.explode(F.when(is_head, F.array(itself, copy)).otherwise(F.array(itself))).alias("to")).select("id", "text", "own", "to.range", "to.copied")
    order = Window.partitionBy("range").orderBy("copied", "id", F.xxhash64("text"), "text")
    placed = dealt.select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"), F.lead("copied").over(order).alias("next_copied"), F.lead("own").over(order).alias("next_own")).where("not copied")
    uid = F.col("range") * F.lit(1 << 36) + F.col("place")
    next_uid = F.when(F.col("next_copied"), F.col("next_own") * F.lit(1 << 36) + 1).otherwise(uid + 1)
    return placed.select("range", uid.alias("uid"), "id", "text", next_uid.alias("next_uid"), "next_text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, blocks: int = 4, query_every: int = 100) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within), a row for each document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document. Null texts
    are empty. n_within, for documents whose id is divisible by query_every (else null): the documents, itself included, whose fingerprint
    is within the radius. A bit's tie is no vote for it; texts without terms have no bits. Null ids count as the smallest, stay null and are no queries; of
    rows with equal ids the next is told by a hash of the text. An empty table gives no rows; other columns are not looked at.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256))
    keys = ["range", "uid", "id", "n_chars", "sha", "next_uid"]
    both = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("t")).select(*keys, "t.which", "t.text")
    voted = votes(both, [*keys, "which"], "text")
    of = lambda f, which: F.max(F.when(F.col("which") == which, F.col(f)))
    prints = voted.groupBy(*keys).agg(of("f0", 0).alias("f0"), of("f1", 0).alias("f1"), of("f0", 1).alias("e0"), of("f1", 1).alias("e1"))
    prints = staged(prints.drop("range"), "fingerprints")
    is_query = (F.col("id") != NO_ID) & (F.col("id") % query_every == 0)
    within = count_within(prints.select("f0", "f1", is_query.alias("is_query")), radius, blocks)
    following = prints.select(F.col("uid").alias("next_uid"), F.col("f0").alias("x0"), F.col("f1").alias("x1"))
    found = prints.join(following, "next_uid").join(within, ["f0", "f1"], "left")
    f, e, x = ((F.col(c + "0"), F.col(c + "1")) for c in "fex")
    return found.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"),
        hex_of(*f).alias("fingerprint"), hex_of(*e).alias("edited_fingerprint"),
        likeness(*f, *e).alias("near_edited"), likeness(*f, *x).alias("near_next"), F.when(is_query, F.col("n_within")).alias("n_within"),
    )
