"""Joins on containment: which texts hold which keys, by equi-joins on anchors and a check of what they find.

A text is cut into words; every stretch of ANCHOR words has a hash, and of each WINDOW neighbouring hashes the least is an
anchor of the text. A key's inner words are words of any text that holds it, in the same order, so the least of its own
hashes is an anchor of all those texts: one equi-join finds every candidate, and contains() tells the true ones. Keys of too
few words are tested one by one where they are few; else their anchors are stretches of characters. No step compares
all texts with all keys, and anchors that many texts share are dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.relational import HOT, salted, small
from quern.session import cut

ANCHOR = 3
"""Words of an anchor."""

WINDOW = 8
"""Neighbouring anchors of which the least is kept: two in nine stay."""

FEW = 500
"""Short keys that every text may be tested against, one by one."""

FEW_CHARS = 100_000
"""Characters of all of them at most."""

STRETCHES = (12, 6, 3, 2, 1)
"""Characters of the anchors of short keys that are many: the largest that fits a key."""

def word_hashes(words: Column, length: int = ANCHOR) -> Column:
    """The hash of each stretch of so many words; empty where there are fewer."""
    at = F.sequence(F.lit(0), F.size(words) - length)
    return F.when(F.size(words) >= length, F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(length)]))).otherwise(F.array().cast("array<bigint>"))


def least_of_windows(hashes: Column, window: int = WINDOW) -> Column:
    """The least of each window of neighbours, each once; empty where there are fewer than a window."""
    at = F.sequence(F.lit(1), F.size(hashes) - window + 1)
    return F.when(F.size(hashes) >= window, F.array_distinct(F.transform(at, lambda i: F.array_min(F.slice(hashes, i, window))))).otherwise(F.array().cast("array<bigint>"))


def _words(text: Column) -> Column:
    return F.split(text, r"[\x20\x09-\x0D]+")


def _stretches(chars: Column, length: int) -> Column:
    at = F.sequence(F.lit(1), F.size(chars) - length + 1)
    return F.when(F.size(chars) >= length, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(chars, i, length), ""))))


def pairs(texts: DataFrame, text_id: str, text: str, keys: DataFrame, key_id: str, key: str, few: int = FEW, few_chars: int = FEW_CHARS, hot: int = HOT) -> DataFrame:
    """(text_id, key_id): every row of texts with every row of keys whose key its text contains.

    An empty key is in every text; a null text or key takes no part. Rows that repeat, or share an id, each count; the ids
    may be null. Other columns are ignored; an empty table on either side gives an empty result.
    """
    rows = texts.where(F.col(text).isNotNull()).select(F.col(text_id).alias("tid"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    asked = keys.where(F.col(key).isNotNull()).select(F.col(key_id).alias("kid"), F.col(key).cast("string").alias("key"))
    asked = asked.withColumn("w", _words(F.col("key"))).withColumn("w", F.expr("slice(w, 2, greatest(size(w) - 2, 0))"))
    asked = cut(asked.withColumn("hashes", word_hashes(F.col("w"))).select("kid", "key", F.when(F.size("hashes") >= WINDOW, F.array_min("hashes")).alias("anchor")))
    long_, short = asked.where("anchor is not null"), asked.where("anchor is null").select("kid", "key")
    found = []
    if long_.head(1):
        # a column for each step: what a lambda reads must not be worked out again for each element
        hashed = rows.select("t1", "t2", _words(F.col("text")).alias("w")).select("t1", "t2", word_hashes(F.col("w")).alias("h"))
        anchors = hashed.select("t1", "t2", F.explode(least_of_windows(F.col("h"))).alias("anchor"))
        anchors = anchors.join(small(long_.select("anchor").distinct()), "anchor", "left_semi").distinct()
        found.append(salted(anchors, long_, ["anchor"], F.xxhash64("t1", "t2"), hot).select("t1", "t2", "kid", "key"))
    size = short.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("key")).alias("chars")).first()
    tested = None
    if size["n"] and size["n"] <= few and size["chars"] <= few_chars:
        listed = short.collect()
        kind = dict(keys.dtypes)[key_id]
        every = F.array(*[F.struct(F.lit(r["kid"]).cast(kind).alias("kid"), F.lit(r["key"]).alias("key")) for r in listed])
        tested = rows.select("tid", F.explode(F.filter(every, lambda k: F.contains(F.col("text"), k["key"]))).alias("k")).select("tid", "k.kid")
    elif size["n"]:
        length = F.coalesce(*[F.when(F.length("key") >= n, n) for n in STRETCHES], F.lit(0))
        short = cut(short.withColumn("length", length).withColumn("anchor", F.substring("key", F.lit(1), F.col("length"))))
        for n in [r["length"] for r in short.select("length").distinct().collect()]:
            of = short.where(F.col("length") == n).drop("length")
            chars = F.array(F.lit("")) if n == 0 else _stretches(F.col("c"), n)
            stretches = rows.select("t1", "t2", F.split("text", "").alias("c")).select("t1", "t2", F.explode(chars).alias("anchor")).join(small(of.select("anchor").distinct()), "anchor", "left_semi").distinct()
            found.append(salted(stretches, of, ["anchor"], F.xxhash64("t1", "t2"), hot).select("t1", "t2", "kid", "key"))
    out = tested
    if found:
        candidates = found[0]
        for f in found[1:]:
            candidates = candidates.unionByName(f)
        joined = salted(rows, cut(candidates), ["t1", "t2"], F.xxhash64("tid"), hot).where(F.contains("text", "key")).select("tid", "kid")
        out = joined if out is None else out.unionByName(joined)
    if out is None:
        out = rows.join(asked.limit(0), F.lit(False)).select("tid", "kid")
    return out.select(F.col("tid").alias(text_id), F.col("kid").alias(key_id))


def first_match(texts: DataFrame, text_id: str, text: str, keys: DataFrame, order: str, key: str, either: bool = False, **limits: int) -> DataFrame:
    """texts, each row with the row of keys that comes first by order and whose key its text contains; nulls where none does.

    either: also keys that contain the text. order tells the rows of keys apart, text_id those of texts; further columns of
    keys must not be called like those of texts.
    """
    found = pairs(texts, text_id, text, keys, order, key, **limits)
    if either:
        found = found.unionByName(pairs(keys, order, key, texts, text_id, text, **limits).select(found.columns))
    best = found.groupBy(text_id).agg(F.min(order).alias(order))
    return texts.join(best, text_id, "left").join(keys, order, "left")
