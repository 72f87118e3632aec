"""Line deduplication: range-partitioned hashes, sorted by document and position, give keep bitmaps for each document.

Every line's key is hashed to 128 bits. The hashes are range-partitioned and sorted, within a hash by falling document and
rising position, so that one pass over a sorted partition sees each key's documents in order: the first holds the
occurrence that stays, and five documents make the key a repeated one. What returns to a document is a bitmap of its kept
lines, compressed to the lengths of its runs; the texts are never exchanged by line. A key that holds a large share of
all lines would fill a partition: a sketch of frequent items finds such keys, their documents are counted by partial
aggregates, and their lines are judged where they stand. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._common import cut

LEAST_LENGTH = 40
"""Code points from which on a key counts."""

LEAST_DOCUMENTS = 5
"""Documents from which on a key is repeated."""

HOT = 512
"""Most keys that are treated as hot; the list of them is broadcast."""

HOT_SHARE = 1 / 1024
"""Share of all counted lines from which on a key is hot."""

SKETCHES = 256
"""Sketches that the tasks' sketches are merged to before they meet."""

def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\v\f\r"))


def line_key(line: Column) -> Column:
    """Equal for two lines that are equal without space and U+0009-000D at both ends, A-Z lower-cased.

    Of a line beyond ASCII it is not that text itself: its UTF-8 is read as one character a byte, so that lower() touches A-Z
    and else lead bytes alone, in a way that tells texts apart, for the bytes that follow are as many as the true lead asks for.
    """
    own = stripped(line)
    return F.lower(F.when(F.octet_length(own) == F.length(own), own).otherwise(F.decode(own.cast("binary"), "ISO-8859-1")))


def _text(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _known(docs: DataFrame) -> DataFrame:
    """(doc_id, th): what tells documents apart; rows that share both have the same result."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(_text(docs)).alias("th"), _text(docs).alias("text"))


def lines(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, th, pos, h1, h2): the lines whose keys count, with their keys' hashes."""
    at = _known(docs).select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    at = at.where((F.octet_length("line") >= least_length) & (F.length(stripped(F.col("line"))) >= least_length)).withColumn("key", line_key(F.col("line")))
    return at.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def hot_keys(all_lines: DataFrame, share: float = HOT_SHARE, most: int = HOT) -> DataFrame:
    """(h1): keys that hold the share of all lines or more, by a sketch that every task fills; at most so many."""
    tracked = 8 * most
    parts = all_lines.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(h1, {tracked})").alias("s"))
    whole = parts.groupBy(F.lit(0).alias("all")).agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))
    found = whole.select("n", F.explode(F.expr(f"approx_top_k_estimate(s, {most})")).alias("t"))
    return found.where(F.col("t.count") >= F.greatest(F.lit(1000), F.col("n") * share)).select(F.col("t.item").alias("h1"))


def dropped(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS, hot_share: float = HOT_SHARE) -> DataFrame:
    """(doc_id, th, pos): lines that go: repeated keys' lines outside the largest doc_id that holds the key.

    Rows that share a doc_id are one document, rows without one another, the smallest.
    """
    every = cut(lines(docs, least_length))  # a fifth of the texts' size, about, and read several times
    gone = F.lit(False)
    hot = cut(hot_keys(every, hot_share))
    if hot.head(1):
        held = every.join(F.broadcast(hot), "h1").groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        owners = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("owner"))
        every = every.join(F.broadcast(cut(owners)), ["h1", "h2"], "left")  # as many rows as hot keys, but for equal first halves
        stays = (F.col("n") < least_documents) | F.col("doc_id").eqNullSafe(F.col("owner"))
        gone = F.col("n").isNotNull()
        spread = F.when(gone, F.xxhash64("doc_id", "th", "pos")).otherwise(F.col("h1"))  # judged already: dealt anywhere
        every = every.where(~gone | ~stays).select("doc_id", "th", "pos", spread.alias("h1"), "h2", gone.alias("gone"))
    else:
        every = every.withColumn("gone", gone)
    ordered = every.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.col("doc_id").desc_nulls_last(), "pos")
    stream = W.partitionBy("h1", "h2").orderBy(F.col("doc_id").desc_nulls_last())
    ranked = ordered.withColumn("nth", F.dense_rank().over(stream))
    ranked = ranked.withColumn("documents", F.max("nth").over(W.partitionBy("h1", "h2")))
    return ranked.where(F.col("gone") | (F.col("documents") >= least_documents) & (F.col("nth") > 1)).select("doc_id", "th", "pos")


def borders(gone: DataFrame) -> DataFrame:
    """gone: (..., n, gone: dropped places, sorted) with borders instead of gone: where a kept run begins, and where it ends,
    by turns; the first begins at 0, the last ends at n. A column for each step, so that no step is worked out twice."""
    rest = [c for c in gone.columns if c != "gone"]
    starts = F.filter("gone", lambda x, i: (i == 0) | (F.get("gone", i - 1) != x - 1))
    ends = F.filter("gone", lambda x, i: (i == F.size("gone") - 1) | (F.get("gone", i + 1) != x + 1))
    between = F.flatten(F.zip_with("starts", "ends", lambda a, z: F.array(a, z + 1)))
    return gone.select(*rest, starts.alias("starts"), ends.alias("ends")).select(*rest, F.concat(F.array(F.lit(0)), between, F.array("n")).alias("borders"))


def _bitmaps(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, th, gone): the sorted places of dropped lines, of documents that have some."""
    return dropped(docs, **limits).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def _judged(docs: DataFrame, columns: list[str], **limits) -> DataFrame:
    """docs' columns with __lines and __keep; helper names are taken that docs doesn't have."""
    gone = _bitmaps(docs, **limits).select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th"), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").cast("long").alias("k_id"), F.xxhash64(_text(docs)).alias("k_th"), F.split(_text(docs), "\n", -1).alias("lines"))
    found = rows.join(gone, F.col("k_id").eqNullSafe(F.col("g_id")) & (F.col("k_th") == F.col("g_th")), "left")
    none = F.array().cast("array<int>")
    return borders(found.select("row", "lines", F.size("lines").alias("n"), F.coalesce("gone", none).alias("gone")))


def _runs() -> Column:
    """Lengths of a bitmap's runs, from its borders: kept lines, then dropped ones, by turns."""
    return F.transform(F.slice("borders", 2, F.size("borders") - 1), lambda x, i: x - F.get("borders", i))


def _lost() -> Column:
    return F.aggregate(F.transform("keep", lambda x, i: F.when(i % 2 == 1, x).otherwise(0)), F.lit(0), lambda s, x: s + x).cast("long")


def _kept() -> Column:
    """The text of the lines within the kept runs."""
    pieces = F.transform(F.sequence(F.lit(0), F.size("borders") - 1, F.lit(2)), lambda i: F.slice("lines", F.get("borders", i) + 1, F.get("borders", i + 1) - F.get("borders", i)))
    return F.array_join(F.flatten(pieces), "\n")


def keep_bitmaps(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, n_lines, n_dropped, keep): keep holds the lengths of the bitmap's runs, kept lines first, then by turns.

    Lines end at \\n; a null or empty text is one empty line. A line's key counts from least_length code points on and is
    repeated from least_documents documents on. Of a repeated key only the lines in the largest doc_id that holds it stay.
    A row for each row of docs: rows that share a doc_id are one document, and so are rows without one; equal rows have
    equal results. Other columns are ignored; an empty table gives an empty result.
    """
    judged = _judged(docs, ["doc_id"], **limits).select(F.col("row.doc_id").alias("doc_id"), "n", _runs().alias("keep"))
    return judged.select("doc_id", F.col("n").cast("long").alias("n_lines"), _lost().alias("n_dropped"), "keep")


def deduplicate(docs: DataFrame, **limits) -> DataFrame:
    """docs with the dropped lines gone from text; n_chars, where there is one, follows. Cases as in keep_bitmaps; a null
    text stays null."""
    judged = _judged(docs, docs.columns, **limits).select("row", _kept().alias("new"))
    text = F.when(F.col("row.text").isNotNull(), F.col("new"))
    made = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return judged.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256): the digest columns of keep_bitmaps and deduplicate; cases as there."""
    judged = _judged(docs, ["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "n", _runs().alias("keep"), F.sha2(_kept().cast("binary"), 256).alias("kept_sha256"))
    return judged.select("doc_id", F.col("n").cast("long").alias("n_lines"), _lost().alias("n_dropped"), "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= 5),
j AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.owner AS gone FROM k LEFT JOIN c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY r
"""
