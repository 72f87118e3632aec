"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents stand in shuffled order on a line of words, cut into equal blocks. Golden-ratio points,
mapped through the cumulative targets, give each slot of the schedule its source; a slot's rank among its
source's slots names the block it takes, and the line starts again when it ends. How many slots the points give a
source, and so how many words it contributes, is the schedule's doing: the points' low discrepancy keeps it near the
target, and only the limit on repeats ends a source earlier. Blocks grow with the corpus, so the schedule has a bounded
number of slots; offsets and ranks are two-level prefix sums over small buckets, so that no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window as W

from ._common import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 1327217885  # 2^31 divided by the golden ratio, made odd
PERIOD = 1 << 31
CELLS = 4096  # or as many as there are sources
SLOTS = 1 << 23
"""Slots of the schedule, about, from which on blocks grow instead."""

BLOCK = 256
"""Words of a block, until the corpus needs more SLOTS than allowed; fewer in a corpus of few words."""

CHUNK = 1024
"""Slots that are ranked together."""

BROADCAST_SOURCES = 10_000
"""Most sources whose table is broadcast; more are joined by a shuffle."""


def _small(sources: DataFrame, n: int) -> DataFrame:
    return F.broadcast(sources) if n <= BROADCAST_SOURCES else sources


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_md5, source, size, h, row): size counts words (null: 0), h orders the shuffle, row is a hash of all
    columns (maps aside) that tells rows apart which share a doc_id and a text."""
    columns = [f.name for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    return docs.select(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("row"), "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """One row for each source: sid (rank by code point, null last), source, source_size, target, quota, block, upto.

    Targets share out share times all words by weight, stop at limit times the source's size and hand on the
    excess: target = least(limit * size, weight * level), where the level is the largest that capping the first
    sources by size over weight gives. quota is the target in whole words, upto the quotas' running sum. The windows
    run over one row for each source.
    """
    by = W.orderBy(F.col("source").asc_nulls_last())
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by).cast("long"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")).cast("long")
    s = s.withColumn("w", weight).withColumn("cap", F.col("source_size") * limit).withColumn("total", F.sum("source_size").over(W.partitionBy()))
    up = W.orderBy(F.col("cap") / F.col("w"), "sid")
    before = F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap")
    rest = F.sum("w").over(up.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", (F.col("total") * F.lit(share) - before) / rest).withColumn("level", F.max("level").over(W.partitionBy()))
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")))
    s = s.withColumn("quota", F.least("cap", F.floor(F.col("target") + 0.5)).cast("long"))
    words = F.floor(F.col("total") * F.lit(share))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(words / 65536)), F.ceil(words / SLOTS)).cast("long")
    return s.withColumn("block", block).withColumn("upto", F.sum("quota").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0))).select("sid", "source", "source_size", "target", "quota", "block", "upto")


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, sid, rank, start, words): which words of its source's endless line each slot takes.

    sources: targets(), cut. A slot takes a whole block; only the last slot before a source's limit on repeats may take
    less, and slots beyond that limit take nothing and are left out.
    """
    spark = sources.sparkSession
    head = sources.agg(F.max("upto").alias("all"), F.max("block").alias("block"), F.count(F.lit(1)).alias("n")).first()
    total, block = head["all"] or 0, head["block"] or 1
    slots = -(-total // block)
    at = F.pmod(F.col("id") % PERIOD * GOLDEN, F.lit(PERIOD)) / PERIOD
    cell = lambda c: F.floor(c / max(1.0, float(total)) * max(CELLS, head["n"]))
    points = spark.range(slots).select(F.col("id").alias("slot"), (at * float(total)).alias("x")).withColumn("cell", cell(F.col("x")))
    lo = F.col("upto") - F.col("quota")
    cells = sources.where("quota > 0").select("sid", lo.alias("lo"), F.col("upto").alias("hi"), F.explode(F.sequence(cell(lo), cell(F.col("upto")))).alias("cell"))
    drawn = points.join(F.broadcast(cells) if head["n"] <= BROADCAST_SOURCES else cells, "cell").where("x >= lo and x < hi").select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = drawn.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    base = counts.withColumn("base", F.sum("n").over(W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    ranked = drawn.withColumn("k", F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1).join(base.select("sid", "chunk", "base"), ["sid", "chunk"])
    ranked = ranked.select("slot", "sid", (F.col("base") + F.col("k")).alias("rank"))
    start, limit = F.col("rank") * F.col("block"), F.col("source_size") * LIMIT
    return ranked.join(_small(sources.select("sid", "source_size", "block"), head["n"]), "sid").where(start < limit).select("slot", "sid", "rank", start.alias("start"), F.least("block", limit - start).alias("words"))


def placed(sized: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """sized with its source's columns and off, the place of its first word on its source's line."""
    d = sized.join(_small(sources.withColumnRenamed("source", "s"), n), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", F.substring("h", 1, 3))
    sums = d.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("base", F.sum("n").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    within = F.sum("size").over(W.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", "text_md5", "row").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    return d.withColumn("in", within).join(sums.select("sid", "bucket", "base"), ["sid", "bucket"]).withColumn("off", F.col("base") + F.col("in"))


def segments(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mix itself, and the placed documents.

    The mix has, for each slot and each document in its block, the words [first, first + words) taken of that
    document: (slot, sid, off, turn, doc_id, text_md5, row, source, size, first, words). Documents are known by (sid, off)
    where size > 0; turn counts how often the source's line has started again. What no slot takes has a null slot and 0
    words.
    """
    sized = cut(sizes(docs))
    sources = cut(targets(sized))
    n = sources.count()
    put = placed(sized, sources, n)
    turn = F.explode(F.sequence(F.lit(0), F.lit(LIMIT - 1)))
    copies = put.where("size > 0").select("sid", "off", "doc_id", "text_md5", "row", "source", "size", "source_size", "block", turn.alias("turn"))
    copies = copies.withColumn("at", F.col("off") + F.col("source_size") * F.col("turn"))
    pieces = copies.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / F.col("block")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block")))))
    mixed = pieces.join(schedule(sources).select("slot", "sid", "rank", "start", F.col("words").alias("of")), ["sid", "rank"], "left")
    first = F.greatest(F.col("start") - F.col("at"), F.lit(0))
    words = F.least(F.col("start") + F.col("of") - F.col("at"), F.col("size")) - first
    return mixed.select("slot", "sid", "off", "turn", "doc_id", "text_md5", "row", "source", "size", first.alias("first"), F.when(F.col("start").isNotNull(), words).otherwise(0).alias("words")), put


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, text_md5): a row for each row of docs.

    Null texts and texts without words have size 0 and are not taken; a null source is a source of its own; rows
    that repeat are placed one after another. Other columns only order such rows. Reruns give the same rows.
    """
    mix, put = segments(docs)
    some = mix.groupBy("sid", "off").agg(F.sum("words").alias("taken"))
    some = put.where("size > 0").join(some, ["sid", "off"])
    none = put.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", F.col("taken").cast("long"), "source", "text_md5"]
    return some.select(columns).unionByName(none.select(columns))


def _start(text: Column, words: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.call_function("regexp_extract", text, F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), words.cast("string"), F.lit("}+")), F.lit(0))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents, with docs' columns, in the order of the schedule: partitions by rising slots, sorted within.

    A document comes once for each turn in which slots take words of it, where the first of these slots stands: whole,
    or up to the word at which its source ends (n_chars, where there is one, follows). Documents that no slot takes,
    null texts and texts without words among them, are left out. Rows without a doc_id or source, rows that repeat and
    rows that differ in further columns only are documents of their own.
    """
    pieces, put = segments(docs)
    copies = pieces.where("slot is not null").groupBy("sid", "off", "turn").agg(F.min("slot").alias("__slot"), F.sum("words").alias("__words"), *[F.first(c).alias(f"__{c}") for c in ("doc_id", "text_md5", "row", "source", "size")])
    copies = cut(copies.where("__words > 0").drop("sid", "off", "turn"))
    columns = [f.name for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"), F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("all"))
    if put.where("size > 0").groupBy("doc_id", "row", "text_md5").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1):  # of equal rows one stands for all
        keyed = keyed.dropDuplicates(["id", "key", "all"])
    same = keyed["id"].eqNullSafe(copies["__doc_id"]) & (keyed["key"] == copies["__text_md5"]) & (keyed["all"] == copies["__row"])
    out = keyed.join(copies, same).withColumn("cut", F.when(F.col("__words") == F.col("__size"), F.col("r.text")).otherwise(_start(F.col("r.text"), F.col("__words"))))
    made = {"text": F.col("cut")} | ({"n_chars": F.length("cut").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.repartitionByRange("__slot").sortWithinPartitions("__slot", "key", "all").select(*[made.get(c, F.col(f"r.`{c}`")).alias(c) for c in docs.columns])


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS h, md5(coalesce(text, '')) AS text_md5 FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid, (sum(source_size) OVER ())::BIGINT AS total FROM s0),
s2 AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS cap FROM s1),
s3 AS (SELECT *, (total * 1.5::DOUBLE - ((sum(cap) OVER (ORDER BY cap::DOUBLE / w, sid))::BIGINT - cap)) /
    (sum(w) OVER (ORDER BY cap::DOUBLE / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM s2),
s4 AS (SELECT *, least(cap::DOUBLE, w * max(level) OVER ()) AS target FROM s3),
s5 AS (SELECT *, least(cap, floor(target + 0.5)::BIGINT) AS quota FROM s4),
s6 AS (SELECT *, (sum(quota) OVER (ORDER BY sid))::BIGINT AS upto, (sum(quota) OVER ())::BIGINT AS mixed,
    greatest(1, least({BLOCK}, floor(floor(total * 1.5::DOUBLE) / 65536)), ceil(floor(total * 1.5::DOUBLE) / {SLOTS}))::BIGINT AS block FROM s5),
slots AS (SELECT ((i % {PERIOD}) * {GOLDEN}) % {PERIOD} / {PERIOD}::DOUBLE * mixed::DOUBLE AS x FROM (SELECT DISTINCT mixed, (mixed + block - 1) // block AS n FROM s6), LATERAL (SELECT unnest(range(n)) AS i)),
drawn AS (SELECT sid, count(*) AS n FROM slots JOIN s6 ON x >= upto - quota AND x < upto GROUP BY sid),
s AS (SELECT s6.*, least(coalesce(n, 0) * block, {LIMIT} * source_size) AS given FROM s6 LEFT JOIN drawn USING (sid)),
p AS (SELECT d.doc_id, d.size, s.source_size, s.target, s.given, s.source, d.text_md5,
    ((sum(d.size) OVER (PARTITION BY s.sid ORDER BY d.h, d.doc_id, d.size, d.text_md5 ROWS UNBOUNDED PRECEDING))::BIGINT - d.size) AS off
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, (greatest(least(size, given - off), 0) + greatest(least(size, given - off - source_size), 0))::BIGINT AS taken, source, text_md5 FROM p
"""
