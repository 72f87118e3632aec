"""Relational queries: scans, filters, sorts, limits, set operations and joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.catalog import query, table
from quern.functions import tables as fixed
from quern.operators import containment
from quern.operators import relational as rel


@query("level_rollup", """
SELECT source, lang, count(*) AS n_tasks, round(avg(quality), 6) AS accuracy, sum(toxic)::BIGINT AS n_toxic
FROM documents JOIN labels USING (doc_id) GROUP BY source, lang ORDER BY source, lang""")
def level_rollup(spark, sf):
    scored = table(spark, sf, "documents").select("doc_id", "source", "lang").join(table(spark, sf, "labels"), "doc_id")
    return scored.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_tasks"), F.round(F.avg("quality"), 6).alias("accuracy"), F.sum("toxic").alias("n_toxic")).orderBy("source", "lang")


@query("database_query", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE lower(c_mktsegment) = 'building' ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def database_query(spark, sf):
    return rel.ask(table(spark, sf, "customer"), "c_mktsegment", "equals", "Building", "c_acctbal", 10, "c_custkey").select("c_custkey", "c_name", "c_acctbal")


def _asked(op, field, value, limit, sql):
    @query(f"database_query_{op}", f"SELECT p_partkey, p_name, p_retailprice, p_size FROM part WHERE {sql} ORDER BY p_retailprice DESC, p_partkey LIMIT {limit}")
    def run(spark, sf):
        return rel.ask(table(spark, sf, "part"), field, op, value, "p_retailprice", limit, "p_partkey").select("p_partkey", "p_name", "p_retailprice", "p_size")


_asked("greater_than", "p_size", "40", 25, "p_size > 40")
_asked("less_than", "p_retailprice", 1000, 10, "p_retailprice < 1000")
_asked("contains", "p_name", "RING", 15, "contains(lower(p_name), 'ring')")
_asked("equals", "p_size", "11", 5, "p_size::VARCHAR = '11'")


def _filter(name, column, condition, value, sql):
    @query(name, f"SELECT p_partkey, p_name, p_retailprice FROM part WHERE {sql}")
    def run(spark, sf):
        return rel.data_filter(table(spark, sf, "part"), column, condition, value).select("p_partkey", "p_name", "p_retailprice")


_filter("filter_greater_than", "p_retailprice", "greater_than", 1500, "p_retailprice > 1500")
_filter("filter_less_than", "p_size", "less_than", 10, "p_size < 10")
_filter("filter_equals", "p_size", "equals", 7, "p_size = 7")
_filter("filter_not_equals", "p_brand", "not_equals", "Brand#11", "p_brand <> 'Brand#11'")
_filter("filter_contains", "p_name", "contains", "RE", "contains(lower(p_name), 're')")
_filter("filter_starts_with", "p_name", "starts_with", "A", "starts_with(lower(p_name), 'a')")
_filter("filter_ends_with", "p_name", "ends_with", "E", "ends_with(lower(p_name), 'e')")


@query("filter_membership", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IS NOT NULL AND NOT (o_totalprice > 1000 AND o_orderstatus = 'F')")
def filter_membership(spark, sf):
    o = table(spark, sf, "orders")
    both = (F.col("o_totalprice") > 1000) & (F.col("o_orderstatus") == "F")
    return o.where(F.col("o_orderstatus").isin("F", "P") & F.col("o_orderpriority").isNotNull() & ~both).select("o_orderkey")


@query("prefix_bucket", """SELECT CASE WHEN starts_with(source, 'src1') THEN 'one' WHEN starts_with(source, 'src2') THEN 'two' ELSE 'other' END AS bucket,
  split_part(url_like, '_', 1) AS head, count(*) AS n FROM (SELECT source, source || '_' || lang AS url_like FROM documents) GROUP BY ALL""")
def prefix_bucket(spark, sf):
    d = table(spark, sf, "documents").select("source", F.concat("source", F.lit("_"), "lang").alias("url_like"))
    bucket = F.when(F.col("source").startswith("src1"), "one").when(F.col("source").startswith("src2"), "two").otherwise("other")
    return d.groupBy(bucket.alias("bucket"), F.split_part("url_like", F.lit("_"), F.lit(1)).alias("head")).agg(F.count(F.lit(1)).alias("n"))


@query("row_mean_min", """SELECT p_partkey, round(list_avg(list_filter([p_size::DOUBLE, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END, length(p_name)::DOUBLE], lambda x: x IS NOT NULL)), 6) AS mean3, least(p_size, p_retailprice, length(p_name)::DOUBLE) AS min3,
  CASE WHEN p_retailprice < 1 THEN p_retailprice * 100 ELSE p_retailprice END AS percent FROM part""")
def row_mean_min(spark, sf):
    p = table(spark, sf, "part").withColumn("known", F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice")))
    return p.select("p_partkey", F.round(rel.row_mean(F.col("p_size").cast("double"), F.col("known"), F.length("p_name").cast("double")), 6).alias("mean3"), F.least(F.col("p_size").cast("double"), "p_retailprice", F.length("p_name").cast("double")).alias("min3"), F.when(F.col("p_retailprice") < 1, F.col("p_retailprice") * 100).otherwise(F.col("p_retailprice")).alias("percent"))


@query("data_sort", "SELECT c_custkey, c_acctbal FROM customer ORDER BY coalesce(c_acctbal, 0) DESC, c_custkey")
def data_sort(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.coalesce("c_acctbal", F.lit(0.0)).desc(), "c_custkey")


@query("sort_absolute", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 25")
def sort_absolute(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.abs("c_acctbal").desc(), "c_custkey").limit(25)


@query("sort_composite", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 50")
def sort_composite(spark, sf):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf, "orders").orderBy(rank, F.col("o_totalprice").desc(), "o_orderkey").limit(50).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("head_tail", """SELECT 'part' AS of, part, key FROM ((SELECT 'head' AS part, p_partkey AS key FROM part ORDER BY p_retailprice, p_partkey LIMIT 10) UNION ALL (SELECT 'tail', p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 5))
UNION ALL SELECT 'region', 'head', r_regionkey FROM region""")
def head_tail(spark, sf):
    p = rel.head_tail(table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_retailprice"), ["p_retailprice", "key"])
    r = rel.head_tail(table(spark, sf, "region").select(F.col("r_regionkey").alias("key")), ["key"])  # too few for a tail
    return p.select(F.lit("part").alias("of"), "part", "key").unionByName(r.select(F.lit("region").alias("of"), "part", "key"))


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 20")
def seeded_sample(spark, sf):
    return table(spark, sf, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))), "doc_id").limit(20)


@query("stratified_sample", """SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) <= 3""")
def stratified_sample(spark, sf):
    return rel.stratified(table(spark, sf, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", 3)


@query("dedup_content", "SELECT min(doc_id) AS doc_id, lang, count(*) AS copies FROM documents GROUP BY lang, md5(text)")
def dedup_content(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("h"))
    return d.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "lang", "copies")


# set operations


@query("union_baselines", """SELECT source AS model, round(avg(n_chars), 6) AS score FROM documents GROUP BY source
UNION ALL SELECT 'random', round(avg(n_chars) * 0.25, 6) FROM documents UNION ALL SELECT 'oracle', max(n_chars)::DOUBLE FROM documents""")
def union_baselines(spark, sf):
    d = table(spark, sf, "documents")
    models = d.groupBy(F.col("source").alias("model")).agg(F.round(F.avg("n_chars"), 6).alias("score"))
    random = d.agg(F.round(F.avg("n_chars") * 0.25, 6).alias("score")).select(F.lit("random").alias("model"), "score")
    return models.unionByName(random).unionByName(d.agg(F.max("n_chars").cast("double").alias("score")).select(F.lit("oracle").alias("model"), "score"))


@query("id_intersection", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def id_intersection(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").intersect(table(spark, sf, "orders").select("o_custkey"))


@query("key_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def key_difference(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("distinct_pairs", "SELECT DISTINCT event_type, user_id FROM events")
def distinct_pairs(spark, sf):
    return table(spark, sf, "events").select("event_type", "user_id").distinct()


# joins


@query("merge_data", """WITH last AS (SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT c_custkey AS user_id, CASE WHEN l.user_id IS NOT NULL THEN l.value ELSE c_acctbal END AS value, l.event_type, l.user_id IS NOT NULL AS matched
FROM customer c LEFT JOIN last l ON c.c_custkey = l.user_id""")
def merge_data(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    right = table(spark, sf, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return rel.merge(left, right, "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "value", "event_type", "matched")


@query("pairwise_join", """WITH m AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL)
SELECT a.event_type AS a, b.event_type AS b, count(*) AS n, round(avg(a.v - b.v), 6) AS mean_diff FROM m a JOIN m b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL""")
def pairwise_join(spark, sf):
    m = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    a, b = m.select("user_id", F.col("event_type").alias("a"), F.col("v").alias("va")), m.select("user_id", F.col("event_type").alias("b"), F.col("v").alias("vb"))
    return a.join(b, "user_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("va") - F.col("vb")), 6).alias("mean_diff"))


@query("default_fill_join", "SELECT doc_id, coalesce(quality, 0) AS quality, CASE WHEN l.doc_id IS NULL THEN 'E10_format_error' END AS error_type FROM documents d LEFT JOIN labels l USING (doc_id)")
def default_fill_join(spark, sf):
    scored = table(spark, sf, "labels").select("doc_id", "quality", F.lit(True).alias("hit"))
    filled = rel.filled(table(spark, sf, "documents").select("doc_id"), scored, "doc_id", {"quality": 0, "hit": False})
    return filled.select("doc_id", "quality", F.when(~F.col("hit"), "E10_format_error").alias("error_type"))


@query("resume_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf):
    return rel.resume(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("semi_top5", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)""")
def semi_top5(spark, sf):
    top = table(spark, sf, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(5).select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(F.broadcast(top), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("tool_explode_join", """WITH t AS (SELECT DISTINCT l_orderkey, l_returnflag AS tool FROM lineitem)
SELECT tool, count(*) AS n_tasks, round(avg(o_totalprice), 6) AS mean_score FROM t JOIN orders ON l_orderkey = o_orderkey GROUP BY tool""")
def tool_explode_join(spark, sf):
    tools = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("tool")).distinct()
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return tools.join(o, "l_orderkey").groupBy("tool").agg(F.count(F.lit(1)).alias("n_tasks"), F.round(F.avg("o_totalprice"), 6).alias("mean_score"))


_RATES_SQL = ", ".join(f"('{c}', {r!r}::DOUBLE)" for c, r in fixed.RATES.items())


@query("double_dimension_lookup", f"""WITH r(currency, rate) AS (VALUES {_RATES_SQL}), c AS (SELECT c_custkey, c_acctbal, upper(substr(n_name, 1, 3)) AS a, CASE c_custkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'JPY' ELSE 'XXX' END AS b FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, round(coalesce(y.rate, 1.0) / coalesce(x.rate, 1.0), 6) AS rate, round(c_acctbal * (coalesce(y.rate, 1.0) / coalesce(x.rate, 1.0)), 4) AS converted FROM c LEFT JOIN r x ON c.a = x.currency LEFT JOIN r y ON c.b = y.currency""")
def double_dimension_lookup(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.upper(F.substring("n_name", 1, 3)).alias("a"))
    to = F.when(F.col("c_custkey") % 3 == 0, "EUR").when(F.col("c_custkey") % 3 == 1, "JPY").otherwise("XXX")
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey").join(n, "c_nationkey").withColumn("b", to)
    rates = F.broadcast(spark.createDataFrame(list(fixed.RATES.items()), "currency string, rate double"))  # fixed rows
    c = c.join(rates.select(F.col("currency").alias("a"), F.col("rate").alias("ra")), "a", "left").join(rates.select(F.col("currency").alias("b"), F.col("rate").alias("rb")), "b", "left")
    rate = F.coalesce("rb", F.lit(1.0)) / F.coalesce("ra", F.lit(1.0))
    return c.select("c_custkey", F.round(rate, 6).alias("rate"), F.round(F.col("c_acctbal") * rate, 4).alias("converted"))


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_KB_SQL = ", ".join(f"({i}, {_text(k)}, {_text(a)}, {c!r}::DOUBLE, {_text(s)})" for i, (k, a, c, s) in enumerate(fixed.KNOWLEDGE))
_ASKED = "CASE c_custkey % 4 WHEN 0 THEN 'What is the capital of France?' WHEN 1 THEN 'largest' WHEN 2 THEN 'Speed of Light ' ELSE 'customer ' || c_custkey::VARCHAR END"


@query("knowledge_base_query", f"""WITH kb(i, k, answer, confidence, source) AS (VALUES {_KB_SQL}), q AS (SELECT c_custkey, lower(trim({_ASKED})) AS q FROM customer)
SELECT c_custkey, answer, confidence FROM q LEFT JOIN kb ON contains(q, k) OR contains(k, q) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY i) = 1""")
def knowledge_base_query(spark, sf):
    k = F.col("c_custkey") % 4
    asked = F.when(k == 0, "What is the capital of France?").when(k == 1, "largest").when(k == 2, "Speed of Light ").otherwise(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")))
    low = F.lower(F.trim(asked))
    # the base is twelve fixed rows: a chain of tests instead of a nested-loop join
    hit = F.coalesce(*[F.when(F.contains(low, F.lit(key)) | F.contains(F.lit(key), low), F.struct(F.lit(a).alias("answer"), F.lit(c).alias("confidence"))) for key, a, c, _ in fixed.KNOWLEDGE])
    return table(spark, sf, "customer").select("c_custkey", hit.alias("h")).select("c_custkey", "h.answer", "h.confidence")


@query("containment_join", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def containment_join(spark, sf):
    """Which documents hold which benchmark passages, whole."""
    return containment.pairs(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text")


_ASKED_PART = "CASE p_partkey % 4 WHEN 0 THEN 'what does the ' || p_name || ' cost?' WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN ' ' || upper(p_name) ELSE 'part ' || p_partkey::VARCHAR END"


@query("knowledge_table", f"""WITH kb AS (SELECT p_name AS k, min(p_partkey) AS i, count(*) AS parts FROM part GROUP BY 1), q AS (SELECT p_partkey, lower(trim({_ASKED_PART})) AS q FROM part)
SELECT p_partkey, i, parts FROM q LEFT JOIN kb ON contains(q, k) OR contains(k, q) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY i) = 1""")
def knowledge_table(spark, sf):
    """A question's first match in a table of keys, either in the other: questions about parts, keys the parts' names."""
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    kind = F.col("p_partkey") % 4
    asked = F.when(kind == 0, F.concat(F.lit("what does the "), "p_name", F.lit(" cost?"))).when(kind == 1, F.split_part("p_name", F.lit(" "), F.lit(1))).when(kind == 2, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(F.concat(F.lit("part "), F.col("p_partkey").cast("string")))
    base = p.groupBy(F.col("p_name").alias("k")).agg(F.min("p_partkey").alias("i"), F.count(F.lit(1)).alias("parts"))
    return containment.first_match(p.select("p_partkey", F.lower(F.trim(asked)).alias("q")), "p_partkey", "q", base, "i", "k", either=True).select("p_partkey", "i", "parts")


@query("cross_config", """WITH w(config, a, b) AS (VALUES ('default', 0.5, 0.5), ('first', 0.8, 0.2), ('second', 0.2, 0.8))
SELECT config, source, round(avg(a * quality + b * toxic), 6) AS score FROM documents JOIN labels USING (doc_id), w GROUP BY config, source""")
def cross_config(spark, sf):
    # a cross join with three fixed rows, as an explode of a literal
    configs = F.array(*[F.struct(F.lit(n).alias("config"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in (("default", 0.5, 0.5), ("first", 0.8, 0.2), ("second", 0.2, 0.8))])
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    d = d.groupBy("source").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t")).select("source", "q", "t", F.explode(configs).alias("w"))
    return d.select("w.config", "source", F.round(F.col("w.a") * F.col("q") + F.col("w.b") * F.col("t"), 6).alias("score"))


@query("annotator_intersection", """SELECT count(*) AS n, round(avg((a.quality = 1 - b.toxic)::INT), 6) AS agreement FROM labels a JOIN labels b USING (doc_id)""")
def annotator_intersection(spark, sf):
    a = table(spark, sf, "labels").select("doc_id", "quality")
    b = table(spark, sf, "labels").select("doc_id", "toxic")
    return a.join(b, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("quality") == 1 - F.col("toxic")).cast("double")), 6).alias("agreement"))


@query("overall_gap_window", "SELECT DISTINCT source, lang, round(avg(n_chars) OVER (PARTITION BY source, lang) - avg(n_chars) OVER (PARTITION BY source), 6) AS gap FROM documents")
def overall_gap_window(spark, sf):
    d = table(spark, sf, "documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("s"), F.count("n_chars").alias("n"))
    w = W.partitionBy("source")
    return d.select("source", "lang", F.round(F.col("s") / F.col("n") - F.sum("s").over(w) / F.sum("n").over(w), 6).alias("gap"))
