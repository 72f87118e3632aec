"""Composition patterns: chains, fan-outs and DAGs of the library's operators, and file-shaped queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog import query, table
from quern.functions import dates, numeric, records, text
from quern.functions import tables as fixed
from quern.operators.compose import Step, join, run
from quern.plans.columns import digits, listed, mod
from quern.sources import io

R = records.remainder


def _celsius(name):
    return (R(records.hashed("weather", F.lower(name)), 45) - 5).cast("double")


def _weather_sql(of: str) -> str:
    return f"(SELECT *, ({mod('d', 45)} - 5)::DOUBLE AS c FROM (SELECT *, {digits(chr(39) + '[' + chr(34) + 'weather' + chr(34) + ', ' + chr(34) + chr(39) + ' || lower(n_name) || ' + chr(39) + chr(34) + ']' + chr(39))} AS d FROM {of}))"


@query("chain_weather_convert", f"SELECT n_nationkey, c AS celsius, round(c * 9 / 5 + 32, 4) AS fahrenheit FROM {_weather_sql('nation')}")
def chain_weather_convert(spark, sf):
    steps = [Step("celsius", _celsius, ["n_name"]), Step("fahrenheit", lambda c: numeric.convert(c, F.lit("celsius"), F.lit("fahrenheit")), ["celsius"])]
    return run(table(spark, sf, "nation"), steps).select("n_nationkey", "celsius", "fahrenheit")


@query("fanout_weather_argmax", f"SELECT n_regionkey, arg_max(n_name, (c, n_name)) AS warmest, max(c) AS celsius FROM {_weather_sql('nation')} GROUP BY 1")
def fanout_weather_argmax(spark, sf):
    n = run(table(spark, sf, "nation"), [Step("c", _celsius, ["n_name"])])
    return n.groupBy("n_regionkey").agg(F.max_by("n_name", F.struct("c", "n_name")).alias("warmest"), F.max("c").alias("celsius"))


@query("dag_weather_statistics", f"SELECT n_regionkey, round(avg(c), 4) AS mean, min(c) AS low, max(c) AS high, 'Region ' || n_regionkey::VARCHAR || ': ' || printf('%.1f', avg(c)) AS report FROM {_weather_sql('nation')} GROUP BY 1")
def dag_weather_statistics(spark, sf):
    n = run(table(spark, sf, "nation"), [Step("c", _celsius, ["n_name"])])
    g = n.groupBy("n_regionkey").agg(F.avg("c").alias("a"), F.min("c").alias("low"), F.max("c").alias("high"))
    return g.select("n_regionkey", F.round("a", 4).alias("mean"), "low", "high", F.format_string("Region %d: %.1f", "n_regionkey", "a").alias("report"))


@query("fanout_exchange", "SELECT c_custkey, " + ", ".join(f"round(c_acctbal * {fixed.RATES[k]!r}::DOUBLE, 4) AS {k.lower()}" for k in ("EUR", "JPY", "GBP")) + " FROM customer")
def fanout_exchange(spark, sf):
    steps = [Step(k.lower(), lambda v, r=fixed.RATES[k]: F.round(v * r, 4), ["c_acctbal"]) for k in ("EUR", "JPY", "GBP")]
    return run(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), steps).drop("c_acctbal")


@query("dag_currency_minmax_format", "SELECT c_custkey, format('{:,.2f}', greatest(e, j) - least(e, j)) AS spread FROM (SELECT c_custkey, round(c_acctbal * 0.92, 4) AS e, round(c_acctbal * 149.5, 4) AS j FROM customer)")
def dag_currency_minmax_format(spark, sf):
    steps = [
        Step("e", lambda v: F.round(v * fixed.RATES["EUR"], 4), ["c_acctbal"]),
        Step("j", lambda v: F.round(v * fixed.RATES["JPY"], 4), ["c_acctbal"]),
        Step("spread", lambda a, b: numeric.formatted(F.greatest(a, b) - F.least(a, b), "comma"), ["e", "j"]),
    ]
    return run(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), steps).select("c_custkey", "spread")


@query("chain_mask_count", r"SELECT conv_id, turn, len(regexp_extract_all(m, '\[(?:SSN|EMAIL|PHONE)\]'))::INT AS masked FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', '[SSN]', 'g'), '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+', '[EMAIL]', 'g'), '\+?[0-9][0-9\s\-()]{7,}[0-9]', '[PHONE]', 'g') AS m FROM conversations)")
def chain_mask_count(spark, sf):
    steps = [Step("m", text.masked, ["text"]), Step("masked", lambda m: F.regexp_count(m, F.lit(r"\[(?:SSN|EMAIL|PHONE)\]")), ["m"])]
    return run(table(spark, sf, "conversations"), steps).select("conv_id", "turn", "masked")


@query("dag_schedule", "SELECT o_orderkey, (o_orderdate::DATE + (8 - isodow(o_orderdate))::INT)::VARCHAR AS monday, isodow(o_orderdate + INTERVAL 10 DAY) <= 5 AS business FROM orders")
def dag_schedule(spark, sf):
    steps = [
        Step("monday", lambda d: dates.next_weekday(d, "MON").cast("string"), ["o_orderdate"]),
        Step("due", lambda d: F.date_add(d, 10), ["o_orderdate"]),
        Step("business", dates.business_day, ["due"]),
    ]
    return run(table(spark, sf, "orders"), steps).select("o_orderkey", "monday", "business")


@query("dag_entities_report", r"""SELECT doc_id, len(regexp_extract_all(text, 'https?://[^\s<>"{}|\\^`\[\]]+'))::INT AS links, len(regexp_extract_all(text, '\$[0-9,.]+'))::INT AS prices, l.quality FROM documents LEFT JOIN labels l USING (doc_id)""")
def dag_entities_report(spark, sf):
    steps = [Step("links", lambda t: F.size(text.found(t, text.ENTITIES["url"])), ["text"]), Step("prices", lambda t: F.regexp_count(t, F.lit(r"\$[0-9,.]+")), ["text"])]
    d = run(table(spark, sf, "documents").select("doc_id", "text"), steps).drop("text")
    return join("doc_id", d, table(spark, sf, "labels").select("doc_id", "quality"))


@query("control_conditions", f"SELECT c AS condition, count(*) AS n, round(avg(CASE c WHEN 'minimal' THEN quality WHEN 'verbose' THEN quality * 0.5 ELSE toxic END), 6) AS mean FROM labels, (SELECT unnest({listed(['minimal', 'verbose', 'chain'])}) AS c) GROUP BY 1")
def control_conditions(spark, sf):
    c = F.explode(F.array(*map(F.lit, ["minimal", "verbose", "chain"]))).alias("condition")
    value = F.when(F.col("condition") == "minimal", F.col("quality")).when(F.col("condition") == "verbose", F.col("quality") * 0.5).otherwise(F.col("toxic"))
    return table(spark, sf, "labels").select("quality", "toxic", c).groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"))


@query("transform_format", "SELECT event_id, json_extract_string(props, '$.k') AS csv, 'k: ' || json_extract_string(props, '$.k') AS txt, replace(props, ' ', '') AS js FROM events")
def transform_format(spark, sf):
    p, schema = F.col("props"), "k int"
    return table(spark, sf, "events").select("event_id", io.converted(p, "json", "csv", schema).alias("csv"), io.converted(p, "json", "text", schema).alias("txt"), io.converted(p, "json", "json", schema).alias("js"))


@query("generate_report", "SELECT '| ' || r_regionkey::VARCHAR || ' | ' || r_name || ' |' AS line FROM region")
def generate_report(spark, sf):
    return io.markdown(table(spark, sf, "region").select("r_regionkey", "r_name"))


@query("flatten_task", """SELECT conv_id, count(*) AS num_steps, count(DISTINCT role) AS num_roles, to_json(list(turn ORDER BY turn)) AS turns FROM conversations GROUP BY 1""")
def flatten_task(spark, sf):
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("num_steps"), F.count_distinct("role").alias("num_roles"), F.array_sort(F.collect_list("turn")).alias("t"))  # a conversation's turns
    return g.select("conv_id", "num_steps", "num_roles", F.to_json("t").alias("turns"))


@query("list_files")
def list_files(spark, sf):
    return io.files(spark, sf).select(F.element_at(F.split("path", "/"), -1).alias("name"), "size")


@query("read_file")
def read_file(spark, sf):
    f = spark.read.format("binaryFile").load(f"{sf}/region.parquet")
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
