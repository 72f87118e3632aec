"""Tables of the failure analysis, task suites, and the readers' and sinks' queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.catalog import query, table
from quern.functions import numeric
from quern.functions import tables as fixed
from quern.operators import scoring, stats, suite
from quern.plans import evaluation as ev
from quern.sources import io, runs

_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
_STEP = f"PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}"


@query("level_summary", f"""SELECT task % 7 AS model, level, count(*) AS n_tasks, round(avg({ev._OVERALL}), 6) AS accuracy, round(avg(seq), 6) AS sequence, round(avg(a), 6) AS arguments, round(avg(c), 6) AS completeness, round(avg(c), 6) AS flow,
  round(avg(wanted), 6) AS avg_tokens, round(avg(done), 6) AS avg_calls FROM {ev._PARTS} GROUP BY ALL""")
def level_summary(spark, sf):
    c = F.col
    t = ev._tasks(spark, sf).withColumn("overall", scoring.overall(c("level"), c("first"), c("seq"), c("args"), c("complete"), c("complete")))
    of = {"accuracy": "overall", "sequence": "seq", "arguments": "args", "completeness": "complete", "flow": "complete", "avg_tokens": "wanted", "avg_calls": "done"}
    return t.groupBy((c("task") % 7).alias("model"), "level").agg(F.count(F.lit(1)).alias("n_tasks"), *[F.round(F.avg(v), 6).alias(k) for k, v in of.items()])


@query("call_diagnostics")
def call_diagnostics(spark, sf):
    """Over the exploded calls of each model's tasks: tools chosen right, arguments, steps done, and flow where steps wait."""
    t = scoring.score(ev.order_tasks(spark, sf)).select((F.col("task") % 7).alias("model"), "flow", F.size("steps").alias("n"), "call_scores")
    waits = F.when(F.exists("call_scores", lambda s: F.size(s["depends_on"]) > 0), F.col("flow"))
    calls = t.withColumn("flow", waits).select("model", "flow", "n", F.posexplode("call_scores").alias("at", "s"))
    done = F.when(F.col("s.matched"), 1.0).otherwise(0.0)
    return calls.groupBy("model").agg(F.round(F.avg(F.when(F.col("s.matched"), 1.0)), 6).alias("tools"), F.round(F.avg(F.when(F.col("s.matched"), F.col("s.args_score"))), 6).alias("arguments"), F.round(F.avg(done), 6).alias("steps"), F.round(F.avg(F.when(F.col("at") == 0, F.col("flow"))), 6).alias("flow"))


@query("distinct_tools", "SELECT l_linestatus AS model, count(DISTINCT l_returnflag) AS tools, count(DISTINCT l_orderkey) AS tasks FROM lineitem GROUP BY 1")
def distinct_tools(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_linestatus", "l_orderkey").agg(F.collect_set("l_returnflag").alias("tools"))
    return t.select(F.col("l_linestatus").alias("model"), "l_orderkey", F.explode("tools").alias("tool")).groupBy("model").agg(F.count_distinct("tool").alias("tools"), F.count_distinct("l_orderkey").alias("tasks"))


@query("failure_rollup", f"""WITH s AS (SELECT l_linestatus AS model, row_number() OVER w AS step, (l_returnflag = 'R')::INT AS failed, lead((l_returnflag = 'R')::INT) OVER w AS next FROM lineitem WINDOW w AS ({_STEP})),
p AS (SELECT step, avg(rate) AS mean FROM (SELECT model, step, avg(failed) AS rate FROM s GROUP BY ALL) GROUP BY 1), c AS (SELECT model, avg(CASE WHEN failed = 0 THEN next END) AS ok, avg(CASE WHEN failed = 1 THEN next END) AS fail FROM s WHERE next IS NOT NULL GROUP BY 1)
SELECT round((SELECT mean FROM p WHERE step = 1), 6) AS step1, round((SELECT mean FROM p WHERE step = 2), 6) AS step2, round((SELECT mean FROM p WHERE step = 2) / (SELECT mean FROM p WHERE step = 1), 6) AS ratio,
  round(avg(ok), 6) AS after_ok, round(avg(fail), 6) AS after_fail, round(avg(CASE WHEN ok > 0 THEN fail / ok END), 6) AS multiplier FROM c""")
def failure_rollup(spark, sf):
    w = W.partitionBy("l_orderkey").orderBy(*_ORDER)
    failed = (F.col("l_returnflag") == "R").cast("double")
    s = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("model"), F.row_number().over(w).alias("step"), failed.alias("failed"), F.lead(failed).over(w).alias("next"))
    known = F.col("next").isNotNull()
    when = lambda c, v: F.avg(F.when(c, v))
    m = s.groupBy("model").agg(*[when(F.col("step") == k, F.col("failed")).alias(f"step{k}") for k in (1, 2)], when(known & (F.col("failed") == 0), F.col("next")).alias("ok"), when(known & (F.col("failed") == 1), F.col("next")).alias("fail"))
    g = m.agg(F.avg("step1").alias("s1"), F.avg("step2").alias("s2"), F.avg("ok").alias("ok"), F.avg("fail").alias("fail"), F.avg(F.when(F.col("ok") > 0, F.col("fail") / F.nullif(F.col("ok"), F.lit(0.0)))).alias("x"))
    ratio = F.when(F.col("s1") > 0, F.col("s2") / F.nullif(F.col("s1"), F.lit(0.0))).otherwise(F.lit(float("inf")))
    return g.select(F.round("s1", 6).alias("step1"), F.round("s2", 6).alias("step2"), F.round(ratio, 6).alias("ratio"), F.round("ok", 6).alias("after_ok"), F.round("fail", 6).alias("after_fail"), F.round("x", 6).alias("multiplier"))


@query("error_share_of_tasks", f"""WITH e AS (SELECT level, CASE WHEN done = 0 THEN 'E10_format_error' WHEN task % 97 = 0 THEN 'E6_hallucinated_tool' WHEN done < wanted THEN 'E8_partial_completion' WHEN lowest < 0.94 THEN 'E4_wrong_arguments' END AS error FROM {ev._PARTS}),
t AS (SELECT level, count(*) AS n FROM e GROUP BY 1) SELECT level, error, round(count(*) * 100.0 / max(n), 6) AS percent FROM e JOIN t USING (level) WHERE error IS NOT NULL GROUP BY ALL""")
def error_share_of_tasks(spark, sf):
    c = F.col
    e = scoring.error_type(c("done"), c("task") % 97 == 0, c("wanted"), F.lit(False), F.lit(False), c("lowest") < 0.94)
    n = ev._tasks(spark, sf).groupBy("level", e.alias("error")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("level"))  # one row for each error
    return n.withColumn("percent", F.round(F.col("n") * 100.0 / total, 6)).where("error is not null").select("level", "error", "percent")


SIZES = {"click": 8.0, "view": 70.0, "purchase": 3.0, "signup": 14.0}
"""Size of a model by name; 0 where it is not known."""

_SIZE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SIZES.items()) + " ELSE 0.0 END::DOUBLE"


def _sized(spark, sf):
    known = F.create_map(*[F.lit(x) for kv in SIZES.items() for x in kv])
    m = table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("accuracy"))
    return m.withColumn("size", F.coalesce(F.try_element_at(known, F.col("model")), F.lit(0.0)))


@query("model_sizes", f"SELECT event_type AS model, {_SIZE} AS size, round(avg(value), 6) AS accuracy FROM events GROUP BY 1, 2")
def model_sizes(spark, sf):
    return _sized(spark, sf).select("model", "size", F.round("accuracy", 6).alias("accuracy"))


@query("scaling_by_size", f"WITH m AS (SELECT event_type, {_SIZE} AS size, avg(value) AS accuracy FROM events GROUP BY 1, 2) SELECT count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(ln(size), accuracy), 6) END AS r FROM m WHERE size > 0")
def scaling_by_size(spark, sf):
    m = _sized(spark, sf).where("size > 0")
    g = m.agg(F.count(F.lit(1)).alias("n"), stats.correlation(F.ln("size"), F.col("accuracy")).alias("r"))
    return g.select("n", F.when(F.col("n") >= 3, F.round("r", 6)).alias("r"))


@query("strip_suffix", r"SELECT c_custkey, regexp_replace(c_name || CASE WHEN c_custkey % 2 = 0 THEN ' (' || c_mktsegment || ')' ELSE '' END, '\s*\([^)]*\)$', '') AS name FROM customer")
def strip_suffix(spark, sf):
    said = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" ("), "c_mktsegment", F.lit(")"))).otherwise(""))
    return table(spark, sf, "customer").select("c_custkey", F.regexp_replace(said, r"\s*\([^)]*\)$", "").alias("name"))


@query("top_pairs", """WITH t AS (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)
SELECT a.c_custkey AS a, b.c_custkey AS b FROM t a JOIN t b ON a.c_custkey < b.c_custkey""")
def top_pairs(spark, sf):
    """Comparisons whose two sides both stand among the best five."""
    t = table(spark, sf, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(5).select(F.col("c_custkey").alias("a"))
    return t.join(F.broadcast(t.withColumnRenamed("a", "b")), F.col("a") < F.col("b"))  # five rows


# task suites

_TARGETS = {"en": 25, "de": 18, "fr": 50, "es": 7}
_WANT = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _TARGETS.items()) + " END"


@query("stratified_targets", f"""WITH d AS (SELECT doc_id, lang, coalesce(source, 'unknown') AS cat, {_WANT} AS want FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')),
c AS (SELECT lang, cat, want, count(*) OVER (PARTITION BY lang) AS k, row_number() OVER (PARTITION BY lang ORDER BY cat) AS i FROM (SELECT DISTINCT lang, cat, want FROM d)),
q AS (SELECT lang, cat, greatest(1, want // k) + (i <= want - greatest(1, want // k) * k)::INT AS quota FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, cat ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS n FROM d JOIN q USING (lang, cat))
SELECT doc_id, lang FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY (n > quota)::INT, md5('42+:' || doc_id::VARCHAR), doc_id) <= want""")
def stratified_targets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return suite.stratified(d, "lang", "source", "doc_id", _TARGETS).select("doc_id", "lang")


_SUITE = {"L0": 20, "L1": 30, "L2": 15, "L3": 40}
_CANDIDATES = """SELECT 'L' || (o_orderkey % 4)::VARCHAR AS level, o_orderpriority AS pattern, o_orderkey AS task, o_orderstatus AS tools, (o_custkey % 50)::VARCHAR AS params FROM orders"""
_WANTED = "CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _SUITE.items()) + " END"


@query("suite_assembly", f"""WITH c AS ({_CANDIDATES}), u AS (SELECT level, min({{'p': pattern, 't': task, 'x': tools}}) AS s FROM c GROUP BY level, CASE WHEN level = 'L0' THEN md5(level || '|' || tools || '|' || params) ELSE task::VARCHAR END),
r AS (SELECT level, s.p AS pattern, s.t AS task, s.x AS tools, {_WANTED} AS want FROM u), k AS (SELECT level, count(DISTINCT pattern) AS k FROM r GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY level, pattern ORDER BY md5('42:' || task::VARCHAR), task) AS n FROM r JOIN k USING (level)),
f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY level ORDER BY (n > greatest(want // k, 1))::INT, md5('42+:' || task::VARCHAR), task) <= want)
SELECT level, pattern, task, array_to_string(list_slice(list_transform(list_sort(list_transform(list_filter(['F', 'O', 'P', 'X', 'Y'], lambda t: t <> tools), lambda t: md5('42:' || task::VARCHAR || ':' || t) || t)), lambda x: substr(x, 33)), 1, 3), ',') AS others FROM f""")
def suite_assembly(spark, sf):
    o = table(spark, sf, "orders")
    c = o.select(F.concat(F.lit("L"), (F.col("o_orderkey") % 4).cast("string")).alias("level"), F.col("o_orderpriority").alias("pattern"), F.col("o_orderkey").alias("task"), F.array("o_orderstatus").alias("tools"), (F.col("o_custkey") % 50).cast("string").alias("params"))
    s = suite.assemble(c, _SUITE)
    return s.select("level", "pattern", "task", F.array_join(suite.distractors(F.col("task"), F.col("tools"), ["F", "O", "P", "X", "Y"], 3), ",").alias("others"))


@query("template_fill", "SELECT n_nationkey, 'What is the weather in ' || n_name || '?' AS prompt, 'Compare {city} with {other}' AS unfilled FROM nation")
def template_fill(spark, sf):
    n = F.col("n_name")
    return table(spark, sf, "nation").select("n_nationkey", suite.filled("What is the weather in {city}?", {"city": n}).alias("prompt"), suite.filled("Compare {city} with {other}", {"city": n}).alias("unfilled"))


# reports, files, readers and sinks


@query("report_formats", """SELECT event_id, upper('Event ' || event_type) || chr(10) || repeat('=', length('Event ' || event_type)) || chr(10) || chr(10) || 'Summary:' || chr(10) || '  k: ' || k || chr(10) || chr(10) || 'Generated: 2026-02-22T12:00:00' AS text,
  '# Event ' || event_type || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || '- **k**: ' || k || chr(10) || chr(10) || '*Report generated at 2026-02-22T12:00:00*' AS markdown,
  '<h1>Event ' || event_type || '</h1>' || chr(10) || '<h2>Summary</h2>' || chr(10) || '<ul>' || chr(10) || '  <li><strong>k</strong>: ' || k || '</li>' || chr(10) || '</ul>' || chr(10) || '<p><em>Report generated at 2026-02-22T12:00:00</em></p>' AS html, 8 AS words FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""")
def report_formats(spark, sf):
    title, data = F.concat(F.lit("Event "), "event_type"), F.from_json("props", "map<string,string>")
    said = {style: io.report(title, data, style) for style in ("text", "markdown", "html")}
    return table(spark, sf, "events").select("event_id", *[c.alias(k) for k, c in said.items()], F.size(F.split(F.trim(F.regexp_replace(said["text"], r"\s+", " ")), " ")).alias("words"))


@query("write_file", """WITH w AS (SELECT '/data/' || event_type || CASE user_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.md' ELSE '.log' END AS path, props AS content, ts, event_id FROM events)
SELECT path, arg_max(content, (ts, event_id)) AS content, length(arg_max(content, (ts, event_id)))::INT AS size, CASE WHEN ends_with(path, '.json') THEN 'application/json' WHEN ends_with(path, '.md') THEN 'text/markdown' ELSE 'text/plain' END AS type, count(*) > 1 AS overwrote_existing FROM w GROUP BY path""")
def write_file(spark, sf):
    end = F.when(F.col("user_id") % 3 == 0, ".json").when(F.col("user_id") % 3 == 1, ".md").otherwise(".log")
    log = table(spark, sf, "events").select(F.concat(F.lit("/data/"), "event_type", end).alias("path"), F.col("props").alias("content"), F.struct("ts", "event_id").alias("at"))
    return io.written(log, "at")


@query("leaderboard_csv", """SELECT event_type AS model, round(avg(value), 4) AS overall, round(avg(CASE WHEN user_id % 4 = 0 THEN value END), 4) AS l0, round(avg(CASE WHEN user_id % 4 = 0 THEN value END) - avg(CASE WHEN user_id % 4 = 3 THEN value END), 4) AS gap FROM events GROUP BY 1""")
def leaderboard_csv(spark, sf):
    """Written by gap as one CSV file, and read back."""
    at = lambda k: F.avg(F.when(F.col("user_id") % 4 == k, F.col("value")))
    m = table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.round(F.avg("value"), 4).alias("overall"), F.round(at(0), 4).alias("l0"), F.round(at(0) - at(3), 4).alias("gap"))
    path = io.scratch(spark, "leaderboard")
    io.write_csv(m.orderBy("gap", "model"), path)
    return io.csv(spark, path, "model string, overall double, l0 double, gap double")


_BOARD = {"model": "string", "provider": "string"} | {c: "double" for c in ("overall_accuracy", "composition_gap", "L0_accuracy", "L1_accuracy", "L2_accuracy", "L3_accuracy", "gap_L1", "gap_L2", "gap_L3", "tool_selection", "argument_accuracy")} | {"total_tokens": "long", "avg_latency_ms": "double"}


@query("leaderboard_file", """WITH s AS (SELECT event_type AS model, 'site' || (length(event_type) % 2)::VARCHAR AS provider, user_id % 4 AS k, value / 100 AS v, user_id FROM events),
m AS (SELECT model, any_value(provider) AS provider, avg(v) AS overall, avg(v) FILTER (k = 0) AS l0, avg(v) FILTER (k = 1) AS l1, avg(v) FILTER (k = 2) AS l2, avg(v) FILTER (k = 3) AS l3, avg((v >= 0.5)::INT) AS sel, avg(v) FILTER (v >= 0.5) AS args, sum(user_id)::BIGINT AS tokens, avg(v * 1000) AS latency FROM s GROUP BY 1)
SELECT model, provider, round(overall, 4) AS overall_accuracy, round(0.3 * (l0 - l1) + 0.3 * (l0 - l2) + 0.4 * (l0 - l3), 4) AS composition_gap, round(l0, 4) AS "L0_accuracy", round(l1, 4) AS "L1_accuracy", round(l2, 4) AS "L2_accuracy", round(l3, 4) AS "L3_accuracy",
  round(l0 - l1, 4) AS "gap_L1", round(l0 - l2, 4) AS "gap_L2", round(l0 - l3, 4) AS "gap_L3", round(sel, 4) AS tool_selection, round(args, 4) AS argument_accuracy, tokens AS total_tokens, round(latency, 1) AS avg_latency_ms FROM m""")
def leaderboard_file(spark, sf):
    """All fifteen columns of a leaderboard, written by rising gap as one CSV file with a header, and read back."""
    v, k = F.col("value") / 100, F.col("user_id") % 4
    at = lambda n: F.avg(F.when(k == n, v)).alias(f"l{n}")
    site = F.concat(F.lit("site"), (F.length("event_type") % 2).cast("string"))
    m = table(spark, sf, "events").groupBy(F.col("event_type").alias("model"), site.alias("provider")).agg(F.avg(v).alias("overall"), *map(at, range(4)), F.avg((v >= 0.5).cast("double")).alias("sel"), F.avg(F.when(v >= 0.5, v)).alias("args"), F.sum("user_id").alias("total_tokens"), F.avg(v * 1000).alias("latency"))
    gap = lambda n: F.col("l0") - F.col(f"l{n}")
    four = {"overall_accuracy": F.col("overall"), "composition_gap": 0.3 * gap(1) + 0.3 * gap(2) + 0.4 * gap(3)} | {f"L{n}_accuracy": F.col(f"l{n}") for n in range(4)} | {f"gap_L{n}": gap(n) for n in (1, 2, 3)} | {"tool_selection": F.col("sel"), "argument_accuracy": F.col("args")}
    m = m.select("model", "provider", *[F.round(c, 4).alias(n) for n, c in four.items()], "total_tokens", F.round("latency", 1).alias("avg_latency_ms"))
    path = io.scratch(spark, "leaderboard")
    io.write_csv(m.orderBy("composition_gap", "model"), path)
    return io.csv(spark, path, ", ".join(f"{n} {t}" for n, t in _BOARD.items()))


@query("task_export", """WITH l AS (SELECT l_orderkey, list({'n': l_linenumber, 'f': l_returnflag, 'q': l_quantity} ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, l_linestatus, l_quantity, l_discount) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey::VARCHAR AS task_id, 'L' || (l_orderkey % 4)::VARCHAR AS level, len(s)::INT AS num_steps, len(list_distinct(list_transform(s, lambda x: x.f)))::INT AS num_tools_offered, array_to_string(list_transform(s, lambda x: x.f), ' -> ') AS tools,
  s[1].q AS first_quantity, 's' || (len(s) - 1)::VARCHAR AS source, len(s)::INT AS answer, 'orders' AS category, '' AS pattern FROM l""")
def task_export(spark, sf):
    """Tasks with all ten columns, as Parquet with zstd under a given schema, and read back: the nested parts from their JSON."""
    t = ev.order_tasks(spark, sf)
    n = F.size("steps")
    t = t.select(F.col("task").alias("task_id"), "level", F.concat(F.lit("Fill order "), F.col("task").cast("string")).alias("prompt"), F.array_distinct(F.transform("steps", lambda s: s["tool"])).alias("available_tools"), "steps",
                 F.concat(F.lit("s"), (n - 1).cast("string")).alias("answer_from"), F.to_json(F.struct(n.alias("lines"))).alias("answer"), F.lit("orders").alias("category"), F.lit(None).cast("string").alias("pattern"))
    path = io.scratch(spark, "export")
    io.write_parquet(io.flat_tasks(t), path)
    r = spark.read.schema(io.EXPORT).parquet(path)
    steps = F.from_json("expected_trace", "struct<steps:array<struct<tool_name:string,arguments:struct<q:double>>>,final_answer_source:string>")
    r = r.withColumn("trace", steps)
    return r.select("task_id", "level", "num_steps", "num_tools_offered", F.array_join(F.transform("trace.steps", lambda s: s["tool_name"]), " -> ").alias("tools"), F.get("trace.steps", F.lit(0))["arguments"]["q"].alias("first_quantity"),
                    F.col("trace.final_answer_source").alias("source"), F.get_json_object("expected_final_answer", "$.lines").cast("int").alias("answer"), "category", "pattern")


@query("results_scan", """WITH e AS (SELECT 'user ' || user_id::VARCHAR AS model, 'site' || (user_id % 3)::VARCHAR AS provider, 'L' || (event_id % 4)::VARCHAR AS level, value / 100 AS overall, event_type, user_id, event_id, value FROM events)
SELECT provider, level, count(*) AS n_tasks, count(DISTINCT model) AS models, round(avg(overall), 6) AS accuracy, count(*) FILTER (event_type = 'error') AS errors, sum(user_id + event_id % 100)::BIGINT AS tokens, round(avg(value), 4) AS latency FROM e GROUP BY 1, 2""")
def results_scan(spark, sf):
    """Nested results documents, one for each user as the model, written and read as a row for each task, then summed by level."""
    c = F.col
    e = table(spark, sf, "events").select("user_id", F.struct(c("event_id").cast("string").alias("task_id"), F.struct(F.concat(F.lit("L"), (c("event_id") % 4).cast("string")).alias("level"), (c("value") / 100).alias("overall"), F.when(c("event_type") == "error", "E1_wrong_tool").alias("error_type")).alias("score"),
                                          F.struct(c("user_id").alias("input"), (c("event_id") % 100).alias("output")).alias("tokens"), c("value").alias("latency_ms")).alias("r"))
    m = e.groupBy("user_id").agg(F.collect_list("r").alias("task_results"))  # a user's tasks
    key = F.concat(F.lit("user "), c("user_id").cast("string"))
    model = F.struct(key.alias("name"), F.concat(F.lit("site"), (c("user_id") % 3).cast("string")).alias("provider"))
    path = io.scratch(spark, "results")
    io.write_json(m.select(F.create_map(key, F.struct(model.alias("model"), c("task_results"))).alias("models")), path)
    r = io.results(spark, path, lines=True)
    return r.groupBy("provider", "level").agg(F.count(F.lit(1)).alias("n_tasks"), F.count_distinct("model").alias("models"), F.round(F.avg("overall"), 6).alias("accuracy"), F.count("error_type").alias("errors"), F.sum(c("input") + c("output")).alias("tokens"), F.round(F.avg("latency_ms"), 4).alias("latency"))


@query("run_folders", """WITH s AS (SELECT 'm' || (doc_id % 5)::VARCHAR AS model, doc_id, quality FROM labels), n AS (SELECT model, count(*) AS n, count(*) FILTER (model <> 'm3' AND (doc_id % 3 = 0 OR model <> 'm2')) AS a FROM s GROUP BY 1),
f AS (SELECT model, CASE WHEN a >= min(n) OVER () THEN 'first' ELSE 'second' END AS folder FROM n)
SELECT s.model, any_value(folder) AS folder, count(*) AS tasks, round(avg(CASE folder WHEN 'first' THEN quality ELSE 1 - quality END), 6) AS overall FROM s JOIN f ON s.model = f.model GROUP BY 1""")
def run_folders(spark, sf):
    """Two folders of runs, written and read by the data source: each model from the first that holds it whole. In the first
    m3 is missing and m2 lacks two thirds of its tasks."""
    runs.register(spark)
    s = table(spark, sf, "labels").select(F.concat(F.lit("m"), (F.col("doc_id") % 5).cast("string")).alias("model"), F.col("doc_id").cast("string").alias("task_id"), F.lit("L0").alias("level"), F.col("quality").cast("double").alias("overall"), F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("folder"), "doc_id")
    least = s.groupBy("model").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    base = io.scratch(spark, "runs").removeprefix("file://")
    first = s.where((F.col("model") != "m3") & ((F.col("model") != "m2") | (F.col("doc_id") % 3 == 0))).drop("doc_id")
    first.write.format("runs").option("path", f"{base}/first").mode("append").save()
    s.drop("doc_id").withColumn("overall", 1 - F.col("overall")).write.format("runs").option("path", f"{base}/second").mode("append").save()
    r = spark.read.format("runs").options(folders=json.dumps([f"{base}/first", f"{base}/second"]), least=least).load()
    g = r.groupBy("model").agg(F.max("folder").alias("folder"), F.count(F.lit(1)).alias("tasks"), F.round(F.avg("overall"), 6).alias("overall"))
    return g.withColumn("folder", F.element_at(F.split("folder", "/"), -1))


@query("latex_document", r"""WITH m AS (SELECT source, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1), t AS (SELECT *, abs(quality - max(quality) OVER ()) < 1e-4 AS q, abs(toxic - min(toxic) OVER ()) < 1e-4 AS x, row_number() OVER (ORDER BY source) AS i FROM m),
b AS (SELECT i + 100 AS place, source || ' & ' || CASE WHEN q THEN '\textbf{' || printf('%.1f', round(quality * 100, 1)) || '\%}' ELSE printf('%.1f', round(quality * 100, 1)) || '\%' END || ' & ' || CASE WHEN x THEN '\textbf{' || printf('%.1f', round(toxic * 100, 1)) || '\%}' ELSE printf('%.1f', round(toxic * 100, 1)) || '\%' END || ' \\' AS line FROM t)
SELECT line FROM b UNION ALL SELECT unnest(['\begin{table}[t]', '\centering', '\caption{Sources}', '\label{tab:sources}', '\begin{tabular}{lcc}', '\toprule', 'Source & Quality & Toxic \\', '\midrule', '\bottomrule', '\end{tabular}', '\end{table}']) AS line""")
def latex_document(spark, sf):
    """A whole table: its frame and header, a row for each source, the best value of each column in bold."""
    m = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.round(F.avg("quality"), 4).alias("quality"), F.round(F.avg("toxic"), 4).alias("toxic"))
    return io.latex_document(m, ["source"], {"quality": True, "toxic": False}, "Sources", "tab:sources", {"source": "Source", "quality": "Quality", "toxic": "Toxic"}).select("line")


@query("markdown_document", """WITH m AS (SELECT lang, source, count(*) AS n, avg(n_chars) AS chars FROM documents GROUP BY ALL), b AS (SELECT '| ' || coalesce(lang, '—') || ' | ' || source || ' | ' || n::VARCHAR || ' | ' || printf('%.4f', chars) || ' |' AS line, row_number() OVER (ORDER BY lang, source) + 1 AS place FROM m)
SELECT place, line FROM b UNION ALL SELECT 0, '| lang | source | n | chars |' UNION ALL SELECT 1, '| --- | --- | --- | --- |'""")
def markdown_document(spark, sf):
    m = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("chars"))
    return io.markdown_document(m, ["lang", "source"])


@query("transform_table", """WITH n AS (SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS k, list(n_name ORDER BY n_nationkey) AS s FROM nation GROUP BY 1), r AS (SELECT n_regionkey, list_zip(k, s) AS z FROM n)
SELECT n_regionkey, 'n_nationkey,n_name' || chr(13) || chr(10) || array_to_string(list_transform(z, lambda x: x[1]::VARCHAR || ',"' || x[2] || ', ' || repeat('"', 2) || 'x' || repeat('"', 3) || chr(13) || chr(10)), '') AS as_csv,
  array_to_string(list_transform(z, lambda x: 'n_nationkey: ' || x[1]::VARCHAR || ', n_name: ' || x[2] || ', "x"'), chr(10)) AS as_text, len(z)::INT AS rows FROM r""")
def transform_table(spark, sf):
    """A region's nations as a JSON list, turned into CSV, and that into text and back into JSON."""
    one = F.struct("n_nationkey", F.concat("n_name", F.lit(', "x"')).alias("n_name"))
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("data"))  # a region's nations
    n = n.withColumn("as_csv", io.transform_format("data", F.lit("json"), F.lit("csv")))
    n = n.withColumn("as_text", io.transform_format("as_csv", F.lit("csv"), F.lit("text"))).withColumn("again", io.transform_format("as_csv", F.lit("csv"), F.lit("json")))
    return n.select("n_regionkey", "as_csv", "as_text", F.json_array_length("again").alias("rows"))


@query("latex_table", r"""WITH m AS (SELECT source, count(*) AS n, round(avg(n_chars), 1) AS chars FROM documents GROUP BY 1) SELECT source || ' & ' || CASE WHEN n = max(n) OVER () THEN '\textbf{' || n::VARCHAR || '}' ELSE n::VARCHAR END || ' & ' || CASE WHEN chars = max(chars) OVER () THEN '\textbf{' || printf('%.1f', chars) || '}' ELSE printf('%.1f', chars) END || ' \\' AS line FROM m""")
def latex_table(spark, sf):
    m = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 1).alias("chars"))
    return io.latex(m, ["n", "chars"], 1)


@query("json_round_trip", "SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def json_round_trip(spark, sf):
    """JSON lines written, and read back by a strict schema."""
    path = io.scratch(spark, "turns")
    io.write_json(table(spark, sf, "conversations").select("conv_id", "text"), path)
    back = spark.read.option("mode", "FAILFAST").schema("conv_id long, text string").json(path)
    return back.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))


@query("quoted_csv", "SELECT n_nationkey, n_name, 'a -> b, \"c\"' AS sequence FROM nation")
def quoted_csv(spark, sf):
    path = io.scratch(spark, "sheet")
    sequence = F.array_join(F.array(F.lit("a"), F.lit('b, "c"')), " -> ")
    io.write_csv(table(spark, sf, "nation").select("n_nationkey", "n_name", sequence.alias("sequence")), path, quote_all=True)
    return io.csv(spark, path, "n_nationkey long, n_name string, sequence string")


@query("suite_scan", "SELECT 'task_' || n_nationkey::VARCHAR AS task_id, 'L' || (n_nationkey % 4)::VARCHAR AS level, n_name AS prompt, CASE WHEN n_nationkey % 5 = 0 THEN 'no tools' END AS fault FROM nation")
def suite_scan(spark, sf):
    """A task suite written as one document, read with its keys checked, and its tasks' faults."""
    n = table(spark, sf, "nation")
    tools = F.when(F.col("n_nationkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("get_weather")))
    task = F.struct(F.concat(F.lit("task_"), F.col("n_nationkey").cast("string")).alias("task_id"), F.concat(F.lit("L"), (F.col("n_nationkey") % 4).cast("string")).alias("level"), F.col("n_name").alias("prompt"), tools.alias("available_tools"), F.lit(1).alias("num_steps"))
    path = io.scratch(spark, "suite")
    io.write_json(n.agg(F.collect_list(task).alias("tasks")).select(F.lit("suite").alias("name"), F.lit("1").alias("version"), F.struct(F.size("tasks").alias("n")).alias("stats"), "tasks"), path)  # one row for each nation
    t = io.suite(spark, path)
    return t.join(io.violations(t), "task_id", "left").select("task_id", "level", "prompt", "fault")


@query("correlation", """SELECT l_returnflag, r, CASE WHEN abs(r) >= 0.9 THEN 'very strong' WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' WHEN abs(r) >= 0.3 THEN 'weak' ELSE 'negligible' END AS strength,
  CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'none' END AS direction FROM (SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1)""")
def correlation(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(stats.correlation(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("r"))
    return g.select("l_returnflag", "r", numeric.strength(F.col("r")).alias("strength"), F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative").otherwise("none").alias("direction"))


@query("transcribe_lookup", "WITH t(k, said, seconds, segments, words) AS (VALUES " + ", ".join(f"('{k}', '{t.replace(chr(39), chr(39) * 2)}', {s}, {len(g)}, {len(t.split())})" for k, (t, s, g) in fixed.TRANSCRIPTS.items()) + """), p AS (SELECT n_nationkey, 'audio/' || CASE n_nationkey % 4 WHEN 0 THEN 'Meeting' WHEN 1 THEN 'lecture' WHEN 2 THEN 'voicemail' ELSE 'memo' END || '_' || n_name || '.mp3' AS source FROM nation)
SELECT n_nationkey, said, seconds, segments, words FROM p LEFT JOIN t ON contains(lower(source), k) WHERE k IS NOT NULL""")
def transcribe_lookup(spark, sf):
    k = F.col("n_nationkey") % 4
    name = F.when(k == 0, "Meeting").when(k == 1, "lecture").when(k == 2, "voicemail").otherwise("memo")
    heard = io.transcribed(F.concat(F.lit("audio/"), name, F.lit("_"), "n_name", F.lit(".mp3")))
    return table(spark, sf, "nation").select("n_nationkey", heard.alias("h")).where("h.known").select("n_nationkey", F.col("h.text").alias("said"), F.col("h.seconds").cast("int").alias("seconds"), F.size("h.segments").alias("segments"), F.size(F.split("h.text", " ")).alias("words"))


@query("memory_details", """WITH l AS (SELECT user_id::VARCHAR AS key, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1)
SELECT w.key, CASE WHEN l.key IS NULL THEN 'not_found' ELSE 'found' END AS status, l.value, CASE WHEN l.key IS NOT NULL THEN 'float' END AS type FROM (VALUES ('1'), ('7'), ('nobody')) w(key) LEFT JOIN l USING (key)""")
def memory_details(spark, sf):
    from quern.operators import state

    log = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.struct("ts", "event_id").alias("at"), "value")
    asked = spark.createDataFrame([("1",), ("7",), ("nobody",)], "key string")
    found = state.latest(log.join(F.broadcast(asked), "key", "left_semi"), "key", "at").select("key", "value", F.lit(True).alias("hit"))
    return asked.join(found, "key", "left").select("key", F.when(F.col("hit"), "found").otherwise("not_found").alias("status"), "value", F.when(F.col("hit"), "float").alias("type"))
