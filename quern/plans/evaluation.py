"""Scoring, statistics, composition, state and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.catalog import query, table
from quern.functions import numeric, sql, text, web
from quern.operators import compose, nested, scoring, state, stats
from quern.sources import io
from quern.streaming import memory

# matching and scores

_NEAR = "FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_partkey = a.p_partkey + 25"
_NAMES = "a.p_partkey, a.p_name AS x, b.p_name AS y"


def _near(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_name").alias("x"), "p_retailprice")
    b = p.select((F.col("p_partkey") - 25).alias("p_partkey"), "p_brand", F.col("x").alias("y"), F.col("p_retailprice").alias("other"))
    return p.join(b, ["p_partkey", "p_brand"])


_SIM = "CASE WHEN x = y THEN 1.0 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END"


@query("edit_distance", f"SELECT p_partkey, levenshtein(x, y)::INT AS distance, round({_SIM}, 6) AS similarity FROM (SELECT {_NAMES} {_NEAR})")
def edit_distance(spark, sf):
    return _near(spark, sf).select("p_partkey", F.levenshtein("x", "y").alias("distance"), F.round(scoring.similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("fuzzy_match", f"SELECT p_partkey, lower(trim(x)) = lower(trim(y)) AS exact, round(CASE WHEN lower(x) = lower(y) THEN 1.0 WHEN s >= 0.85 THEN s ELSE 0.0 END, 6) AS score FROM (SELECT *, {_SIM.replace('x', 'lower(x)').replace('y)', 'lower(y))').replace('= y', '= lower(y)').replace('malower(x)', 'max')} AS s FROM (SELECT {_NAMES} {_NEAR}))".replace("grealower(y)", "greatest"))
def fuzzy_match(spark, sf):
    x, y = F.col("x"), F.col("y")
    return _near(spark, sf).select("p_partkey", scoring.match_exact(x, y).alias("exact"), F.round(scoring.match_string(x, y), 6).alias("score"))


@query("numeric_tolerance", f"SELECT p_partkey, CASE WHEN u = v OR CASE WHEN u = 0 THEN abs(v) < 0.05 ELSE abs(u - v) <= 0.05 * greatest(abs(u), abs(v)) END THEN 1.0 ELSE 0.0 END AS score FROM (SELECT a.p_partkey, a.p_retailprice AS u, b.p_retailprice AS v {_NEAR})")
def numeric_tolerance(spark, sf):
    return _near(spark, sf).select("p_partkey", scoring.match_numeric(F.col("p_retailprice"), F.col("other"), 0.05).alias("score"))


@query("argument_match", "SELECT event_id, round(((event_type = 'click')::INT + (user_id % 2 = 0)::INT) / (2 + (user_id % 3 = 0)::INT), 6) AS score FROM events")
def argument_match(spark, sf):
    wanted = F.create_map(F.lit("type"), F.lit("click"), F.lit("even"), F.lit("yes"))
    got = F.map_concat(F.create_map(F.lit("type"), F.col("event_type"), F.lit("even"), F.when(F.col("user_id") % 2 == 0, "Yes").otherwise("no way")), F.when(F.col("user_id") % 3 == 0, F.create_map(F.lit("extra"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>")))
    return table(spark, sf, "events").select("event_id", F.round(scoring.match_arguments(wanted, got), 6).alias("score"))


@query("json_match", """SELECT event_id, round(((json_extract(props, '$.k')::DOUBLE = 7)::INT + (event_type = 'click')::INT + ((user_id % 5 = 3)::INT + (value > 50)::INT) / 2 + ((user_id % 2 = 1)::INT + 1) / 2 * 2 / 3) / 4, 9) AS score FROM events""")
def json_match(spark, sf):
    """What a call was given, beside what it should have been: numbers, texts, an object and lists of unequal length."""
    wanted = F.lit('{"k": 7, "type": "Click ", "who": {"id": "3", "ok": true}, "list": [1, 2.0]}')
    made = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("type"), F.struct((F.col("user_id") % 5).cast("string").alias("id"), (F.col("value") > 50).alias("ok")).alias("who"), F.array(F.col("user_id") % 2, F.lit(2), F.lit(3)).alias("list")))
    e = table(spark, sf, "events").select("event_id", wanted.alias("wanted"), made.alias("made"))
    return nested.match(e, "wanted", "made").select("event_id", F.round("score", 9).alias("score"))


_FIRST = "(l_linenumber, l_partkey, l_suppkey, l_shipdate)"
_SCORED = f"""SELECT l_orderkey AS task, 'L' || (l_orderkey % 4)::VARCHAR AS level, count(*) AS wanted, count_if(l_returnflag <> 'R') AS done, avg(CASE WHEN l_returnflag <> 'R' THEN 1 - l_discount END) AS args,
  min(CASE WHEN l_returnflag <> 'R' THEN 1 - l_discount END) AS lowest, 1 - avg(l_tax) AS seq, arg_min(l_returnflag <> 'R', {_FIRST}) AS first FROM lineitem GROUP BY 1"""


def _tasks(spark, sf):
    ok = F.col("l_returnflag") != "R"
    given = F.when(ok, 1 - F.col("l_discount"))
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(F.count(F.lit(1)).alias("wanted"), F.count_if(ok).alias("done"), F.avg(given).alias("args"), F.min(given).alias("lowest"), (1 - F.avg("l_tax")).alias("seq"), F.min_by(ok, F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")).alias("first"))
    return g.withColumn("level", F.concat(F.lit("L"), (F.col("task") % 4).cast("string"))).withColumn("args", F.coalesce("args", F.lit(0.0))).withColumn("complete", F.col("done") / F.col("wanted"))


_PARTS = f"(SELECT *, coalesce(args, 0) AS a, done / wanted AS c FROM ({_SCORED}))"
_OVERALL = "CASE level WHEN 'L0' THEN CASE WHEN first AND a >= 0.85 THEN 1.0 ELSE 0.0 END WHEN 'L1' THEN 0.40 * seq + 0.35 * a + 0.25 * c WHEN 'L2' THEN 0.35 * seq + 0.35 * a + 0.30 * c ELSE 0.30 * seq + 0.30 * a + 0.15 * c + 0.25 * (1 - (wanted - done) / wanted) END"


@query("level_weighted_score", f"SELECT task, level, round({_OVERALL}, 9) AS overall FROM {_PARTS}")
def level_weighted_score(spark, sf):
    c = F.col
    return _tasks(spark, sf).select("task", "level", F.round(scoring.overall(c("level"), c("first"), c("seq"), c("args"), c("complete"), c("complete")), 9).alias("overall"))


@query("error_taxonomy", f"""SELECT error, count(*) AS n FROM (SELECT *, done + CASE WHEN task % 5 = 0 THEN 3 ELSE 0 END AS calls FROM {_PARTS}),
LATERAL (SELECT CASE WHEN calls = 0 THEN 'E10_format_error' WHEN task % 97 = 0 THEN 'E6_hallucinated_tool' WHEN calls < wanted THEN 'E8_partial_completion' WHEN seq < 0.97 THEN 'E3_wrong_order'
  WHEN lowest < 0.94 THEN 'E4_wrong_arguments' WHEN calls > wanted THEN 'E7_unnecessary_tool' ELSE 'none' END AS error) GROUP BY error""")
def error_taxonomy(spark, sf):
    c = F.col
    calls = c("done") + F.when(c("task") % 5 == 0, 3).otherwise(0)
    e = scoring.error_type(calls, c("task") % 97 == 0, c("wanted"), F.lit(False), c("seq") < 0.97, c("lowest") < 0.94)
    return _tasks(spark, sf).groupBy(F.coalesce(e, F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def order_tasks(spark, sf):
    """Each order as a task: its lines are the steps, each waiting for the line before it, and the calls are its filled
    lines by part, some with another quantity."""
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_discount"))).alias("s"))
    said = lambda q: F.concat(F.lit('{"q": '), q.cast("string"), F.lit("}"))
    name = lambda i: F.concat(F.lit("s"), i.cast("string"))
    steps = F.transform("s", lambda x, i: F.struct(name(i).alias("id"), x["l_returnflag"].alias("tool"), said(x["l_quantity"]).alias("arguments"), F.when(i > 0, F.array(name(i - 1))).otherwise(F.array().cast("array<string>")).alias("depends_on")))
    made = F.array_sort(F.transform(F.filter("s", lambda x: (x["l_linestatus"] == "F") | (x["l_discount"] > 0.02)), lambda x: F.struct(x["l_partkey"].alias("p"), x["l_returnflag"].alias("tool"), said(F.when(x["l_discount"] > 0.08, x["l_quantity"] + 1).otherwise(x["l_quantity"])).alias("arguments"))))
    calls = F.transform(made, lambda x: F.struct(x["tool"].alias("tool"), x["arguments"].alias("arguments")))
    return s.select("task", F.concat(F.lit("L"), (F.col("task") % 4).cast("string")).alias("level"), steps.alias("steps"), calls.alias("calls"))


@query("score_task")
def score_task(spark, sf):
    t = scoring.score(order_tasks(spark, sf))
    return t.select("task", "level", *[F.round(c, 9).alias(c) for c in ("sequence", "arguments", "complete", "flow", "overall")], "error")


@query("data_flow_score", """WITH s AS (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY ALL)
SELECT a.l_orderkey AS task, round(avg((a.ok AND b.ok)::INT), 6) AS flow FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber - 1 GROUP BY 1""")
def data_flow_score(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(F.col("l_returnflag") != "R").alias("ok"))
    t = s.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), "ok")).alias("s"))  # an order's steps
    matched = F.transform(F.filter("s", lambda x: x["ok"]), lambda x: x["n"])
    all_n = F.transform("s", lambda x: x["n"])
    dependent = F.filter("s", lambda x: F.array_contains(all_n, x["n"] - 1))
    good = F.filter(dependent, lambda x: x["ok"] & F.array_contains(matched, x["n"] - 1))
    return t.where(F.size(dependent) > 0).select(F.col("l_orderkey").alias("task"), F.round(F.size(good) / F.size(dependent), 6).alias("flow"))


@query("sequence_score", """WITH t AS (SELECT l_orderkey AS task, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag) AS f FROM lineitem GROUP BY 1), p AS (SELECT task, f, unnest(range(len(f) + 1)) AS p FROM t), q AS (SELECT *, unnest(range(p, len(f) + 1)) AS q FROM p)
SELECT task, round(max(len(list_filter(f[1:p], lambda x: x = 'A')) + len(list_filter(f[p + 1:q], lambda x: x = 'N')) + len(list_filter(f[q + 1:], lambda x: x = 'R'))) / any_value(len(f)), 6) AS score FROM q GROUP BY task""")
def sequence_score(spark, sf):
    steps = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag"))).alias("s"))
    flags = F.transform("s", lambda x: x["l_returnflag"])
    wanted = F.array_sort(flags)
    return steps.select(F.col("l_orderkey").alias("task"), F.round(scoring.lcs(wanted, flags) / F.size(flags), 6).alias("score"))


@query("greedy_assignment", """WITH RECURSIVE t AS (SELECT l_orderkey, list(l_discount ORDER BY l_linenumber, l_partkey, l_discount) AS d FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey, d, 0 AS i, []::INT[] AS chosen FROM t UNION ALL
  SELECT l_orderkey, d, i + 1, list_append(chosen, list_sort(list_transform(list_filter(range(len(d)), lambda j: NOT list_contains(chosen, j::INT)), lambda j: {'v': -(1 - abs(d[i + 1] - d[len(d) - j] / 2)), 'c': j::INT}))[1].c) FROM r WHERE i < len(d))
SELECT l_orderkey, chosen FROM r WHERE i = len(d)""")
def greedy_assignment(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_discount"))).alias("s"))
    n = F.size("s")
    places = lambda: F.sequence(F.lit(0), n - 1)
    # every step would like a call that is close to it in discount, and several like the same
    near = lambda i, j: 1 - F.abs(F.get(F.col("s"), i)["l_discount"] - F.get(F.col("s"), n - 1 - j)["l_discount"] / 2)
    pairs = F.flatten(F.transform(places(), lambda i: F.transform(places(), lambda j: F.struct(i.alias("s"), j.alias("c"), near(i, j).alias("v")))))
    return s.select("l_orderkey", scoring.assign(n, pairs).alias("chosen"))


_ANSWER = """CASE event_id % 4 WHEN 0 THEN '{"tool": "' || event_type || '", "args": ' || props || '}' WHEN 1 THEN 'Two calls: ```json [{"name": "' || event_type || '", "arguments": ' || props || '}, {"function": "log"}] ``` done'
  WHEN 2 THEN 'first {"name": "' || event_type || '", "arguments": {"k": "x"}} then {"tool": }' ELSE 'nothing to call' END"""


@query("parse_calls", """WITH e AS (SELECT event_id, event_type, event_id % 4 AS m, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, 0 AS call_index, event_type AS tool, CASE WHEN m = 2 THEN 'x' ELSE k END AS k, NULL::VARCHAR AS fault FROM e WHERE m < 3 UNION ALL SELECT event_id, 1, 'log', NULL, NULL FROM e WHERE m = 1
UNION ALL SELECT event_id, NULL, NULL, NULL, CASE WHEN m = 2 THEN 'not_json' ELSE 'no_call' END FROM e WHERE m > 1""")
def parse_calls(spark, sf):
    """Answers read by a table function, in SQL: their calls, an argument of each, and the faults of what should be a call."""
    sql.register(spark)
    e = table(spark, sf, "events").select("event_id", F.expr(_ANSWER).alias("answer"))
    return spark.sql("SELECT event_id, t.call_index, t.tool, t.k, t.fault FROM {e}, LATERAL parse_calls(answer, 'k') t", e=e)


@query("sql_functions", """SELECT l_orderkey, count(*) AS n, round(avg(CASE WHEN l_quantity = round(l_quantity * 1.00005, 6) OR abs(l_quantity - l_quantity * 1.00005) <= 1e-4 * (l_quantity * 1.00005) THEN 1.0 ELSE 0.0 END), 6) AS near,
  round(sum(greatest(5, least(l_quantity, 20))), 4) AS clamped, count_if(isodow(l_shipdate) < 6)::BIGINT AS workdays FROM lineitem GROUP BY 1""")
def sql_functions(spark, sf):
    """The library's functions by their SQL names."""
    sql.register(spark)
    return spark.sql("""SELECT l_orderkey, count(*) AS n, round(avg(match_numeric(l_quantity, l_quantity * 1.00005D)), 6) AS near, round(sum(clamp_value(l_quantity, 5D, 20D)), 4) AS clamped,
      count_if(is_business_day(cast(l_shipdate AS date))) AS workdays FROM {lines} GROUP BY l_orderkey""", lines=table(spark, sf, "lineitem"))


@query("tool_call_parser", "SELECT event_id, event_type AS tool, replace(props, ' ', '') AS arguments FROM events")
def tool_call_parser(spark, sf):
    said = F.concat(F.lit('```json\n{"name": "'), F.col("event_type"), F.lit('", "args": '), F.col("props"), F.lit("}\n```"))
    return table(spark, sf, "events").select("event_id", F.explode(scoring.calls(said)).alias("c")).select("event_id", "c.tool", "c.arguments")


@query("bottleneck_gap", """WITH l0 AS (SELECT event_type AS tool, avg((value >= 50)::INT) AS rate FROM events WHERE user_id % 4 = 0 AND event_type <> 'view' GROUP BY 1),
t AS (SELECT user_id, 'L' || (user_id % 4)::VARCHAR AS level, event_type AS tool, avg(value) / 100 AS score FROM events WHERE user_id % 4 <> 0 GROUP BY ALL),
m AS (SELECT user_id, level, min(coalesce(rate, 0.0)) AS low, avg(score) AS score FROM t LEFT JOIN l0 USING (tool) GROUP BY ALL)
SELECT round(avg(CASE WHEN level = 'L1' THEN low - score END), 6) AS gap_l1, round(avg(CASE WHEN level = 'L2' THEN low - score END), 6) AS gap_l2, round(avg(CASE WHEN level = 'L3' THEN low - score END), 6) AS gap_l3,
  round(0.30 * coalesce(avg(CASE WHEN level = 'L1' THEN low - score END), 0) + 0.30 * coalesce(avg(CASE WHEN level = 'L2' THEN low - score END), 0) + 0.40 * coalesce(avg(CASE WHEN level = 'L3' THEN low - score END), 0), 6) AS gap FROM m""")
def bottleneck_gap(spark, sf):
    e = table(spark, sf, "events")
    l0 = e.where("user_id % 4 = 0 and event_type <> 'view'").groupBy("event_type").agg(F.avg((F.col("value") >= 50).cast("double")).alias("rate"))
    t = e.where("user_id % 4 <> 0").groupBy("user_id", "event_type").agg((F.avg("value") / 100).alias("score"))
    m = t.join(l0, "event_type", "left").groupBy("user_id").agg(F.min(F.coalesce("rate", F.lit(0.0))).alias("low"), F.avg("score").alias("score"))
    gap = lambda k: F.avg(F.when(F.col("user_id") % 4 == k, F.col("low") - F.col("score")))
    g = m.agg(*[gap(k).alias(f"g{k}") for k in (1, 2, 3)])
    whole = 0.30 * F.coalesce("g1", F.lit(0.0)) + 0.30 * F.coalesce("g2", F.lit(0.0)) + 0.40 * F.coalesce("g3", F.lit(0.0))
    return g.select(*[F.round(f"g{k}", 6).alias(f"gap_l{k}") for k in (1, 2, 3)], F.round(whole, 6).alias("gap"))


@query("gap_definitions", """WITH m AS (SELECT event_type, avg(CASE WHEN user_id % 4 = 0 THEN value END) AS l0, avg(CASE WHEN user_id % 4 = 1 THEN value END) AS l1, avg(CASE WHEN user_id % 4 = 2 THEN value END) AS l2, avg(CASE WHEN user_id % 4 = 3 THEN value END) AS l3 FROM events GROUP BY 1)
SELECT event_type, round(l0 - l3, 6) AS delta, round((l1 + l2 + l3) / 3 - l0, 6) AS selection_gap, round(l0 - (l1 + l2 + l3) / 3, 6) AS leaderboard_gap, l0 < least(l1, l2, l3) AS strict_gap, round(l0 - l1, 6) AS gap_l1, round(l0 - l2, 6) AS gap_l2 FROM m""")
def gap_definitions(spark, sf):
    at = lambda k: F.avg(F.when(F.col("user_id") % 4 == k, F.col("value"))).alias(f"l{k}")
    m = table(spark, sf, "events").groupBy("event_type").agg(*[at(k) for k in range(4)])
    l0, l1, l2, l3 = (F.col(f"l{k}") for k in range(4))
    mean = (l1 + l2 + l3) / 3
    return m.select("event_type", F.round(l0 - l3, 6).alias("delta"), F.round(mean - l0, 6).alias("selection_gap"), F.round(l0 - mean, 6).alias("leaderboard_gap"), (l0 < F.least(l1, l2, l3)).alias("strict_gap"), F.round(l0 - l1, 6).alias("gap_l1"), F.round(l0 - l2, 6).alias("gap_l2"))


# sequence, arguments, completeness, data flow of L1, L2 and L3, and the score that counts as a pass
# The weight configurations that are compared.
CONFIGS = (
    ("default", ((0.40, 0.35, 0.25, 0.0), (0.35, 0.35, 0.15, 0.15), (0.30, 0.30, 0.15, 0.25)), None),
    ("uniform", ((1 / 3, 1 / 3, 1 / 3, 0.0), (0.25,) * 4, (0.25,) * 4), None),
    ("sequence", ((0.60, 0.20, 0.20, 0.0), (0.50, 0.20, 0.15, 0.15), (0.50, 0.20, 0.15, 0.15)), None),
    ("arguments", ((0.20, 0.60, 0.20, 0.0), (0.15, 0.55, 0.15, 0.15), (0.15, 0.55, 0.15, 0.15)), None),
    ("completeness", ((0.20, 0.20, 0.60, 0.0), (0.15, 0.15, 0.55, 0.15), (0.15, 0.15, 0.55, 0.15)), None),
    ("data flow", ((0.25, 0.25, 0.50, 0.0), (0.15, 0.15, 0.15, 0.55), (0.15, 0.15, 0.15, 0.55)), None),
    ("pass at 0.50", ((0.40, 0.35, 0.25, 0.0), (0.35, 0.35, 0.15, 0.15), (0.30, 0.30, 0.15, 0.25)), 0.50),
    ("pass at 0.70", ((0.40, 0.35, 0.25, 0.0), (0.35, 0.35, 0.15, 0.15), (0.30, 0.30, 0.15, 0.25)), 0.70),
)


def rescored(t):
    """(config, model, level, score): each task's score under each configuration; a model is a task's key modulo 7."""
    c = F.col
    base = scoring.overall(c("level"), c("first"), c("seq"), c("args"), c("complete"), c("complete"))

    def under(weights, least):
        s = F.when(c("level") == "L0", base)
        for name, (x, a, z, f) in zip(("L1", "L2", "L3"), weights):
            s = s.when(c("level") == name, x * c("seq") + a * c("args") + (z + f) * c("complete"))
        return s if least is None else F.when(c("level") == "L0", base).otherwise(F.when(s >= least, 1.0).otherwise(0.0))

    each = F.array(*[F.struct(F.lit(n).alias("config"), under(w, least).alias("score")) for n, w, least in CONFIGS])
    return t.select((c("task") % 7).alias("model"), "level", F.explode(each).alias("x")).select("model", "level", "x.config", "x.score")


def _config_sql() -> str:
    def score(weights, least):
        body = " ".join(f"WHEN '{name}' THEN {x!r} * seq + {a!r} * a + {z + f!r} * c" for name, (x, a, z, f) in zip(("L1", "L2", "L3"), weights))
        graded = f"CASE level {body} END"
        return f"CASE WHEN level = 'L0' THEN (first AND a >= 0.85)::INT::DOUBLE ELSE {graded if least is None else f'({graded} >= {least})::INT::DOUBLE'} END"

    return " UNION ALL ".join(f"SELECT '{n}' AS config, task % 7 AS model, level, {score(w, least)} AS score FROM {_PARTS}" for n, w, least in CONFIGS)


@query("weight_ablation", f"""SELECT config, model, round(avg(score), 6) AS overall, round(avg(CASE WHEN level = 'L0' THEN score END), 6) AS l0, round(avg(CASE WHEN level = 'L1' THEN score END), 6) AS l1,
  round(avg(CASE WHEN level = 'L2' THEN score END), 6) AS l2, round(avg(CASE WHEN level = 'L3' THEN score END), 6) AS l3, coalesce(avg(CASE WHEN level = 'L0' THEN score END), 0) < least(coalesce(avg(CASE WHEN level = 'L1' THEN score END), 0),
  coalesce(avg(CASE WHEN level = 'L2' THEN score END), 0), coalesce(avg(CASE WHEN level = 'L3' THEN score END), 0)) AS gap FROM ({_config_sql()}) GROUP BY ALL""")
def weight_ablation(spark, sf):
    at = lambda k: F.avg(F.when(F.col("level") == f"L{k}", F.col("score")))
    m = rescored(_tasks(spark, sf)).groupBy("config", "model").agg(F.round(F.avg("score"), 6).alias("overall"), *[at(k).alias(f"l{k}") for k in range(4)])
    l0, *rest = (F.coalesce(f"l{k}", F.lit(0.0)) for k in range(4))
    return m.select("config", "model", "overall", *[F.round(f"l{k}", 6).alias(f"l{k}") for k in range(4)], (l0 < F.least(*rest)).alias("gap"))


@query("ablation_spearman", f"""WITH m AS (SELECT config, model, round(avg(score), 9) AS s FROM ({_config_sql()}) GROUP BY ALL),
r AS (SELECT config, model, rank() OVER (PARTITION BY config ORDER BY s) + (count(*) OVER (PARTITION BY config, s) - 1) / 2 AS r FROM m)
SELECT b.config, count(*) AS n, round(corr(a.r, b.r), 6) AS rho FROM r a JOIN r b ON a.model = b.model WHERE a.config = 'default' AND b.config <> 'default' GROUP BY 1""")
def ablation_spearman(spark, sf):
    m = rescored(_tasks(spark, sf)).groupBy("config", "model").agg(F.round(F.avg("score"), 9).alias("s"))
    r = m.select("config", "model", stats.average_rank("s", ["config"]).cast("double").alias("r"))  # one row for each model
    base = r.where("config = 'default'").select("model", F.col("r").alias("base"))
    g = r.where("config <> 'default'").join(base, "model").groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.round(stats.correlation(F.col("base"), F.col("r")), 6).alias("rho"))
    return g


# statistics



def boot_sql(keys: str, of: str, value: str, order: str, reps: int) -> str:
    copies = " + ".join(f"(u >= {t})::INT" for t in stats.THRESHOLDS)
    return f"""draws AS (SELECT {keys}, {value} AS v, blk * 8 + dig AS r, ('0x' || substr(md5(concat_ws('|', {order}, blk)), (4 * dig + 1)::INT, 4))::INT AS u FROM {of}, range(0, {-(-reps // 8)}) t(blk), range(0, 8) s(dig) WHERE blk * 8 + dig < {reps}),
m AS (SELECT {keys}, r, sum(v * w) / sum(w) AS mean FROM (SELECT *, {copies} AS w FROM draws WHERE v IS NOT NULL) GROUP BY {keys}, r HAVING sum(w) > 0)"""


PAIRED = "(avg(x) - avg(y)) / sqrt((var_samp(x) + var_samp(y)) / 2)"
"""Cohen's d of paired scores."""


@query("bootstrap_interval", f"""WITH {boot_sql('toxic', 'labels', 'quality', 'doc_id', 200)}
SELECT toxic, (SELECT round(avg(quality), 6) FROM labels l WHERE l.toxic = m.toxic) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m GROUP BY toxic""")
def bootstrap_interval(spark, sf):
    return stats.bootstrap(table(spark, sf, "labels").select("doc_id", "toxic", F.col("quality").cast("double").alias("quality")), ["toxic"], "quality", ["doc_id"])


@query("bootstrap_gap", f"""WITH {boot_sql('event_type', "(SELECT * FROM events WHERE event_id % 7 = 0 OR true)", 'value', 'event_id', 40)}
SELECT b.event_type, round(quantile_cont(a.mean - b.mean, 0.025), 6) AS low, round(quantile_cont(a.mean - b.mean, 0.975), 6) AS high FROM m a JOIN m b ON a.r = b.r WHERE a.event_type = 'click' AND b.event_type <> 'click' GROUP BY 1""")
def bootstrap_gap(spark, sf):
    m = stats.resampled(table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value", ["event_id"], 40)
    base = m.where("event_type = 'click'").select("replicate", F.col("mean").alias("base"))
    d = m.where("event_type <> 'click'").join(base, "replicate").withColumn("gap", F.col("base") - F.col("mean"))
    return d.groupBy("event_type").agg(F.round(F.percentile("gap", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("gap", F.lit(0.975)), 6).alias("high"))


@query("paired_bootstrap", f"""WITH p AS (SELECT 1 AS one, user_id, avg(CASE WHEN event_type = 'click' THEN value END) AS x, avg(CASE WHEN event_type = 'view' THEN value END) AS y FROM events GROUP BY 2 HAVING x - y IS NOT NULL), {boot_sql('one', 'p', 'x - y', 'user_id', 200)},
o AS (SELECT avg(x - y) AS o, count(*) AS n, {PAIRED} AS d FROM p)
SELECT n, round(o, 6) AS diff, (SELECT round(avg((abs(mean - o) >= abs(o))::INT), 6) FROM m) AS p_value, round(d, 4) AS effect_size FROM o""")
def paired_bootstrap(spark, sf):
    pick = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    p = table(spark, sf, "events").groupBy("user_id").agg(pick("click").alias("x"), pick("view").alias("y"))
    return stats.paired(p.withColumn("one", F.lit(1)), ["one"], "x", "y", ["user_id"]).drop("one")


_MOMENTS = "SELECT event_type, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM events GROUP BY 1"


@query("cohens_d", f"""WITH s AS ({_MOMENTS}), p AS (SELECT a.event_type AS a, b.event_type AS b, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS d FROM s a JOIN s b ON a.event_type < b.event_type)
SELECT a, b, round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM p""")
def cohens_d(spark, sf):
    s = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("value").alias("n"))
    a, b = (s.select(*[F.col(c).alias(f"{c}{i}") for c in s.columns]) for i in (1, 2))
    c = F.col
    p = a.join(b, c("event_type1") < c("event_type2"))  # one row for each type
    d = stats.cohens_d(c("m1"), c("m2"), c("v1"), c("v2"), c("n1"), c("n2"))
    return p.select(c("event_type1").alias("a"), c("event_type2").alias("b"), F.round(d, 6).alias("d"), stats.effect(d).alias("effect"))


@query("cohens_kappa", "SELECT count(*) AS n, round(avg((quality = 1 - toxic)::INT), 6) AS agreement, round((avg((quality = 1 - toxic)::INT) - (avg(quality) * avg(1 - toxic) + avg(1 - quality) * avg(toxic))) / (1 - (avg(quality) * avg(1 - toxic) + avg(1 - quality) * avg(toxic))), 6) AS kappa FROM labels")
def cohens_kappa(spark, sf):
    return stats.kappa(table(spark, sf, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")), "a", "b")


@query("spearman_rank", """WITH m AS (SELECT source, avg(n_chars) AS x, max(n_chars) AS y FROM documents GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b FROM m) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def spearman_rank(spark, sf):
    m = table(spark, sf, "documents").groupBy("source").agg(F.avg("n_chars").alias("x"), F.max("n_chars").alias("y"))
    r = m.select(stats.average_rank("x").alias("a"), stats.average_rank("y").alias("b"))  # one row for each source
    return r.agg(F.count(F.lit(1)).alias("n"), F.round(stats.correlation(F.col("a").cast("double"), F.col("b").cast("double")), 6).alias("rho"))


_BY_USER = "SELECT user_id, event_type AS model, avg(value) AS score FROM events GROUP BY ALL"


def pairwise(spark, sf):
    """(a, b, user_id, x, y): paired scores of every two models. A user's list has a place for each model, few in number."""
    s = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("model")).agg(F.avg("value").alias("score"))
    u = s.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("model", "score"))).alias("s"))
    two = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y["model"] > x["model"]), lambda y: F.struct(x["model"].alias("a"), y["model"].alias("b"), x["score"].alias("x"), y["score"].alias("y")))))
    return u.select("user_id", F.explode(two).alias("p")).select("user_id", "p.a", "p.b", "p.x", "p.y")


@query("pairwise_bonferroni", f"""WITH s AS ({_BY_USER}), p AS (SELECT l.model AS a, r.model AS b, l.user_id, l.score AS x, r.score AS y FROM s l JOIN s r ON l.user_id = r.user_id AND l.model < r.model), {boot_sql('a, b', 'p', 'x - y', 'user_id', 96)},
o AS (SELECT a, b, count(*) AS n, avg(x - y) AS diff, round({PAIRED}, 4) AS d FROM p GROUP BY ALL), t AS (SELECT m.a, m.b, round(avg((abs(mean - diff) >= abs(diff))::INT), 6) AS p_value FROM m JOIN o ON m.a = o.a AND m.b = o.b GROUP BY ALL)
SELECT o.a, o.b, n, round(diff, 6) AS diff, p_value, d AS effect_size, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect,
  round(0.05 / count(*) OVER (), 8) AS alpha, p_value < 0.05 / count(*) OVER () AS significant FROM o JOIN t ON o.a = t.a AND o.b = t.b""")
def pairwise_bonferroni(spark, sf):
    p = stats.paired(pairwise(spark, sf), ["a", "b"], "x", "y", ["user_id"], 96)
    alpha = 0.05 / F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))  # one row for each pair of models
    return p.withColumn("effect", stats.effect(F.col("effect_size"))).withColumn("alpha", F.round(alpha, 8)).withColumn("significant", F.col("p_value") < alpha)


# tables of the analysis


@query("model_intervals", f"""WITH e AS (SELECT event_type AS model, unnest(['L' || (user_id % 4)::VARCHAR, 'overall']) AS level, event_id, value FROM events), {boot_sql('model, level', 'e', 'value', 'event_id', 64)}
SELECT m.model, m.level, (SELECT round(avg(value), 6) FROM e WHERE e.model = m.model AND e.level = m.level) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high,
  (SELECT count(*) FROM e WHERE e.model = m.model AND e.level = m.level) AS n FROM m GROUP BY ALL""")
def model_intervals(spark, sf):
    levels = F.explode(F.array(F.concat(F.lit("L"), (F.col("user_id") % 4).cast("string")), F.lit("overall"))).alias("level")
    e = table(spark, sf, "events").select(F.col("event_type").alias("model"), levels, "event_id", "value")
    return stats.bootstrap(e, ["model", "level"], "value", ["event_id"], 64).join(e.groupBy("model", "level").agg(F.count(F.lit(1)).alias("n")), ["model", "level"])


@query("category_accuracy", f"""WITH s AS (SELECT source AS model, coalesce(lang, 'unknown') AS category, doc_id, quality::DOUBLE AS v FROM documents JOIN labels USING (doc_id)), {boot_sql('model, category', 's', 'v', 'doc_id', 64)},
g AS (SELECT model, category, count(*) AS n, avg(v) AS mean FROM s GROUP BY ALL), o AS (SELECT model, avg(v) AS overall FROM s GROUP BY 1), b AS (SELECT model, category, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM m GROUP BY ALL)
SELECT g.model, g.category, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(mean - overall, 6) AS gap FROM g JOIN o ON o.model = g.model JOIN b ON b.model = g.model AND b.category = g.category""")
def category_accuracy(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("model"), F.coalesce("lang", F.lit("unknown")).alias("category"))
    s = d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("v")), "doc_id")
    g = s.groupBy("model", "category").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.sum("v").alias("s"))
    w = W.partitionBy("model")  # one row for each category
    gap = g.select("model", "category", "n", F.round(F.col("m") - F.sum("s").over(w) / F.sum("n").over(w), 6).alias("gap"))
    return gap.join(stats.bootstrap(s, ["model", "category"], "v", ["doc_id"], 64), ["model", "category"])


@query("paired_conditions", f"""WITH s AS ({_BY_USER}), p AS (SELECT a.model AS condition, a.user_id, b.score AS x, a.score AS y FROM s a JOIN s b ON a.user_id = b.user_id AND b.model = 'view' WHERE a.model IN ('click', 'purchase')), {boot_sql('condition', 'p', 'x - y', 'user_id', 200)},
o AS (SELECT condition, count(*) AS n, avg(x - y) AS diff, {PAIRED} AS d FROM p GROUP BY ALL), t AS (SELECT m.condition, round(avg((abs(mean - diff) >= abs(diff))::INT), 6) AS p_value FROM m JOIN o ON m.condition = o.condition GROUP BY ALL)
SELECT 'view vs ' || o.condition AS comparison, n, round(diff, 6) AS diff, p_value, round(d, 4) AS effect_size, p_value < 0.05 AS significant_at_005, p_value < 0.01 AS significant_at_001 FROM o JOIN t ON o.condition = t.condition""")
def paired_conditions(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("condition")).agg(F.avg("value").alias("y"))
    base = s.where("condition = 'view'").select("user_id", F.col("y").alias("x"))
    t = stats.paired(s.where(F.col("condition").isin("click", "purchase")).join(base, "user_id"), ["condition"], "x", "y", ["user_id"])
    return t.select(F.concat(F.lit("view vs "), "condition").alias("comparison"), "n", "diff", "p_value", "effect_size", (F.col("p_value") < 0.05).alias("significant_at_005"), (F.col("p_value") < 0.01).alias("significant_at_001"))


@query("proportion_interval", f"""WITH e AS (SELECT event_type, event_id, (value >= 50)::INT::DOUBLE AS v FROM events), {boot_sql('event_type', 'e', 'v', 'event_id', 64)}
SELECT event_type, (SELECT round(avg(v), 6) FROM e WHERE e.event_type = m.event_type) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m GROUP BY 1""")
def proportion_interval(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", (F.col("value") >= 50).cast("double").alias("v"))
    return stats.bootstrap(e, ["event_type"], "v", ["event_id"], 64)


@query("correlation_test")
def correlation_test(spark, sf):
    """Pearson and Spearman with their p-values over documents' length and quality, by source."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    g = d.groupBy("source").agg(F.avg("n_chars").alias("x"), F.avg("quality").alias("y"))
    r = g.select("x", "y", stats.average_rank("x").cast("double").alias("rx"), stats.average_rank("y").cast("double").alias("ry"))  # one row for each source
    c = F.col
    t = r.agg(F.count(F.lit(1)).cast("double").alias("n"), stats.correlation(c("x"), c("y")).alias("pearson"), stats.correlation(c("rx"), c("ry")).alias("spearman"))
    return t.select("n", F.round("pearson", 6).alias("pearson"), F.round(stats.correlation_p("pearson", "n"), 6).alias("pearson_p"), F.round("spearman", 6).alias("spearman"), F.round(stats.correlation_p("spearman", "n"), 6).alias("spearman_p"))


@query("random_baseline", "SELECT round(avg(1.0 / n), 6) AS random FROM (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1)")
def random_baseline(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("n"))
    return g.agg(F.round(F.avg(1 / F.col("n")), 6).alias("random"))


@query("oracle_baseline", "SELECT event_type, round(1.0 / count(DISTINCT user_id), 8) AS chance FROM events GROUP BY 1")
def oracle_baseline(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))
    return g.select("event_type", F.round(1 / F.col("n"), 8).alias("chance"))


# composition


@query("chain_extract_statistics", r"""SELECT doc_id, round(avg(v), 4) AS mean, count(v) AS n FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: length(x))) AS v FROM documents) GROUP BY doc_id""")
def chain_extract_statistics(spark, sf):
    steps = [
        compose.Step("found", lambda t: text.found(t, "[0-9]+"), ["text"]),
        compose.Step("sizes", lambda f: F.transform(f, lambda x: F.length(x).cast("double")), ["found"]),
        compose.Step("summary", lambda s: numeric.array_summary(s), ["sizes"]),
    ]
    d = compose.run(table(spark, sf, "documents").select("doc_id", "text"), steps).where(F.size("found") > 0)
    return d.select("doc_id", "summary.mean", F.col("summary.n").cast("long").alias("n"))


@query("chain_weekday_format", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 30 DAY, '%A') AS day FROM orders")
def chain_weekday_format(spark, sf):
    steps = [compose.Step("later", lambda d: F.date_add(d, 30), ["o_orderdate"]), compose.Step("day", lambda d: F.date_format(d, "EEEE"), ["later"])]
    return compose.run(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), steps).select("o_orderkey", "day")


@query("fanout_hash", "SELECT doc_id, md5(text) = md5(lower(text)) AS same, substr(md5(text), 1, 8) AS md5, substr(sha256(text), 1, 8) AS sha FROM documents")
def fanout_hash(spark, sf):
    steps = [compose.Step("m", lambda t: web.digest(t, "md5"), ["text"]), compose.Step("s", lambda t: web.digest(t, "sha256"), ["text"]), compose.Step("same", lambda m, t: m == web.digest(F.lower(t), "md5"), ["m", "text"])]
    return compose.run(table(spark, sf, "documents").select("doc_id", "text"), steps).select("doc_id", "same", F.substring("m", 1, 8).alias("md5"), F.substring("s", 1, 8).alias("sha"))


@query("fanout_argmax", "SELECT n_regionkey, arg_max(n_name, (c, n_name)) AS best, max(c) AS customers FROM (SELECT n_regionkey, n_name, count(c_custkey) AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY 1")
def fanout_argmax(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("c"))
    n = table(spark, sf, "nation").join(c, "n_nationkey", "left").fillna({"c": 0})
    return n.groupBy("n_regionkey").agg(F.max_by("n_name", F.struct("c", "n_name")).alias("best"), F.max("c").alias("customers"))


@query("dag_fork_join", r"""SELECT doc_id, w * 2 + u AS score, w, u FROM (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::INT AS w, len(regexp_extract_all(text, '[A-Z]'))::INT AS u FROM documents)""")
def dag_fork_join(spark, sf):
    steps = [
        compose.Step("score", lambda w, u: w * 2 + u, ["w", "u"]),
        compose.Step("w", lambda t: F.size(text.words(t)), ["text"]),
        compose.Step("u", lambda t: F.regexp_count(t, F.lit("[A-Z]")), ["text"]),
    ]
    return compose.run(table(spark, sf, "documents").select("doc_id", "text"), steps).select("doc_id", "score", "w", "u")


_SAID, _READ = (rf"list_distinct(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'))" for c in ("said", "text"))


@query("dag_two_scans", f"""WITH c AS (SELECT conv_id AS doc_id, count(*) AS turns, max(text) AS said FROM conversations GROUP BY 1), j AS (SELECT doc_id, length(text)::INT AS chars, turns, {_READ} AS x, {_SAID} AS y FROM documents JOIN c USING (doc_id))
SELECT doc_id, chars, turns, CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 4) END AS similarity FROM j""")
def dag_two_scans(spark, sf):
    """Two scans, each with a step of its own, meet in a third: how alike a document and a turn of the conversation are."""
    d = compose.run(table(spark, sf, "documents").select("doc_id", "text"), [compose.Step("chars", F.length, ["text"])])
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("turns"), F.max("text").alias("said"))
    both = compose.run(d.join(c, "doc_id"), [compose.Step("similarity", lambda a, b: F.round(text.overlap(a, b), 4), ["text", "said"])])
    return both.select("doc_id", "chars", "turns", "similarity")


@query("dag_left_join", "SELECT doc_id, length(d.text)::INT AS a, n AS b, d.doc_id % 2 = 0 AS even FROM documents d LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) ON conv_id = doc_id")
def dag_left_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.length("text").alias("a"), (F.col("doc_id") % 2 == 0).alias("even"))
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("b"))
    return compose.join("doc_id", d, c)


@query("chain_filter_statistics", "SELECT count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM (SELECT c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 100)")
def chain_filter_statistics(spark, sf):
    top = table(spark, sf, "customer").where("c_acctbal > 0").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(100)
    return top.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("parallel_steps", "SELECT l_orderkey AS task, max(n) > 1 AS parallel FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def parallel_steps(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.array(F.col("l_linenumber").cast("string")).alias("depends_on"))
    return compose.level(s).select(F.col("task_id").alias("task"), "parallel")


# state

_LATEST = "SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS value, count(*) AS versions FROM events GROUP BY 1"


def _log(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("value"), F.array("event_type", F.when(F.col("value") > 50, "high").otherwise("low")).alias("tags"))


@query("store_memory", "SELECT user_id::VARCHAR AS key, arg_max(event_type, (ts, event_id)) AS value, count(*) AS versions, count(*) > 1 AS overwrote FROM events GROUP BY 1")
def store_memory(spark, sf):
    return state.latest(_log(spark, sf), "key", "at").select("key", "value", "versions", (F.col("versions") > 1).alias("overwrote"))


@query("retrieve_memory", "SELECT user_id::VARCHAR AS key, arg_max(event_type, (ts, event_id)) AS value FROM events WHERE user_id = 7 GROUP BY 1")
def retrieve_memory(spark, sf):
    return state.retrieve(_log(spark, sf), "key", "at", "7").select("key", "value")


@query("list_memories", "SELECT user_id::VARCHAR AS key FROM events GROUP BY 1 HAVING arg_max(value, (ts, event_id)) > 50")
def list_memories(spark, sf):
    return state.tagged(_log(spark, sf), "key", "at", "high").select("key")


@query("get_session_context", "WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1) SELECT (SELECT count(*) FROM l) AS keys, array_to_string(list_sort(list(DISTINCT x)), ',') AS tags FROM (SELECT t AS x FROM l UNION ALL SELECT CASE WHEN v > 50 THEN 'high' ELSE 'low' END FROM l)")
def get_session_context(spark, sf):
    return state.context(_log(spark, sf), "key", "at")


@query("memory_stream", """WITH l AS (SELECT user_id::VARCHAR AS key, arg_max(event_type, (ts, event_id)) AS value, arg_max(value, (ts, event_id)) > 50 AS high, count(*) AS versions FROM events GROUP BY 1)
SELECT key, value, versions, versions > 1 AS overwrote, high FROM l""")
def memory_stream(spark, sf):
    """The store as a stream leaves it: events replayed through keyed state, and the changes it wrote."""
    at = io.scratch(spark, "memory")
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")  # a pattern, for the table may be one file
    writes = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.array(F.when(F.col("value") > 50, "high").otherwise("low")).alias("tags"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, memory.PROVIDER)
    try:
        memory.keep(memory.remember(writes), f"{at}/out", f"{at}/log").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return memory.current(spark, f"{at}/out").select("key", "value", "versions", "overwrote", F.array_contains("tags", "high").alias("high"))


# extensions of the batch forms


@query("tumbling_counts", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_windows(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
