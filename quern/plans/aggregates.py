"""Grouped aggregates, grouping sets, windows and failure tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.catalog import query, table
from quern.operators import ordered, stats
from quern.operators import relational as rel

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def _agg(name, expression, sql):
    @query(name, f"SELECT l_returnflag, l_linestatus, {sql} AS value FROM lineitem GROUP BY ALL")
    def run(spark, sf):
        return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(expression().alias("value"))


_agg("aggregate_sum", lambda: F.round(F.sum("l_quantity"), 4), "round(sum(l_quantity), 4)")
_agg("aggregate_average", lambda: F.round(F.avg("l_extendedprice"), 4), "round(avg(l_extendedprice), 4)")
_agg("aggregate_count", lambda: F.count(F.lit(1)), "count(*)")
_agg("aggregate_min", lambda: F.min("l_extendedprice"), "min(l_extendedprice)")
_agg("aggregate_max", lambda: F.max("l_extendedprice"), "max(l_extendedprice)")
_agg("aggregate_count_distinct", lambda: F.count_distinct("l_partkey"), "count(DISTINCT l_partkey)")
_agg("min_max_range", lambda: F.round(F.max("l_extendedprice") - F.min("l_extendedprice"), 6), "round(max(l_extendedprice) - min(l_extendedprice), 6)")


@query("statistical_summary", """SELECT l_shipmode_like AS grp, count(*) AS n, round(avg(l_quantity), 4) AS mean, round(median(l_quantity), 4) AS median, round(stddev_samp(l_quantity), 4) AS stdev,
  min(l_quantity) AS low, max(l_quantity) AS high, round(sum(l_quantity), 4) AS total FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_like FROM lineitem) GROUP BY 1""")
def statistical_summary(spark, sf):
    q = F.col("l_quantity")
    lines = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("grp"), q)
    g = lines.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(q), 4).alias("mean"), F.round(F.stddev_samp(q), 4).alias("stdev"), F.min(q).alias("low"), F.max(q).alias("high"), F.round(F.sum(q), 4).alias("total"))
    middle = ordered.quantiles(lines, ["grp"], "l_quantity", [0.5])
    return g.join(middle, "grp").select("grp", "n", "mean", F.round("quantile", 4).alias("median"), "stdev", "low", "high", "total")


@query("quartiles", """WITH g AS (SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75, 0.99]) AS q FROM lineitem GROUP BY 1, 2), a AS (SELECT unnest([0.25, 0.5, 0.75, 0.99]::DOUBLE[]) AS share, unnest([1, 2, 3, 4]) AS i)
SELECT l_returnflag, l_linestatus, share, round(q[i], 4) AS quantile FROM g, a""")
def quartiles(spark, sf):
    q = ordered.quantiles(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.25, 0.5, 0.75, 0.99])
    return q.select("l_returnflag", "l_linestatus", F.col("at").alias("share"), F.round("quantile", 4).alias("quantile"))


@query("standard_deviation", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(var_samp(value), 6) AS variance FROM events GROUP BY event_type")
def standard_deviation(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.var_samp("value"), 6).alias("variance"))


@query("pass_rate", "SELECT o_orderpriority, round(avg(CASE WHEN o_totalprice >= 0.85 * 200000 THEN 1 ELSE 0 END), 6) AS pass_rate, sum((o_orderstatus = 'F')::INT)::BIGINT AS n_f FROM orders GROUP BY 1")
def pass_rate(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(F.avg((F.col("o_totalprice") >= 0.85 * 200000).cast("double")), 6).alias("pass_rate"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"))


@query("grouping_sets_quality", """SELECT source, lang, count(*) AS n, round(100 * avg(quality), 4) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (source), (lang))""")
def grouping_sets_quality(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang").join(table(spark, sf, "labels"), "doc_id")
    return d.groupingSets([[], ["source"], ["lang"]], "source", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg("quality"), 4).alias("quality"))


@query("rollup_overall", "SELECT coalesce(event_type, 'overall') AS model, CASE WHEN grouping(bucket) = 1 THEN 'overall' ELSE bucket END AS level, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT *, 'L' || (user_id % 4)::VARCHAR AS bucket FROM events) GROUP BY ROLLUP (event_type, bucket)")
def rollup_overall(spark, sf):
    e = table(spark, sf, "events").withColumn("bucket", F.concat(F.lit("L"), (F.col("user_id") % 4).cast("string")))
    r = e.rollup("event_type", "bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.grouping("bucket").alias("g"))
    return r.select(F.coalesce("event_type", F.lit("overall")).alias("model"), F.when(F.col("g") == 1, "overall").otherwise(F.col("bucket")).alias("level"), "n", "mean")


@query("segment_averages", "SELECT CASE WHEN grouping(seg) = 1 THEN 'all' ELSE seg END AS segment, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM (SELECT c_mktsegment AS seg, c_acctbal FROM customer) GROUP BY GROUPING SETS ((seg), ())")
def segment_averages(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("seg"), "c_acctbal").groupingSets([["seg"], []], "seg").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"), F.grouping("seg").alias("g"))
    return c.select(F.when(F.col("g") == 1, "all").otherwise(F.col("seg")).alias("segment"), "n", "mean")


@query("pivot_errors", """SELECT user_id % 10 AS grp, coalesce(sum(CASE WHEN event_type = 'click' THEN 1 END), 0)::BIGINT AS click, coalesce(sum(CASE WHEN event_type = 'view' THEN 1 END), 0)::BIGINT AS "view", coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 END), 0)::BIGINT AS purchase FROM events GROUP BY 1""")
def pivot_errors(spark, sf):
    return rel.pivot_sum(table(spark, sf, "events").withColumn("grp", F.col("user_id") % 10), ["grp"], "event_type", ["click", "view", "purchase"], F.lit(1))


@query("pivot_mean_variance", """WITH m AS (SELECT source, lang, avg(n_chars) AS a FROM documents GROUP BY ALL)
SELECT lang, round(var_samp(a), 4) AS variance, round(max(a) - min(a), 6) AS range FROM m GROUP BY lang""")
def pivot_mean_variance(spark, sf):
    m = table(spark, sf, "documents").groupBy("source", "lang").agg(F.avg("n_chars").alias("a"))
    return m.groupBy("lang").agg(F.round(F.var_samp("a"), 4).alias("variance"), F.round(F.max("a") - F.min("a"), 6).alias("range"))


@query("argmax_group", "SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS worst FROM orders GROUP BY 1")
def argmax_group(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("worst"))


@query("error_histogram", "SELECT list_sort(list(event_type || '=' || n::VARCHAR)) AS histogram FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def error_histogram(spark, sf):
    n = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.array_sort(F.collect_list(F.concat("event_type", F.lit("="), F.col("n").cast("string")))).alias("histogram"))


@query("composed_rate", "SELECT source, round(sum(toxic) / count_if(lang <> 'en'), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING count_if(lang <> 'en') > 0")
def composed_rate(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang").join(table(spark, sf, "labels"), "doc_id")
    g = d.groupBy("source").agg(F.sum("toxic").alias("t"), F.count_if(F.col("lang") != "en").alias("n")).where("n > 0")
    return g.select("source", F.round(F.col("t") / F.col("n"), 6).alias("rate"))


@query("totals", "SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars, count(DISTINCT source) AS sources, round(avg(n_chars), 6) AS mean, min(n_chars) AS low, max(n_chars) AS high FROM documents")
def totals(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"), F.round(F.avg("n_chars"), 6).alias("mean"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))


@query("argument_domains", "SELECT k AS arg, count(DISTINCT v) AS size, round(1.0 / count(DISTINCT v), 6) AS chance FROM (SELECT 'event_type' AS k, event_type AS v FROM events UNION ALL SELECT 'k', json_extract_string(props, '$.k') FROM events) GROUP BY k")
def argument_domains(spark, sf):
    e = table(spark, sf, "events").select(F.explode(F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))).alias("arg", "v"))
    g = e.groupBy("arg").agg(F.count_distinct("v").alias("size"))
    return g.select("arg", "size", F.round(1 / F.col("size"), 6).alias("chance"))


@query("create_invoice", "SELECT l_orderkey, round(sum(coalesce(l_quantity, 1) * coalesce(l_extendedprice, 0)), 2) AS total, count(*) AS items_count FROM lineitem GROUP BY 1")
def create_invoice(spark, sf):
    amount = F.coalesce("l_quantity", F.lit(1.0)) * F.coalesce("l_extendedprice", F.lit(0.0))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(amount), 2).alias("total"), F.count(F.lit(1)).alias("items_count"))


@query("linear_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def linear_regression(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


@query("percentile_of_value", "SELECT o_orderpriority, round(100 * avg(CASE WHEN o_totalprice <= 100000 THEN 1.0 ELSE 0.0 END), 4) AS rank FROM orders GROUP BY 1")
def percentile_of_value(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(100 * F.avg(F.when(F.col("o_totalprice") <= 100000, 1.0).otherwise(0.0)), 4).alias("rank"))


# windows


@query("moving_average", """SELECT event_id, round(avg(value) OVER w, 4) AS sma FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING) QUALIFY count(value) OVER w = 5""")
def moving_average(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, sf, "events").select("event_id", F.round(F.avg("value").over(w), 4).alias("sma"), F.count("value").over(w).alias("n")).where("n = 5").drop("n")


@query("normalize_data", "SELECT event_id, CASE WHEN max(value) OVER w = min(value) OVER w THEN 0.0 ELSE round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) END AS scaled FROM events WINDOW w AS (PARTITION BY event_type)")
def normalize_data(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    # minimum and maximum are aggregated before they are joined back: no task sorts a whole type
    bounds = rel.small(e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    spread = F.col("hi") - F.col("lo")
    return e.join(bounds, "event_type").select("event_id", F.when(spread == 0, 0.0).otherwise(F.round((F.col("value") - F.col("lo")) / F.when(spread != 0, spread), 6)).alias("scaled"))


@query("percent_rank_window", "SELECT p_partkey, round(100 * cume_dist() OVER (PARTITION BY p_brand ORDER BY p_retailprice), 4) AS pct FROM part")
def percent_rank_window(spark, sf):
    p = ordered.ranked(table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], "p_retailprice")
    return p.select("p_partkey", F.round(100 * F.col("share"), 4).alias("pct"))


@query("order_of_events", "SELECT event_id, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS place FROM events")
def order_of_events(spark, sf):
    return ordered.numbered(table(spark, sf, "events").select("event_id", "value"), [F.col("value").desc_nulls_last(), "event_id"]).select("event_id", "place")


@query("ranks_of_events", """SELECT event_id, rank() OVER w AS rank, rank() OVER w + (count(*) OVER (PARTITION BY value) - 1) / 2 AS average_rank, round(100 * cume_dist() OVER w, 4) AS pct FROM events WHERE value IS NOT NULL WINDOW w AS (ORDER BY value)""")
def ranks_of_events(spark, sf):
    e = ordered.ranked(table(spark, sf, "events").select("event_id", "value"), [], "value")
    return e.select("event_id", "rank", "average_rank", F.round(100 * F.col("share"), 4).alias("pct"))


@query("spearman_of_orders", """WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS a, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2 AS b
  FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def spearman_of_orders(spark, sf):
    return ordered.spearman(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), [], "o_totalprice", "o_custkey").select("n", F.round("rho", 6).alias("rho"))


@query("series_of_events", """SELECT event_id, CASE WHEN count(value) OVER w = 20 THEN round(avg(value) OVER w, 4) END AS sma, lead(event_type) OVER (ORDER BY ts, event_id) AS next, round(value - lag(value, 7) OVER (ORDER BY ts, event_id), 6) AS change
  FROM events WINDOW w AS (ORDER BY ts, event_id ROWS 19 PRECEDING)""")
def series_of_events(spark, sf):
    """All events as one series in time: a moving average of full windows, the next type, and the change from seven before."""
    made = {"mean": F.avg("value"), "n": F.count("value"), "next": F.lead("event_type"), "old": F.lag("value", 7)}
    e = ordered.moving(table(spark, sf, "events").select("event_id", "ts", "event_type", "value"), ["ts", "event_id"], made, 19, 1, frame=(-19, 0))
    return e.select("event_id", F.when(F.col("n") == 20, F.round("mean", 4)).alias("sma"), "next", F.round(F.col("value") - F.col("old"), 6).alias("change"))


@query("pareto_frontier", """SELECT p_brand, p_partkey FROM part QUALIFY p_retailprice > coalesce(max(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)""")
def pareto_frontier(spark, sf):
    return ordered.frontier(table(spark, sf, "part").select("p_brand", "p_size", "p_retailprice", "p_partkey"), ["p_brand"], "p_size", "p_retailprice", "p_partkey").select("p_brand", "p_partkey")


@query("pareto_lines", """SELECT l_extendedprice, l_quantity, l_orderkey FROM (SELECT round(l_extendedprice * (1 - l_discount), 2) AS l_extendedprice, l_quantity, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY ALL)
  QUALIFY l_quantity > coalesce(max(l_quantity) OVER (ORDER BY l_extendedprice, l_quantity DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)""")
def pareto_lines(spark, sf):
    """What is cheapest for its quantity, of all lines: one frontier over the whole table."""
    price = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).alias("l_extendedprice")
    lines = table(spark, sf, "lineitem").select(price, "l_quantity", "l_orderkey")
    return ordered.frontier(lines, [], "l_extendedprice", "l_quantity", "l_orderkey")


_STEPS = "(SELECT *, l_returnflag = 'R' AS failed FROM lineitem)"


@query("error_cascade", f"""WITH s AS (SELECT l_linestatus, failed, lead(failed) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS next FROM {_STEPS})
SELECT l_linestatus, round(avg(CASE WHEN NOT failed THEN next::INT END), 6) AS after_ok, round(avg(CASE WHEN failed THEN next::INT END), 6) AS after_fail,
  round(avg(CASE WHEN failed THEN next::INT END) / avg(CASE WHEN NOT failed THEN next::INT END), 6) AS multiplier FROM s WHERE next IS NOT NULL GROUP BY 1""")
def error_cascade(spark, sf):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    s = table(spark, sf, "lineitem").withColumn("failed", F.col("l_returnflag") == "R").withColumn("next", F.lead("failed").over(w).cast("double")).where("next is not null")
    ok, fail = F.avg(F.when(~F.col("failed"), F.col("next"))), F.avg(F.when(F.col("failed"), F.col("next")))
    g = s.groupBy("l_linestatus").agg(ok.alias("ok"), fail.alias("fail"))
    ratio = F.when(F.col("ok") == 0, F.lit(float("inf"))).otherwise(F.col("fail") / F.when(F.col("ok") != 0, F.col("ok")))
    return g.select("l_linestatus", F.round("ok", 6).alias("after_ok"), F.round("fail", 6).alias("after_fail"), F.round(ratio, 6).alias("multiplier"))


@query("step_position_failure", f"""SELECT step, count(*) AS n, count(DISTINCT l_orderkey) AS tasks, round(avg(failed::INT), 6) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS step FROM {_STEPS}) GROUP BY step""")
def step_position_failure(spark, sf):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    s = table(spark, sf, "lineitem").withColumn("step", F.row_number().over(w))
    return s.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("tasks"), F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 6).alias("rate"))


@query("step_failure_by_model", """SELECT model, step::INT AS step, count(*) AS n, count(DISTINCT l_orderkey) AS tasks, round(avg(failed::INT), 6) AS rate FROM (SELECT l_orderkey, l_returnflag = 'R' AS failed, o_orderpriority AS model,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS step FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY ALL""")
def step_failure_by_model(spark, sf):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")  # an order's lines
    s = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").cast("double").alias("failed"), F.row_number().over(w).alias("step"))
    s = s.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("model")), "l_orderkey")
    return s.groupBy("model", "step").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("tasks"), F.round(F.avg("failed"), 6).alias("rate"))


@query("tool_difficulty_by_level", """SELECT tool, coalesce(level, 'all') AS level, count(*) AS n, round(avg(l_discount), 6) AS mean, round(avg((l_discount >= 0.05)::INT), 6) AS pass_rate FROM (SELECT l_returnflag AS tool, 'L' || l_linenumber::VARCHAR AS level, l_discount FROM lineitem) GROUP BY GROUPING SETS ((tool), (tool, level))""")
def tool_difficulty_by_level(spark, sf):
    """Every level there is, and all of them together, in one pass."""
    g = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("tool"), F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("level"), "l_discount")
    g = g.groupingSets([["tool"], ["tool", "level"]], "tool", "level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("mean"), F.round(F.avg((F.col("l_discount") >= 0.05).cast("double")), 6).alias("pass_rate"))
    return g.withColumn("level", F.coalesce("level", F.lit("all")))


@query("share_of_group", "SELECT source, lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY source, lang")
def share_of_group(spark, sf):
    g = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("lang")), 6))


@query("top_n_per_group", "SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_n_per_group(spark, sf):
    w = W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn")).where("rn <= 3")


@query("best_flags", "WITH m AS (SELECT source, round(avg(n_chars), 6) AS a, count(*) AS n FROM documents GROUP BY 1) SELECT source, a, abs(a - max(a) OVER ()) < 1e-4 AS best_a, n = max(n) OVER () AS best_n FROM m")
def best_flags(spark, sf):
    m = table(spark, sf, "documents").groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("a"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(F.lit(1))  # one row for each source
    return m.select("source", "a", (F.abs(F.col("a") - F.max("a").over(w)) < 1e-4).alias("best_a"), (F.col("n") == F.max("n").over(w)).alias("best_n"))


@query("first_wins", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_wins(spark, sf):
    return rel.first(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("global_rank", "SELECT source, row_number() OVER (ORDER BY avg(n_chars) DESC, source) AS rank FROM documents GROUP BY source")
def global_rank(spark, sf):
    m = table(spark, sf, "documents").groupBy("source").agg(F.avg("n_chars").alias("a"))
    return m.select("source", F.row_number().over(W.orderBy(F.col("a").desc(), "source")).cast("long").alias("rank"))


@query("dominant_error", "SELECT lang, source FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) = 1")
def dominant_error(spark, sf):
    g = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return rel.pick(g, ["lang"], [F.col("n").desc(), F.col("source")]).select("lang", "source")


@query("tool_difficulty", """SELECT l_returnflag AS tool, count(*) AS n, round(avg(l_discount), 6) AS mean, round(avg(CASE WHEN l_linenumber = 1 THEN l_discount END), 6) AS l1, round(avg(CASE WHEN l_linenumber = 2 THEN l_discount END), 6) AS l2, round(avg(CASE WHEN l_linenumber = 99 THEN l_discount END), 6) AS l99 FROM lineitem GROUP BY 1 ORDER BY mean""")
def tool_difficulty(spark, sf):
    at = lambda k: F.round(F.avg(F.when(F.col("l_linenumber") == k, F.col("l_discount"))), 6).alias(f"l{k}")
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("tool")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("mean"), at(1), at(2), at(99)).orderBy("mean")


@query("error_share_by_level", "SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS fraction, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS ord FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY lang, source")
def error_share_by_level(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels").where("toxic = 1"), "doc_id").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    order = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    out = d.select("lang", "source", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy("lang")), 6).alias("fraction"), order.alias("ord"))
    return out.orderBy("ord", F.col("fraction").desc())


@query("scaling_correlation", "WITH m AS (SELECT source, avg(n_chars) AS acc, max(n_chars) AS size FROM documents GROUP BY 1 HAVING count(*) > 0) SELECT count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(ln(size), acc), 6) END AS r FROM m")
def scaling_correlation(spark, sf):
    m = table(spark, sf, "documents").groupBy("source").agg(F.avg("n_chars").alias("acc"), F.ln(F.max("n_chars")).alias("size"))
    return m.agg(F.count(F.lit(1)).alias("n"), F.round(stats.correlation(F.col("size"), F.col("acc")), 6).alias("r0")).select("n", F.when(F.col("n") >= 3, F.col("r0")).alias("r"))


@query("matrix_unpivot", "WITH m AS (SELECT source, round(avg(CASE WHEN lang = 'en' THEN n_chars END), 6) AS en, round(avg(CASE WHEN lang = 'de' THEN n_chars END), 6) AS de FROM documents GROUP BY 1) SELECT source, 'en' AS level, en AS value FROM m UNION ALL SELECT source, 'de', de FROM m")
def matrix_unpivot(spark, sf):
    at = lambda k: F.round(F.avg(F.when(F.col("lang") == k, F.col("n_chars"))), 6).alias(k)
    m = table(spark, sf, "documents").groupBy("source").agg(at("en"), at("de"))
    return m.unpivot("source", ["en", "de"], "level", "value")


@query("progress_monitor", "SELECT source, count(*) AS total, count(quality) AS done, round(avg(quality), 6) AS mean, count_if(toxic = 1) AS errors, count_if(quality IS NULL) AS open FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def progress_monitor(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count("quality").alias("done"), F.round(F.avg("quality"), 6).alias("mean"), F.count_if(F.col("toxic") == 1).alias("errors"), F.count_if(F.col("quality").isNull()).alias("open"))


@query("error_examples", "SELECT lang, doc_id, substr(text, 1, 80) AS preview FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 3")
def error_examples(spark, sf):
    bad = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    d = table(spark, sf, "documents").select("doc_id", "lang", F.substring("text", 1, 80).alias("preview")).join(bad, "doc_id")
    return d.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("doc_id"))).where("n <= 3").select("lang", "doc_id", "preview")


@query("linear_fit", "WITH m AS (SELECT source, avg(n_chars) AS x, avg(quality) AS y FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT round(regr_slope(y, x), 8) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM m HAVING count(*) >= 3")
def linear_fit(spark, sf):
    m = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.avg("n_chars").alias("x"), F.avg("quality").alias("y"))
    return m.agg(F.round(F.regr_slope("y", "x"), 8).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n")


@query("diagnostic_top", "WITH m AS (SELECT source, round(avg(n_chars), 6) AS size, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1 ORDER BY quality DESC, source LIMIT 6) SELECT source, 'size' AS metric, size AS value FROM m UNION ALL SELECT source, 'quality', quality FROM m UNION ALL SELECT source, 'toxic', toxic FROM m")
def diagnostic_top(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    m = d.groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("size"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic")).orderBy(F.col("quality").desc(), "source").limit(6)
    return m.unpivot("source", ["size", "quality", "toxic"], "metric", "value")
