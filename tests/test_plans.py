"""Patterns, suites, statistics, the function registry and the sinks' parts on small inputs."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import registry
from quern.operators import scoring, stats, suite
from quern.plans import compositions, evaluation
from quern.sources import io


def test_patterns_are_what_their_level_says():
    assert len({p.name for p in compositions.PATTERNS}) == len(compositions.PATTERNS) >= 55
    for p in compositions.PATTERNS:
        made = set()
        for name, op, inputs in p.steps:
            assert op in compositions.OPS and name not in made
            made.add(name)
        if p.level == "L2":
            assert p.parallel(), p.name
        if p.level == "L1" and len(p.steps) == 2:
            assert not p.parallel(), p.name


def test_stratified_targets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("xy"), rng.choice(["a"] * 20 + ["b"] * 3 + [None, "c"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, level string, cat string")
    got = suite.stratified(df, "level", "cat", "id", {"x": 40, "y": 3, "z": 5}).collect()
    by = collections.Counter(r.level for r in got)
    assert by == {"x": 40, "y": 3} and len({r.id for r in got}) == 43
    cats = collections.Counter(r.cat for r in got if r.level == "x")
    have = collections.Counter(c for _, level, c in rows if level == "x")
    assert all(cats[c] == min(have[c], 10) for c in ("b", "c", None)) and cats["a"] == 40 - sum(cats[c] for c in ("b", "c", None))
    again = suite.stratified(df.repartition(5), "level", "cat", "id", {"x": 40, "y": 3, "z": 5}).collect()
    assert {r.id for r in again} == {r.id for r in got}


def test_assembly(spark):
    rows = [("L0", "p", i, ["t", "s"][:: 1 - 2 * (i % 2)], str(i // 4)) for i in range(40)] + [("L1", f"q{i % 3}", 100 + i, ["u"], "") for i in range(30)] + [("L1", "rare", 500, ["u"], "")]
    got = suite.assemble(spark.createDataFrame(rows, "level string, pattern string, task int, tools array<string>, params string"), {"L0": 99, "L1": 20}).collect()
    by = collections.Counter(r.level for r in got)
    assert by == {"L0": 10, "L1": 20}  # of four tasks with equal tools and params one stays
    each = collections.Counter(r.pattern for r in got if r.level == "L1")
    assert each["rare"] == 1 and all(each[f"q{i}"] >= 5 for i in range(3))
    d = spark.range(5).select(suite.distractors(F.col("id"), F.array(F.lit("a")), ["a", "b", "c", "d"], 2).alias("d")).collect()
    assert all(len(set(r.d)) == 2 and "a" not in r.d for r in d)


def test_templates(spark):
    r = spark.range(1).select(suite.filled("{a} and {b}", {"a": F.lit(1), "b": F.lit("x")}), suite.filled("{a} and {c}", {"a": F.lit(1)}), suite.filled("{a}", {"a": F.lit(None).cast("string")})).first()
    assert tuple(r) == ("1 and x", "{a} and {c}", "{a}")


def plain_p(r, n):
    """Twice the tail of the t distribution, by summing its density."""
    df, t = n - 2, abs(r) * math.sqrt((n - 2) / (1 - r * r))
    x = np.tan((np.arange(400_000) + 0.5) / 400_000 * math.pi / 2)  # the density over an angle, all of it in reach
    density = (1 + x * x / df) ** (-(df + 1) / 2) * (1 + x * x)
    return density[x > t].sum() / density.sum()


def test_tails(spark):
    cases = [(r, float(n)) for r in (0.0, 0.5, -0.5, 0.9, 0.3, 0.02) for n in (3, 4, 12, 13, 103, 2000)]
    for x in spark.createDataFrame(cases, "r double, n double").select("r", "n", stats.correlation_p("r", "n").alias("p")).collect():
        assert x.p == pytest.approx(plain_p(x.r, x.n), abs=1e-4)
    edge = spark.createDataFrame([(0.5, 2.0), (1.0, 5.0), (None, 9.0)], "r double, n double").select(stats.correlation_p("r", "n").alias("p")).collect()
    assert [x.p for x in edge] == [None, 0.0, None]


def test_bootstrap_draws_are_poisson(spark):
    w = [x for r in spark.range(500).select(stats.weights(F.col("id"), 60).alias("w")).collect() for x in r.w]
    share = collections.Counter(w)
    assert len(w) == 30_000 and all(abs(share[k] / len(w) - math.exp(-1) / math.factorial(k)) < 0.01 for k in range(5))


def test_paired_differences(spark):
    rng = random.Random(5)
    rows = [("same", i, x := rng.gauss(0, 1), x + rng.gauss(0, 1)) for i in range(200)] + [("apart", i, x := rng.gauss(0, 1), x - 1 + rng.gauss(0, 0.3)) for i in range(200)] + [("apart", 999, None, 1.0)]
    got = {r.k: r for r in stats.paired(spark.createDataFrame(rows, "k string, i int, x double, y double"), ["k"], "x", "y", ["i"]).collect()}
    assert got["apart"].p_value == 0 and got["apart"].n == 200 and got["same"].p_value > 0.01 and 0.8 < got["apart"].effect_size < 1.3


def test_registry():
    schema = registry._FUNCTIONS["clamp_value"].schema()["function"]
    assert schema["parameters"]["required"] == ["value", "low", "high"] and registry._FUNCTIONS["classify_text"].schema()["function"]["parameters"]["properties"]["categories"]["type"] == "array"
    with pytest.raises(KeyError):
        registry.call("no_such_function")
    with pytest.raises(ValueError):
        registry.register("clamp_value", "x", len)


def test_registered_functions_run(spark):
    assert spark.range(1).select(registry.call("slugify", text=F.lit("A b")), registry.call("percentage_change", old=F.lit(2.0), new=F.lit(3.0))).first() == ("a-b", 50.0)


def test_transcripts_files_and_suites(spark, tmp_path):
    heard = spark.createDataFrame([("My_MEETING.wav",), ("x.mp3",)], "s string").select(io.transcribed(F.col("s")).alias("t")).collect()
    assert heard[0].t.seconds == 22 and heard[0].t.known and not heard[1].t.known and 30 <= heard[1].t.seconds < 150 and 0.85 <= heard[1].t.confidence <= 1
    log = spark.createDataFrame([("/a.json", "{}", 1), ("/a.json", "[1]", 2), ("/b.bin", "", 1)], "path string, content string, at int")
    assert sorted(map(tuple, io.written(log, "at").collect())) == [("/a.json", "[1]", 3, "application/json", True), ("/b.bin", "", 0, "text/plain", False)]
    (tmp_path / "s.json").write_text('{"name": "s", "version": "1", "tasks": [{"task_id": "t", "prompt": " ", "available_tools": ["a"], "num_steps": 1}]}')
    with pytest.raises(Exception, match="a suite has name"):
        io.suite(spark, str(tmp_path / "s.json")).collect()
    io.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "rows"))
    io.write_json(spark.createDataFrame([(2, "x")], "a int, b string"), str(tmp_path / "rows"), append=True)
    assert spark.read.json(str(tmp_path / "rows")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"task_id": "t"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        io.records(spark, str(tmp_path / "bad.jsonl"), strict=True).collect()
    assert [r.fault for r in io.violations(spark.createDataFrame([("t", "p", ["a"], 1), ("u", None, ["a"], 1), ("v", "p", [], 1), ("w", "p", ["a"], 0)], "task_id string, prompt string, available_tools array<string>, num_steps int")).orderBy("task_id").collect()] == ["no prompt", "no tools", "no steps"]


def test_diagnostics(spark, sf):
    from quern.plans import analysis

    tasks = scoring.score(evaluation.order_tasks(spark, sf)).select("task", "flow", "call_scores").collect()
    by = collections.defaultdict(list)
    for r in tasks:
        by[r.task % 7].append(r)
    for r in analysis.call_diagnostics(spark, sf).collect():
        calls = [c for t in by[r.model] for c in t.call_scores]
        matched = [c.args_score for c in calls if c.matched]
        flows = [t.flow for t in by[r.model] if any(c.depends_on for c in t.call_scores)]
        assert r.tools == 1.0 and r.arguments == pytest.approx(sum(matched) / len(matched), abs=1e-6)
        assert r.steps == pytest.approx(len(matched) / len(calls), abs=1e-6) and r.flow == pytest.approx(sum(flows) / len(flows), abs=1e-6)
