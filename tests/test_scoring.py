"""Scores of whole tasks, fuzzy values and answers, beside plain versions of the rules."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import nested, scoring

TASK = "task int, level string, steps array<struct<id:string,tool:string,arguments:string,depends_on:array<string>>>, calls array<struct<tool:string,arguments:string>>"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_value(e, a):
    if e is None or a is None:
        return 1.0 if e is None and a is None else 0.0
    if e is True or e is False:
        return 1.0 if bool(a) == e else 0.0
    if isinstance(e, (int, float)):
        try:
            x = float(a)
        except (ValueError, TypeError):
            return 0.0
        return 1.0 if e == x or (abs(x) < 1e-4 if e == 0 else math.isclose(e, x, rel_tol=1e-4)) else 0.0
    if isinstance(e, list):
        if not isinstance(a, list):
            return 0.0
        if not e or not a:
            return 1.0 if not e and not a else 0.0
        each = [plain_value(x, a[i]) if i < len(a) else 0.0 for i, x in enumerate(e)]
        return sum(each) / len(each) * min(len(e), len(a)) / max(len(e), len(a))
    if isinstance(e, dict):
        if not isinstance(a, dict):
            return 0.0
        if not e or not a:
            return 1.0 if not e and not a else 0.0
        keys = {*e, *a}
        return sum(plain_value(e[k], a[k]) if k in e and k in a else 0.0 for k in keys) / len(keys)
    x, y = (" ".join(str(v).lower().split()) for v in (e, a))
    alike = 1.0 if x == y else 1 - plain_distance(x, y) / max(len(x), len(y))
    return alike if alike >= 0.85 else 0.0


def plain_score(level, steps, calls):
    used, matched = set(), {}
    for i, s in enumerate(steps):
        best = None
        for j, c in enumerate(calls):
            if j not in used and s["tool"].strip().lower() == c["tool"].strip().lower():
                v = plain_value(json.loads(s["arguments"]), json.loads(c["arguments"]))
                if best is None or v > best[0]:
                    best = (v, j)
        if best:
            used.add(best[1])
            matched[i] = best[0]
    want, got = [s["tool"] for s in steps], [c["tool"] for c in calls]
    common = max((len(k) for n in range(len(want) + 1) for k in itertools.combinations(want, n) if subsequence(k, got)), default=0)
    seq = common / len(want) if want else 1.0
    args = sum(matched.values()) / len(matched) if matched else 0.0
    done = len(matched) / max(len(steps), 1)
    names = {steps[i]["id"] for i in matched}
    waits = [i for i, s in enumerate(steps) if s["depends_on"]]
    flow = sum(i in matched and set(steps[i]["depends_on"]) <= names for i in waits) / len(waits) if waits else 1.0
    if level == "L0":
        total = float(0 in matched and args >= 0.85)
    elif level == "L1":
        total = seq * 0.40 + args * 0.35 + done * 0.25
    elif level == "L2":
        total = seq * 0.35 + args * 0.35 + flow * 0.15 + done * 0.15
    else:
        total = seq * 0.30 + args * 0.30 + flow * 0.25 + done * 0.15
    if not calls:
        error = "E10_format_error"
    elif set(got) - set(want):
        error = "E6_hallucinated_tool"
    elif len(calls) < len(steps):
        error = "E8_partial_completion"
    elif common < len(want):
        error = "E3_wrong_order"
    elif any(v < 0.85 for v in matched.values()):
        error = "E4_wrong_arguments"
    else:
        error = "E7_unnecessary_tool" if len(calls) > len(steps) else None
    return seq, args, done, flow, total, error


def subsequence(k, of):
    it = iter(of)
    return all(x in it for x in k)


def test_distance():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(2))
        assert scoring._distance(a, b) == plain_distance(a, b)
    assert scoring._distance("a" * 100, "b" + "a" * 99) == 1


VALUES = [None, True, False, 0, 5, "5", "5.0", 5.0004, 1e-5, "abc", "hello world", "hello worlds", "Hello  World", [], [1, "x"], [1], ["1", "x", 2], {}, {"a": 1}, {"a": "1.0", "b": None}, {"a": [True, {"c": "text one"}]}, {"a": [1, {"c": "text onE"}]}, "nan", "1_0"]


def test_values(spark):
    cases = [(json.dumps(e), json.dumps(a)) for e in VALUES for a in VALUES]
    got = spark.createDataFrame(cases, "e string, a string").select("e", "a", scoring.match_json("e", "a").alias("v")).collect()
    for r in got:
        assert r.v == pytest.approx(plain_value(json.loads(r.e), json.loads(r.a))), (r.e, r.a)
    assert spark.range(1).select(scoring.match_json(F.lit("{"), F.lit("1")), scoring.match_json(F.lit(None).cast("string"), F.lit("1"))).first() == (None, None)


def test_whole_tasks(spark):
    rng, rows = random.Random(7), []
    names, values = ["get", "Get", "send", "calc "], ['{"x": 1}', '{"x": "1"}', '{"x": 2}', "{}", '{"q": "some long text"}', '{"q": "some long texts"}']
    for i in range(250):
        steps = [{"id": f"s{k}", "tool": rng.choice(names), "arguments": rng.choice(values), "depends_on": rng.sample([f"s{j}" for j in range(k)], rng.randint(0, k))} for k in range(rng.randint(0, 4))]
        calls = [{"tool": rng.choice([*names, "odd"] if i % 5 == 0 else names), "arguments": rng.choice(values)} for _ in range(rng.randint(0, 5))]
        rows.append((i, f"L{i % 4}", steps, [{k: s[k] for k in ("tool", "arguments")} for s in steps] + calls[:1] if i % 3 == 0 else calls))
    for r in scoring.score(spark.createDataFrame(rows, TASK)).collect():
        _, level, steps, calls = rows[r.task]
        want = plain_score(level, steps, calls)
        assert (r.sequence, r.arguments, r.complete, r.flow, r.overall) == pytest.approx(want[:5]) and r.error == want[5], rows[r.task]
    empty = scoring.score(spark.createDataFrame([(1, "L2", None, None), (2, None, [], [])], TASK)).collect()
    assert [(r.sequence, r.arguments, r.complete, r.flow, r.error) for r in empty] == [(1.0, 0.0, 0.0, 1.0, "E10_format_error")] * 2


def test_score_task_query(spark, sf):
    from quern.plans import evaluation

    tasks = {r.task: r.asDict(recursive=True) for r in evaluation.order_tasks(spark, sf).limit(200).collect()}
    got = [r for r in evaluation.score_task(spark, sf).collect() if r.task in tasks]
    assert len(got) == len(tasks)
    for r in got:
        t = tasks[r.task]
        want = plain_score(t["level"], t["steps"], t["calls"])
        assert (r.sequence, r.arguments, r.complete, r.flow, r.overall) == pytest.approx(want[:5]) and r.error == want[5]


ANSWERS = {
    'I call {"name": "a", "args": {"x": 1}} and then {"tool": "b"}.': [("a", '{"x":1}'), ("b", "{}")],
    '{"tool": "a", "arguments": {"x": "}"}} said }': [],  # the brace in the text ends the run early, as the scan counts braces alone
    "```json\n[{\"tool\": \"a\"}, 7, {\"function\": \"b\", \"parameters\": {\"é\": [1]}}]\n```": [("a", "{}"), ("b", '{"é":[1]}')],
    "```\n{\"tool\": \"\", \"name\": \"n\", \"arguments\": \"text\"}": [("n", "{}")],
    '} {"tool": "a"}': [],
    "nothing": [], "": [], "[1, 2]": [], '{"tool": 5}': [("5", "{}")], '{"arguments": {}, "args": {"y": 2}, "tool": "t"}': [("t", '{"y":2}')],
}


def test_answers(spark):
    df = spark.createDataFrame([(t,) for t in ANSWERS] + [(None,)], "t string").select("t", scoring.calls("t").alias("c"))
    for r in df.collect():
        assert (r.c if r.t is None else [(c.tool, c.arguments) for c in r.c]) == (None if r.t is None else ANSWERS[r.t]), r.t


def random_json(rng, depth=3):
    k = rng.random()
    if depth and k < 0.3:
        return [random_json(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    if depth and k < 0.6:
        return {c: random_json(rng, depth - 1) for c in rng.sample("abcde", rng.randint(0, 4))}
    return rng.choice([None, True, False, 0, 1, 7, 7.0001, -3, 2.5, "7", "true", "some text", "some  Text", "sometext", "", " 2.5 ", "é"])


def changed(rng, x):
    if rng.random() < 0.15:
        return random_json(rng, 1)
    if isinstance(x, list):
        return [changed(rng, v) for v in x][: rng.randint(0, 9)]
    if isinstance(x, dict):
        return {k: changed(rng, v) for k, v in x.items() if rng.random() < 0.9}
    return x


def comparable(e, a):
    """A text is compared with what JSON, not Python, writes of a container or a number beyond plain ones."""
    if isinstance(e, dict) and isinstance(a, dict):
        return all(comparable(e[k], a[k]) for k in e.keys() & a.keys())
    if isinstance(e, list) and isinstance(a, list):
        return all(map(comparable, e, a))
    return not (isinstance(e, str) and isinstance(a, (dict, list, float)))


def test_nested_values_in_the_jvm(spark):
    rng = random.Random(6)
    cases = [(e, a) for e in VALUES for a in VALUES]
    for _ in range(400):
        e = random_json(rng, 4)
        cases += [(e, changed(rng, e)), (e, random_json(rng, 2))]
    cases = [(e, a) for e, a in cases if comparable(e, a)]
    texts = [(json.dumps(e, ensure_ascii=i % 2 == 0), json.dumps(a)) for i, (e, a) in enumerate(cases)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)] + [(-1, "{", "1"), (-2, None, "1"), (-3, "1", "nope")], "i long, e string, a string")
    out = nested.match(df, "e", "a", "v")
    assert out.columns == ["i", "e", "a", "v"] and "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r.v for r in out.collect()}
    assert got[-1] is got[-2] is got[-3] is None
    for i, (e, a) in enumerate(cases):
        assert got[i] == pytest.approx(plain_value(e, a)), (e, a)
    assert nested.match(df.limit(0), "e", "a").count() == 0


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


def test_lcs_of_any_length(spark):
    rng = random.Random(2)
    cases = [([], ["a"]), (["a"], []), ([], []), (["a"], ["b"])]
    for n in (1, 2, 5, 40, 61, 62, 63, 64, 124, 125, 130, 300, 1000):
        for letters in ("ab", "abcdefghij", [f"w{i}" for i in range(50)]):
            cases.append((rng.choices(letters, k=n), rng.choices(letters, k=rng.randint(1, n + 5))))
    cases.append((["a"] * 200, ["a"] * 150))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>").repartition(4)
    got = {r.i: r.n for r in df.select("i", scoring.lcs(F.col("a"), F.col("b")).alias("n")).collect()}
    assert [got[i] for i in range(len(cases))] == [plain_lcs(a, b) for a, b in cases]
    odd = spark.createDataFrame([(["a", None, "b"], [None, "b"]), (None, ["a"])], "a array<string>, b array<string>")
    assert [r.n for r in odd.select(scoring.lcs(F.col("a"), F.col("b")).alias("n")).collect()] == [1, None]


def test_functions_under_sql_names(spark):
    from quern.functions import sql

    names = sql.register(spark)
    assert set(names) >= {"parse_calls", "match_string"}
    rows = [("Hello  World", "hello world", 4.0, 5.0), ("hello worlds", "hello world", 0.0, 1e-5), ("abc", "xyz", -2.0, 7.0), ("", "", 3.0, 3.0002), (None, "a", None, 1.0)]
    df = spark.createDataFrame(rows, "e string, a string, x double, y double").withColumn("d", F.to_date(F.lit("2026-02-22")))
    got = spark.sql("SELECT match_string(e, a) AS s, match_numeric(x, y) AS n, percentage_change(x, y) AS p, clamp_value(y, 0D, 2D) AS c, is_business_day(d) AS b, pass_rate(array(x, 0.9D)) AS r FROM {df}", df=df).collect()
    want = df.select(scoring.match_string(F.col("e"), F.col("a")).alias("s"), scoring.match_numeric(F.col("x"), F.col("y")).alias("n")).collect()
    assert [(r.s, r.n) for r in got[:4]] == [(r.s, r.n) for r in want[:4]]
    assert [r.p for r in got][0] == 25.0 and [r.c for r in got] == [2.0, 1e-5, 2.0, 2.0, 1.0] and not got[0].b and got[0].r == 1.0


def test_a_bad_call_is_a_row_with_a_fault(spark):
    from quern.functions import sql

    sql.register(spark)
    texts = ['{"tool": "a", "args": {"x": [1, 2], "y": "t"}}', "[]", "{", "say {} or {\"name\": \"b\"}", None, "words", '```json\n[{"name": "c"}, 5]\n```', "{bad} {\"tool\": \"d\"}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, answer string")
    got = spark.sql("SELECT i, t.* FROM {df}, LATERAL parse_calls(answer, 'x', 'y') t ORDER BY i, call_index NULLS LAST", df=df)
    assert got.columns == ["i", "call_index", "tool", "arguments", "fault", "x", "y"]
    rows = [(r.i, r.call_index, r.tool, r.fault, r.x, r.y) for r in got.collect()]
    assert rows == [(0, 0, "a", None, "[1, 2]", "t"), (1, None, None, "no_call", None, None), (2, None, None, "not_json", None, None), (3, 0, "b", None, None, None), (3, None, None, "no_tool", None, None),
                    (5, None, None, "no_call", None, None), (6, 0, "c", None, None, None), (6, None, None, "no_tool", None, None), (7, 0, "d", None, None, None), (7, None, None, "not_json", None, None)]
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT t.* FROM {df}, LATERAL parse_calls(answer, answer) t", df=df).collect()
