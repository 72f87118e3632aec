"""Functions, operators and sources on small known inputs."""

import json
import math
import zlib

import pytest
from pyspark.sql import functions as F

from quern.functions import dates, numeric, records, text, web
from quern.operators import compose, relational, scoring, state, stats
from quern.sources import io


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_text(spark):
    assert one(spark, text.spelling(F.lit("Teh RECIEVE untill now, teh")))[0] == "The RECEIVE until now, the"
    assert one(spark, text.slug(F.lit("  Crème Brûlée & Co_2 "))) == ("creme-brulee-co-2",)
    assert one(spark, text.title(F.lit("o'neil 3rd place")), text.camel(F.lit("big red-dog")), text.snake(F.lit("bigRed Dog"))) == ("O'Neil 3Rd Place", "bigRedDog", "big_red_dog")
    assert one(spark, text.masked(F.lit("a@b.co 123-45-6789 +1 555 123 4567"))) == ("[EMAIL] [SSN] [PHONE]",)
    assert one(spark, text.overlap(F.lit("a b c"), F.lit("B c d")), text.overlap(F.lit(""), F.lit("!"))) == (0.5, 1.0)
    assert one(spark, text.language(F.lit("der Hund und die Katze")))[0].language == "German"
    assert tuple(one(spark, text.sentiment(F.lit("good great bad")))[0]) == ("positive", 0.67)
    assert one(spark, text.truncated(F.lit("abcdefgh"), 5), text.occurrences(F.lit("banana"), "an")) == ("ab...", 2)
    assert tuple(one(spark, text.category(F.lit("Space sports now"), ["sports", "space travel"]))[0]) == ("sports", 0.8)


@pytest.mark.parametrize("value,said", [(0, "zero"), (21, "twenty-one"), (115, "one hundred fifteen"), (-1200300, "minus one million two hundred thousand three hundred"), (2.5, "two point five")])
def test_number_words(spark, value, said):
    spoken, back = one(spark, text.number_words(F.lit(float(value))), text.words_number(F.lit("1.5 million")))
    assert spoken == said and back == 1.5e6


def test_numbers(spark):
    assert one(spark, numeric.percent_change(F.lit(50.0), F.lit(75.0)), numeric.percent_change(F.lit(0.0), F.lit(1.0))) == (50.0, None)
    assert one(spark, numeric.convert(F.lit(100.0), F.lit("Celsius"), F.lit(" fahrenheit")), numeric.convert(F.lit(1.0), F.lit("kg"), F.lit("parsec"))) == (212.0, None)
    assert one(spark, numeric.formula("sqrt(16) + 2 ** 3 * max(1, 2) - 7 % 4"), numeric.formula("1 / 0")) == (17.0, None)
    for bad in ("__import__('os')", "a.b", "lambda: 1", "[1]"):
        with pytest.raises(ValueError):
            numeric.formula(bad)
    s = one(spark, numeric.array_summary(F.array(*map(F.lit, [1.0, 2.0, 3.0, 10.0]))))[0]
    assert (s.n, s.mean, s.median, s.low, s.high) == (4, 4.0, 2.5, 1.0, 10.0) and abs(s.stdev - 4.0825) < 1e-9


def test_dates(spark):
    d = lambda s: F.lit(s).cast("date")
    assert one(spark, dates.business_days(d("2026-02-20"), d("2026-02-24")), dates.business_days(d("2026-02-20"), d("2026-02-20")), dates.business_days(d("2026-02-20"), d("2026-02-19"))) == (2, 0, None)
    assert str(one(spark, dates.next_weekday(d("2026-02-23"), "MON"))[0]) == "2026-03-02"
    assert tuple(one(spark, dates.since(F.lit("2025-02-21 11:00:00")))[0]) == (366, 1, "1 year, 1 day, 1 hour")
    assert one(spark, dates.since(F.lit("2030-01-01")))[0] is None
    assert [str(x) for x in one(spark, *[dates.parsed(F.lit(s)) for s in ("Feb 22, 2026", "02/22/2026", "22-02-2026", "22 February 2026")])] == ["2026-02-22"] * 4


def test_web(spark):
    assert tuple(one(spark, web.domain(F.lit("https://u@a.b.example.com:80/x?y#z")))[0]) == ("a.b", "example", "com")
    assert tuple(one(spark, web.parts(F.lit("HTTP://h:1/p?q=1#f")))[0]) == ("http", "h:1", "/p", "q=1", "f")
    assert one(spark, web.percent_encoded(F.lit("a b~*é/")), web.percent_decoded(F.lit("a%20b+c"))) == ("a%20b~%2A%C3%A9%2F", "a b+c")
    assert one(spark, web.links(F.lit('see http://a.com/x. <a href="https://b.org">')))[0] == ["http://a.com/x", "https://b.org"]
    assert one(spark, web.deflated_size(F.lit("x" * 100), F.lit(6)))[0] == len(zlib.compress(b"x" * 100, 6))


@pytest.mark.parametrize("value", ["paris", 'a "b" \\ c\n', "héllo 😀"])
def test_records_spell_json(spark, value):
    import hashlib

    want = hashlib.sha256(json.dumps(["weather", value]).encode()).hexdigest()
    digest, rest = one(spark, records.hashed("weather", F.lit(value)), records.remainder(records.hashed("weather", F.lit(value)), 45))
    assert digest == want and rest == int(want, 16) % 45


def test_merge(spark):
    left = spark.createDataFrame([(1, "a"), (3, "b")], "id int, v string")
    right = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "id int, v string, at int")
    got = sorted((r.id, r.v, r.at, r.matched) for r in relational.merge(left, right, "id", [F.col("at")]).collect())
    assert got == [(1, "y", 2, True), (3, "b", None, False)]


def test_matching(spark):
    assert one(spark, scoring.match_string(F.lit("hello world"), F.lit("Hello  World")), scoring.match_string(F.lit("abc"), F.lit("xyz")), scoring.similarity(F.lit(""), F.lit(""))) == (1.0, 0.0, 1.0)
    assert one(spark, scoring.match_numeric(F.lit(0.0), F.lit(5e-5)), scoring.match_numeric(F.lit(1.0), F.lit(1.1))) == (1.0, 0.0)
    assert one(spark, scoring.match_json(F.lit('{"a": [1, 2], "b": null}'), F.lit('{"a": [1, 3], "b": null}')))[0] == 0.75
    a = lambda s: F.array(*map(F.lit, s.split()))
    assert one(spark, scoring.lcs(a("get calc mail"), a("get mail calc")), scoring.lcs(F.array().cast("array<string>"), a("x"))) == (2, 0)


def test_assignment_matches_a_plain_loop(spark):
    import random

    rng, cases = random.Random(3), []
    for i in range(60):
        n, m = rng.randint(0, 4), rng.randint(0, 4)
        cases.append((i, n, [(s, c, rng.randint(0, 3) / 3) for s in range(n) for c in range(m) if rng.random() < 0.7]))
    df = spark.createDataFrame(cases, "i int, n int, p array<struct<s:int,c:int,v:double>>")
    for r in df.select("i", scoring.assign(F.col("n"), F.col("p")).alias("got")).collect():
        _, n, pairs = cases[r.i]
        used, want = set(), []
        for s in range(n):
            best = max(((v, -c) for q, c, v in pairs if q == s and c not in used), default=None)
            want.append(-1 if best is None else -best[1])
            used.add(want[-1])
            used.discard(-1)
        assert r.got == want


def test_every_line_of_an_order_is_assigned(spark, sf):
    from quern.plans import evaluation

    orders = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount").collect():
        orders.setdefault(r[0], []).append(tuple(r[1:]))
    want = {}
    for k, v in orders.items():
        d, free, want[k] = [x[2] for x in sorted(v)], set(range(len(v))), []
        for i in range(len(d)):
            best = max(free, key=lambda j: (1 - abs(d[i] - d[len(d) - 1 - j] / 2), -j))
            free.remove(best)
            want[k].append(best)
    assert {r.l_orderkey: r.chosen for r in evaluation.greedy_assignment(spark, sf).collect()} == want


def test_calls(spark):
    said = '```json\n[{"tool": "a", "arguments": {"x": 1}}, {"function": "b", "parameters": {}}]\n```'
    assert [(c.tool, c.arguments) for c in one(spark, scoring.calls(F.lit(said)))[0]] == [("a", '{"x":1}'), ("b", "{}")]


def test_statistics(spark):
    df = spark.createDataFrame([(i, "a", float(i % 7)) for i in range(50)], "i int, g string, v double")
    r = stats.bootstrap(df, ["g"], "v", ["i"]).first()
    assert r.low <= r["mean"] <= r.high and r.low < r.high
    assert r == stats.bootstrap(df.repartition(3), ["g"], "v", ["i"]).first()
    lit = F.lit
    assert one(spark, stats.cohens_d(lit(1.0), lit(1.0), lit(0.0), lit(0.0), lit(5), lit(5)), stats.cohens_d(lit(2.0), lit(1.0), lit(0.0), lit(0.0), lit(5), lit(5))) == (0.0, math.inf)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert flat.select(stats.correlation(F.col("x"), F.col("y"))).first()[0] is None


def test_compose(spark):
    steps = [compose.Step("c", lambda a, b: a + b, ["a", "b"]), compose.Step("a", lambda i: i * 2, ["id"]), compose.Step("b", lambda i: i + 1, ["id"])]
    assert [r.c for r in compose.run(spark.range(3), steps).orderBy("id").collect()] == [1, 4, 7]
    with pytest.raises(ValueError):
        compose.run(spark.range(1), [compose.Step("id", lambda: F.lit(1))])


def test_state(spark):
    log = spark.createDataFrame([("k", 1, "old", ["x"]), ("k", 2, "new", ["y"]), ("l", 1, "one", ["y", "z"])], "key string, at int, value string, tags array<string>")
    assert sorted((r.key, r.value, r.versions) for r in state.latest(log, "key", "at").collect()) == [("k", "new", 2), ("l", "one", 1)]
    assert [r.key for r in state.tagged(log, "key", "at", "x").collect()] == []
    assert tuple(state.context(log, "key", "at").first()) == (2, "y,z")


def test_sources(spark, tmp_path):
    row = {"task_id": "t1", "model": "m", "score": {"level": "L1", "overall": 0.5}, "tokens": {"input": 1, "output": 2}, "latency_ms": 3.0, "num_tool_calls": 1}
    (tmp_path / "checkpoint_m.jsonl").write_text(json.dumps(row) + "\n\n{broken\n")
    got = io.records(spark, str(tmp_path / "checkpoint_*.jsonl")).collect()
    assert [(r.task_id, r.score.overall, r.file) for r in got] == [("t1", 0.5, "checkpoint_m.jsonl")]
    (tmp_path / "results.json").write_text(json.dumps({"models": {"m": {"model": {"name": "M", "provider": "p"}, "task_results": [row]}}}, indent=1))
    r = io.results(spark, str(tmp_path / "results.json")).first()
    assert (r.model, r.level, r.overall, r.argument_score, r.output) == ("M", "L1", 0.5, 0.0, 2)
    io.write_csv(spark.createDataFrame([("a,b", 'say "x"')], "p string, q string"), str(tmp_path / "out"), quote_all=True)
    assert tuple(io.csv(spark, str(tmp_path / "out"), "p string, q string").first()) == ("a,b", 'say "x"')
    assert io.files(spark, str(tmp_path)).count() >= 2 and "results" in io.newest(spark, str(tmp_path / "*.json"))
    io.write_parquet(spark.range(3), str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 3
    assert one(spark, io.converted(F.lit('{"a":1,"b":"x"}'), "json", "text", "a int, b string"))[0] == "a: 1, b: x"
    assert one(spark, io.yes_no(F.lit(" yes")), io.yes_no(F.lit("maybe"))) == (True, None)
    assert io.markdown(spark.createDataFrame([("a", 0.5, None)], "n string, x double, y double")).first()[0] == "| a | 0.5000 | – |"


def test_first_complete(spark):
    runs = [spark.createDataFrame([("m", i) for i in range(n)], "model string, i int") for n in (1, 3, 4)]
    got = io.first_complete(runs, least=3)
    assert got.count() == 3 and {r.run for r in got.collect()} == {1}


def test_streams(spark, tmp_path):
    from quern.streaming import state as streams

    spark.range(20).select((F.col("id") % 4).alias("key"), F.col("id").alias("at"), F.timestamp_seconds(F.col("id") * 60).alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, at long, ts timestamp").parquet(str(tmp_path / "in"))
    q = streams.latest(stream, "key", "at").writeStream.outputMode("complete").format("memory").queryName("latest_rows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.key, r["at"]) for r in spark.table("latest_rows").collect()) == [(0, 16), (1, 17), (2, 18), (3, 19)]
    for _ in range(2):  # a second run finds nothing new
        streams.append_checkpointed(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 20
    q = streams.tumbling(stream, "ts", "5 minutes", "1 minute", "key").writeStream.outputMode("complete").format("memory").queryName("tumbling_rows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tumbling_rows").agg(F.sum("n")).first()[0] == 20


def test_correlation_of_known_pairs(spark):
    """Rows without a partner take no part, large offsets cost no digits, and r stays within -1 and 1."""
    from quern.operators import stats

    r = lambda rows: spark.createDataFrame(rows, "x double, y double").agg(stats.correlation(F.col("x"), F.col("y")).alias("r")).first()["r"]
    assert r([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (100.0, None), (None, 5.0)]) == 1.0
    big = [(1.7e9 + i, 1.7e9 + i + (i % 3) * 0.01) for i in range(50)]
    own = spark.createDataFrame(big, "x double, y double").agg(F.corr("x", "y")).first()[0]
    assert abs(r(big) - own) < 1e-9 and r(big) <= 1.0
    assert r([(1.0, 1.0), (1.0, 2.0), (2.0, None)]) is None and r([(None, 1.0)]) is None


def test_bootstrap_beside_a_plain_one(spark):
    """Each replicate's mean is that of the rows, as often as it draws them."""
    from quern.operators import stats

    rows = [(f"g{i % 3}", float(i * i % 17), i) for i in range(60)] + [("g1", None, 99)]
    df = spark.createDataFrame(rows, "g string, v double, i int")
    for replicates in (1, 8, 45, 100):
        drawn = {r.i: r.w for r in df.select("i", stats.weights(F.concat_ws("|", F.col("i").cast("string")), replicates).alias("w")).collect()}
        got = {(r.g, r.replicate): r["mean"] for r in stats.resampled(df, ["g"], "v", ["i"], replicates).collect()}
        want = {}
        for g in ("g0", "g1", "g2"):
            for k in range(replicates):
                own = [(v, drawn[i][k]) for h, v, i in rows if h == g and v is not None]
                if sum(w for _, w in own):
                    want[g, k] = sum(v * w for v, w in own) / sum(w for _, w in own)
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_whole_texts_between_formats(spark):
    cases = [
        ('[{"a": 1, "b": "x, y"}, {"a": null}]', "json", "csv", 'a,b\r\n1,"x, y"\r\n,\r\n'), ("a,b\n1,\"x\ny\"\n", "csv", "text", "a: 1, b: x\ny"), ("a,b\n1,2\n", "csv", "json", '[\n  {\n    "a": "1",\n    "b": "2"\n  }\n]'),
        ('{"a": 1, "b": [2]}', "json", "text", "a: 1\nb: [2]"), ('[1, "x"]', "json", "text", "1\nx"), ("plain", "text", "json", '"plain"'), ("plain", "text", "csv", "plain"), ("{", "json", "csv", None),
        ('[{"a": 1}, {"b": 2}]', "json", "csv", None), ("", "csv", "text", ""), (None, "csv", "json", None),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "d string, o string, t string")
    assert [r.x for r in df.select(io.transform_format("d", "o", "t").alias("x")).collect()] == [c[3] for c in cases]


def test_asked_by_arguments(spark):
    df = spark.createDataFrame([(1, "Apple", "10", 1.0), (2, "pineapple", "x", 3.0), (3, None, "30", None), (4, "fig", None, 3.0)], "id int, name string, size string, price double")
    ask = lambda *a, **k: [r.id for r in relational.ask(df, *a, **k).collect()]
    assert ask("name", "equals", "APPLE") == [1] and ask("name", "contains", "Apple", sort_by="price") == [2, 1]
    assert ask("size", "greater_than", "9", "id") == [3, 1] and ask("size", "less_than", 11) == [1]
    assert ask("nothing", "equals", "1") == [] and sorted(ask("name", None, "x")) == [1, 2, 3, 4]
    assert ask(sort_by="price", limit=2, tie="id") == [2, 4] and len(ask(sort_by="nothing", limit=3)) == 3
    assert ask("id", "equals", 3) == [3]


def test_queries_that_sql_cannot_express(spark, sf):
    import hashlib
    import os
    import re

    from quern import catalog

    q = catalog.queries()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.sha512 for r in q["hash_sha512"](spark, sf).collect()} == {i: hashlib.sha512(t.encode()).hexdigest() for i, t in texts.items()}
    files = {f: os.path.getsize(f"{sf}/{f}") for f in os.listdir(sf) if not f.startswith(".")}
    assert {r.name: r.size for r in q["list_files"](spark, sf).collect()} == files
    r = q["read_file"](spark, sf).first()
    with open(f"{sf}/region.parquet", "rb") as f:
        assert (r.name, r.size, r.sha256) == ("region.parquet", files["region.parquet"], hashlib.sha256(f.read()).hexdigest())
    found = q["extract_entities"](spark, sf).columns
    assert "doc_id" in found
    emails = spark.createDataFrame([("write to ab@x.org or call +1 523 555 1055 on 3/4/2024",)], "t string").select(text.entities(F.col("t")).alias("e")).first()["e"]
    assert "ab@x.org" in str(emails) and "3/4/2024" in str(emails) and re.search("523 555 1055", str(emails))


def test_correlation_test_beside_plain_numbers(spark, sf):
    """r by its definition, ranks by sorting, and the p-value by integrating the density of t."""
    from collections import defaultdict

    from quern import catalog

    d = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("source", "n_chars", "quality").collect()
    by = defaultdict(list)
    for r in d:
        by[r.source].append((r.n_chars, r.quality))
    xs, ys = (([sum(v[i] for v in g) / len(g) for g in by.values()]) for i in (0, 1))

    def pearson(a, b):
        ma, mb = sum(a) / len(a), sum(b) / len(b)
        return sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))

    def ranks(a):
        return [sum(y < x for y in a) + (sum(y == x for y in a) + 1) / 2 for x in a]

    def p_value(r, n):
        k = n - 2
        t = abs(r) * math.sqrt(k / (1 - r * r))
        density = lambda u: math.gamma((k + 1) / 2) / math.sqrt(k * math.pi) / math.gamma(k / 2) * (1 + u * u / k) ** (-(k + 1) / 2)
        steps = 20_000
        h = t / steps
        return 1 - 2 * h / 3 * sum(density(i * h) * (1 if i in (0, steps) else 4 if i % 2 else 2) for i in range(steps + 1))

    got = catalog.queries()["correlation_test"](spark, sf).first()
    r, rho = pearson(xs, ys), pearson(ranks(xs), ranks(ys))
    assert got.n == len(by) and got.pearson == pytest.approx(r, abs=2e-6) and got.spearman == pytest.approx(rho, abs=2e-6)
    assert got.pearson_p == pytest.approx(p_value(r, len(by)), abs=1e-5) and got.spearman_p == pytest.approx(p_value(rho, len(by)), abs=1e-5)
