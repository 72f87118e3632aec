"""Ranks, series, frontiers, quantiles and samples with a heavy key, beside DuckDB and plain Python."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.operators import containment, ordered, relational, suite


@pytest.fixture(scope="module")
def heavy(spark):
    """A key with two thirds of the rows, heavy ties, null keys and null values."""
    rng = random.Random(4)
    rows = [(i, None if i % 41 == 0 else "a" if i % 3 else f"k{i % 5}", None if i % 53 == 0 else 7.0 if i % 4 == 0 else round(rng.expovariate(0.01), 2), rng.randint(0, 40)) for i in range(9000)]
    return spark.createDataFrame(rows, "id long, k string, v double, c int").repartition(6).cache()


@pytest.fixture(scope="module")
def t(heavy):
    con = duckdb.connect()
    con.register("t", heavy.toArrow())
    return con


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def want(con, sql):
    return sorted(map(str, con.execute(sql).fetchall()))


def test_numbers(heavy, t):
    got = ordered.numbered(heavy.select("id", "k", "v"), ["v", "id"])
    assert rows(got.select("id", "place")) == want(t, "SELECT id, row_number() OVER (ORDER BY v NULLS FIRST, id) FROM t")
    got = ordered.numbered(heavy.select("id", "k", "v"), ["v", "id"], ["k"], "n")
    assert rows(got.select("id", "n")) == want(t, "SELECT id, row_number() OVER (PARTITION BY k ORDER BY v NULLS FIRST, id) FROM t")


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ranks(heavy, t, keys):
    got = ordered.ranked(heavy.select("id", "k", "v"), keys, "v").select("id", "rank", F.round("average_rank", 3), F.round("share", 6))
    w = f"({'PARTITION BY k' if keys else ''} ORDER BY v)"
    assert rows(got) == want(t, f"SELECT id, rank() OVER {w}, round(rank() OVER {w} + (count(*) OVER (PARTITION BY {'k, ' if keys else ''}v) - 1) / 2, 3), round(cume_dist() OVER {w}, 6) FROM t WHERE v IS NOT NULL")


def test_a_heavy_tie_is_dealt_out(heavy):
    many = heavy.where("v is not null").select("id", "v")
    joined = relational.salted(many, many.select("v").distinct(), ["v"], F.xxhash64("id"), 100)
    assert joined.count() == many.count()
    assert "__part" in joined._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("block", [1 << 15, 50])
def test_one_series(heavy, t, block):
    made = {"mean": F.avg("v"), "n": F.count("v"), "next": F.lead("v"), "last": F.lag("v", 2)}
    got = ordered.moving(heavy.select("id", "c", "v"), ["c", "id"], made, 4, 1, block)
    w = "ORDER BY c, id"
    sql = f"SELECT id, round(avg(v) OVER ({w} ROWS BETWEEN 4 PRECEDING AND 1 FOLLOWING), 6), count(v) OVER ({w} ROWS BETWEEN 4 PRECEDING AND 1 FOLLOWING), lead(v) OVER ({w}), lag(v, 2) OVER ({w}) FROM t"
    assert rows(got.select("id", F.round("mean", 6), "n", "next", "last")) == want(t, sql)


def test_windows_longer_than_a_block_and_than_the_series(heavy, t):
    got = ordered.moving(heavy.select("id", "v"), ["id"], {"s": F.sum("v"), "n": F.count(F.lit(1))}, 700, 0, 10)
    assert rows(got.select("id", F.round("s", 3), "n")) == want(t, "SELECT id, round(sum(v) OVER w, 3), count(*) OVER w FROM t WINDOW w AS (ORDER BY id ROWS 700 PRECEDING)")
    got = ordered.moving(heavy.limit(3).select("id"), ["id"], {"n": F.count(F.lit(1))}, 9, 9, 5)
    assert [r["n"] for r in got.collect()] == [3, 3, 3]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_frontiers(heavy, t, keys):
    got = ordered.frontier(heavy, keys, "c", "v", "id").select("id")
    by = "PARTITION BY k" if keys else ""
    assert rows(got) == want(t, f"SELECT id FROM t WHERE v IS NOT NULL QUALIFY v > coalesce(max(v) OVER ({by} ORDER BY c, v DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)")


@pytest.mark.parametrize("few, bins", [(4096, 2048), (5, 8), (1, 3)])
def test_quantiles(heavy, t, few, bins):
    at = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = ordered.quantiles(heavy, ["k"], "v", at, bins, few)
    q = {(k, a): x for k, a, x in (tuple(r) for r in got.collect())}
    for k, xs in t.execute(f"SELECT k, quantile_cont(v, {at}) FROM t GROUP BY k").fetchall():
        assert [q[k, a] for a in at] == pytest.approx(xs, rel=1e-12)
    assert len(q) == 7 * len(at)


def test_quantiles_of_extremes(spark):
    values = [1e308, -1e308, 0.0, 5e-324, 1.0, 1.0, 1.0, float("inf"), float("nan"), None, 2.0]
    df = spark.createDataFrame([(x,) for x in values], "v double")
    got = {r["at"]: r["quantile"] for r in ordered.quantiles(df, [], "v", [0.0, 0.5, 1.0], 4, 1).collect()}
    assert got == {0.0: -1e308, 0.5: 1.0, 1.0: 1e308}
    assert ordered.quantiles(df.limit(0), [], "v", [0.5]).count() == 0


def test_places_need_no_window_over_rows(spark, heavy):
    """The largest task holds a range, whatever its key: two thirds of the rows share one."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = ordered._parted(heavy.select("id", "k", "v"), ["k"], ["v", "id"])
        assert max(r["count"] for r in placed.groupBy("__part").count().collect()) < 9000 / 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_first_rows_of_a_stratum_are_kept_before_the_exchange(heavy, t):
    order = [F.md5(F.col("id").cast("string")), F.col("id")]
    got = ordered.bottom(heavy, ["k"], order, 20)
    assert rows(got.select("id", "k")) == want(t, "SELECT id, k FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY md5(id::VARCHAR), id) <= 20")
    assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


# samples of task suites


def plain_stratified(rows, targets, seed="42"):
    """The rule on plain lists: quota and remainder by category, refill and trim by a second draw."""
    import hashlib

    draw = lambda s, k: (hashlib.md5(f"{s}:{k}".encode()).hexdigest(), k)
    out = []
    for level, want in targets.items():
        mine = [(i, "unknown" if c is None else c) for i, lv, c in rows if lv == level]
        cats = sorted({c for _, c in mine})
        if not cats:
            continue
        share = max(1, want // len(cats))
        first, rest = [], []
        for n, c in enumerate(cats):
            own = sorted((i for i, x in mine if x == c), key=lambda i: draw(seed, i))
            quota = share + (n < want - share * len(cats))
            first += own[:quota]
            rest += own[quota:]
        again = lambda i: draw(seed + "+", i)
        out += (sorted(first, key=again) + sorted(rest, key=again))[:want]
    return sorted(out)


@pytest.mark.parametrize("targets", [{"a": 12, "b": 5, "c": 30, "none": 4}, {"a": 3, "b": 200}, {"a": 1}])
def test_stratified(spark, targets):
    rng = random.Random(len(targets))
    data = [(i, rng.choice("aaaabc"), rng.choice([None, "x", "y", "y", "y", f"z{i % 9}"])) for i in range(700)]
    df = spark.createDataFrame(data, "id long, level string, cat string")
    got = suite.stratified(df, "level", "cat", "id", targets)
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == plain_stratified(data, targets)


# containment


KEYS = ["", "a", "é", "bc", "the cat", "the cat sat", "one two three four five six seven eight nine ten eleven twelve", "three  four five six seven eight nine ten eleven twelve thirteen fourteen",
        " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(5, 40)), "w1 w2", None, "x" * 30, "zzz", "the cat"]


@pytest.mark.parametrize("few", [500, 0])
def test_containment(spark, few):
    rng = random.Random(2)
    texts = [None, "", "a", "abc", "the cat sat on the mat", "xx" * 20, KEYS[6] + " thirteen", "zero " + KEYS[6], "x" + KEYS[6] + "y", KEYS[6].replace(" ", "\t"), KEYS[7], "and " + KEYS[8] + " end", KEYS[9]]
    texts += [" ".join(rng.choice(["w1", "w2", "the", "cat", "é", KEYS[9]]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [KEYS[8]] * 20
    t = spark.createDataFrame([(i if i else None, x, 1) for i, x in enumerate(texts)], "tid long, text string, kid int")
    k = spark.createDataFrame([(i, x) for i, x in enumerate(KEYS)], "kid int, word string")
    got = containment.pairs(t.select("tid", "text"), "tid", "text", k, "kid", "word", few)
    expect = [(i if i else None, j) for i, x in enumerate(texts) for j, y in enumerate(KEYS) if x is not None and y is not None and y in x]
    assert rows(got) == sorted(map(str, expect))
    assert containment.pairs(t.limit(0), "tid", "text", k, "kid", "word", few).count() == 0
    assert containment.pairs(t, "tid", "text", k.limit(0), "kid", "word", few).columns == ["tid", "kid"]


def test_containment_compares_no_text_with_every_key(spark):
    t = spark.createDataFrame([(i, f"text {i} " + KEYS[8] + f" tail {i}") for i in range(200)], "tid long, text string")
    k = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, 40))) for i in range(6)], "kid int, word string")
    got = containment.pairs(t, "tid", "text", k, "kid", "word", hot=10)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 1200 and "Cross" not in plan and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_first_match(spark):
    t = spark.createDataFrame([(1, "what is the capital of france"), (2, "largest"), (3, "nothing here"), (4, None)], "tid long, text string")
    k = spark.createDataFrame([(3, "capital of france", "Paris"), (1, "largest ocean", "Pacific"), (2, "capital", "?")], "ord int, word string, answer string")
    assert rows(containment.first_match(t, "tid", "text", k, "ord", "word", either=True).select("tid", "answer")) == sorted(["(1, '?')", "(2, 'Pacific')", "(3, None)", "(4, None)"])
