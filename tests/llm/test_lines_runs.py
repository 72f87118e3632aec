"""Line dedup and periodic runs beside brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import oracle
from quern.llm import line_dedup, runs

SPACE = " \t\n\v\f\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_lines(rows, least_length=40, least_documents=5):
    key = lambda line: line.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_length:
                held[key(line)].add(float("-inf") if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        me = float("-inf") if i is None else i
        keep = [x for x in lines if len(held.get(key(x), ())) < least_documents or max(held[key(x)]) == me]
        out.append((i, len(lines), len(lines) - len(keep), sha("\n".join(keep))))
    return sorted(out, key=str)


def made_rows():
    rng = random.Random(5)
    shared = [f"{'  ' * (k % 2)}Shared line number {k} that is long enough to count as one " + "é" * (k % 3) for k in range(12)]
    rows = []
    for i in range(60):
        lines = [rng.choice(shared).swapcase() if rng.random() < 0.2 else rng.choice([*shared, "", "short", f"own {i} " + "x" * rng.randint(30, 45)]) for _ in range(rng.randint(0, 12))]
        rows.append((i, "\n".join(lines)))
    common = "a line that stands in a third of all documents, many times over"
    rows += [(1000 + i, f"{common}\n\t{common} \n{common.upper()}") for i in range(700)]
    rows += [(1000, "another text of the same doc_id\n" + common), (None, common), (None, None), (5, ""), rows[3], rows[3]]
    return rows + [(None, shared[0]), (-4, "\n".join(shared))]


def test_lines_against_brute_force(spark):
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((tuple(r) for r in line_dedup.report(docs).collect()), key=str)
    assert got == brute_lines(rows)
    assert line_dedup.hot_keys(line_dedup.lines(docs)).count() == 1  # the common line is judged apart, the others in the stream
    assert sorted((tuple(r)[:3] for r in line_dedup.keep_bitmaps(docs).collect()), key=str) == sorted((r[:3] for r in got), key=str)


def test_bitmaps_give_the_texts(spark):
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"keep": line_dedup.F.lit(1), "row": line_dedup.F.lit(2), "n_chars": line_dedup.F.lit(0)})
    out = line_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    want = {(i, h) for i, _, _, h in brute_lines(rows)}
    assert {(r["doc_id"], sha(r["text"] or "")) for r in out.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)


def test_line_dedup_corners(spark, odd, empty):
    assert line_dedup.report(odd).count() == odd.count()
    assert line_dedup.deduplicate(odd).columns == odd.columns
    assert line_dedup.report(empty).count() == 0
    assert sorted((tuple(r) for r in line_dedup.report(odd).collect()), key=str) == brute_lines([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_keys_tell_apart_what_lower_casing_would_join(spark):
    """Only A-Z is lower-cased: É, the Kelvin sign, İ and lead bytes that differ by 32 stay what they are."""
    tail = " and a common rest of the line that is long enough to count"
    heads = ["É", "é", "K", "k", "K", "İ", "i", "Ñandú", "ñandú", "\u00c9x", "\u3069x", "\ud7a3", "Ω", "ω", "Ω", "ß", "ẞ"]
    lines = [h + tail for h in heads] + [h + tail.upper() + " \x0b" for h in heads]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(line_dedup.line_key(line_dedup.F.col("line"))).collect()
    want = [x.strip(SPACE).translate({c: c + 32 for c in range(65, 91)}) for x in lines]
    assert all((a == b) == (x == y) for (a,), x in zip(got, want) for (b,), y in zip(got, want))


def test_line_dedup_stays_in_one_exchange_of_lines(spark, sf):
    """The stream runs on the range partitions; its windows ask for no exchange of their own."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = line_dedup.dropped(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan and "Python" not in plan


def test_line_dedup_sql(spark, sf):
    from quern.llm import queries

    assert oracle.compare(spark, oracle.connect(sf), sf, queries.op11_line_dedup, line_dedup.ORACLE_SQL) is None


def brute_runs(w, exponent=4, shortest=6):
    n, out = len(w), {}
    for p in range(1, n // exponent + 1):
        x = 0
        while x < n - p:
            if w[x] != w[x + p]:
                x += 1
                continue
            y = x
            while y < n - p and w[y] == w[y + p]:
                y += 1
            if y - x + p >= max(shortest, exponent * p):
                out.setdefault((x, y + p), p)
            x = y
    return sorted((a, z, p) for (a, z), p in out.items())


def made_words(rng, longest):
    out, n, letters = [], rng.randint(0, longest), rng.choice([1, 2, 3, 6])
    while len(out) < n:
        if out and rng.random() < 0.3:
            a = rng.randrange(len(out))
            out += out[a : rng.randint(a + 1, len(out))] * rng.randint(1, 6)
        else:
            out.append(rng.randrange(letters))
    return out[:longest]


@pytest.mark.parametrize("exponent, shortest", [(4, 6), (2, 2), (3, 1), (4, 1), (2, 6)])
def test_runs_against_brute_force(exponent, shortest):
    rng = random.Random(exponent * 10 + shortest)
    for _ in range(200):
        docs = [made_words(rng, 90) for _ in range(rng.randint(1, 5))]
        words, doc = np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        want, at = [], 0
        for d in docs:
            want += [(a + at, z + at, p) for a, z, p in brute_runs(d, exponent, shortest)]
            at += len(d)
        assert [tuple(x) for x in runs.all_runs(words, doc, exponent, shortest).tolist()] == sorted(want, key=lambda r: (r[0], r[2]))


def test_factors_and_blocks_against_brute_force():
    rng = random.Random(3)
    for _ in range(100):
        w = made_words(rng, 50)
        s = runs.Suffixes(np.array(w, np.int64), np.zeros(len(w), np.int64))
        assert s.order.tolist() == sorted(range(len(w)), key=lambda i: w[i:])
        common = lambda i, j: next((k for k in range(len(w) - j) if w[i + k] != w[j + k]), len(w) - j)
        length, source = s.previous()
        assert length.tolist() == [max((common(i, j) for i in range(j)), default=0) for j in range(len(w))]
        assert all(not n or common(i, j) == n and i < j for j, (n, i) in enumerate(zip(length.tolist(), source.tolist())))


def test_one_word_repeated_and_a_long_text():
    n = 200_000
    assert runs.all_runs(np.zeros(n, np.int64), np.zeros(n, np.int64)).tolist() == [[0, n, 1]]
    w = np.tile(np.arange(777), 50)[:30_000]
    assert runs.all_runs(w, np.zeros(len(w), np.int64)).tolist() == [[0, 30_000, 777]]


def brute_report(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
    found = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    gone = {j for a, z, p in found for j in range(a + p, z)}
    best = max(found, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2]), default=None)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (i, len(found), *top, sha("".join(f"{a},{z - a},{p}\n" for a, z, p in found)), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))


def test_run_report(spark, odd, empty, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " \t".join(f"w{x}" for x in made_words(rng, 80))) for i in range(150)] + [(2, "a b"), (2, "a b"), (None, "x " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in runs.report(docs).collect()), key=str) == sorted((brute_report(*r) for r in rows), key=str)
    rows = [(r["doc_id"], r["text"] if len(r["text"] or "") < 5000 else None) for r in odd.collect()]
    small = odd.withColumn("text", runs.F.when(runs.F.length("text") < 5000, runs.F.col("text")))
    assert sorted((tuple(r) for r in runs.report(small).collect()), key=str) == sorted((brute_report(*r) for r in rows), key=str)
    assert runs.report(odd).count() == odd.count()
    assert runs.report(empty).count() == runs.find(empty).count() == runs.collapse(empty).count() == 0
    texts = {r["doc_id"]: r["text"] for r in runs.collapse(spark.createDataFrame([(1, "go " * 8 + "on"), (2, None)], "doc_id long, text string")).collect()}
    assert texts == {1: "go on", 2: ""}
    assert [tuple(x) for x in runs.find(spark.createDataFrame([(1, "on " + "go to " * 5)], "doc_id long, text string")).first()["runs"]] == [(1, 10, 2)]
