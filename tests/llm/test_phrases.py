"""Collocations beside brute force and SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import oracle
from quern.llm import phrases


def brute(rows, least=30, longest=4, share=80, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        cand = {g: a for g, a in count.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in cand.items():
            if any(len(x) > len(g) and 100 * b >= share * a and any(x[i : i + len(g)] == g for i in range(len(x))) for x, b in cand.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (count[g[:k]] + count[g[k:]]), k, count[g[:k]], count[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def texts(seed, docs, words):
    rng = random.Random(seed)
    vocabulary = ["the", "New", "york", "city", "é", "ſ", "K", "x\x1cy", "\x00", "of", "don't", "a-b"]
    for i in range(docs):
        w = []
        while len(w) < rng.randint(0, words):
            w += rng.choice([["New", "York", "City", "hall"], ["of", "the"], [rng.choice(vocabulary)]])
        yield rng.choice(["en", "de", None, "und", ""]), "".join(x + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "!\r\n"]) for x in w)


@pytest.mark.parametrize("least, longest, share, top", [(3, 4, 80, 2000), (30, 4, 80, 2000), (2, 3, 60, 7), (5, 2, 80, 2000), (2, 5, 100, 50)])
def test_against_brute_force(spark, least, longest, share, top):
    rows = list(texts(least, 80, 60)) + [("en", "very common pair " * 400), (None, None), ("en", "")]
    rows += rows[:3]
    docs = spark.createDataFrame([(i, t, lang, 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n long").repartition(5)
    got = phrases.mine(docs, least, longest, share, top)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, longest, share, top)
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string"} | {c: "bigint" for c in ("rank", "a", "l", "r", "n", "score")}


def test_small_chunks_and_tables(spark, monkeypatch):
    """Counts are those of the whole however the texts are cut, and a full table of bits only costs work."""
    rows = list(texts(1, 60, 80))
    docs = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")
    want = brute(rows, 3)
    monkeypatch.setattr(phrases, "CHUNK", 50)
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert sorted(tuple(r) for r in phrases.mine(docs, 3).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scores_beyond_64_bits(spark):
    big = 10**15
    table = spark.createDataFrame([([1], 3 * big), ([2], 4 * big), ([3], big + 1), ([1, 2], big), ([2, 3], big), ([1, 2, 3], big - 1)], "w array<long>, n long")
    got = {tuple(r["w"]): (r["l"], r["r"], r["score"]) for r in phrases.scored(table).collect()}
    cut = lambda a, l, r: (l, r, 2_000_000 * a // (l + r))
    assert got == {(1, 2): cut(big, 3 * big, 4 * big), (2, 3): cut(big, 4 * big, big + 1), (1, 2, 3): cut(big - 1, 3 * big, big)}
    assert {tuple(r["w"]) for r in phrases.covered(table).collect()} == {(1, 2), (2, 3)}


def test_growth_keeps_what_stands_at_the_borders():
    w = np.array([[1, 2, 3, 0], [1, 2, 3, 4], [1, 2, 5, 6], [1, 2, 5, 7], [2, 3, 4, 9], [9, 9, 9, 9]], np.int64)
    n = np.array([1, 1, 10, 20, 2, 1])
    got = {tuple(w[r][:k]): c for rows, k, total in phrases.grow(w, n, 30) for r, c in zip(rows.tolist(), total.tolist())}
    assert got[1, 2, 5] == 30 and got[9, 9, 9] == got[9, 9, 9, 9] == 1 and got[1, 2, 3] == 2 and (2, 3, 4) not in got and (1, 2, 5, 6) not in got


def test_corners(spark, odd, empty):
    assert phrases.mine(empty).count() == 0
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert sorted(tuple(r) for r in phrases.mine(odd, 2, 3).collect()) == brute(rows, 2, 3)


def test_sql(spark, sf):
    from quern.llm import queries

    assert oracle.compare(spark, oracle.connect(sf), sf, queries.op13_phrases, phrases.ORACLE_SQL) is None
