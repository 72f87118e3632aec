"""Near-duplicates at the threshold: every link between shingle sets counts, none is left to fingerprints."""

import random
from pathlib import Path

import numpy as np
import pytest
from test_text_operators import plain_groups

from quern.llm import simhash


def edited(rng, words, texts, copies):
    """Bases and copies with some words replaced, so that many pairs lie about the threshold."""
    out = []
    for _ in range(texts):
        base = [rng.choice(words) for _ in range(rng.randint(30, 160))]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("chunk", "recall"), [(4096, 0.97), (8, 0.97), (4096, 0.01)])
def test_no_link_at_the_threshold_is_missed(spark, chunk, recall):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    texts = edited(rng, words, 40, 9)
    passage = " ".join(words[:7])
    texts += [f"{passage} {rng.choice(words)} {rng.choice(words)}" for _ in range(60)]  # a passage that is most of short texts
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicate(docs, chunk=chunk, recall=recall).collect()}
    assert kept == {i for i, r in enumerate(plain_groups(texts)) if r == i}


def test_prefixes_and_bounds_lose_no_similar_pair():
    rng = np.random.default_rng(5)
    tried = 0
    for _ in range(3000):
        n, t = int(rng.integers(1, 60)), float(rng.choice([0.5, 0.8, 0.9]))
        x = rng.integers(0, 1 << 62, n).astype(np.uint64)
        y = np.r_[x[rng.random(n) < rng.uniform(0.7, 1)], rng.integers(0, 1 << 62, int(rng.integers(0, 8))).astype(np.uint64)]
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        if not len(y) or both < t * (len(x) + len(y) - both) - 1e-9:
            continue
        tried += 1
        known = np.unique(rng.choice(x, min(len(x), 9)))
        common = known, rng.integers(32, 99, len(known))
        p, q = (simhash.prefix(simhash.rarest_first(s, common), t) for s in (x, y))
        key = next(k for k in p if k in q)
        bits = np.frombuffer(simhash.parities(x) + simhash.parities(y), np.uint64).reshape(2, -1)
        pos = np.array([p.tolist().index(key), q.tolist().index(key)])
        a, b, _ = simhash._sharing(t)(np.zeros(2, int), np.array([-1, -1]), bits, np.array([1, 2]), np.array([1, 2]), np.array([len(x), len(y)]), pos)
        assert (a.tolist(), b.tolist()) == ([2], [1])
    assert tried > 500


@pytest.mark.parametrize("few", [simhash.FEW_EDGES, 0])
def test_components_of_few_links_take_few_jobs(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW_EDGES", few)
    rng = random.Random(7)
    pairs = {(max(p), min(p)) for p in (rng.sample(range(-99, 400), 2) for _ in range(240))} | {(i + 1, i) for i in range(1000, 1040)}
    least = {}
    for _ in range(500):
        for a, b in pairs:
            least[a] = least[b] = min(least.get(a, a), least.get(b, b))
    spark.sparkContext.setJobGroup(f"few {few}", "")
    try:
        got = simhash.components(spark.createDataFrame(sorted(pairs), "a long, b long").repartition(5)).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"few {few}"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, got)) == sorted((k, v) for k, v in least.items() if k != v)
    assert not few or jobs <= 8


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_sets_are_not_stored_to_be_compared(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(11)
    base = [rng.choice("abcdefghij") + str(rng.randrange(5000)) for _ in range(20_000)]
    texts = []
    for i in range(24):
        copy = list(base) if i < 16 else [f"{w}{i}" for w in base]
        copy[rng.randrange(len(copy))] = f"only{i}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string")
    simhash.deduplicate(docs.limit(0)).collect()
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("part-*"))
    before = size()
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == [0, *range(16, 24)]
    assert size() - before < 24 * len(base) * 8 / 2  # half of the sets; prefixes are a fifth
