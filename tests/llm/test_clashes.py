"""Wrong results of earlier rounds: repeated query ids, clashing helper names, and what bounds a cascade's levels."""

import numpy as np
import pytest

from quern.llm import ann, mixing, pii, simhash, url_filter


def test_a_repeated_query_id_gets_the_neighbours_of_its_smallest_vector(spark):
    rng = np.random.default_rng(8)
    rows = [(100, [-9.0, 0.0]), (100, [9.0, 0.0]), (200, [9.0, 0.1]), (200, [9.0, 0.1]), (300, [0.0, 1.0])]
    rows += [(1000 + 7 * i + (7 * i % 100 == 0), [9.0 + float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(0, 0.1, (300, 2)))]
    rows = [(i, v) for i, v in rows if i in (100, 200, 300) or i % 100]
    got = [tuple(r) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    want = []
    for q, v in ((100, [-9.0, 0.0]), (200, [9.0, 0.1]), (300, [0.0, 1.0])):
        best = {}
        for i, x in rows:
            if i != q:
                d = float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum()))
                best[i] = min(d, best.get(i, d))
        want += [(q, k + 1, i, d) for k, (i, d) in enumerate(sorted(best.items(), key=lambda e: (e[1], e[0]))[:10])]
    assert got == want


def test_long_vectors_get_fewer_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CENTRES", 8)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 1)
    rows = [(i, [float(i % 13), float(i % 7), 1.0, 2.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ann.search(df, every=10).count() == 200


CLASHES = ["__key string", "__all long", "__slot long", "__row long", "__r string", "__id long", "r string", "id long", "h string", "key string", "cut string", "all string", "best string", "row string", "__f_email string", "__G_Card int", "th long", "gone int", "hot int"]


@pytest.fixture(scope="module")
def clashing(spark):
    texts = [f"mail bob{i}@example.com now or pay " + " ".join(f"w{i}x{j}" for j in range(40)) for i in range(9)]
    rows = [(i, t, "en", f"s{i % 2}", len(t), *[f"{c}{i}" if "string" in c else i for c in CLASHES]) for i, t in enumerate([*texts, texts[0]])]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars int", *CLASHES]))


def test_columns_that_are_called_like_helpers_stay(clashing):
    rows = {r["doc_id"]: r for r in clashing.collect()}
    extra = [c.split()[0] for c in CLASHES]
    alone = simhash.deduplicate(clashing)
    assert alone.columns == clashing.columns and sorted(alone.collect()) == [rows[i] for i in range(9)]
    masked = pii.redact(clashing)
    assert masked.columns == clashing.columns and masked.count() == 10
    assert all("[EMAIL]" in r["text"] and [r[c] for c in extra] == [rows[r["doc_id"]][c] for c in extra] for r in masked.collect())
    mixed = mixing.mix(clashing)
    taken = {r["doc_id"] for r in mixing.taken(clashing).where("taken > 0").collect()}
    assert mixed.columns == clashing.columns and {r["doc_id"] for r in mixed.collect()} == taken != set()
    assert all([r[c] for c in extra] == [rows[r["doc_id"]][c] for c in extra] and rows[r["doc_id"]]["text"].startswith(r["text"]) for r in mixed.collect())


def test_equal_rows_are_taken_once(clashing):
    twice = clashing.unionByName(clashing)
    assert simhash.deduplicate(twice).count() == 9


def test_no_level_is_larger_than_allowed(spark):
    """Few listed keys among many: the unlisted ones that pass for listed count, too."""
    keys = spark.range(20_000).selectExpr("concat('host', id, '.org') as key", "id % 2000 = 0 as listed")
    cascade = url_filter.BloomCascade.build(keys, max_bits=1024)
    assert all(bits <= 1024 for levels in cascade.shards for bits, _ in levels) and len(cascade.shards) > 1
    assert cascade.mark(keys, "key", "found").where("found <> listed").count() == 0
    one = url_filter.BloomCascade.build(keys)
    assert len(one.shards) == 1 and one.mark(keys, "key", "found").where("found <> listed").count() == 0


def test_recall_is_a_parameter(spark):
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(words[: 300 - 3 * i]), i) for i in range(4)], "doc_id long, text string, n_chars int")
    assert [r.doc_id for r in simhash.deduplicate(docs, recall=0.999).collect()] == [0]
    for wrong in (0.0, 1.0):
        with pytest.raises(ValueError, match="recall"):
            simhash.deduplicate(docs, recall=wrong)
