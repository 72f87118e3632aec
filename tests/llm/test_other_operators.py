"""Nearest neighbours, url filters and the pipeline."""

import hashlib
import itertools
import re

import duckdb
import numpy as np
import pytest

from quern.llm import ann, url_filter


def test_hilbert_is_a_walk():
    for n, bits in ((2, 3), (3, 2), (5, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        key = ann.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("cell", [8192, 40])
def test_nearest_is_exact(spark, cell, monkeypatch):
    monkeypatch.setattr(ann, "CELL", cell)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 512 if cell > 100 else 3)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    x[50:80] = x[50]
    x[300:] += 40 * rng.standard_normal((3, 8))[rng.integers(0, 3, 300)].astype(np.float32)  # clusters, which bounds tell apart
    df = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, score double").repartition(4)
    got = [tuple(r) for r in ann.search(df, every=50).orderBy("query_id", "rank").collect()]
    v, want = x.astype(np.float64), []
    for q in range(0, 600, 50):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(600), d)) if j != q][:10]
        want += [(q, i + 1, int(j), float(d[j])) for i, j in enumerate(order)]
    assert got == want


def test_odd_vectors(spark):
    rows = [(0, None), (100, [0.0, 0.0]), (200, [1.0, 2.0]), (200, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [float("nan"), 1.0]), (3, [1.0, None]), (300, [1.0]), (None, [1.0, 1.0]), (5, [1.0, 2.5]), (4, [1.0, 2.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(df).orderBy("query_id", "rank").collect()] == [(200, 1, 1, 0.0), (200, 2, 4, 0.0), (200, 3, 5, 0.5)]
    assert ann.search(df.limit(0)).collect() == []


URLS = [None, "", "x", "HTTP://A.Spam.ORG", "a://b.c/en/?x://y", "http://Example.com/en/x", "http://www.EXAMPLE.com/en/", "http://x.net/fr/a#b", "http://x.net?fr/", "https://casino-win.org/", "https://good.org/", "://", "http://bets.org:80/"]


@pytest.mark.parametrize("max_bits", [1 << 20, 1 << 9])
def test_url_filter(spark, max_bits, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARDS_A_PASS", 2)
    hosts = [f"https://h{i}.{'spam' if i % 3 == 0 else 'fine'}.org/p" for i in range(400)]
    df = spark.createDataFrame([(i, u, "", "", "x") for i, u in enumerate(URLS + hosts + hosts[:50])] + [(None, "http://a.com/", None, None, None)], "page_id long, url string, html string, host string, verdict string")
    pages = df.select("page_id", "url").toArrow()  # noqa: F841
    want = duckdb.sql(url_filter.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in url_filter.judge(df, max_bits=max_bits).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert url_filter.judge(df.limit(0)).count() == 0

def test_empty_host_is_allowed_whatever_the_list(spark):
    key = url_filter.F.col("host")
    names = spark.createDataFrame([("",)] + [(f"s{i}.casino.org",) for i in range(400)], "host string")
    at = {r.host: set(r.p) for r in names.select("host", url_filter.F.array(*url_filter.BloomCascade._positions(key, 0, 64, 4)).alias("p")).collect()}
    listed = {next(h for h in at if h and p in at[h]) for p in at[""]}  # together they set every bit of the empty host
    urls = [None, "no scheme", *(f"http://{h}/" for h in sorted(listed))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(pages).orderBy("page_id").collect()] == ["allow"] * 2 + ["block"] * len(listed)


def plain_redact(text):
    """Personal data masked kind after kind, with plain regular expressions and sums."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    luhn = lambda d: sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def iban(m):
        plain = m.group().replace(" ", "")
        return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1

    def ssn(m):
        near = (m.string[max(0, m.start() - 40) : m.start()] + " " + m.string[m.end() : m.end() + 20]).lower()
        if re.search("^(000|666|9)|-00-|-0000$", m.group()):
            return False
        return bool(re.search(r"\b(ssn|social security|social)\b", near)) and not re.search(r"\b(part|serial|order)\b", near)

    kinds = [
        ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("IP", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        ("CARD", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))),
        ("PHONE", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m.group())) <= 15),
        ("IBAN", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", iban),
        ("SSN", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ssn),
    ]
    for kind, pattern, ok in kinds:
        text = re.sub(pattern, lambda m: f"[{kind}]" if ok(m) else m.group(), text or "")  # noqa: B023
    return text


def test_pipeline_beside_brute_force(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    P = pytest.importorskip("public_tokenizers")
    from test_text_operators import plain_groups, plain_mix
    from tokenizers import Tokenizer

    from quern.llm import bpe, toxicity

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    data = sorted((r.doc_id, r.text, r.source) for r in docs.collect() if model.score(*toxicity.features(r.text)) < 0.5)
    groups = plain_groups([t for _, t, _ in data])
    kept = [(i, plain_redact(t), s) for k, (i, t, s) in enumerate(data) if groups[k] == k]
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t))) for i, t, s in kept]
    block = max(1, min(256, int(1.5 * sum(n for _, _, n in sized)) // 65536))
    taken = plain_mix(sized, block)[1]
    library, want = Tokenizer.from_file(P.path(bpe.DEFAULT_VOCABULARY)), []
    for (i, t, _), (_, _, n), took in zip(kept, sized, taken):
        start = lambda k: t[: [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)][k - 1]]  # noqa: B023, E731
        parts = [t] * (took // n if n else 0) + ([start(took % n)] if n and took % n else [])
        want += [(i, hashlib.sha256(" ".join(map(str, library.encode(p, add_special_tokens=False).ids)).encode()).hexdigest()) for p in parts]
    got = [(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()]
    assert len(got) > 100 and sorted(got) == sorted(want)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "bpe"]


def test_stages_take_an_odd_table(spark, sf, odd):
    """Nulls, ties, repeated rows and clashing columns, through all stages; each operator's test has the empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "bpe":
            assert docs.columns == odd.columns
            docs = spark.createDataFrame(docs.collect(), odd.schema)
    rows = docs.collect()
    assert len(rows) > 3 and all(r.n_tokens > 0 for r in rows)
