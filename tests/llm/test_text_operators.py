"""Operators on documents, on awkward rows and against brute force."""

import base64
import collections
import hashlib
import math
import random
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quern.llm import bpe, lm, media, mixing, pii, secrets, simhash, toxicity


def rows(df):
    return [r.asDict() for r in df.collect()]


# near-duplicates


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprint(odd):
    for r in odd.collect():
        assert simhash.fingerprint(r.text) == plain_fingerprint(r.text)


@pytest.mark.parametrize("chunk", [4096, 4])
def test_near_duplicates(spark, odd, chunk):
    rng = random.Random(chunk)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(200)) for _ in range(12)]
    near = [(100 + i, " ".join(w if rng.random() > 0.004 * (i % 5) else "zz" for w in rng.choice(texts).split())) for i in range(150)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    data = docs.collect()
    fps = [plain_fingerprint(r.text) for r in data]
    want = sorted((str(r.doc_id), f"{f:016x}", str(c)) for r, f, c in zip(data, fps, plain_components([r.doc_id for r in data], fps, 4)))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs, chunk=chunk).collect())
    assert got == want


def test_within_matches_popcount():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 64).astype(np.uint64)
    base[1::2] = base[::2] ^ np.uint64(0b1011)
    planes, full = simhash._planes(base.reshape(1, 64, 1)), np.array([np.uint64(0xFFFFFFFFFFFFFFFF)])
    for radius in (0, 2, 3, 4, 7):
        probe, lanes, _ = simhash.within(planes, full, base.reshape(64, 1), np.zeros(64, int), radius)
        got = {(int(p), k) for p, m in zip(probe, lanes) for k in range(64) if int(m) >> k & 1}
        assert got == {(i, j) for i in range(64) for j in range(64) if bin(int(base[i]) ^ int(base[j])).count("1") <= radius}


def test_wide_distances():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**63, (200, simhash.WORDS)).astype(np.uint64)
    fps[1::2] = fps[::2] ^ (rng.integers(0, 2**63, (100, simhash.WORDS)).astype(np.uint64) & rng.integers(0, 2**63, (100, simhash.WORDS)).astype(np.uint64) & rng.integers(0, 2**63, (100, simhash.WORDS)).astype(np.uint64))
    group = np.repeat([0, 1], 100)
    got = {(int(i), int(j)): int(d) for a, b, c in simhash._hits(group, np.full(200, -1), fps, 100) for i, j, d in zip(a, b, c)}
    bits = lambda i, j: int(np.bitwise_count(fps[i] ^ fps[j]).sum())
    assert got == {(i, j): bits(i, j) for i in range(200) for j in range(i + 1, 200) if group[i] == group[j] and bits(i, j) <= 100} and len(got) >= 90


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts, similarity=0.8):
    sets, root = [plain_shingles(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if (not x and not sets[j]) or len(x & sets[j]) >= similarity * len(x | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def near_copies(rng, texts, rates, words):
    out = []
    for _ in range(texts):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        out += [" ".join(base)] + [" ".join(rng.choice(words) if rng.random() < rate else w for w in base) for rate in rates]
    return out


@pytest.mark.parametrize("chunk", [4096, 16])
def test_deduplicate_finds_near_copies(spark, chunk):
    rng = random.Random(chunk)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    texts = near_copies(rng, 60, [0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.2], words)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicate(docs, chunk=chunk).collect()}
    want = {i for i, r in enumerate(plain_groups(texts)) if r == i}
    assert want <= kept and len(kept) <= len(want) * 1.02  # nothing similar is kept but by chance, nothing else is lost


def test_deduplicate(spark, odd, empty):
    kept = simhash.deduplicate(odd)
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted(set(ids)) and {3, 4, 6, 8, 9} <= set(ids) and 5 not in ids
    assert kept.columns == odd.columns
    assert simhash.deduplicate(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0
    data = [(1, "a b c", "x"), (1, "quite another text", "x"), (1, "a b c", "y"), (None, "a b c", "x"), (None, "no id here", "x"), (None, "no id here", "x"), (2, None, "x"), (3, "", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, row string")
    assert sorted((str(r.doc_id), str(r.text)) for r in simhash.deduplicate(docs).collect()) == [("1", "a b c"), ("1", "quite another text"), ("2", "None"), ("None", "no id here")]


def test_a_hot_key_is_dealt_out(spark):
    many = spark.createDataFrame([(i % 3 if i % 10 == 0 else 7, i) for i in range(400)], "k int, v int")
    one = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k int, w string")
    for how in ("inner", "left"):
        got = sorted(map(tuple, simhash.salted(many, one, "k", many["v"], how, simhash.crowded(many, "k", 50), 50).select("k", "v", "w").collect()), key=str)
        assert got == sorted(map(tuple, many.join(one, "k", how).select("k", "v", "w").collect()), key=str)


def test_tables_grow_with_the_corpus():
    assert len(simhash._tables(4, 10**6)) == 15 and len(simhash._tables(4, 10**11)) == 35
    rng = random.Random(3)
    for n in (0, 10**11):
        masks = [m & (1 << 64) - 1 for m in simhash._tables(4, n)]
        for _ in range(200):
            flip = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not m & flip for m in masks)


# personal data and secrets


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_pii(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m.group())]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


@pytest.fixture(scope="module")
def noise(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab@.%+-1234567890 ().é😀") for _ in range(150)) for _ in range(150)]
    texts += ["x@y.zz " * 700 + "1.2.3.4 " * 300, "a@b.c%x@d.e 1.2.3.4.5.6.7.8 001.002.3.255 4111 1111 1111 1111", "x" * 200_000, "9" * 20_000, "a@b" + ".c" * 5_000]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_pii(noise, odd, empty):
    for docs in (noise, odd):
        want = sorted((str(r.doc_id), digest(plain_pii(r.text))) for r in docs.select("doc_id", "text").collect())
        assert sorted((str(r.doc_id), r.base_sha256) for r in pii.report(docs).collect()) == want
    assert pii.report(empty).count() == 0


def test_pii_checks_and_context(spark):
    texts = ["iban GB82 WEST 1234 5698 7654 32", "iban GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789", "part 123-45-6789"]
    got = {r["doc_id"]: r["spans"] for r in rows(pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert got == {0: "iban:5:32", 1: "", 2: "ssn:4:15", 3: ""}


def test_redact(odd):
    got = {(r["doc_id"], r["n_chars"]): r["text"] for r in rows(pii.redact(odd))}
    assert any(t == "mail me: [EMAIL] or [PHONE]" for t in got.values())
    assert pii.redact(odd).columns == odd.columns and got[(None, None)] is None


def plain_secrets(text):
    kinds = [
        ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 32),
    ]
    found = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m)]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_secrets(spark, odd, empty):
    rng = random.Random(8)
    parts = ["token = \"abcd1234efgh\" ", "AKIA", "A1B2" * 5, "password:", "x" * 9, "0123456789abcdef" * 2, " ", "\n", "api_key='short' ", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(25)) for _ in range(120)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    want = sorted((str(r.doc_id), digest(plain_secrets(r.text))) for r in docs.collect())
    assert sorted((str(r.doc_id), r.base_sha256) for r in secrets.report(docs).collect()) == want
    assert secrets.report(empty).count() == 0


def test_weak_parts_need_partners():
    alone, pair = "client_id=web-7431", "client_id=web-7431 pass=hunter2x at https://db.example.com"
    assert secrets.scan(alone) == []
    assert {s.kind for s in secrets.scan(pair)} == {"client_id", "short_secret", "endpoint"}
    assert secrets.scan("client_id=web-7431" + " " * 500 + "pass=hunter2x") == []


def test_interval_join_matches_all_pairs():
    rng = random.Random(21)
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(0, 14)):
            s = rng.randint(0, 120)
            parts.append((rng.choice(["id", "secret", "endpoint"]), "k", s, s + rng.randint(1, 40)))
        parts.sort(key=lambda p: (p[2], p[3]))
        reach = rng.choice([0, 5, 30])
        want = [{r for r, _, s, e in parts if r != role and max(s - b, a - e) <= reach} for role, _, a, b in parts]
        assert secrets._interval_join(parts, reach) == want


def test_long_parts_are_whole():
    key = hashlib.sha512(b"key").digest()
    long = base64.b64encode(key).decode()
    assert len(long) == 88
    for part in (long, base64.b64encode(key * 4).decode()):
        text = f"client_id = abc1234 {part}"
        assert [(s.kind, text[s.start : s.end], s.linked) for s in secrets.scan(text)] == [("client_id", "client_id = abc1234", "secret"), ("random", part, "id")]
    text = f"user: {'u' * 90} pwd=abcdefgh https://{'h' * 300}.com"
    assert [text[s.start : s.end] for s in secrets.scan(text)] == [f"user: {'u' * 90}", "pwd=abcdefgh", f"https://{'h' * 300}.com"]


# toxicity


def test_toxicity(spark, odd, empty):
    rng = random.Random(2)
    clean = "the quick brown fox jumps over lazy dogs near rivers and hills".split()
    bad = "idiot moron scum pathetic worthless".split()
    data = [(i, " ".join(rng.choices(clean, k=30) + (rng.choices(bad, k=3) if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].held_out for i in held) and all(got[i].predicted == data[i][2] for i in held)
    odd_scores = rows(toxicity.score(odd, model))
    assert len(odd_scores) == odd.count() and all(0 <= r["score"] <= 1 for r in odd_scores)
    assert next(r for r in odd_scores if r["doc_id"] == 8)["predicted"] == 1
    assert toxicity.reject(odd, model).columns == odd.columns and 8 not in [r.doc_id for r in toxicity.reject(odd, model).collect()]
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


def test_toxicity_beside_a_plain_version(spark):
    """Posterior and scores of a small sample, from the formulas written out row by row."""
    rng = random.Random(6)
    clean, bad = "alpha beta gamma delta please thanks".split(), "zork blarg idiot scum".split()
    texts = [" ".join(rng.choices(clean, k=12) + (rng.choices(bad, k=rng.randint(1, 3)) if i % 4 == 0 else [])) for i in range(240)]
    labels = np.array([int(i % 4 == 0) if rng.random() > 0.05 else int(i % 4 != 0) for i in range(240)])
    rows = [toxicity.features(t) for t in texts]
    words, fixed = [h for h, _ in rows], np.array([v for _, v in rows])
    votes = toxicity.cast_votes(words, fixed, labels, toxicity.induce(words, labels))
    model = toxicity.LabelModel.fit(votes)
    got = model.posterior(votes)
    for i in range(len(texts)):
        odds = math.log(model.prior / (1 - model.prior))
        for j in range(votes.shape[1]):
            k = int(votes[i, j]) + 1
            odds += model.discount[j] * math.log(model.rates[1, k, j] / model.rates[0, k, j])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-50, min(50, odds)))), abs=1e-9)
    right = model.accuracy(votes.shape[1] - 1)
    assert 0.8 < right[0] <= 1 and 0.6 < right[1] <= 1
    judge = toxicity.train(words, fixed, labels)
    for t, (h, v) in list(zip(texts, rows))[:40]:
        odds = judge.bias + sum(float(judge.words[w]) for w in h) / math.sqrt(len(h)) + sum(float(judge.induced[w]) for w in h) + sum(float(a) * float(b) for a, b in zip(v, judge.votes))
        assert judge.score(h, v) == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-5)
    predicted = [judge.score(h, v) >= 0.5 for h, v in rows]
    assert sum(p == (i % 4 == 0) for i, p in enumerate(predicted)) >= 235  # the true class, whatever the noise of the labels


def test_toxicity_without_the_labels_vote():
    """The classifier learns the other voters' posterior, which finds what they know and is not the labels."""
    rng = random.Random(6)
    clean, bad = "alpha beta gamma delta please thanks".split(), "zork blarg idiot scum".split()
    toxic = np.array([int(i % 4 == 0) for i in range(240)])
    texts = [" ".join(rng.choices(clean, k=12) + (rng.choices(bad, k=rng.randint(1, 3)) if y else [])) for y in toxic]
    labels = np.where(np.array([rng.random() for _ in texts]) < 0.1, 1 - toxic, toxic)
    rows = [toxicity.features(t) for t in texts]
    words, fixed = [h for h, _ in rows], np.array([v for _, v in rows])
    alone = toxicity.train(words, fixed, labels, label_votes=False)
    assert not np.array_equal(alone.words, toxicity.train(words, fixed, labels).words)
    assert sum((alone.score(h, v) >= 0.5) == bool(y) for (h, v), y in zip(rows, toxic)) >= 230


def test_fit_takes_ties_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i % 50, "same text idiot" if i % 2 else "same text") for i in range(200)] + [(None, None), (51, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(i, 0) for i in range(50)] + [(51, 0)], "doc_id long, toxic int")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(a.words, b.words) and a.bias == b.bias
    few = toxicity.fit(docs, labels, chars=200)  # a bound on characters draws fewer rows, and still fits
    assert 0 <= few.score(*toxicity.features("same text idiot")) <= 1


# media


def test_media_round_trip(odd, empty):
    for payload in (b"", bytes(range(256)) * 40, b"\xff" * 9000, bytes(4032), bytes(4033)):
        avi = media.write_avi(payload)
        assert media.read_payload(avi) == payload
        for frame in media.parse_avi(avi)[0]:
            fast, slow = media.decode_frame(frame), media._decode_any(frame)
            assert np.array_equal(fast[0], slow[0]) and fast[1:3] == slow[1:3]
    for r in rows(media.report(odd)):
        text = next(x.text for x in odd.collect() if x.doc_id == r["doc_id"] and (x.doc_id is not None or len((x.text or "").encode()) == r["n_bytes"]))
        raw = (text or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert media.report(empty).count() == 0
    assert media.to_clips(media.to_avi(odd)).count() >= odd.count()


def test_damaged_files_stop_nothing(spark):
    whole = media.write_avi(bytes(range(256)) * 40)
    files = [whole, whole[: len(whole) // 2], b"", b"RIFF", None, whole[:60] + b"\xff" * 200 + whole[260:], b"no video"]
    got = collections.defaultdict(list)
    for r in media.to_clips(spark.createDataFrame([(i, None if f is None else bytearray(f)) for i, f in enumerate(files)], "doc_id int, avi binary")).collect():
        got[r.doc_id].append(r.clip)
    assert got[0] == [0, 1] and 4 not in got and all(got[i] == [None] for i in (2, 3, 6)) and set(got) <= {0, 1, 2, 3, 5, 6}


def test_media_features_are_the_pictures(spark):
    """The features, from pixels that an inverse cosine transform written out here gives."""
    rng = random.Random(12)
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.where(u == 0, math.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * math.pi / 16)
    for payload in (b"abc" * 64, bytes(rng.randrange(256) for _ in range(64 * 700)), b"\0" * 64 * 300 + bytes(rng.randrange(200, 256) for _ in range(64 * 300))):
        frames, _, us = media.parse_avi(media.write_avi(payload))
        light, hist = [], []
        for f in frames:
            coefficients, _, _, quant = media._decode_any(f)
            flat = coefficients.reshape(-1, 64).astype(float) * quant
            blocks = np.zeros((len(flat), 8, 8))
            for k, (r, c) in enumerate(media_zigzag()):
                blocks[:, r, c] = flat[:, k]
            pixels = np.clip(np.rint(basis.T @ blocks @ basis + 128), 0, 255)
            h = np.bincount((pixels.ravel() // (256 / media.BINS)).astype(int), minlength=media.BINS) / pixels.size
            hist.append(h)
            light.append(float(h @ ((np.arange(media.BINS) + 0.5) * 256 / media.BINS)))
        got = media.clips(media.write_avi(payload))
        starts = media.shots(np.array(hist))
        assert [c[1] for c in got] == [s * us // 1000 for s in starts]
        for (_, _, _, mean), a, b in zip(got, starts, [*starts[1:], len(frames)]):
            assert mean == pytest.approx(np.mean(light[a:b]), abs=0.5)


def media_zigzag():
    return sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))


def test_shots():
    flat, other = np.eye(media.BINS)[[3] * 10], np.eye(media.BINS)[[20] * 10]
    assert media.shots(np.concatenate([flat, other, flat])) == [0, 10, 20]
    assert media.shots(np.zeros((0, media.BINS))) == []


# language model


def plain_scores(data):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    docs = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in data]
    c, pairs = collections.Counter(), collections.Counter()
    for i, w in docs:
        if not held(i):
            c.update(w)
            pairs.update(zip([b"start", *w], w))
    total, types = sum(c.values()), len(c)
    base = [sum(math.log10((c[x] + 0.1) / (total + 0.1 * (types + 1))) for x in w) for _, w in docs]
    starts = sum(not held(i) for i, _ in docs)
    return docs, c, pairs, total, types, starts, base, held


def test_language_model(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 50)
    rng = random.Random(4)
    data = [(i, " ".join(rng.choices("a b c d e f g h".split(), [8, 7, 6, 5, 4, 3, 2, 1], k=rng.randint(0, 30)))) for i in range(200)] + [(r.doc_id, r.text) for r in odd.collect()]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score(docs).collect())
    tokens, c, _, total, _, _, base, held = plain_scores(data)
    assert got == sorted((str(i), held(i), len(w), sum(c[x] > 0 for x in w), total, round(b, 6)) for (i, w), b in zip(tokens, base))
    assert lm.score(empty).count() == 0


def test_tokens_of_a_chunk_are_a_group_alone(monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 3)
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "held_out": False, "text": "one two three"} for i in range(4)])
    bodies = []
    for task in range(3):
        monkeypatch.setattr("pyspark.TaskContext.get", lambda: types.SimpleNamespace(partitionId=lambda: task))
        bodies += [r for out in lm._counting(2, 2, 40)(iter([batch])) for r in out.to_pylist() if r["kind"] == 0]
    assert len({r["chunk"] for r in bodies}) == 12 and len({r["target"] for r in bodies}) == 12 and all(r["target"] < 0 for r in bodies)


def test_interpolation(spark, monkeypatch):
    data = [(i, t) for i, t in enumerate(["a b a", "b a", "a a c", "", None, "c b zz a", "a b c a b"] * 5)]
    tokens, c, pairs, total, types, starts, _, held = plain_scores(data)
    triples = collections.Counter(g for i, w in tokens if not held(i) for g in zip([b"start", b"start", *w], [b"start", *w], w))
    for order, given in ((2, [0.1, 0.3, 0.6]), (3, [0.1, 0.2, 0.3, 0.4])):
        monkeypatch.setattr(lm, "expectation_maximisation", lambda *a: np.tile(given, (lm.BUCKETS * 2, 1)))  # noqa: B023
        got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(data, "doc_id long, text string"), order).collect()}
        for i, w in tokens:
            want = 0.0
            for u, v, x in zip([b"start", b"start", *w], [b"start", *w], w):
                l0, l1, l2, l3 = [*given, 0.0][:4]
                before2, before3 = starts if v == b"start" else c[v], starts if v == b"start" else pairs[u, v]
                if not before3:
                    l2, l3 = l2 + l3, 0.0
                if not before2:
                    l1, l2 = l1 + l2, 0.0
                want += math.log10((l3 * triples[u, v, x] / before3 if l3 else 0) + (l2 * pairs[v, x] / before2 if l2 else 0) + l1 * c[x] / total + l0 / (types + 1))
            assert abs(got[i] - want) < 1e-9, (order, i)


@pytest.mark.parametrize("order", [2, 3])
def test_weights_are_those_of_ungridded_counts(spark, order, monkeypatch):
    rng, seen = random.Random(11), {}
    data = [(i, " ".join(rng.choices("a b c d e f g h i j".split(), [30, 20, 10, 5, 4, 3, 2, 1, 1, 1], k=rng.randint(0, 40)))) for i in range(300)]
    exact = lm.expectation_maximisation
    monkeypatch.setattr(lm, "expectation_maximisation", lambda *a: seen.setdefault("w", exact(*a)))
    lm.score(spark.createDataFrame(data, "doc_id long, text string"), order)
    tokens, c, pairs, total, types, starts, _, held = plain_scores(data)
    triples = collections.Counter(g for i, w in tokens if not held(i) for g in zip([b"start", b"start", *w], [b"start", *w], w))
    p, bucket = [], []
    for i, w in tokens:
        if held(i):
            continue
        for u, v, x in zip([b"start", b"start", *w], [b"start", *w], w):
            c2, c3 = ((starts if v == b"start" else n) - 1 for n in (c[v], pairs[u, v]))
            p.append([1 / (types + 1), (c[x] - 1) / (total - 1), (pairs[v, x] - 1) / c2 if c2 else 0.0, (triples[u, v, x] - 1) / c3 if c3 else 0.0][: order + 1])
            bucket.append(lm.BUCKETS + c3.bit_length() if order == 3 and c3 else c2.bit_length())
    want = lm._maximise(np.array(p), np.array(bucket), np.ones(len(p)), lm.ROUNDS)
    likelihood = lambda w: np.log10((np.array(p) * w[bucket]).sum(axis=1)).sum()
    assert likelihood(np.full_like(want, 1 / (order + 1))) < likelihood(seen["w"]) <= likelihood(want) + 1e-6
    assert likelihood(want) - likelihood(seen["w"]) < 0.001 * abs(likelihood(want))  # the grid loses next to nothing


def test_weights_prefer_what_predicts():
    span = 64 * lm.STEPS[2]
    sure, rare = 1, 1 + 10 * lm.STEPS[2]
    w = lm.expectation_maximisation(np.array([(3 * span + sure) * span + rare, (5 * span + 0) * span + rare]), np.array([1000.0, 1000.0]), 10**6, 2)
    assert w[3, 2] > 0.9 and w[5, 1] > 0.9 and np.allclose(w.sum(axis=1), 1)


# mixing


def plain_mix(data, block):
    """Words taken of each row by walking through the schedule, slot by slot."""
    sources = sorted({r[1] for r in data}, key=lambda s: (s is None, s))
    size = {s: sum(r[2] for r in data if r[1] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    goal, free = {}, set(sources)
    while free:
        left = 1.5 * sum(size.values()) - sum(goal.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * size[s]}
        goal.update({s: 2.0 * size[s] for s in over} if over else share)
        free -= over or free
    quota = {s: math.floor(goal[s] + 0.5) for s in sources}
    line = {s: [i for i, r in sorted(enumerate(data), key=lambda x: hashlib.md5(b"" if x[1][0] is None else str(x[1][0]).encode()).hexdigest()) if r[1] == s for _ in range(r[2])] * 2 for s in sources}
    at, taken, order, total = dict.fromkeys(sources, 0), [0] * len(data), [], sum(quota.values())
    for slot in range(-(-total // block)):
        x, low = (slot * mixing.GOLDEN) % mixing.PERIOD / mixing.PERIOD * float(total), 0
        for s in sources:
            if low <= x < low + quota[s]:
                words = line[s][at[s] : at[s] + block]
                at[s] += block
                order += words
                for i in words:
                    taken[i] += 1
            low += quota[s]
    return goal, taken, order


def test_mixing_walks_its_schedule(spark, monkeypatch):
    rng = random.Random(9)
    data = [(i, rng.choice(["a", "b", "ü", None, "c"]) if i % 3 else "a", rng.randint(0, 60)) for i in range(150)]
    docs = spark.createDataFrame([(i, s, " ".join(["w"] * n) or None) for i, s, n in data], "doc_id long, source string, text string")
    goal, taken, order = plain_mix(data, 1)
    got = {r["doc_id"]: r for r in rows(mixing.taken(docs))}
    for (i, s, n), want in zip(data, taken):
        assert got[i]["taken"] == want <= 2 * n and got[i]["target"] == pytest.approx(goal[s])
    first = list(dict.fromkeys(order))
    out = [r.doc_id for r in mixing.mix(docs).collect()]
    assert list(dict.fromkeys(out)) == [data[i][0] for i in first]  # the order in which the slots reach the documents


def test_mixing(odd, empty):
    got = rows(mixing.taken(odd))
    assert len(got) == odd.count()
    by = collections.defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    for rs in by.values():
        assert rs[0]["source_size"] == sum(r["size"] for r in rs) and abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 8
    assert sorted(map(str, got)) == sorted(map(str, rows(mixing.taken(odd.repartition(3)))))
    assert mixing.taken(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mix_takes_what_is_planned(odd):
    out = mixing.mix(odd)
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in out.select("text").collect())
    assert words == sum(r["taken"] for r in rows(mixing.taken(odd))) and out.columns == odd.columns


def test_mix_keeps_rows_that_differ_in_further_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", k, k) for k in "pqr"] + [(2, "d e", "t", "p", "x")] * 4 + [(4, "f", "u", "p", "x")] * 2, "doc_id long, text string, source string, extra string, row string")
    took = {(r["doc_id"]): 0 for r in rows(docs)}
    for r in rows(mixing.taken(docs)):
        took[r["doc_id"]] += r["taken"]
    out = rows(mixing.mix(docs))
    assert {i: sum(len(r["text"].split()) for r in out if r["doc_id"] == i) for i in took} == took
    assert {r["extra"] for r in out if r["doc_id"] == 1} == {"p", "q", "r"}


# tokens


@pytest.fixture(scope="module")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path(bpe.DEFAULT_VOCABULARY)


def test_bpe_is_the_library_s(spark, odd, empty, vocabulary):
    from tokenizers import Tokenizer

    library, codec, rng = Tokenizer.from_file(vocabulary), bpe.Codec(vocabulary), random.Random(6)
    texts = [r.text or "" for r in odd.collect()] + ["".join(rng.choice("aeiouthrns  .,!'0😀éßΣİ\n日") for _ in range(60)) for _ in range(400)] + ["".join(rng.choice("theinganrsoed") for _ in range(40)) for _ in range(400)]
    for t in texts:
        e = library.encode(t, add_special_tokens=False)
        assert codec.encode(t) == e.ids and codec.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect()]
    want = sorted((str(i), len(x), sha(" ".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in ids)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.report(odd, vocabulary).collect()) == want
    assert bpe.report(empty, vocabulary).count() == 0
    assert bpe.decode(bpe.encode(odd, vocabulary), vocabulary).count() == odd.count()
