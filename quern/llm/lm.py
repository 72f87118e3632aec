"""Language-model scores by deleted interpolation.

Counts of words and of n-grams up to an order, taken over the whole training part, are mixed: for order 2
p(w | v) = l2 f(w | v) + l1 f(w) + l0 / (V + 1), for order 3 with l3 f(w | u v) before it. The weights go by the frequency
of the longest context that was seen, and are learned by expectation-maximisation on counts from which the token itself
is deleted.

Counting is one exchange. Each task packs its documents into chunks: a chunk's distinct words and n-grams go, as
sorted hashes with their training counts, to the task that owns that range of hashes; it adds the counts
of all chunks and sends each chunk's totals back in the order asked. A chunk's tokens travel beside as numbers,
in a group of their own. So no task holds the vocabulary, a frequent word or n-gram arrives once from a chunk, and
what is exchanged grows with the distinct n-grams of the chunks. Words are told apart by 64 bits of hash; n-grams by as
many as the corpus's characters take to number, and SPARE more, so that one in 2 ** SPARE at most shares its hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod, cut

FOLDS = 10
SMOOTH = 0.1
CHUNK_TOKENS = 2_000_000
"""Tokens after which a chunk is closed; a single longer document is a chunk of its own."""

BUCKETS = 20
"""Context buckets for each length of a context: bit length of its training count."""

STEPS = {2: 8, 3: 2}
"""Steps of the histogram grid in each doubling of a probability, by order."""

ROUNDS = 30
ORDER = 2
"""Words of the longest n-gram, 2 or 3. Order 3 needs more disk than the check tool allows (README)."""

SPARE = 16
"""Bits of an n-gram's hash beyond those that number the corpus's characters."""

_END, _START = b"\n", b"\n\n"  # no words: words hold no white space
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _pack(a: np.ndarray) -> bytes:
    """Integers, in planes of equal bytes, compressed."""
    small = next((t for t in (np.uint8, np.uint16, np.uint32) if not len(a) or int(a.max()) <= np.iinfo(t).max), np.uint64)
    raw = a.astype(small).view(np.uint8).reshape(-1, small().itemsize).T.tobytes()
    return bytes([small().itemsize]) + zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(b: bytes) -> np.ndarray:
    size = b[0]
    raw = zstandard.ZstdDecompressor().decompress(b[1:])
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(f"u{size}").ravel().astype(np.int64 if size < 8 else np.uint64)


def _gram_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _MIX[0] + b
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _before(places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What stands before each token, plus one; 0 at a document's start."""
    before = np.empty(len(places), np.int64)
    before[1:] = places[:-1] + 1
    before[np.cumsum(lengths) - lengths] = 0
    return before


def _grams(tokens: np.ndarray, lengths: np.ndarray, h: np.ndarray, order: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For pairs, then triples: hashes of the distinct ones, and each token's place among them (the n-gram it ends)."""
    out, places, known = [], tokens.astype(np.int64), h
    for n in range(2, order + 1):
        codes, which = np.unique(_before(places, lengths) << 32 | tokens.astype(np.int64), return_inverse=True)
        full = _gram_hash(np.r_[np.uint64(xxhash.xxh3_64_intdigest(_START * (n - 1))), known][codes >> 32], h[codes & 0xFFFFFFFF])
        out.append((full >> np.uint64(64 - bits), which))
        places, known = which, full
    return out


class _Chunk:
    """Documents' tokens as numbers of a local vocabulary."""

    def __init__(self):
        self.words: dict[bytes, int] = {_END: 0}
        self.rows: list[tuple[int | None, bool, int]] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, held_out: bool, text: str | None) -> None:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        known = self.words
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
        self.tokens += [ids, np.zeros(1, np.int32)]
        self.rows.append((doc_id, held_out, len(words) + 1))
        self.size += len(words) + 1

    def layout(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([n for _, _, n in self.rows], np.int64)
        return np.concatenate(self.tokens), lengths, np.array([h for _, h, _ in self.rows], bool), np.array([i for i, _, _ in self.rows], object)


def _counting(targets: int, order: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0

        def close(c: _Chunk) -> Iterator[pa.RecordBatch]:
            nonlocal serial
            name = task << 32 | serial
            serial += 1
            tokens, lengths, held, ids = c.layout()
            trained = np.repeat(~held, lengths)
            h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in c.words), np.uint64, len(c.words))
            often = np.argsort(-np.bincount(tokens, minlength=len(h)), kind="stable")  # frequent words get small numbers
            number = np.empty(len(h), np.int32)
            number[often] = np.arange(len(h), dtype=np.int32)
            tokens, h = number[tokens], h[often]
            out: list[tuple[int, int, int, bytes]] = []
            for kind, (key, which) in enumerate([(h, tokens), *_grams(tokens, lengths, h, order, bits)], 1):
                n = np.bincount(which[trained], minlength=len(key))
                by = np.argsort(key, kind="stable")
                key, n = key[by], n[by]
                owner = (key >> np.uint64((bits if kind > 1 else 64) - 32)).astype(np.int64) * targets >> 32
                edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(key) else np.array([], int)
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(key)]):
                    gaps = np.diff(key[a:b], prepend=np.uint64(0))
                    body = _pack(gaps)
                    out.append((int(owner[a]), name, kind, len(body).to_bytes(4, "little") + body + _pack(n[a:b])))
            seen = ",".join("" if i is None else str(i) for i in ids).encode()
            parts = [_pack(tokens), _pack(lengths), _pack(held.astype(np.uint8)), zstandard.ZstdCompressor(level=1).compress(seen), h.tobytes()]
            out.append((-1 - name, name, 0, b"".join(len(p).to_bytes(4, "little") + p for p in parts)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["target", "chunk", "kind", "body"])

        chunk = _Chunk()
        for b in batches:
            for i, held, text in zip(b.column(0), b.column(1), b.column(2)):
                chunk.add(i.as_py(), held.as_py(), text.as_py())
                if chunk.size >= CHUNK_TOKENS:
                    yield from close(chunk)
                    chunk = _Chunk()
        if chunk.rows:
            yield from close(chunk)

    return run


def _total(table: pa.Table) -> pa.Table:
    """One owner's hashes: every chunk's counts replaced by the totals. A chunk's tokens, a group alone, pass through."""
    target = table["target"][0].as_py()
    if target < 0:
        zero = lambda t: pa.array([0] * len(table), t)
        return pa.table([table["chunk"], table["kind"], zero(pa.int32()), zero(pa.int64()), zero(pa.int64()), table["body"]], names=["chunk", "kind", "part", "types", "tokens", "body"])
    chunk, kind, body = table["chunk"].to_pylist(), table["kind"].to_pylist(), table["body"].to_pylist()
    out: list[tuple[int, int, int, int, int, bytes]] = []
    for k in sorted({*kind}):
        rows = [i for i in range(len(kind)) if kind[i] == k]
        if not rows:
            continue
        keys, counts = [], []
        for i in rows:
            n = int.from_bytes(body[i][:4], "little")
            keys.append(np.cumsum(_unpack(body[i][4 : 4 + n]).astype(np.uint64), dtype=np.uint64))
            counts.append(_unpack(body[i][4 + n :]).astype(np.int64))
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        at = 0
        for j, (i, key) in enumerate(zip(rows, keys)):
            known = (int((total > 0).sum()), int(total.sum())) if j == 0 and k == 1 else (0, 0)
            out.append((chunk[i], k, target, *known, _pack(total[which[at : at + len(key)]])))
            at += len(key)
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["chunk", "kind", "part", "types", "tokens", "body"])


def _parts(body: bytes) -> list[bytes]:
    parts, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 4], "little")
        parts.append(body[at + 4 : at + 4 + n])
        at += 4 + n
    return parts


def _gathering(order: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        """One chunk: its tokens, its words' training counts, and those of the n-grams that each token ends."""
        rows = sorted(zip(table["kind"].to_pylist(), table["part"].to_pylist(), table["body"].to_pylist()), key=lambda r: r[:2])
        parts = _parts(rows[0][2])
        tokens, lengths = _unpack(parts[0]).astype(np.int64), _unpack(parts[1]).astype(np.int64)
        h = np.frombuffer(parts[4], np.uint64)
        counts = []
        for kind, (key, which) in enumerate([(h, None), *_grams(tokens, lengths, h, order, bits)], 1):  # totals come by rising hash
            total = np.empty(len(key), np.int64)
            total[np.argsort(key, kind="stable")] = np.concatenate([_unpack(b) for k, _, b in rows if k == kind])
            counts.append(_pack(total if which is None else total[which]))
        packed = [parts[0], *counts, parts[1], parts[2], parts[3]]
        known, total = sum(table["types"].to_pylist()), sum(table["tokens"].to_pylist())
        return pa.table([pa.array([known], pa.int64()), pa.array([total], pa.int64()), pa.array([b"".join(len(p).to_bytes(4, "little") + p for p in packed)], pa.binary())], names=["types", "tokens", "body"])

    return run


def _read(body: bytes, starts: int):
    """(counts, contexts, lengths, held-out flags, ids): counts of each token and of the n-grams it ends, by length, and
    of the contexts of those n-grams."""
    *packed, seen = _parts(body)
    tokens, words, *grams, lengths, held = (_unpack(p).astype(np.int64) for p in packed)
    counts, contexts = [words[tokens], *grams], []
    for c in counts[:-1]:
        context = np.empty_like(c)
        context[1:] = c[:-1]
        context[np.cumsum(lengths) - lengths] = starts
        contexts.append(context)
    ids = [int(i) if i else None for i in zstandard.ZstdDecompressor().decompress(seen).decode().split(",")]
    return counts, contexts, lengths, held.astype(bool), ids


def _bucket(contexts: list[np.ndarray]) -> np.ndarray:
    """The longest context that was seen, and the bit length of its count."""
    bucket = np.zeros(len(contexts[0]), np.int64)
    for n, c in enumerate(contexts):
        bucket = np.where(c > 0, n * BUCKETS + np.minimum(np.frexp(c.astype(np.float64))[1], BUCKETS - 1), bucket)
    return bucket


def _span(order: int) -> int:
    return 64 * STEPS[order]


def _grid(starts: int, total: int, order: int):
    """Training tokens by context bucket and by their estimates, the token itself deleted, on a log grid."""
    span, steps = _span(order), STEPS[order]

    def step(top: np.ndarray, low: np.ndarray | int) -> np.ndarray:
        near = np.minimum(1 + np.rint(-np.log2(np.maximum(top, 1) / np.maximum(low, 1)) * steps), span - 1)
        return np.where((top > 0) & (low > 0), near, 0).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column(0):
                counts, contexts, lengths, held, _ = _read(body.as_py(), starts)
                on = np.repeat(~held, lengths)
                counts, contexts = [c[on] - 1 for c in counts], [c[on] - 1 for c in contexts]
                cell = _bucket(contexts)
                for top, low in reversed(list(zip(counts, [total - 1, *contexts]))):
                    cell = cell * span + step(top, low)
                cells, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], ["cell", "n"])

    return run


def expectation_maximisation(cells: np.ndarray, n: np.ndarray, vocabulary: int, order: int = ORDER, rounds: int = ROUNDS) -> np.ndarray:
    """(buckets, order + 1): weights of the uniform, word, pair ... estimates for each context bucket."""
    span, steps = _span(order), STEPS[order]
    value = lambda s: np.where(s > 0, 2.0 ** (-(s - 1) / steps), 0.0)
    bucket = cells // span**order
    return _maximise(np.stack([np.full(len(cells), 1 / (vocabulary + 1)), *(value(cells // span**i % span) for i in range(order))], axis=1), bucket, n, rounds)


def _maximise(p: np.ndarray, bucket: np.ndarray, n: np.ndarray, rounds: int) -> np.ndarray:
    order = p.shape[1] - 1
    size = (order - 1) * BUCKETS
    weight = np.full((size, order + 1), 1 / (order + 1))
    for _ in range(rounds):
        share = p * weight[bucket]
        share *= (n / share.sum(axis=1))[:, None]
        new = np.stack([np.bincount(bucket, share[:, k], size) for k in range(order + 1)], axis=1) + 1e-3
        weight = new / new.sum(axis=1, keepdims=True)
    return weight


def _scoring(weight: np.ndarray, starts: int, total: int, vocabulary: int):
    base = np.log10(total + SMOOTH * (vocabulary + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column(0):
                counts, contexts, lengths, held, ids = _read(body.as_py(), starts)
                by = list(weight[_bucket(contexts)].T)
                # a context without counts hands its weight to the shorter one, and a model without tokens all of it to the uniform part
                for n in range(len(by) - 1, 1, -1):
                    seen = contexts[n - 2] > 0
                    by[n - 1], by[n] = np.where(seen, by[n - 1], by[n - 1] + by[n]), np.where(seen, by[n], 0.0)
                by[0], by[1] = (by[0], by[1]) if total else (by[0] + by[1], by[1] * 0)
                p = by[0] / (vocabulary + 1) + by[1] * counts[0] / max(total, 1)
                for n in range(2, len(by)):
                    p = p + by[n] * counts[n - 1] / np.maximum(contexts[n - 2], 1)
                at = np.cumsum(lengths) - lengths
                sums = [np.add.reduceat(x, at) for x in (np.log10(counts[0] + SMOOTH) - base, np.log10(p), (counts[0] > 0).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held), pa.array(lengths), pa.array(sums[2]), pa.array(np.full(len(ids), total, np.int64)), pa.array(sums[0]), pa.array(sums[1])], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row for each row of docs.

    Learns from the rows whose crc32 of doc_id is not 0 modulo FOLDS (a null doc_id counts among them). Words are
    runs other than space and U+0009-000D, A-Z lower-cased; each text ends with a token of its own; a null text
    counts as empty. The score is the interpolated model's log10 probability of the text, n-grams included; with
    no training rows all weight falls on the uniform part. Repeated rows each count; other columns are ignored.
    """
    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string"))
    starts = rows.where("not held_out").select("doc_id").agg(F.count(F.lit(1))).first()[0]
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    targets = max(1, size * order // 16_000_000)
    bits = min(64, max(40, math.ceil(math.log2(size + 1)) + SPARE))
    asked = rows.mapInArrow(_counting(targets, order, bits), "target long, chunk long, kind int, body binary")
    totals = asked.groupBy("target").applyInArrow(_total, "chunk long, kind int, part int, types long, tokens long, body binary")
    chunks = cut(totals.groupBy("chunk").applyInArrow(_gathering(order, bits), "types long, tokens long, body binary"))
    known = chunks.agg(F.sum("types").alias("v"), F.sum("tokens").alias("n")).first()
    vocabulary, total = known["v"] or 0, known["n"] or 0
    grid = chunks.select("body").mapInArrow(_grid(starts, total, order), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most a bucket times (64 * STEPS) ** order cells, far fewer in use
    weight = expectation_maximisation(grid["cell"].to_numpy(np.int64), grid["n"].to_numpy(np.float64), vocabulary, order)
    return chunks.select("body").mapInArrow(_scoring(weight, starts, total, vocabulary), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
