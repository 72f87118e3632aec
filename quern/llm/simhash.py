"""SimHash near-duplicates: fingerprints, bit-sliced comparison within candidate buckets, components.

Fingerprints stand in vertical bit planes, 64 to a machine word; one word updates 64 distances through carry-save
counters, and a probe is abandoned as soon as all lanes of its block exceed the radius. Buckets hold few fingerprints;
those above ``CHUNK`` rows are dealt out as pairs of chunks over many tasks, and a bucket returns no more links than it
has rows, never its pairs. Keys with many rows are salted wherever rows are joined on them. Nothing but counts and short
lists of crowded keys reaches the driver.

Two searches use it. ``near_duplicates`` is exact in the distance of 64-bit fingerprints: two within ``radius`` bits agree
on at least two of six bit blocks (radius 4), or three of seven and so on in larger corpora, so each distinct fingerprint
enters one bucket for each such choice. ``deduplicate`` is exact in the similarity of shingle sets. Fingerprints of 512 bits
enter buckets by random choices of their bits, and each set is compared with the nearest it meets, which groups most
copies; then sets of different groups that share one of their rarest shingles are compared, which no similar pair
escapes. Bounds on what two sets can share spare most comparisons; no link is made or missed by a fingerprint.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window as W

from ._common import cut, trim

CHUNK = 4096
"""Rows of a bucket that one task compares; larger buckets are split into pairs of chunks."""

HOT = 512
"""Rows of a key from which on a join deals them out over several tasks."""

HOT_BROADCAST = 100_000
"""Most rows of the list of large buckets or keys that are broadcast; a longer list is joined by a shuffle."""

FEW_EDGES = 100_000
"""Most edges whose components one task finds, in a few MB; more take steps of joins."""

BUCKET = 512
"""Rows of a bucket that deduplicate aims at."""

WORDS = 8
"""Machine words of a wide fingerprint."""

RECALL = 0.97
"""Chance that a pair exactly at the threshold meets in a bucket of fingerprints; what does not is found by its shingles."""

OFTEN = 32
"""Texts that share a shingle from which on it counts as common."""

COMMON = 1 << 17
"""Most common shingles that are told to all tasks. They only set an order; any order finds the same pairs."""

COUNTED = 1_000_000
"""Shingles that a task counts at a time."""

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_NULL_BASE = 0x7000000000000000  # node ids of fingerprints whose documents all lack a doc_id


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of a text; 0 for a text without words (null included)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - words_per_shingle + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        length = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(length + 1) - 1
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a:b], 42) for a, b in zip((ends - length)[:n].tolist(), ends[words_per_shingle - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    packed = np.array(hashes, np.uint64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(packed[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """(doc_id, fp): one row for each row of docs; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words_per_shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64 * words, blocks) words: bit r of word [p, k] is bit p of row r of block k. fps: (blocks, 64, words)."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64).reshape(bits.shape[2], len(fps))


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save: three words in, their sum and their carry out."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def within(planes: np.ndarray, full: np.ndarray, queries: np.ndarray, blocks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Probe i asks which lanes of blocks[i] lie within radius (at most 127) of queries[i] (n, words).

    full holds each block's used lanes. Returns the probes with a hit, their lanes as bits, and the counters' planes.
    """
    size = max(3, radius.bit_length())
    over, probe = ~full[blocks], np.arange(len(queries))
    c = [np.zeros(len(queries), np.uint64) for _ in range(size)]
    step = 8 if len(planes) == 64 else 64
    for top in range(0, len(planes), step):
        for at in range(top, top + step, 8):
            x = [planes[k, blocks] ^ (((queries[:, k >> 6] >> np.uint64(k & 63)) & np.uint64(1)) * _ALL) for k in range(at, at + 8)]
            c[0], a = _add(c[0], x[0], x[1])
            c[0], b = _add(c[0], x[2], x[3])
            c[1], fours = _add(c[1], a, b)
            c[0], a = _add(c[0], x[4], x[5])
            c[0], b = _add(c[0], x[6], x[7])
            c[1], more = _add(c[1], a, b)
            c[2], carry = _add(c[2], fours, more)
            for i in range(3, size):
                c[i], carry = c[i] ^ carry, c[i] & carry
            over |= carry
        beyond = over.copy()  # lanes whose count is above the radius
        equal = np.full(len(queries), _ALL)
        for i in reversed(range(size)):
            if radius >> i & 1:
                equal &= c[i]
            else:
                beyond |= equal & c[i]
                equal &= ~c[i]
        over |= beyond
        alive = over != _ALL
        if not alive.all():
            over, probe, queries, blocks = (v[alive] for v in (over, probe, queries, blocks))
            c = [v[alive] for v in c]
        if not len(probe):
            break
    return probe, ~over, c


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of each index's component under the links a-b."""
    root = np.arange(n) if root is None else root
    while True:
        ra, rb = root[a], root[b]
        on = ra != rb
        if not on.any():
            return root
        np.minimum.at(root, np.maximum(ra[on], rb[on]), np.minimum(ra[on], rb[on]))
        while not np.array_equal(up := root[root], root):
            root = up


def _hits(group: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows within the radius, and their distances, in batches. Rows come sorted by group, then side; side -1: a
    whole bucket or chunk, compared with itself; 0 and 1: two chunks, compared with each other only."""
    n = len(fp)
    run = np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])]
    first = np.flatnonzero(run)
    at = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    start = np.flatnonzero(at % 64 == 0)
    block = np.cumsum(at % 64 == 0) - 1
    lane = at % 64
    rows = np.zeros((len(start), 64, fp.shape[1]), np.uint64)
    rows[block, lane] = fp
    full = np.zeros(len(start), np.uint64)
    np.bitwise_or.at(full, block, np.uint64(1) << lane.astype(np.uint64))
    planes = _planes(rows)
    g = np.r_[True, group[1:] != group[:-1]]
    last = np.r_[np.flatnonzero(g)[1:], n] - 1
    end = block[last][np.cumsum(g) - 1]  # each row's last block of its group
    begin = block.copy()  # each row's first block to probe
    crossing = side >= 0
    if crossing.any():
        other = np.flatnonzero(crossing & (side == 1) & np.r_[True, (side[1:] != side[:-1]) | (group[1:] != group[:-1])])
        where = dict(zip(group[other].tolist(), block[other].tolist()))
        begin[crossing] = [where.get(x, 1 << 60) for x in group[crossing].tolist()]
        begin[side == 1] = 1 << 60
    probes = np.maximum(end - begin + 1, 0)
    probes[(begin == end) & ~crossing & (lane + 1 == np.bitwise_count(full[block]))] = 0  # last row: no later lane
    rows_with = np.flatnonzero(probes)
    todo = np.cumsum(probes[rows_with])
    done, most = 0, 65536 // fp.shape[1]
    while done < len(rows_with):
        upto = max(done + 1, int(np.searchsorted(todo, (todo[done - 1] if done else 0) + most)))
        who = rows_with[done:upto]
        q = np.repeat(who, probes[who])
        b = begin[q] + np.arange(len(q)) - np.repeat(np.cumsum(probes[who]) - probes[who], probes[who])
        hit, lanes, counters = within(planes, full, fp[q], b, radius)
        own = b[hit] == block[q[hit]]  # in its own block a row looks at later lanes only
        later = _ALL << (lane[q[hit]].astype(np.uint64))
        lanes = np.where(own, lanes & (later ^ (np.uint64(1) << lane[q[hit]].astype(np.uint64))), lanes)
        k, l = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        away = sum(((c[k] >> l.astype(np.uint64)) & np.uint64(1)).astype(np.int64) << i for i, c in enumerate(counters))
        yield q[hit][k], start[b[hit][k]] + l, away
        done = upto


def _star(rep: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row of a component but its smallest, with the smallest."""
    low = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(low, root, rep)
    keep = rep != low[root]
    return rep[keep], low[root[keep]]


def _links(radius: int):
    """Stars over the links of at most radius bits inside each group: fewer than there are rows."""

    def find(group: np.ndarray, side: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((rep, side, group))
        group, side, fp, rep = group[order], side[order], fp[order], rep[order]
        root = np.arange(len(fp))
        for a, b, _ in _hits(group, side, fp, radius):
            root = _roots(len(fp), a, b, root)
        a, b = _star(rep, root)
        return a, b, np.zeros(len(a), np.int64)

    return find


def _nearest(radius: int):
    """Each row's nearest of its group with a smaller rep, within radius bits: no more than there are rows."""

    def find(group: np.ndarray, side: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((rep, side, group))
        group, side, fp, rep = group[order], side[order], fp[order], rep[order]
        n, none = len(fp), np.iinfo(np.int64).max
        best = np.full(n, none)
        for a, b, d in _hits(group, side, fp, radius):
            up = rep[a] > rep[b]
            np.minimum.at(best, np.where(up, a, b), d * n + np.where(up, b, a))
        a = np.flatnonzero(best < none)
        return rep[a], rep[best[a] % n], best[a] // n

    return find


def _sharing(similarity: float):
    """Pairs of rows of different groups that may be similar. A row is a set that has the bucket's shingle at pos in its
    order; n: the set's size; bits: its parities. Sets meet in the bucket of the first shingle they share."""

    def find(group: np.ndarray, side: np.ndarray, bits: np.ndarray, rep: np.ndarray, owner: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((rep, side, group))
        group, side, bits, rep, owner, n, left = (c[order] for c in (group, side, bits, rep, owner, n, n - pos))
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[first, len(group)])
        start, end = np.repeat(first, size), np.repeat(first + size, size)
        zero = np.repeat(np.add.reduceat((side == 0).astype(np.int64), first), size)
        begin = np.where(side < 0, np.arange(len(group)) + 1, np.where(side == 0, start + zero, end))
        todo = np.cumsum(end - begin)
        found, done = [np.zeros((3, 0), np.int64)], 0
        while done < len(group):
            upto = max(done + 1, int(np.searchsorted(todo, (todo[done - 1] if done else 0) + 200_000)))
            many = (end - begin)[done:upto]
            q = np.repeat(np.arange(done, upto), many)
            r = np.repeat(begin[done:upto], many) + np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)
            done = upto
            on = (owner[q] != owner[r]) & (np.minimum(left[q], left[r]) * (1 + similarity) >= similarity * (n[q] + n[r]) - 1e-6)
            q, r = q[on], r[on]
            d = np.bitwise_count(bits[q] ^ bits[r]).sum(axis=1, dtype=np.int64)  # the sets differ in as many shingles at least
            on = d * (1 + similarity) <= (1 - similarity) * (n[q] + n[r]) + 1e-6
            q, r, d = q[on], r[on], d[on]
            found.append(np.unique(np.stack([np.maximum(rep[q], rep[r]), np.minimum(rep[q], rep[r]), d]), axis=1))
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))

    return find


def _words(column: pa.Array) -> np.ndarray:
    """Fingerprints, a long or a binary of WORDS words each, as (n, words)."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _linker(find: Callable):
    """(a, b, d) that find returns for buckets; a batch has the bucket's t, key, lo and hi, a row's slot, what else find
    takes and the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            t, key, lo, hi, slot, *rest, fp = all_ = [np.concatenate(c) for c in zip(*held)]
            new = np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
            stop = len(t) if final else int(np.flatnonzero(new)[-1])
            group = np.cumsum(new) - 1
            held, rows = ([] if final else [tuple(c[stop:].copy() for c in all_)]), len(t) - stop
            size = np.bincount(group[:stop])
            on = size[group[:stop]] > 1
            if on.any():
                pick = lambda c: c[:stop][on]
                side = np.where(pick(lo) == pick(hi), -1, (pick(slot) == pick(hi)).astype(np.int64))
                found = find(pick(group), side, pick(fp), *map(pick, rest))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["a", "b", "d"])

        for batch in batches:
            *longs, words = batch.columns
            fp = _words(words)
            held.append((*(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in longs), fp))
            rows += batch.num_rows
            if rows >= 200_000 // fp.shape[1]:
                yield from flush(False)
        if held:
            yield from flush(True)
        trim()

    return run


def crowded(many: DataFrame, key: str, hot: int = HOT) -> DataFrame | None:
    """(key, __n): the keys with over hot rows of many, to be broadcast where they are few; None if there are none."""
    large = many.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot)
    few = large.limit(HOT_BROADCAST + 1).toArrow()  # key and count alone, and no more of them than that
    if len(few) <= HOT_BROADCAST:
        return F.broadcast(many.sparkSession.createDataFrame(few, large.schema)) if len(few) else None
    return cut(large)


def salted(many: DataFrame, one: DataFrame, key: str, apart: Column, how: str = "inner", large: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """many joined with one, which has a row for each key; the keys of crowded() are dealt over several tasks by the hash
    of apart, a column of many."""
    if large is None:
        return many.join(one, key, how)
    parts = F.coalesce(F.ceil(F.col("__n") / hot), F.lit(1)).cast("int")
    many = many.join(large, key, "left").withColumn("__part", F.pmod(F.xxhash64(apart), parts).cast("int")).drop("__n")
    one = one.join(large, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__n")
    return many.join(one, [key, "__part"], how).drop("__part")


def _tables(radius: int, n: int = 0, chunk: int = CHUNK) -> list[int]:
    """Bit masks (signed): every choice of k - radius of k blocks; fingerprints within the radius agree on one. k grows
    until n random fingerprints give buckets well under a chunk."""
    k = radius + 2
    while k < 12 and n * 4 > chunk << 64 * (k - radius) // k:
        k += 1
    edges = [round(64 * i / k) for i in range(k + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(x)) for x in combinations(block, k - radius)]


def _search(keys: DataFrame, find: Callable, chunk: int) -> DataFrame:
    """(a, b, d) that find returns for every bucket. keys: (t, key, fp) and the further longs that find takes."""
    rest = [c for c in keys.columns if c not in ("t", "key", "fp")]
    hot = cut(keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > chunk))
    large = hot.count()
    if large:
        hot = F.broadcast(hot) if large <= HOT_BROADCAST else hot
        keys = keys.join(hot, ["t", "key"], "left").withColumn("parts", F.coalesce(F.ceil(F.col("__n") / chunk), F.lit(1)).cast("int"))
        keys = keys.withColumn("slot", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"))
        keys = keys.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = keys.select("t", "key", F.least("slot", "j").alias("lo"), F.greatest("slot", "j").alias("hi"), "slot", *rest, "fp")
    else:
        zero = F.lit(0)
        keys = keys.select("t", "key", zero.alias("lo"), zero.alias("hi"), zero.alias("slot"), *rest, "fp")
    dealt = keys.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi")
    return dealt.mapInArrow(_linker(find), "a long, b long, d long")


def links(nodes: DataFrame, radius: int = 4, chunk: int = CHUNK, n: int = 0) -> DataFrame:
    """(a, b), b < a: stars that connect exactly the nodes connected by fingerprints at radius bits or fewer.

    nodes: (fp, rep), distinct in both, about n of them. radius: 0 to 7.
    """
    keys = nodes.select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(_tables(radius, n, chunk))])).alias("k"), "fp", "rep").select("k.t", "k.key", "fp", "rep")
    return _search(keys, _links(radius), chunk).select("a", "b").distinct()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """components() of the links of one task."""
    links = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches]
    if links:
        nodes, at = np.unique(np.concatenate(links, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        root = _roots(len(nodes), a, b)
        on = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(nodes[root[on]])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that has a link, other than its component's smallest, with that smallest node.

    Up to FEW_EDGES links meet in one task. More alternate large-star and small-star steps with joins and partial minima
    only, a node's many links dealt over several tasks; a step's edges are checkpointed. Steps add no edges.
    """
    edges = cut(edges)
    if edges.count() <= FEW_EDGES:
        return cut(edges.coalesce(1).mapInArrow(_grouped, "a long, b long"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hot = crowded(both, "a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted(both, least, "a", F.col("b"), "inner", hot).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted(large, least, "a", F.col("b"), "inner", hot)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges
        before = tuple(now)


def near_duplicates(docs: DataFrame, radius: int = 4, words_per_shingle: int = 4, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs.

    Words are runs other than space and U+0009-000D, A-Z lower-cased; shingles count with repeats. A null text
    counts as empty; texts without words share the fingerprint zero and link like any others. Rows without a
    doc_id take part; a component of such rows alone has a null component_id. Repeated rows each get a row.
    Columns other than doc_id and text are ignored; an empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, words_per_shingle))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    nodes = cut(nodes.select("fp", F.coalesce("rep", F.col("fp").bitwiseAND((1 << 60) - 1).bitwiseOR(F.lit(_NULL_BASE))).alias("rep")))
    roots = components(links(nodes, radius, chunk, nodes.count())).select(F.col("a").alias("rep"), "b")
    known = nodes.join(roots, "rep", "left").select("fp", F.coalesce("b", "rep").alias("component_id"))
    found = salted(fps, known, "fp", F.col("doc_id"), "left", crowded(fps, "fp"))
    owner = F.when(F.col("component_id") < _NULL_BASE, F.col("component_id"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), owner.alias("component_id"))


# similarity of shingle sets


def shingles(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles (the whole sequence, if it has fewer words; none without words)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(words_per_shingle, len(h))
    n = len(h) - k + 1
    mixed = np.full(n, len(h) if n == 1 else k, np.uint64)  # of fewer words than k, or as many: their number counts
    for i in range(k):
        mixed = _scramble(mixed + h[i : i + n])
    return np.unique(mixed)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of 64 * WORDS bits of a shingle set; zero of an empty one."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 16384):
        part = np.stack([_scramble(hashes[at : at + 16384] + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF)) for i in range(WORDS)], axis=1)
        counts += np.unpackbits(np.ascontiguousarray(part).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def _share(similarity: float) -> float:
    """The share of bits that differ, on average, between sets of one size with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _row(docs: DataFrame) -> Column:
    """A hash of all columns but maps: with doc_id it tells rows apart that are not equal."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)])


def common_shingles(texts: DataFrame, words_per_shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles that many rows of texts (text) share, ascending by hash, for an order of shingles: the
    counts leave out what a task sees once, and copies beside one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        rows = 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held.values()]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1], pa.int64())], ["h", "n"])

        for b in batches:
            for t in b.column(0):
                s = shingles(t.as_py(), words_per_shingle)
                if held.setdefault(xxhash.xxh3_64_intdigest(s), s) is s:
                    rows += len(s)
                if rows >= COUNTED:
                    yield flush()
                    rows = 0
        yield flush()
        trim()

    counts = texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    got = counts.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = got["h"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def rarest_first(s: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A sorted set by (count, hash), uncommon shingles first: an order of all shingles that is the same for every set."""
    known, counts = common
    if not len(known) or not len(s):
        return s
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    return s[np.lexsort((s, np.where(known[at] == s, counts[at], 0)))]


def prefix(s: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of an ordered set: so many that any set as similar shares one of them, the first it shares at all."""
    return s[: len(s) - max(1, math.ceil(similarity * len(s) - 1e-6)) + 1] if len(s) else s


def parities(s: np.ndarray) -> bytes:
    """For each of 64 * WORDS classes of shingles, whether the set has an odd number of them."""
    return np.packbits(np.bincount((s >> np.uint64(40)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1, bitorder="little").astype(np.uint8).tobytes()


def similar(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: float, words_per_shingle: int = 5, chunk: int = CHUNK, recall: float = RECALL, common: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(a, b): each node that is similar to another, other than its group's smallest, with that smallest node.

    nodes: (rep, fp, n, prefix, bits), distinct shingle sets with wide fingerprint, size, prefix and parities; texts: from
    rows (b, part, rep) to the same with rep's text, a row once at least; common: the shingles by which the prefixes are
    ordered. Every link is a comparison of two sets, made anew from their texts, which are smaller than the sets.
    Fingerprints propose the first ones: each node's nearest in the buckets that recall asks for. Prefixes propose all
    others between the groups that these make.
    """
    n, bits, p = nodes.count(), 64 * WORDS, _share(similarity)
    radius = min(127, int(bits * p + 2 * math.sqrt(bits * p * (1 - p))))
    width = max(4, math.ceil(math.log2(max(2, n / BUCKET))))
    meet = (1 - p) ** width
    tables = math.ceil(math.log(1 - recall) / math.log(1 - meet))
    rng = np.random.default_rng(11)
    chosen = [sorted(rng.choice(bits, width, replace=False).tolist()) for _ in range(tables)]
    often = np.zeros(0, np.uint64) if common is None else common[0]

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fp = np.unpackbits(_words(b.column(0)).view(np.uint8), axis=1, bitorder="little")
            for t, places in enumerate(chosen):
                key = fp[:, places].astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(key), b.column(0), b.column(1)], ["t", "key", "fp", "rep"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                rep, sets = b.column(0)[at : at + 1000].to_numpy(), [np.frombuffer(x.as_py(), np.uint64) for x in b.column(1)[at : at + 1000]]
                size = np.array([len(x) for x in sets])
                key = np.concatenate(sets)
                pos = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(rep, size)), pa.array(pos.astype(np.int32)), pa.array(np.isin(key, often))], ["key", "rep", "pos", "common"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs (rep, b) that are similar. Rows come by b, part and rep, that of b itself first; equal rows count once."""
        first, last, known = None, None, np.zeros(0, np.uint64)
        for batch in batches:
            b, x, texts = batch["b"].to_pylist(), batch["rep"].to_pylist(), batch["text"]
            found = []
            for i in range(batch.num_rows):
                if (b[i], x[i]) == last:
                    continue
                last = b[i], x[i]
                s = known if x[i] == first else shingles(texts[i].as_py(), words_per_shingle)
                if b[i] == x[i]:
                    first, known = b[i], s
                    continue
                both = len(np.intersect1d(known, s, assume_unique=True))
                if both >= similarity * (len(known) + len(s) - both) - 1e-9:
                    found.append(last)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (1, 0)], ["a", "b"])
        trim()

    def true(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar. The pairs of one b are a task's, or several tasks' where they are many; b's text
        goes to each of these once, and that of a once for each pair."""
        pairs = cut(pairs)
        if not pairs.head(1):
            return pairs
        large = crowded(pairs, "b", HOT)
        parts = F.lit(0) if large is None else F.pmod(F.xxhash64("a"), F.coalesce(F.ceil(F.col("__n") / HOT), F.lit(1))).cast("int")
        dealt = (pairs if large is None else pairs.join(large, "b", "left")).select("a", "b", parts.alias("part"))
        asked = dealt.select("b", "part", F.col("a").alias("rep")).unionByName(dealt.select("b", "part", F.col("b").alias("rep")).distinct())
        rows = texts(asked).select("b", "part", (F.col("rep") != F.col("b")).alias("other"), "rep", "text")
        return cut(rows.repartition("b", "part").sortWithinPartitions("b", "part", "other", "rep").mapInArrow(compared, "a long, b long"))

    def grouped(df: DataFrame, groups: DataFrame, key: str, name: str) -> DataFrame:
        return df.join(groups.select(F.col("a").alias(key), F.col("b").alias("__g")), key, "left").withColumn(name, F.coalesce("__g", key)).drop("__g")

    met = _search(nodes.select("fp", "rep").mapInArrow(spread_out, "t int, key long, fp binary, rep long"), _nearest(radius), chunk)
    links = true(met.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", "m.b"))
    groups = components(links)

    keys = nodes.select("rep", "prefix").mapInArrow(listed, "key long, rep long, pos int, common boolean")
    part = F.when(F.col("common"), F.pmod(F.xxhash64("rep"), F.lit(64))).otherwise(F.lit(0))  # a common one needs no count
    counted = keys.withColumn("c", F.count(F.lit(1)).over(W.partitionBy("key", part)))
    shared = cut(counted.where("common or c > 1").select("key", "rep", "pos"))
    holders = grouped(nodes.join(shared.select("rep").distinct(), "rep", "left_semi").select("rep", "n", F.col("bits").alias("fp")), groups, "rep", "owner")
    found = cut(_search(shared.join(holders, "rep").select(F.lit(0).alias("t"), "key", "fp", "rep", "owner", "n", "pos"), _sharing(similarity), chunk).distinct())
    if not found.head(1):
        return groups
    apart = grouped(grouped(found, groups, "a", "ga"), groups, "b", "gb")
    nearest = apart.groupBy(F.least("ga", "gb").alias("low"), F.greatest("ga", "gb").alias("high")).agg(F.min(F.struct("d", "a", "b")).alias("m")).select("m.a", "m.b")
    links = cut(links.unionByName(true(nearest)))  # the nearest of two groups first: most others need no comparison then
    groups = components(links)
    apart = grouped(grouped(found, groups, "a", "ga"), groups, "b", "gb").where("ga <> gb").select("a", "b")
    more = true(apart.join(nearest, ["a", "b"], "left_anti"))
    return components(links.unionByName(more)) if more.head(1) else groups


def deduplicate(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5, chunk: int = CHUNK, recall: float = RECALL) -> DataFrame:
    """docs with one row of each group of near-copies: that with the smallest doc_id, rows without one last.

    Two texts are near-copies if the Jaccard similarity of their sets of shingles is at least similarity; groups are closed
    under this, and no link is missed. recall: the share of pairs at the threshold that are looked for by fingerprints, before the
    others are found by shingles; the result does not depend on it. A null text counts as empty, and texts without words are copies of one another. Of equal rows, and of rows
    that differ in further columns only, one stays. Rows that share a doc_id but not their text are documents of their
    own. An empty table gives an empty result.
    """
    if not 0 < recall < 1:
        raise ValueError("recall lies between 0 and 1: buckets of random bits never make a pair certain")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, n, fps, prefixes, bits = [], [], [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), words_per_shingle)
                rep.append(xxhash.xxh64_intdigest(s, 42))
                n.append(len(s))
                fps.append(wide_fingerprint(s))
                prefixes.append(prefix(rarest_first(s, common), similarity).tobytes())
                bits.append(parities(s))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(rep, np.uint64).view(np.int64)), pa.array(n, pa.int32()), *(pa.array(x, pa.binary()) for x in (fps, prefixes, bits))], ["doc_id", "row", "rep", "n", "fp", "prefix", "bits"])
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row(docs).alias("row"), F.col("text").cast("string").alias("text"))
    common = common_shingles(rows, words_per_shingle)
    fps = rows.mapInArrow(sketch, "doc_id long, row long, rep long, n int, fp binary, prefix binary, bits binary")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "row")).alias("best")
    nodes = cut(fps.groupBy("rep").agg(best, *[F.first(c).alias(c) for c in ("n", "fp", "prefix", "bits")]))  # one for each set

    def texts(asked: DataFrame) -> DataFrame:
        """The asked nodes' texts; where they are few, the documents stay where they are."""
        known = nodes.select("rep", F.col("best.row").alias("row"), F.col("best.doc_id").alias("id"))
        wanted = cut(salted(asked, known, "rep", F.xxhash64("b", "part"), "inner", crowded(asked, "rep")))
        wanted = F.broadcast(wanted) if wanted.count() <= HOT_BROADCAST else wanted
        return rows.join(wanted, "row").where(F.col("id").eqNullSafe(F.col("doc_id"))).select("b", "part", "rep", "text")

    groups = similar(nodes, texts, similarity, words_per_shingle, chunk, recall, common)
    joined = nodes.select("rep", "best").join(groups.select(F.col("a").alias("rep"), "b"), "rep", "left")
    chosen = cut(joined.groupBy(F.coalesce("b", "rep").alias("g")).agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"), F.col("best.doc_id").alias("doc_id")))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col("doc_id").cast("long").alias("id"), _row(docs).alias("h"))
    kept = tagged.join(chosen, (tagged["h"] == chosen["row"]) & tagged["id"].eqNullSafe(chosen["doc_id"]), "left_semi")
    again = rows.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # equal rows
    if again.alias("a").join(chosen.alias("c"), F.expr("a.row = c.row and a.doc_id <=> c.doc_id"), "left_semi").head(1):
        kept = kept.dropDuplicates(["id", "h"])
    return kept.select(*[F.col(f"r.`{c}`").alias(c) for c in docs.columns])
