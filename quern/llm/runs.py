"""Periodic runs of words: suffix array, longest previous factors, blocks, boundary extensions and copied runs.

A run is a maximal stretch of words with a smallest period that it repeats often enough. Documents are worked on many at
a time, as arrays. Prefix doubling ranks all suffixes; its levels, which are kept, compare any two of them. The suffix
array and its LCP values give each position's longest previous factor, and walking these cuts a text into Lempel-Ziv
blocks. A run either touches a block's border, then its period is short beside the two blocks that meet there and the
period's equalities are extended to both sides (Main); or it lies strictly within a block, then it is a copy of a run of
the block's earlier occurrence, and is taken over from there, in rising order of buckets by start (Kolpakov, Kucherov).
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPONENT = 4
"""Times at least that a run holds its period."""

SHORTEST = 6
"""Words of a run at least."""

BATCH = 1 << 19
"""Words that are worked on together; a longer document is worked on alone."""


class Suffixes:
    """Suffix order of many texts at once, none of which matches over its end.

    words: numbers of the words, equal ones equal; doc: the text each belongs to, rising.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        n = self.n = len(words)
        key = doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
        rank = np.empty(n + 1, np.int32)  # place of the first suffix that begins alike; beyond the end: -1
        rank[order] = np.repeat(start, np.diff(np.r_[start, n]))
        rank[n] = -1
        self.levels = [rank]
        """levels[k] is equal for two positions where their next 2**k words are."""
        size = np.diff(np.r_[start, n])
        live = order[np.repeat(size > 1, size)]
        step = 1
        while len(live):
            rank = rank.copy()
            old = self.levels[-1]
            key = old[live].astype(np.int64) * (n + 2) + old[np.minimum(live + step, n)] + 1
            by = np.argsort(key, kind="stable")
            live, key = live[by], key[by]
            head = old[live]
            of = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
            place = np.arange(len(live)) - np.repeat(of, np.diff(np.r_[of, len(live)]))
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(live)])
            rank[live] = np.repeat((head + place)[first], size)
            self.levels.append(rank)
            live = live[np.repeat(size > 1, size)]
            step *= 2
        self.order = np.empty(n, np.int64)
        self.order[rank[:n]] = np.arange(n)

    def alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x on equal those from y on, for positions x < y or x > y."""
        n, top = self.n, np.full(len(x), -1, np.int64)
        live = np.arange(len(x))
        for k, level in enumerate(self.levels):
            live = live[level[x[live]] == level[y[live]]]
            if not len(live):
                break
            top[live] = k
        out = np.where(top >= 0, np.int64(1) << np.maximum(top, 0), 0)
        for k in range(int(top.max(initial=0)) - 1, -1, -1):
            at = np.flatnonzero(top > k)
            level = self.levels[k]
            out[at] += (level[np.minimum(x[at] + out[at], n)] == level[np.minimum(y[at] + out[at], n)]).astype(np.int64) << k
        return out

    def previous(self) -> tuple[np.ndarray, np.ndarray]:
        """Each position's longest previous factor, and where it stands (itself, where there is none)."""
        n, order = self.n, self.order
        lcp = np.zeros(n + 1, np.int64)  # of neighbours in the order
        if n > 1:
            near = np.flatnonzero(self.levels[0][order[1:]] == self.levels[0][order[:-1]])
            lcp[near + 1] = self.alike(order[near], order[near + 1])
        length, source = np.zeros(n, np.int64), np.arange(n)
        for side in (-1, 1):  # the nearest earlier position on each side of the order, and the LCP on the way there
            at = np.arange(n) + side
            least = lcp[:n].copy() if side < 0 else lcp[1:].copy()
            live = np.flatnonzero(least)
            while len(live):
                live = live[order[at[live]] > order[live]]
                step = at[live]
                least[live] = np.minimum(least[live], least[step])
                at[live] = at[step]
                live = live[least[live] > 0]
            better = np.flatnonzero(least > length[order])
            length[order[better]] = least[better]
            source[order[better]] = order[at[better]]
        return length, source


def blocks(length: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each takes its longest previous factor, or one word."""
    step, out, i = np.maximum(length, 1).tolist(), [], 0
    while i < len(step):
        out.append(i)
        i += step[i]
    return np.array(out, np.int64)


def _touching(s: Suffixes, begin: np.ndarray, border: np.ndarray, most: np.ndarray, exponent: int, shortest: int) -> np.ndarray:
    """(start, end, period) of the runs that touch a border and have a period of most at most.

    begin: where the border's text begins. A run of period p is a stretch of positions whose words equal those p further
    on; one that touches the border b has such a stretch beside b - p, or else beside b.
    """
    which = np.repeat(np.arange(len(border)), most)
    period = np.arange(len(which)) - np.repeat(np.cumsum(most) - most, most) + 1
    word, n, found = s.levels[0], s.n, []

    def same(x: np.ndarray, p: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = (x >= b) & (x + p < n)
        return ok & (word[np.where(ok, x, 0)] == word[np.where(ok, x + p, n)])

    for left in (True, False):
        at = border[which] - period if left else border[which]
        b = begin[which]
        keep = np.flatnonzero((at >= b) & (same(at, period, b) | same(at - 1, period, b)))
        at, p, b = at[keep], period[keep], b[keep]
        e = {i: same(at + i, p, b) for i in (-3, -2, -1, 0, 1, 2)}
        keep = (e[0] & (e[-1] | e[1])) | (e[-1] & e[-2])
        need = np.maximum((exponent - 1) * p, shortest - p)
        keep &= (need < 3) | (e[-1] & e[0]) | (e[0] & e[1] & e[2]) | (e[-1] & e[-2] & e[-3])
        keep |= (need < 2) & (e[0] | e[-1])
        at, p, b, need = at[keep], p[keep], b[keep], need[keep]
        right = np.where(at + p < n, s.alike(at, np.minimum(at + p, n)), 0)
        lo, hi = b.copy(), at.copy()  # the first position whose equality reaches the border
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            ok = s.alike(mid, mid + p[open_]) >= at[open_] - mid
            hi[open_] = np.where(ok, mid, hi[open_])
            lo[open_] = np.where(ok, lo[open_], mid + 1)
        ok = at - lo + right >= need
        found.append(np.stack([lo[ok], (at + right + p)[ok], p[ok]], axis=1))
    return np.concatenate(found)


def _copied(found: list[tuple[int, int, int]], starts: list[int], ends: list[int], sources: list[int]) -> list[tuple[int, int, int]]:
    """found, sorted, with the runs strictly within blocks: those of the blocks' earlier occurrences, moved."""
    for a, z, source in zip(starts, ends, sources):
        last = source + z - a - 1  # a copied run ends before the block's last word
        i = bisect.bisect_left(found, (source + 1, 0, 0))
        while i < len(found) and found[i][0] < last:
            start, end, p = found[i]
            if end <= last:
                bisect.insort(found, (start + a - source, end + a - source, p))
            i += 1
    return found


def all_runs(words: np.ndarray, doc: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST) -> np.ndarray:
    """(start, end, period) of all runs, by start, then period; end is exclusive, positions are those of words.

    words: numbers, equal for equal words; doc: the text that each belongs to, rising. exponent is 2 at least.
    """
    if not len(words):
        return np.zeros((0, 3), np.int64)
    s = Suffixes(words, doc)
    length, source = s.previous()
    block = blocks(length)
    size = np.diff(np.r_[block, len(words)])
    first = np.r_[True, doc[block[1:]] != doc[block[:-1]]]  # blocks at a text's beginning
    begins = block[first]
    of = np.cumsum(first) - 1
    before = np.where(first, 0, np.r_[0, size[:-1]])
    last = np.r_[np.flatnonzero(first)[1:] - 1, len(block) - 1]  # every text's end is a border, too
    border = np.r_[block[~first], block[last] + size[last]]
    most = np.r_[(size + before)[~first], size[last]] // (exponent - 1)
    touching = _touching(s, np.r_[begins[of[~first]], begins[of[last]]], border, most, exponent, shortest)
    if not len(touching):
        return touching
    touching = touching[np.lexsort((touching[:, 2], touching[:, 1], touching[:, 0]))]
    touching = touching[np.r_[True, (touching[1:, :2] != touching[:-1, :2]).any(axis=1)]]  # the smallest of a stretch's periods
    out: list[tuple[int, int, int]] = []
    owner = doc[touching[:, 0]]
    edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]).tolist()
    for a, z in zip(edges, [*edges[1:], len(touching)]):
        d = of[np.searchsorted(block, touching[a, 0], "right") - 1]
        lo, hi = np.searchsorted(block, begins[d]), last[d] + 1
        big = lo + np.flatnonzero(size[lo:hi] >= shortest + 2)
        out += _copied(list(map(tuple, touching[a:z].tolist())), block[big].tolist(), (block[big] + size[big]).tolist(), source[block[big]].tolist())
    table = np.array(out, np.int64)
    return table[np.lexsort((table[:, 2], table[:, 0]))]


class _Texts:
    """Documents that are worked on together."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.rows: list[tuple[int | None, list[bytes], np.ndarray | None]] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes | None, planted: bool) -> None:
        words = (text or b"").split()  # at space and U+0009-000D
        place = _planted(doc_id, len(words)) if planted else None
        self.rows.append((doc_id, words, place))
        self.size += len(words)

    def runs(self, exponent: int, shortest: int) -> Iterator[tuple[int | None, list[bytes], np.ndarray]]:
        """(doc_id, words, runs) of each document; positions count within it."""
        number, parts = self.number, []
        for _, words, place in self.rows:
            ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
            parts.append(ids if place is None else ids[place])
        doc = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        found = all_runs(np.concatenate(parts), doc, exponent, shortest)
        begin = np.cumsum([0, *map(len, parts)])
        cuts = np.searchsorted(found[:, 0], begin)
        for i, (doc_id, words, place) in enumerate(self.rows):
            own = found[cuts[i] : cuts[i + 1]] - np.array([begin[i], begin[i], 0])
            yield doc_id, words if place is None else [words[j] for j in place.tolist()], own


def _planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's rewritten documents: which word stands at each place of one in ten; None for the others."""
    import zlib

    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay when every run is left with its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def _each(docs: DataFrame, schema: str, row, planted: bool, exponent: int, shortest: int, *more: str) -> DataFrame:
    """row(doc_id, words, runs) of every document, as columns of the schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "array<struct<start:long,length:long,period:long>>": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))}
        types = [kinds[c.split(" ", 1)[1]] for c in schema.split(", ")]
        held = _Texts()

        def close() -> pa.RecordBatch:
            out = [row(*x) for x in held.runs(exponent, shortest)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                text = text.as_py()
                if held.rows and held.size + len(text or b"") // 4 > BATCH:
                    yield close()
                    held = _Texts()
                held.add(doc_id.as_py(), text, planted)
        if held.rows:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(work, schema)


def find(docs: DataFrame, exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, runs): each document's runs, by start, then period; a row for each row of docs.

    Words are runs of characters other than space and U+0009-000D, numbered from 0. A run has the period at least
    exponent times, shortest words at least, and no neighbouring word continues it. A null text counts as empty and has
    none; repeated rows and null ids are kept; other columns are ignored; an empty table gives an empty result.
    """
    def row(doc_id, words, found):
        return doc_id, [{"start": a, "length": z - a, "period": p} for a, z, p in found.tolist()]

    return _each(docs, "doc_id long, runs array<struct<start:long,length:long,period:long>>", row, False, exponent, shortest)


def collapse(docs: DataFrame, exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, text): the words that are left when every run keeps its first period, joined by a space; cases as in find."""
    def row(doc_id, words, found):
        keep = kept(len(words), found)
        return doc_id, b" ".join([w for w, k in zip(words, keep.tolist()) if k] if len(found) else words).decode("utf-8", "replace")

    return _each(docs, "doc_id long, text string", row, False, exponent, shortest)


def report(docs: DataFrame) -> DataFrame:
    """The query's columns: counts, the run of most periods, and digests of all runs and of the collapsed text.

    One document in ten, by the crc32 of its id, is rewritten to repeat itself first; a null id's is not. Cases as in find.
    """
    def row(doc_id, words, found):
        runs = [(a, z - a, p) for a, z, p in found.tolist()]
        best: tuple = (None,) * 4
        for a, n, p in runs:
            if best[0] is None or n * best[2] > best[1] * p:  # in order of start, then period: the first of equals stays
                best = (a, n, p, 1000 * n // p)
        text = b" ".join([w for w, k in zip(words, kept(len(words), found).tolist()) if k] if len(found) else words)
        listed = "".join(f"{a},{n},{p}\n" for a, n, p in runs).encode()
        return doc_id, len(runs), *best, hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest()

    columns = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _each(docs, columns, row, True, EXPONENT, SHORTEST)
