"""Collocations: contiguous phrases grown to the right from frequent prefixes, and scored against their best cut.

A phrase is frequent only if its parts are, so phrases are grown. Frequent words come first, then frequent pairs of them;
both counts are summed where the texts stand before they are exchanged, and a bit table of what is frequent, of bounded
size, goes to the next pass, where a false hit costs some work and changes no count. Each occurrence of a frequent pair
that a frequent pair continues is then a pointer into its prefix's projection: the prefix and the words that follow, up to
the length of the longest phrase. Projections are range-partitioned by prefix and sorted, so that a task holds the
projections of a range of prefixes and extends each to the right, depth first, by counting its sorted stretch and
descending only where the count suffices. A prefix that holds a large share of the corpus is cut between tasks; what stands
at a task's borders is returned with its partial count and summed. Words are 64-bit hashes, seeded by language, until
the results are named again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ordered import numbered

from ._common import cut
from .simhash import _scramble, crowded, salted

LEAST = 30
"""Occurrences of a phrase at least."""

LONGEST = 4
"""Words of a phrase at most; 2 at least."""

SHARE = 80
"""Percent of a phrase's occurrences that a longer one takes to replace it."""

TOP = 2000
"""Phrases returned for each language."""

SCALE = 2_000_000

CHUNK = 1 << 20
"""Words that are counted together before they are exchanged."""

MOST_BITS = 1 << 27
"""Bits of a table of frequent words or pairs (16 MB), which grows with their number until then."""

_BREAK, _NONE = b"\n", b""
_TABLE = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")


def tokens(text: bytes) -> list[bytes]:
    """Words, A-Z lower-cased, with line feeds where pieces end; empty strings are to be left out."""
    return text.lower().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")


class Frequent:
    """A table of bits that are set for all keys it was made of, and for few others."""

    def __init__(self, keys: DataFrame, n: int, most_bits: int = MOST_BITS):
        """keys: (key long), n of them."""
        self.width = max(10, min(most_bits.bit_length() - 1, (16 * n).bit_length()))
        place = F.shiftrightunsigned("key", 64 - self.width)
        words = keys.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
        got = words.toArrow()  # a 64th of the bits at most
        self.bits = np.zeros(1 << (self.width - 6), np.uint64)
        self.bits[got["w"].to_numpy()] = got["v"].to_numpy().view(np.uint64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> np.uint64(64 - self.width)
        return (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


class _Numbers(dict):
    """Words by their number, which is the next one where a word is new."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Chunk:
    """Documents' words as local numbers, for each language: 0 is a break, 1 nothing."""

    def __init__(self):
        self.known: dict[str, _Numbers] = {}
        self.parts: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.known:
            self.known[lang] = _Numbers({_BREAK: 0, _NONE: 1})
        found = tokens(text)
        ids = np.fromiter(map(self.known[lang].__getitem__, found), np.int64, len(found))
        self.parts.setdefault(lang, []).extend([ids[ids != 1], np.zeros(1, np.int64)])
        self.size += len(ids)

    def languages(self) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
        """(language, words by number, their hashes, the numbers with three breaks at the end)."""
        for lang, known in self.known.items():
            seed = xxhash.xxh3_64_intdigest(lang.encode())
            h = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in known), np.uint64, len(known))
            h[h == 0] = 1
            h[:2] = 0
            yield lang, list(known), h, np.concatenate([*self.parts[lang], np.zeros(LONGEST, np.int64)])


def _pass(docs: DataFrame, schema: str, types: list[pa.DataType], each) -> DataFrame:
    """each(language, words, hashes, numbers), a list of columns, of every chunk's languages."""
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
            for part in chunk.languages():
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(each(*part), types)], names)

        chunk = _Chunk()
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                chunk.add(lang.as_py(), text.as_py())
                if chunk.size >= CHUNK:
                    yield from close(chunk)
                    chunk = _Chunk()
        if chunk.known:
            yield from close(chunk)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return rows.mapInArrow(work, schema)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _scramble(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _words(lang: str, words: list[bytes], h: np.ndarray, ids: np.ndarray) -> list:
    n = np.bincount(ids, minlength=len(h))
    n[:2] = 0, n[2:].sum()  # the sum goes with no word
    return [[lang] * (len(h) - 1), [None, *(w.decode("utf-8", "replace") for w in words[2:])], h[1:].view(np.int64), n[1:]]


def _pairs(frequent: Frequent):
    def each(lang: str, words: list[bytes], h: np.ndarray, ids: np.ndarray) -> list:
        ok = frequent(h) & (h != 0)
        ok = ok[ids]
        at = np.flatnonzero(ok[:-1] & ok[1:])
        code, n = np.unique(ids[at] << 32 | ids[at + 1], return_counts=True)
        return [h[code >> 32].view(np.int64), h[code & 0xFFFFFFFF].view(np.int64), n]

    return each


def _windows(frequent: Frequent, longest: int):
    def each(lang: str, words: list[bytes], h: np.ndarray, ids: np.ndarray) -> list:
        here = h[ids]
        goes_on = np.flatnonzero((here[:-1] != 0) & (here[1:] != 0))
        ok = np.zeros(len(ids), bool)
        ok[goes_on] = frequent(_pair(here[goes_on], here[goes_on + 1]))
        at = np.flatnonzero(ok[:-1] & ok[1:])
        code, columns = np.zeros(len(at), np.int64), []
        alive = np.ones(len(at), bool)
        for k in range(longest):
            if k > 2:
                alive &= ok[at + k - 1]
            column = np.where(alive, ids[np.minimum(at + k, len(ids) - 1)], 0)
            columns.append(column)
            code = np.unique(code << 32 | column, return_inverse=True)[1].astype(np.int64)  # equal codes so far, equal words so far
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        return [*(h[c[first]].view(np.int64) for c in columns), n]

    return each


def grow(w: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(rows, length, counts): the extensions of pairs in a sorted stretch of projections, shorter ones before longer ones.

    w: a row for each pointer, 0 where it ends; n: how often it stands. Counts below least are left out and not
    extended, but for the first and the last, which may go on in another stretch.
    """
    rows = np.arange(len(w))
    for length in range(3, w.shape[1] + 1):
        rows = rows[w[rows, length - 1] != 0]
        if not len(rows):
            return
        part = w[rows, :length]
        start = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]).any(axis=1)])
        total = np.add.reduceat(n[rows], start)
        good = total >= least
        good[[0, -1]] = True
        yield rows[start[good]], length, total[good]
        rows = rows[np.repeat(good, np.diff(np.r_[start, len(rows)]))]


def _growing(longest: int, least: int):
    columns = [f"w{k + 1}" for k in range(longest)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            w = np.stack([b.column(k).to_numpy() for k in range(longest)], axis=1)
            for rows, length, total in grow(w, b.column(longest).to_numpy(), least):
                out = w[rows]
                out[:, length:] = 0
                yield pa.RecordBatch.from_arrays([*(pa.array(out[:, k]) for k in range(longest)), pa.array(total)], [*columns, "n"])

    return work


def _counted(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, word, h, n): frequent words, and with a null word each language's sum; and (w array<long>, n): all frequent phrases."""
    longs = lambda k: [pa.int64()] * k
    every = _pass(docs, "lang string, word string, h long, n long", [pa.string(), pa.string(), *longs(2)], _words)
    words = cut(every.groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= least)))
    known = words.where("word is not null")
    pairs = _pass(docs, "a long, b long, n long", longs(3), _pairs(Frequent(known.select(F.col("h").alias("key")), known.count())))
    pairs = cut(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    phrases = known.select(F.array("h").alias("w"), "n").unionByName(pairs.select(F.array("a", "b").alias("w"), "n"))
    if longest > 2:
        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_pair(*(c.to_numpy().view(np.uint64) for c in b.columns)).view(np.int64))], ["key"])

        frequent = Frequent(pairs.select("a", "b").mapInArrow(keys, "key long"), pairs.count())
        names = [f"w{k + 1}" for k in range(longest)]
        schema = ", ".join(f"{c} long" for c in [*names, "n"])
        projected = _pass(docs, schema, longs(longest + 1), _windows(frequent, longest))
        grown = projected.repartitionByRange(*names).sortWithinPartitions(*names).mapInArrow(_growing(longest, least), schema)
        long_ = grown.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        phrases = phrases.unionByName(long_.select(F.filter(F.array(*names), lambda x: x != 0).alias("w"), "n"))
    return words, cut(phrases)


def _looked_up(many: DataFrame, key: str, one: DataFrame, column: str, to: str, apart: Column) -> DataFrame:
    """many with one's column, by the key; keys that many rows ask for are dealt over several tasks."""
    small = one.select(F.col("w").alias(key), F.col(column).alias(to))
    return salted(many, small, key, apart, "inner", crowded(many, key, 1 << 16), 1 << 16)


def _exact(a: Column, digits: int = 19) -> Column:
    return a.cast(f"decimal({digits},0)")


def scored(phrases: DataFrame) -> DataFrame:
    """(w, a, l, r, score): the lowest-scoring cut of each phrase of two words or more, ties to the shortest first part."""
    cuts = phrases.where(F.size("w") > 1).select("w", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("w", F.lit(1), F.col("k")), "right": F.slice("w", F.col("k") + 1, F.size("w"))})
    for side, to in (("left", "l"), ("right", "r")):
        cuts = _looked_up(cuts, side, phrases, "n", to, F.xxhash64("w"))
    cuts = cuts.withColumns({"up": _exact(F.col("a")) * F.lit(SCALE), "down": _exact(F.col("l")) + _exact(F.col("r"))})
    least = cuts.groupBy("w").agg(F.first("a").alias("a"), F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("s"))
    return least.select("w", "a", "s.l", "s.r", "s.score")


def covered(phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """(w): phrases that a longer frequent one holds contiguously, and with at least the share of their occurrences."""
    at = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))))
    inner = phrases.where(F.size("w") > 2).select(F.explode(at).alias("w"), "n").groupBy("w").agg(F.max("n").alias("most"))
    both = inner.join(phrases, "w")
    return both.where(_exact(F.col("most")) * 100 >= _exact(F.col("n")) * share).select("w")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, then a, both falling, then phrase.

    Texts are lower-cased (A-Z) and cut into pieces at . , ; : ! ? and U+000A-000D, pieces into words at space and tab.
    a counts a phrase's occurrences within pieces, l and r those of the parts of its lowest-scoring cut, n all words of
    the language; the score is floor(2000000 * a / (l + r)). A null text counts as empty, a null lang is 'und'; repeated rows
    count each time; ties are broken by the phrase's UTF-8 bytes; other columns, doc_id among them, are ignored; an empty
    table gives an empty result.
    """
    words, phrases = _counted(docs, longest, least)
    kept = scored(phrases).join(covered(phrases, share), "w", "left_anti")
    names = words.where("word is not null").select(F.array("h").alias("w"), F.struct("lang", "word").alias("named"))
    spelled = kept.select("*", F.posexplode("w").alias("at", "h")).withColumn("h", F.array("h"))
    spelled = _looked_up(spelled, "h", names, "named", "named", F.xxhash64("w", "at"))
    columns = ["a", "l", "r", "score"]
    found = spelled.groupBy("w").agg(*[F.first(c).alias(c) for c in columns], F.first("named.lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "named.word"))).alias("words"))
    found = found.select("lang", F.array_join(F.transform("words", lambda x: x["word"]), " ").alias("phrase"), *columns)
    ranked = numbered(found, [F.col("score").desc(), F.col("a").desc(), "phrase"], ["lang"], "rank").where(F.col("rank") <= top)
    sums = words.where("word is null").select("lang", "n")
    return ranked.join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


ORACLE_SQL = r"""
WITH p AS (SELECT lang, piece, row_number() OVER () AS id FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, w[i : i + k - 1] AS g FROM w, LATERAL (SELECT unnest(range(1, 5)) AS k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
f AS (SELECT lang, k, g, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT lang, k, g, n AS a FROM f WHERE k > 1 AND n >= 30),
u AS (SELECT c.*, i, l.n AS l, r.n AS r, (2000000::HUGEINT * a // (l.n + r.n)::HUGEINT)::BIGINT AS score FROM c, LATERAL (SELECT unnest(range(1, k)) AS i)
  JOIN f l ON l.lang = c.lang AND l.k = i AND l.g = c.g[1 : i] JOIN f r ON r.lang = c.lang AND r.k = c.k - i AND r.g = c.g[i + 1 :]),
s AS (SELECT lang, k, g, a, l, r, score FROM u QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1),
b AS (SELECT lang, g[i : i + m - 1] AS g, max(a) AS most FROM c, LATERAL (SELECT unnest(range(2, k)) AS m), LATERAL (SELECT unnest(range(1, k - m + 2)) AS i) GROUP BY ALL),
v AS (SELECT s.* FROM s LEFT JOIN b USING (lang, g) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a),
n AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
o AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM v)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang)
QUALIFY rank <= 2000
"""
