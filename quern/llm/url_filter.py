"""URL filtering: host and path rules, then exact list membership by a cascade of Bloom filters.

Level 0 encodes the listed keys; level 1 those unlisted keys of the corpus that pass level 0; level 2 those
listed keys that pass level 1; and so on until a level lets nothing false through. Over the complete universe
of the corpus's keys the first level that rejects a key tells its side without error, so urls are judged by
bit tests against literals, with no join. Built-in functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, cut

MAX_BITS = 1 << 25
"""Most bits of one level, which the driver gathers and which is carried as a literal (4 MB). Where the listed keys, or the
unlisted ones that pass for them, need more, the keys are dealt to several cascades by hash."""

SHARDS_A_PASS = 8
"""Cascades that one pass over the rows carries; more take further passes, each over its own share of the rows."""

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

# Words that put a host on the block list where a dot- or hyphen-separated part of it equals one.
BLOCK_WORDS = ("ads", "adult", "bet", "bets", "betting", "casino", "crack", "gambling", "loans", "malware", "phish", "pills", "poker", "porn", "sex", "spam", "torrent", "track", "viagra", "warez", "xxx")
BLOCK_PATTERN = rf"(^|[.-])({'|'.join(BLOCK_WORDS)})([.-]|$)"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ://."""
    part = lambda i: F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        of, _, rest = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


class BloomCascade:
    """Exact membership within a universe of keys. A key belongs to one of the shards, by hash; each has its levels."""

    def __init__(self, shards: list[list[tuple[int, str]]], hashes: int):
        self.shards, self.hashes = shards, hashes

    @staticmethod
    def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
        a, b = (F.pmod(F.xxhash64(key, F.lit(2 * level + i)), F.lit(bits)) for i in (0, 1))
        return [F.pmod(a + b * i, F.lit(bits)) for i in range(hashes)]

    @classmethod
    def _test(cls, key: Column, level: int, spec: tuple[int, str], hashes: int) -> Column:
        bits, words = spec
        array = F.split(F.lit(words), ",").cast("array<bigint>")  # folded to one literal when planned, which all hashes share
        at = F.array(*cls._positions(key, level, bits, hashes))
        return F.forall(at, lambda p: F.getbit(F.get(array, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1)

    @staticmethod
    def _shard(key: Column, shards: int) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards)), F.lit(0)) if shards > 1 else F.lit(0)

    @classmethod
    def _levels(cls, side: DataFrame, other: DataFrame, n: int, bits_per_key: int, hashes: int, max_bits: int) -> list[tuple[int, str]] | None:
        """None where a level, listed or not, would have over max_bits, a word's 64 at least."""
        levels: list[tuple[int, str]] = []
        while n:
            if n * bits_per_key > max(64, max_bits):
                return None
            bits = max(64, -(-n * bits_per_key // 64) * 64)
            at = F.explode(F.array(*cls._positions(F.col("key"), len(levels), bits, hashes))).alias("p")
            rows = side.select(at).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
            words = {r["w"]: r["v"] for r in rows.collect()}  # at most bits / 64 rows
            levels.append((bits, ",".join(str(words.get(w, 0)) for w in range(bits // 64))))
            side, other = other.where(cls._test(F.col("key"), len(levels) - 1, levels[-1], hashes)), side
            n = side.count()
        return levels

    @classmethod
    def build(cls, universe: DataFrame, bits_per_key: int = 10, hashes: int = 4, max_bits: int = MAX_BITS) -> BloomCascade:
        """universe: key string, listed boolean; null keys are left out, a key listed once counts as listed."""
        keys = cut(universe.where("key is not null").groupBy("key").agg(F.max("listed").alias("listed")))
        n = keys.where("listed").count()
        passing = 1.5 * (1 - math.exp(-hashes / bits_per_key)) ** hashes * (keys.count() - n)  # level 1: the unlisted that level 0 lets through
        shards = max(1, math.ceil(max(n, passing) * bits_per_key / max(64, max_bits)))
        while True:
            made = []
            for i in range(shards):
                own = keys.where(cls._shard(F.col("key"), shards) == i) if shards > 1 else keys
                side = own.where("listed")
                levels = cls._levels(side, own.where("not listed"), side.count() if shards > 1 else n, bits_per_key, hashes, max_bits)
                if levels is None:
                    break
                made.append(levels)
            else:
                return cls(made, hashes)
            shards += shards // 4 + 1  # a shard above the mean

    def contains(self, key: Column, first: int = 0, last: int | None = None) -> Column:
        """For keys of the universe, of the shards from first to before last; false for null."""
        out = F.lit(False)
        for i, levels in list(enumerate(self.shards))[first:last]:
            inside = F.lit(len(levels) % 2 == 1)
            for level in reversed(range(len(levels))):
                inside = F.when(self._test(key, level, levels[level], self.hashes), inside).otherwise(F.lit(level % 2 == 1))
            out = F.when(self._shard(key, len(self.shards)) == i, inside).otherwise(out) if len(self.shards) > 1 else inside
        return F.coalesce(out, F.lit(False))

    def mark(self, df: DataFrame, key: str, to: str) -> DataFrame:
        """df with a boolean column, by bit tests alone."""
        n, out = len(self.shards), None
        for at in range(0, n, SHARDS_A_PASS):
            rows = df.where(self._shard(F.col(key), n).between(at, at + SHARDS_A_PASS - 1)) if n > SHARDS_A_PASS else df
            rows = rows.withColumn(to, self.contains(F.col(key), at, at + SHARDS_A_PASS))
            out = rows if out is None else out.unionByName(rows)
        return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, blocked: str = BLOCK_PATTERN, max_bits: int = MAX_BITS) -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of pages.

    A url under a rule gets the longest rule's verdict; any other is blocked if its host is on the list (the
    corpus's hosts that match the pattern) and else allowed. A null url or one without :// has an empty host and
    path, no rule, and is allowed. Repeated rows and null ids are kept; other columns are ignored.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).select(F.col("host").alias("key"), ((F.col("host") != "") & F.col("host").rlike(blocked)).alias("listed"))
    cascade = BloomCascade.build(hosts, max_bits=max_bits)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = cascade.mark(rows, "host", "listed").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "listed")
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '{BLOCK_PATTERN}') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
