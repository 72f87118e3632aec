"""Order over whole tables and heavy groups without a window that a task must hold alone.

A table is range-partitioned by its order and sorted, so that a row's place is the rows of earlier ranges and its own place
within its range; only one count for each range is summed across ranges. Ties are counted before they are placed, and
moving windows work on blocks of places that get their neighbours' border rows. Quantiles are found by histograms that
narrow to the bucket that holds them, and Pareto frontiers from the frontiers of ranges. All with built-in functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.operators.relational import salted, small
from quern.operators.stats import correlation
from quern.session import cut

BLOCK = 1 << 15
"""Places of a block of a moving window."""

BINS = 2048
"""Buckets of a histogram pass."""

FEW = 4096
"""Rows of a bucket whose values are sorted together instead of being counted once more."""


def _order(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _parted(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """df in ranges of keys and order, with __part, the range, and __at, the place within it; cut, so that both stay."""
    by = [*map(F.col, keys), *map(_order, order)]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    at = F.col("__id").bitwiseAND((1 << 33) - 1)
    return cut(placed.withColumns({"__part": F.shiftright("__id", 33), "__at": at}).drop("__id"))


def _before(parts: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """parts, a row for each range and key, with __before: the sum of value over the key's earlier ranges.

    A key in many ranges has a row for each, so this window is over ranges, never over rows.
    """
    w = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("__before", F.coalesce(F.sum(value).over(w), F.lit(0)))


def numbered(df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = (), name: str = "place") -> DataFrame:
    """df with the row's number by order within its key, from 1: row_number() without a group in a task.

    order tells rows apart, or equal ones are numbered in any order. A null key is a key of its own.
    """
    placed = _parted(df, keys, order)
    parts = placed.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    base = _before(parts, keys, F.col("__n")).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), "__before", "__first")
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = placed.join(small(base), same)
    return out.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first") + 1).select(*df.columns, name)


def value_places(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, before, total): each value that is not null, its rows, those of smaller values, and all of the key.

    Ties are counted before the values are placed, however many rows share one.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    placed = _parted(counts, keys, [value])
    within = F.sum("n").over(W.partitionBy(*keys, "__part").orderBy("__at").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    placed = placed.withColumn("__in", within)
    parts = placed.groupBy(*keys, "__part").agg(F.sum("n").alias("__n"))
    w = W.partitionBy(*keys)
    base = _before(parts, keys, F.col("__n")).withColumn("total", F.sum("__n").over(w))
    base = base.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), "__before", "total")
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return placed.join(small(base), same).select(*keys, value, "n", (F.col("__before") + F.col("__in")).alias("before"), "total")


def ranked(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """df's rows with a value, and rank, average_rank (ties at their mean) and share (the part of the key at or below it)."""
    places = value_places(df, keys, value)
    rest = places.select(*[F.col(c).alias(f"__{c}") for c in [*keys, value]], "n", "before", "total").withColumn("__on", F.xxhash64(*[F.col(f"__{c}") for c in [*keys, value]]))
    rows = df.where(F.col(value).isNotNull()).withColumn("__on", F.xxhash64(*[F.col(c) for c in [*keys, value]]))
    joined = salted(rows, rest, ["__on"], F.xxhash64(*[F.col(c) for c in df.columns if dict(df.dtypes)[c][:3] != "map"]))
    for c in [*keys, value]:
        joined = joined.where(F.col(c).eqNullSafe(F.col(f"__{c}")))
    rank = F.col("before") + 1
    return joined.select(*df.columns, rank.alias("rank"), (F.col("before") + (F.col("n") + 1) / 2).alias("average_rank"), ((F.col("before") + F.col("n")) / F.col("total")).alias("share"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho): rank correlation of the rows where both are known, ties at their mean rank."""
    both = ranked(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, x).withColumnRenamed("average_rank", "__rx").drop("rank", "share")
    both = ranked(both, keys, y)
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("__rx"), F.col("average_rank")).alias("rho"))


def moving(df: DataFrame, order: Sequence[str | Column], columns: dict[str, Column], before: int, after: int = 0, block: int = BLOCK, frame: tuple[int, int] | None = None) -> DataFrame:
    """df with columns computed over the row and its neighbours in one series: so many rows before and after it.

    columns: name to an aggregate such as avg("x"), or a column made by lag or lead of no more rows. order tells rows apart.
    frame: the rows that aggregates see, if not all of these.
    """
    placed = numbered(df, order, name="__place")
    size = max(block, before + after + 1)
    own = F.floor((F.col("__place") - 1) / size)
    first, last = (F.floor((F.col("__place") - 1 + d) / size) for d in (-after, before))  # blocks whose rows this one is a neighbour of
    spread = placed.withColumn("__own", own).withColumn("__block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    series = W.partitionBy("__block").orderBy("__place")
    seen = series.rowsBetween(*(frame or (-before, after)))
    made = {n: c.over(series if _offset(c) else seen) for n, c in columns.items()}
    return spread.select("*", *[c.alias(n) for n, c in made.items()]).where(F.col("__own") == F.col("__block")).drop("__own", "__block", "__place")


def _offset(c: Column) -> bool:
    return str(c).startswith(("Column<'lag(", "Column<'lead("))


def frontier(df: DataFrame, keys: Sequence[str], cost: str, value: str, tie: str) -> DataFrame:
    """(keys, cost, value, tie): each key's rows whose value is above that of all cheaper ones; of equal cost and value the
    smallest tie. Nulls in cost or value take no part.

    Each cost's best row comes first, by partial aggregates; each range keeps its own frontier, and of that what rises above
    the best of all earlier ranges.
    """
    best = F.min_by(F.struct(value, tie), F.struct(F.when(F.isnan(F.col(value).cast("double")), F.lit(0.0)).otherwise(-F.col(value).cast("double")), F.col(tie))).alias("b")
    one = df.where(F.col(cost).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, cost).agg(best).select(*keys, cost, "b.*")
    placed = _parted(one, keys, [cost])
    w = W.partitionBy(*keys, "__part").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    own = cut(placed.withColumn("__m", F.max(value).over(w)).where(F.col("__m").isNull() | (F.col(value) > F.col("__m"))).drop("__m", "__at"))
    parts = own.groupBy(*keys, "__part").agg(F.max(value).alias("__top"))
    earlier = F.max("__top").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), earlier.alias("__best"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return own.join(small(parts), same).where(F.col("__best").isNull() | (F.col(value) > F.col("__best"))).select(*keys, cost, value, tie)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """(keys, at, quantile): exact quantiles, interpolated between neighbours; values that are null or not finite are left out.

    Each pass counts the rows of every bucket that holds a wanted place, and goes on within it, until a bucket has few rows
    or one value: three passes or so, each of partial sums. Groups are told apart by keys, which may be null.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(F.xxhash64(*[F.lit(0), *map(F.col, keys)]).alias("__g"), F.struct(*[F.lit(0).alias("__none"), *map(F.col, keys)]).alias("__k"), v.alias("v"))
    sizes = cut(rows.groupBy("__k").agg(F.first("__g").alias("__g"), F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    asked = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("at"), side(F.lit(float(q)) * (F.col("n") - 1)).cast("long").alias("place")) for q in at for side in (F.floor, F.ceil)]))
    wanted = sizes.select("__k", "__g", "lo", "hi", F.col("n").alias("rows"), F.lit(0).cast("long").alias("before"), asked.alias("w")).select("*", "w.at", "w.place").drop("w").distinct()
    closed = None
    while True:
        wanted = cut(wanted)
        done = wanted.where((F.col("rows") <= few) | (F.col("lo") == F.col("hi")))
        closed = done if closed is None else closed.unionByName(done)
        wide = wanted.where((F.col("rows") > few) & (F.col("lo") < F.col("hi")))
        if not wide.head(1):
            break
        spans = wide.select("__k", "__g", "lo", "hi").distinct()
        inside = _inside(rows, spans)
        # scaled before it is divided, and rising with v whatever is rounded
        bucket = F.least(F.lit(bins - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins)).cast("int")
        counts = inside.groupBy("__k", "lo", "hi", bucket.alias("b")).agg(F.count(F.lit(1)).alias("rows"), F.min("v").alias("from"), F.max("v").alias("to"))
        upto = F.sum("rows").over(W.partitionBy("__k", "lo", "hi").orderBy("b").rowsBetween(W.unboundedPreceding, 0)) - F.col("rows")  # bins rows at most
        counts = cut(counts.withColumn("skip", upto)).withColumnsRenamed({"rows": "found", "__k": "key", "lo": "lo2", "hi": "hi2"})
        met = wide.join(counts, (F.col("__k") == F.col("key")) & (F.col("lo") == F.col("lo2")) & (F.col("hi") == F.col("hi2")))
        met = met.where((F.col("place") >= F.col("before") + F.col("skip")) & (F.col("place") < F.col("before") + F.col("skip") + F.col("found")))
        wanted = met.select("__k", "__g", F.col("from").alias("lo"), F.col("to").alias("hi"), F.col("found").alias("rows"), (F.col("before") + F.col("skip")).alias("before"), "at", "place")
    closed = cut(closed)
    one = closed.where("lo = hi").select("__k", "at", "place", F.col("lo").alias("x"))
    spans = closed.where("lo < hi").select("__k", "__g", "lo", "hi", "before").distinct()
    lists = _inside(rows, spans).groupBy("__k", "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("vs")).withColumnsRenamed({"__k": "key", "lo": "lo2", "hi": "hi2"})  # few values each
    some = closed.where("lo < hi").join(lists, (F.col("__k") == F.col("key")) & (F.col("lo") == F.col("lo2")) & (F.col("hi") == F.col("hi2")))
    some = some.select("__k", "at", "place", F.get("vs", (F.col("place") - F.col("before")).cast("int")).alias("x"))
    found = one.unionByName(some).groupBy("__k", "at").agg(F.min("x").alias("a"), F.max("x").alias("z"))
    found = found.join(sizes.select("__k", "n"), "__k")
    exact = F.col("at") * (F.col("n") - 1)
    return found.select(*[F.col(f"__k.{k}").alias(k) for k in keys], "at", (F.col("a") + (F.col("z") - F.col("a")) * (exact - F.floor(exact))).alias("quantile"))


def _inside(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows with the span of their group that they stand in."""
    spans = small(spans.select(F.col("__k").alias("k2"), F.col("__g").alias("g2"), "lo", "hi"))
    return rows.join(spans, (F.col("__g") == F.col("g2")) & (F.col("__k") == F.col("k2")) & F.col("v").between(F.col("lo"), F.col("hi"))).select("__k", "v", "lo", "hi")


def bottom(df: DataFrame, strata: Sequence[str], order: Sequence[Column], k: int, parts: int = 64) -> DataFrame:
    """The first k rows of each stratum by order: first of each of a stratum's parts, where every task keeps k rows before
    any is exchanged (k up to the session's spark.sql.optimizer.windowGroupLimitThreshold), then of those."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    part = F.pmod(F.xxhash64(*[o for o in order]), F.lit(parts))
    first = df.select(*columns, part.alias("__part")).withColumn("__n", F.row_number().over(W.partitionBy(*strata, "__part").orderBy(*order))).where(F.col("__n") <= k)
    return first.withColumn("__n", F.row_number().over(W.partitionBy(*strata).orderBy(*order))).where(F.col("__n") <= k).drop("__part", "__n")
