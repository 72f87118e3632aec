"""Joins, deduplication and grouped shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.session import cut

BROADCAST_ROWS = 50_000

HOT = 1 << 16
"""Rows of a key from which on a join deals them over several tasks."""


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def salted(many: DataFrame, few: DataFrame, on: Sequence[str], apart: Column, hot: int = HOT) -> DataFrame:
    """The inner join on the columns named, the keys with over hot rows of many dealt out by the hash of apart.

    The list of such keys has a row for each hot rows of many at most; few's rows are repeated for them.
    """
    large = cut(many.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot))
    if not large.head(1):
        return many.join(few, list(on))
    parts = F.coalesce(F.ceil(F.col("__n") / hot), F.lit(1)).cast("int")
    dealt = many.join(small(large), list(on), "left").withColumn("__part", F.pmod(F.xxhash64(apart), parts).cast("int")).drop("__n")
    repeated = few.join(small(large), list(on), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__n")
    return dealt.join(repeated, [*on, "__part"]).drop("__part")


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by order, whose parts may fall: for keys of few rows, as aggregates have."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """The first, or last, row of each key by rising order: partial aggregates, so that no key's rows meet in one task."""
    rest = [c for c in df.columns if c not in keys]
    choose = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(choose(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*").select(df.columns)


def merge(left: DataFrame, right: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Left join on the key as text; of equal right keys the last by order wins, right columns replace left ones of
    the same name where there is a match, and matched tells it."""
    last = first(right.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit(""))), ["__key"], order, last=True).drop(key)
    last = last.select("__key", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__r_{c}") for c in last.columns if c != "__key"])
    out = left.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit(""))).join(last, "__key", "left")
    hit = F.coalesce("__hit", F.lit(False))
    names = [c.removeprefix("__r_") for c in last.columns if c.startswith("__r_")]
    shared = [F.when(hit, F.col(f"__r_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in left.columns]
    return out.select(*shared, *[F.col(f"__r_{c}").alias(c) for c in names if c not in left.columns], hit.alias("matched"))


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def filled(tasks: DataFrame, scores: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Every task with its score, defaults for those without."""
    return tasks.join(scores, key, "left").fillna(defaults)


def pivot_sum(df: DataFrame, keys: Sequence[str], by: str, values: Sequence, what: Column) -> DataFrame:
    """One pass of conditional sums, 0 where there is none."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col(by) == v, what)), F.lit(0)).alias(str(v)) for v in values])


def query(df: DataFrame, where: Column | None = None, sort_by: str | None = None, limit: int = 10, tie: str | None = None) -> DataFrame:
    """Scan, filter, sort descending, limit."""
    out = df if where is None else df.where(where)
    if sort_by:
        out = out.orderBy(F.col(sort_by).desc(), *([F.col(tie)] if tie else []))
    return out.limit(limit)


ASKED = {
    "equals": lambda c, v: F.lower(c.cast("string")) == str(v).lower(),
    "greater_than": lambda c, v: c.cast("string").try_cast("double") > float(v),
    "less_than": lambda c, v: c.cast("string").try_cast("double") < float(v),
    "contains": lambda c, v: F.contains(F.lower(c.cast("string")), F.lit(str(v).lower())),
}


def ask(df: DataFrame, filter_field: str | None = None, filter_op: str | None = None, filter_value: object = None, sort_by: str | None = None, limit: int = 10, tie: str | None = None) -> DataFrame:
    """One query over a table, by arguments: a filter of four kinds, texts without case, a falling sort, a limit.

    A field that the table lacks matches nothing, and one to sort by is passed over; a filter that lacks a part filters
    nothing. Of rows that tie in the order those with the smallest tie come first.
    """
    out = df
    if filter_field and filter_op and filter_value is not None:
        out = df.where(ASKED[filter_op](F.col(filter_field), filter_value)) if filter_field in df.columns else df.limit(0)
    return query(out, None, sort_by if sort_by in df.columns else None, limit, tie)


def row_mean(*columns: Column) -> Column:
    """The mean of a row's values that are not null."""
    known = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(known), F.lit(0))


def head_tail(df: DataFrame, order: Sequence[str], first: int = 10, last: int = 5) -> DataFrame:
    """df with part: the first rows by order, and the last ones where there are more rows than the first."""
    head = df.orderBy(*order).limit(first).withColumn("part", F.lit("head"))
    if df.limit(first + 1).count() <= first:
        return head
    return head.unionByName(df.orderBy(*[F.col(c).desc() for c in order]).limit(last).withColumn("part", F.lit("tail")))


FILTERS = {
    "greater_than": lambda c, v: c.cast("double") > float(v),
    "less_than": lambda c, v: c.cast("double") < float(v),
    "equals": lambda c, v: c.cast("string") == str(v),
    "not_equals": lambda c, v: c.cast("string") != str(v),
    "contains": lambda c, v: F.lower(c.cast("string")).contains(str(v).lower()),
    "starts_with": lambda c, v: F.lower(c.cast("string")).startswith(str(v).lower()),
    "ends_with": lambda c, v: F.lower(c.cast("string")).endswith(str(v).lower()),
}


def data_filter(df: DataFrame, column: str, condition: str, value: object) -> DataFrame:
    return df.where(FILTERS[condition](F.col(column), value))


def stratified(df: DataFrame, strata: Sequence[str], key: str, quota: int, seed: str = "42") -> DataFrame:
    """Up to quota rows of each stratum, drawn by the md5 of seed and key."""
    drawn = W.partitionBy(*strata).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return df.withColumn("__n", F.row_number().over(drawn)).where(F.col("__n") <= quota).drop("__n")
