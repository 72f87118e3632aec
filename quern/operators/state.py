"""Keyed state as an append-only log: a store appends, a read takes the latest row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order; a partial maximum of whole rows, so no key's history meets in one task."""
    rest = [c for c in log.columns if c not in (key, order)]
    best = log.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("s"), F.count(F.lit(1)).alias("versions"))
    return best.select(key, f"s.{order}", *[f"s.{c}" for c in rest], "versions")


def store(log: DataFrame, rows: DataFrame) -> DataFrame:
    return log.unionByName(rows, allowMissingColumns=True)


def retrieve(log: DataFrame, key: str, order: str, value: object) -> DataFrame:
    return latest(log.where(F.col(key) == value), key, order)


def tagged(log: DataFrame, key: str, order: str, tag: str) -> DataFrame:
    """Keys whose latest row carries the tag."""
    return latest(log, key, order).where(F.array_contains("tags", tag))


def context(log: DataFrame, key: str, order: str) -> DataFrame:
    """(keys, tags): how many keys there are, and all tags in use, sorted."""
    now = latest(log, key, order)
    tags = now.select(F.explode("tags").alias("tag")).groupBy("tag").count().agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))
    return now.agg(F.count(F.lit(1)).alias("keys")).join(tags)
