"""Composition: steps with dependencies become one plan.

A step is a function of its dependencies' columns. Steps on one table run as columns in topological order (a chain
or a fan-out is then one projection); steps that are tables of their own are joined on the row's key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    name: str
    build: Callable[..., Column]
    depends_on: Sequence[str] = ()


def run(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """df with a column for each step; build gets the columns named in depends_on (steps or columns of df)."""
    by_name = {s.name: s for s in steps}
    if len(by_name) < len(steps) or set(by_name) & set(df.columns):
        raise ValueError("step names must differ from each other and from the columns")
    graph = {s.name: [d for d in s.depends_on if d in by_name] for s in steps}
    for name in TopologicalSorter(graph).static_order():
        s = by_name[name]
        df = df.withColumn(name, s.build(*[F.col(d) for d in s.depends_on]))
    return df


def join(key: str, *branches: DataFrame) -> DataFrame:
    """Branches that meet again, row by row."""
    out = branches[0]
    for b in branches[1:]:
        out = out.join(b, key, "left")
    return out


def level(steps: DataFrame) -> DataFrame:
    """(task_id, parallel): whether two of a task's steps have the same dependencies. steps: task_id, depends_on."""
    same = steps.groupBy("task_id", F.array_join(F.array_sort("depends_on"), ",").alias("on")).agg(F.count(F.lit(1)).alias("n"))
    return same.groupBy("task_id").agg((F.max("n") > 1).alias("parallel"))
