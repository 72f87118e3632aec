"""Statistics on grouped samples: bootstrap, paired tests, effect sizes, agreement and rank correlation.

A replicate of the bootstrap weighs every row by a draw from the Poisson distribution, which resampling with replacement
tends to in large samples. The draws are digits of an md5 of the row's key, so every engine draws the same, no row needs a
number, and a replicate's mean is two partial sums: no sample meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window as W

THRESHOLDS = [int(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8)]
"""A draw below 65536 stands for as many copies of a row as there are thresholds at or below it."""


ABREAST = 40
"""Replicates whose sums a row adds to together: the sums of a group's block are under a hundred columns."""


def weights(key: Column, replicates: int) -> Column:
    """How often each replicate draws the row with this key: eight replicates to one md5."""
    draw = lambda h, k: F.conv(F.substring(h, 4 * k + 1, 4), 16, 10).cast("int")
    times = lambda u: sum((u >= t).cast("int") for t in THRESHOLDS)
    eight = lambda h: F.array(*[F.transform(F.array(draw(h, k)), times)[0] for k in range(8)])
    blocks = F.sequence(F.lit(0), F.lit(-(-replicates // 8) - 1))
    every = F.flatten(F.transform(blocks, lambda b: F.transform(F.array(F.md5(F.concat_ws("|", key, b.cast("string")))), eight)[0]))
    return F.slice(every, 1, replicates)


def resampled(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], replicates: int) -> DataFrame:
    """(keys, replicate, mean): weighted means, one for each replicate and group. The columns of order tell rows apart.

    A row adds to the sums of ABREAST replicates at once, so that what is exchanged is a few wide rows for each group and task.
    """
    row = F.concat_ws("|", *[F.col(c).cast("string") for c in order])
    blocks = F.sequence(F.lit(0), F.lit((replicates - 1) // ABREAST))
    drawn = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), weights(row, replicates).alias("__w"))
    drawn = drawn.select(*keys, "__v", "__w", F.explode(blocks).alias("__b")).withColumn("__w", F.slice("__w", F.col("__b") * ABREAST + 1, F.lit(ABREAST)))
    times = [F.get("__w", F.lit(k)) for k in range(min(ABREAST, replicates))]
    sums = drawn.groupBy(*keys, "__b").agg(*[F.sum(F.col("__v") * t).alias(f"__s{k}") for k, t in enumerate(times)], *[F.sum(t).alias(f"__n{k}") for k, t in enumerate(times)])
    each = F.array(*[F.struct((F.col("__b") * ABREAST + k).alias("replicate"), F.col(f"__s{k}").alias("s"), F.col(f"__n{k}").alias("n")) for k in range(len(times))])
    return sums.select(*keys, F.explode(each).alias("r")).where("r.n > 0").select(*keys, "r.replicate", (F.col("r.s") / F.col("r.n")).alias("mean"))


def bootstrap(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], replicates: int = 200, alpha: float = 0.05) -> DataFrame:
    """(keys, mean, low, high): percentile interval of the mean."""
    means = resampled(df, keys, value, order, replicates)
    bounds = means.groupBy(*keys).agg(F.round(F.percentile("mean", F.lit(alpha / 2)), 6).alias("low"), F.round(F.percentile("mean", F.lit(1 - alpha / 2)), 6).alias("high"))
    return df.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean")).join(bounds, list(keys))


def paired(pairs: DataFrame, keys: Sequence[str], x: str, y: str, order: Sequence[str], replicates: int = 200) -> DataFrame:
    """(keys, n, diff, p_value, effect_size) of paired scores: two-sided bootstrap test that x - y has mean 0, and Cohen's d.
    A replicate of the centred differences is one of the differences less their mean."""
    diffs = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__d", F.col(x) - F.col(y))
    own = diffs.groupBy(*keys).agg(F.count("__d").alias("n"), F.avg("__d").alias("diff"), *[f(c).alias(f"__{n}{c}") for c in (x, y) for n, f in (("m", F.avg), ("v", F.var_samp))])
    means = resampled(diffs, keys, "__d", order, replicates).join(own.select(*keys, "diff"), list(keys))
    p = means.groupBy(*keys).agg(F.round(F.avg((F.abs(F.col("mean") - F.col("diff")) >= F.abs("diff")).cast("double")), 6).alias("p_value"))
    c = F.col
    d = cohens_d(c(f"__m{x}"), c(f"__m{y}"), c(f"__v{x}"), c(f"__v{y}"), c("n"), c("n"))
    return own.join(p, list(keys)).select(*keys, "n", F.round("diff", 6).alias("diff"), "p_value", F.round(d, 4).alias("effect_size"))


def _tail(t: float, df: int) -> float:
    """Chance of a larger absolute t: the finite series for whole degrees of freedom."""
    angle = math.atan(abs(t) / math.sqrt(df))
    c, s = math.cos(angle), math.sin(angle)
    term = total = c if df % 2 else 1.0
    for k in range(3 if df % 2 else 2, df - 1, 2):
        term *= (k - 1) / k * c * c
        total += term
    within = (2 / math.pi * (angle + (s * total if df > 1 else 0.0))) if df % 2 else s * total
    return min(1.0, max(0.0, 1 - within))


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation of n pairs; null below three pairs. For few rows: one a group."""

    def one(r: float, n: float) -> float | None:
        if r != r or n < 3:
            return None
        return 0.0 if abs(r) >= 1 else _tail(r * math.sqrt((n - 2) / (1 - r * r)), int(n) - 2)

    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")


def cohens_d(mean1: Column, mean2: Column, var1: Column, var2: Column, n1: Column, n2: Column) -> Column:
    """Difference over the pooled deviation; signed infinity if that is 0 and the means differ, 0 if they don't."""
    pooled = F.sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / F.when(n1 + n2 > 2, n1 + n2 - 2))
    return F.when(pooled > 0, (mean1 - mean2) / F.when(pooled > 0, pooled)).when(mean1 > mean2, float("inf")).when(mean1 < mean2, float("-inf")).otherwise(0.0)


def effect(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").when(size.isNotNull(), "large")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, kappa) of two yes/no annotators; null kappa where chance agrees always."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    t = df.where(x.isNotNull() & y.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return t.select("n", F.round("po", 6).alias("agreement"), F.round(F.try_divide(F.col("po") - chance, 1 - chance), 6).alias("kappa"))


def average_rank(value: str, keys: Sequence[str] = ()) -> Column:
    """Rank with ties at their mean."""
    w = W.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / 2


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r of the rows where both sides are known, null where either doesn't vary (the built-in would divide by zero)."""
    both = x.isNotNull() & y.isNotNull()
    x, y = (F.when(both, c.cast("double")) for c in (x, y))
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    r = F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    return F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
