"""Suites of tasks: drawing by quota, distractors, and stratified samples. Draws go by md5, so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.operators.ordered import bottom
from quern.operators.relational import small
from quern.session import cut


def draw(seed: str, *key: Column) -> Column:
    """What a row is ordered by when it is drawn."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in key]))


def stratified(df: DataFrame, level: str, category: str, key: str, targets: dict[str, int], seed: str = "42") -> DataFrame:
    """As many rows of each level as its target says, spread over its categories.

    Each category gives an even share, one at least, and the first ones by name a row more where the shares leave a
    remainder; what small categories lack is drawn from the level's other rows, and what single rows of many categories
    bring too much is drawn away. A null category is one of its own.
    """
    want = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    rows = df.where(F.col(level).isin(*targets))
    sizes = rows.groupBy(level, F.coalesce(category, F.lit("unknown")).alias("__cat")).agg(F.count(F.lit(1)).alias("__have"))
    at = W.partitionBy(level)  # one row for each category
    n = F.count(F.lit(1)).over(at)
    share = F.greatest(F.lit(1), F.floor(F.col("__want") / n))
    extra = (F.row_number().over(at.orderBy("__cat")) <= F.col("__want") - share * n).cast("int")
    quota = sizes.withColumn("__want", want[F.col(level)]).select(level, "__cat", "__want", (share + extra).alias("__quota"))
    rows = rows.withColumn("__cat", F.coalesce(category, F.lit("unknown")))
    most = max(targets.values(), default=0)
    drawn = bottom(rows, [level, "__cat"], [draw(seed, F.col(key)), F.col(key)], most)
    drawn = drawn.withColumn("__n", F.row_number().over(W.partitionBy(level, "__cat").orderBy(draw(seed, F.col(key)), key)))
    first = drawn.join(small(quota), [level, "__cat"]).where("__n <= __quota").select(*df.columns)
    return _refilled(first, rows.select(*df.columns), level, [key], key, targets, seed).select(df.columns)


def _refilled(first: DataFrame, rows: DataFrame, level: str, same: list[str], key: str, targets: dict[str, int], seed: str) -> DataFrame:
    """Each level's target of rows: of first in the order of a second draw, then of the level's others. same tells rows apart."""
    want = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    again = [draw(f"{seed}+", F.col(key)), F.col(key)]
    most = max(targets.values(), default=0)
    first = cut(bottom(first, [level], again, most))
    # a level lacks others only if it has fewer first ones than its target, so twice the target's rows hold enough
    others = bottom(rows, [level], again, 2 * most).join(first, [level, *same], "left_anti")
    both = first.withColumn("__late", F.lit(0)).unionByName(others.withColumn("__late", F.lit(1)))
    place = F.row_number().over(W.partitionBy(level).orderBy("__late", *again))
    return both.withColumn("__m", place).where(F.col("__m") <= want[F.col(level)]).drop("__m", "__late")


def assemble(candidates: DataFrame, targets: dict[str, int], seed: str = "42", floor: int = 1) -> DataFrame:
    """(level, pattern, task, tools) of a suite: each pattern of a level brings count over patterns tasks, floor at least,
    the level stops at its target, and what patterns with too few tasks lack is drawn from the level's others.

    candidates: level, pattern, task, tools array, params. Of the tasks of one operator (L0) with equal tools and params one
    stays.
    """
    alone = F.col("level") == "L0"
    same = F.md5(F.concat_ws("|", "level", F.array_join(F.array_sort("tools"), ","), "params"))
    rows = candidates.groupBy("level", F.when(alone, same).otherwise(F.col("task").cast("string")).alias("k")).agg(F.min(F.struct("pattern", "task", "tools")).alias("t")).select("level", "t.*")
    patterns = rows.groupBy("level").agg(F.count_distinct("pattern").alias("__p"))
    want = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    quota = F.greatest(F.floor(want[F.col("level")] / F.col("__p")), F.lit(floor))
    most = max(*targets.values(), floor)
    rows = rows.where(F.col("level").isin(*targets))
    drawn = bottom(rows, ["level", "pattern"], [draw(seed, F.col("task")), F.col("task")], most)
    drawn = drawn.withColumn("__n", F.row_number().over(W.partitionBy("level", "pattern").orderBy(draw(seed, F.col("task")), "task")))
    first = drawn.join(small(patterns), "level").where(F.col("__n") <= quota).select("level", "pattern", "task", "tools")
    return _refilled(first, rows.select("level", "pattern", "task", "tools"), "level", ["task"], "task", targets, seed).select("level", "pattern", "task", "tools")


def distractors(task: Column, used: Column, tools: list[str], n: int, seed: str = "42") -> Column:
    """n tools that a task doesn't use, drawn by its key."""
    other = F.array_except(F.array(*map(F.lit, tools)), used)
    drawn = F.array_sort(F.transform(other, lambda t: F.struct(draw(seed, task, t).alias("d"), t.alias("t"))))
    return F.transform(F.slice(drawn, 1, n), lambda x: x["t"])


def filled(template: str, values: dict[str, Column]) -> Column:
    """The template with {names} replaced; as it is where it names something that values lack or that is null."""
    out, names = F.lit(template), [part.split("}")[0] for part in template.split("{")[1:]]
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return F.coalesce(out, F.lit(template)) if set(names) <= set(values) else F.lit(template)
