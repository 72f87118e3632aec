"""Fuzzy equality of nested values in the JVM: JSON read as VARIANT, taken apart level by level.

A value's score is a weighted sum of its leaves' scores, and a leaf's weight is known on the way down: an object shares its
weight among the keys of both sides, a list among the expected elements, less where the lengths differ. So each level is
one explode of the containers that both sides have, nothing is folded back up, and a row's score is one sum at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.scoring import similarity
from quern.session import cut

CLOSE = 1e-4
"""Relative tolerance of numbers, and absolute tolerance around 0."""

ALIKE = 0.85
"""Least similarity of texts; below it they score 0."""


def kind(v: Column) -> Column:
    """object, array, null, boolean, string or number."""
    shape = F.schema_of_variant(v)
    return F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "VOID", "null").when(shape == "BOOLEAN", "boolean").when(shape == "STRING", "string").when(shape.isNotNull(), "number")


def _get(v: str, what: str) -> Column:
    return F.try_variant_get(v, "$", what)


def _size(v: str, k: str) -> Column:
    return F.when(F.col(k) == "object", F.size(_get(v, "map<string,variant>"))).when(F.col(k) == "array", F.size(_get(v, "array<variant>")))


def _truth() -> Column:
    """What the actual value is as a yes or no: zero, the empty text and empty containers are no."""
    return F.when(F.col("ak") == "boolean", _get("a", "boolean")).when(F.col("ak") == "number", _get("a", "double") != 0).when(F.col("ak") == "string", _get("a", "string") != "").otherwise(_size("a", "ak") > 0)


def _as_number() -> Column:
    """The actual value as a number, a text such as " 1_000.5 " among them; null where it is none."""
    text = F.trim(_get("a", "string"))
    written = F.when(text.rlike(r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"), F.regexp_replace(text, "_", "").try_cast("double"))
    return F.when(F.col("ak") == "number", _get("a", "double")).when(F.col("ak") == "boolean", _get("a", "boolean").cast("double")).when(F.col("ak") == "string", written)


def _as_text(v: str, k: str) -> Column:
    """Spaces joined and lower-cased; a yes or no by its word, numbers and containers as JSON writes them."""
    said = F.when(F.col(k) == "string", _get(v, "string")).otherwise(F.to_json(F.col(v)))
    return F.trim(F.regexp_replace(F.lower(said), r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def _leaf() -> Column:
    """The score of two values of which the expected one is no container, or which can't be compared element by element."""
    e, x = _get("e", "double"), _as_number()
    near = F.when(e == 0, F.abs(x) < CLOSE).otherwise((F.abs(x) < float("inf")) & (F.abs(e - x) <= CLOSE * F.greatest(F.abs(e), F.abs(x))))
    p, q = _as_text("e", "ek"), _as_text("a", "ak")
    alike = similarity(p, q)
    return (
        F.when((F.col("ek") == "null") | (F.col("ak") == "null"), (F.col("ek") == F.col("ak")).cast("double"))
        .when(F.col("ek") == "boolean", (_truth() == _get("e", "boolean")).cast("double"))
        .when(F.col("ek") == "number", F.coalesce(((e == x) | near).cast("double"), F.lit(0.0)))
        .when(F.col("ek") == "string", F.when(p == q, 1.0).when(alike >= ALIKE, alike).otherwise(0.0))
        .otherwise(((F.col("ek") == F.col("ak")) & (_size("e", "ek") == 0) & (_size("a", "ak") == 0)).cast("double"))
    )


def match(df: DataFrame, expected: str, actual: str, name: str = "score") -> DataFrame:
    """df with the fuzzy equality, 0 to 1, of two columns of JSON text; null where either is null or no JSON.

    By the expected value's kind, at any depth: numbers within CLOSE, also as text; texts by edit distance; anything stands
    for a yes or no by its truth; null equals null alone. There are as many passes as the values are deep. Repeated rows
    each get their score; an empty table gives an empty result.
    """
    rows = cut(df.withColumn("__row", F.monotonically_increasing_id()))
    level = rows.select("__row", F.lit(1.0).alias("w"), F.try_parse_json(F.col(expected)).alias("e"), F.try_parse_json(F.col(actual)).alias("a")).where("e is not null and a is not null")
    known, scores = level.select("__row"), None
    while True:
        level = level.withColumns({"ek": kind(F.col("e")), "ak": kind(F.col("a"))}).withColumns({"en": _size("e", "ek"), "an": _size("a", "ak")})
        both = F.col("ek").isin("object", "array") & (F.col("ek") == F.col("ak")) & (F.col("en") > 0) & (F.col("an") > 0)
        leaves = level.where(~both).groupBy("__row").agg(F.sum(F.col("w") * _leaf()).alias("s"))
        scores = leaves if scores is None else scores.unionByName(leaves)
        inner = level.where(both)
        em, am = _get("e", "map<string,variant>"), _get("a", "map<string,variant>")
        o = inner.where("ek = 'object'").select("__row", "w", em.alias("em"), am.alias("am"))
        keys = F.array_intersect(F.map_keys("em"), F.map_keys("am"))
        o = o.select("__row", (F.col("w") / F.size(F.array_union(F.map_keys("em"), F.map_keys("am")))).alias("w"), "em", "am", F.explode(keys).alias("k"))
        o = o.select("__row", "w", F.element_at("em", F.col("k")).alias("e"), F.element_at("am", F.col("k")).alias("a"))
        x = inner.where("ek = 'array'").select("__row", (F.col("w") / F.col("en") * F.least("en", "an") / F.greatest("en", "an")).alias("w"), _get("e", "array<variant>").alias("ea"), _get("a", "array<variant>").alias("aa"))
        x = x.select("__row", "w", "aa", F.posexplode("ea").alias("i", "e")).where(F.col("i") < F.size("aa")).select("__row", "w", "e", F.get("aa", F.col("i")).alias("a"))
        level = cut(o.unionByName(x))
        if not level.head(1):
            break
    total = known.join(scores.groupBy("__row").agg(F.sum("s").alias("s")), "__row", "left").select("__row", F.coalesce("s", F.lit(0.0)).alias(name))
    return rows.join(total, "__row", "left").drop("__row")
