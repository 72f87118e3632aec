"""Matching of expected and actual calls, and the scores made of it.

Column expressions, but for values and answers in JSON of any shape, which Python reads in Arrow batches.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from quern.functions.text import let


WORD = 62
"""Bits of a long that an addition of two leaves room above."""


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / F.when(longest > 0, longest))


def match_exact(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a.cast("string"))) == F.lower(F.trim(b.cast("string")))


def match_string(a: Column, b: Column, threshold: float = 0.85) -> Column:
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    alike = similarity(flat(a), flat(b))
    return F.when(flat(a) == flat(b), 1.0).when(alike >= threshold, alike).otherwise(0.0)


def match_numeric(expected: Column, actual: Column, tolerance: float = 1e-4) -> Column:
    near = F.when(expected == 0, F.abs(actual) < tolerance).otherwise(F.abs(expected - actual) <= tolerance * F.greatest(F.abs(expected), F.abs(actual)))
    return F.when((expected == actual) | near, 1.0).otherwise(0.0)


def match_arguments(expected: Column, actual: Column) -> Column:
    """Mean over the union of two string maps' keys; a key that one lacks scores 0. Two empty maps score 1, one 0."""
    keys = F.array_union(F.map_keys(expected), F.map_keys(actual))
    each = F.transform(keys, lambda k: F.coalesce(match_string(F.try_element_at(expected, k), F.try_element_at(actual, k)), F.lit(0.0)))
    return F.when(F.size(keys) == 0, 1.0).otherwise(F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(keys), F.lit(1)))


def _distance(a: str, b: str) -> int:
    """Edit distance, one machine step for a whole column of the table: a column's rises and falls are two bit sets."""
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    rises, falls, d = full, 0, len(a)
    for c in b:
        same = where.get(c, 0) | falls
        across = (((same & rises) + rises) ^ rises) | same
        up, down = falls | ~(across | rises) & full, rises & across
        d += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & full, down << 1 & full
        rises, falls = down | ~(same | up) & full, up & same
    return d


def _text(e: str, a: str, threshold: float = 0.85) -> float:
    e, a = (" ".join(s.lower().split()) for s in (e, a))
    if e == a:
        return 1.0
    alike = 1 - _distance(e, a) / max(len(e), len(a))
    return alike if alike >= threshold else 0.0


def _number(e: float, a: object) -> float:
    try:
        x = float(a)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 0.0
    return float(e == x or (abs(x) < 1e-4 if e == 0 else abs(e - x) <= 1e-4 * max(abs(e), abs(x))))


def _value(e: object, a: object) -> float:
    """By the expected value's kind, at any depth: a text may be a little off, a number may come as text, and anything
    stands for a boolean by its truth."""
    if e is None or a is None:
        return float(e is a)
    if isinstance(e, bool):
        return float(bool(a) == e)
    if isinstance(e, (int, float)):
        return _number(float(e), a)
    if isinstance(e, list):
        if not isinstance(a, list) or bool(e) != bool(a):
            return 0.0
        shorter, longer = sorted((len(e), len(a)))
        return sum(map(_value, e, a)) / len(e) * shorter / longer if e else 1.0
    if isinstance(e, dict):
        if not isinstance(a, dict) or bool(e) != bool(a):
            return 0.0
        return sum(_value(e[k], a[k]) for k in e.keys() & a.keys()) / len(e.keys() | a.keys()) if e else 1.0
    return _text(str(e), str(a))


@F.pandas_udf(DoubleType())
def match_json(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """Fuzzy equality of two JSON values of any depth, the arguments of a call among them; null where either is no JSON."""

    def one(e: str | None, a: str | None) -> float | None:
        try:
            return None if e is None or a is None else _value(json.loads(e), json.loads(a))
        except ValueError:
            return None

    return pd.Series([one(e, a) for e, a in zip(expected, actual)], dtype="float64")


PAIRS = ArrayType(StructType().add("s", IntegerType()).add("c", IntegerType()).add("v", DoubleType()))
CALLS = ArrayType(StructType().add("tool", StringType()).add("arguments", StringType()))


@F.pandas_udf(PAIRS)
def pairs(steps: pd.Series, calls: pd.Series) -> pd.Series:
    """Every step and call of one tool, names compared without case and outer space, with the score of the arguments.

    Both are JSON lists of objects with tool and arguments (an object's text); arguments that are no object are none.
    """

    def read(text: str | None) -> list[tuple[str, dict]]:
        found = []
        for x in json.loads(text or "[]"):
            try:
                arguments = json.loads(x.get("arguments") or "{}")
            except ValueError:
                arguments = {}
            found.append((str(x.get("tool", "")).strip().lower(), arguments if isinstance(arguments, dict) else {}))
        return found

    def one(wanted: str | None, made: str | None) -> list[dict]:
        made = read(made)
        return [{"s": i, "c": j, "v": _value(e, a)} for i, (tool, e) in enumerate(read(wanted)) for j, (name, a) in enumerate(made) if name == tool]

    return pd.Series([one(*x) for x in zip(steps, calls)])


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of any length, by sets of bits.

    A bit for each element of a, WORD to a long: each element of b takes one addition of longs, whose carry goes on from one to
    the next; at the end a cleared bit stands for a common element. Elements of b that a lacks change nothing.
    """
    full = F.lit((1 << WORD) - 1)
    words = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / WORD).cast("int"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    summed = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    mask = lambda s: F.transform(words, lambda w: summed(F.transform(F.slice(a, w * WORD + 1, WORD), lambda x, i: F.when(x == s, bit(i)).otherwise(F.lit(0).cast("long")))))

    def added(v: Column, m: Column) -> Column:
        def one(acc: Column, w: Column) -> Column:
            of, on = F.get(v, w), F.get(m, w)
            total = of + of.bitwiseAND(on) + acc["carry"]
            new = total.bitwiseAND(full).bitwiseOR(of.bitwiseAND(F.bitwise_not(on)))
            return F.struct(F.array_append(acc["v"], new).alias("v"), F.shiftright(total, WORD).alias("carry"))

        start = F.struct(F.array().cast("array<bigint>").alias("v"), F.lit(0).cast("long").alias("carry"))
        return F.aggregate(words, start, one, lambda acc: acc["v"])

    def fold(bound: Column) -> Column:
        left = F.aggregate(bound["places"], F.transform(words, lambda w: full), lambda v, p: added(v, F.get(bound["masks"], (p - 1).cast("int"))))
        return summed(F.transform(left, lambda v: WORD - F.bit_count(v).cast("long"))).cast("int")

    symbols = F.array_distinct(a)
    places = lambda s: F.filter(F.transform(b, lambda y: F.array_position(s, y)), lambda p: p > 0)
    common = let(symbols, lambda s: let(F.struct(F.transform(s, mask).alias("masks"), places(s).alias("places")), fold))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(common)


def assign(steps: Column, pairs: Column) -> Column:
    """The call that each of so many steps takes, -1 for none: in order, the best unused by score, the earliest on a tie.

    pairs: array<struct<s,c,v>> of step, call and score, from 0.
    """

    def choose(taken: Column, s: Column) -> Column:
        free = F.filter(pairs, lambda p: (p["s"] == s) & ~F.array_contains(taken, p["c"]))
        best = F.array_sort(F.transform(free, lambda p: F.struct((-p["v"]).alias("v"), p["c"].alias("c"))))
        return F.array_append(taken, F.coalesce(F.get(best, F.lit(0))["c"], F.lit(-1)))

    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(0), steps - 1), F.array().cast("array<int>"), choose)).otherwise(F.array().cast("array<int>"))


# The weights of a level's scores.
WEIGHTS = {  # sequence, arguments, completeness, data flow
    "L1": (0.40, 0.35, 0.25, 0.0),
    "L2": (0.35, 0.35, 0.15, 0.15),
    "L3": (0.30, 0.30, 0.15, 0.25),
}


def overall(level: Column, first: Column, sequence: Column, arguments: Column, complete: Column, flow: Column) -> Column:
    """L0 is all or nothing: the first step has its call, and the arguments reach 0.85. The others weigh four scores."""
    out = F.when(level == "L0", F.when(first & (arguments >= 0.85), 1.0).otherwise(0.0))
    for name, (s, a, c, f) in WEIGHTS.items():
        out = out.when(level == name, sequence * s + arguments * a + complete * c + flow * f)
    return out


def error_type(calls: Column, unknown: Column, wanted: Column, wrong: Column, order: Column, low: Column) -> Column:
    """The first fault that applies, null for none. calls and wanted are numbers of calls and steps; unknown: a call's
    tool is no step's; wrong: a matched call has another tool; order: the sequence is not whole; low: a matched call's
    arguments score below 0.85."""
    return F.coalesce(
        F.when(calls == 0, "E10_format_error"),
        F.when(unknown, "E6_hallucinated_tool"),
        F.when(calls < wanted, "E8_partial_completion"),
        F.when(wrong, "E1_wrong_tool"),
        F.when(order, "E3_wrong_order"),
        F.when(low, "E4_wrong_arguments"),
        F.when(calls > wanted, "E7_unnecessary_tool"),
    )


def score(tasks: DataFrame) -> DataFrame:
    """tasks with call_scores, sequence, arguments, complete, flow, overall and error.

    tasks: level, steps array<struct<id,tool,arguments,depends_on>> and calls array<struct<tool,arguments>>, arguments as
    JSON text. A step takes the best free call of its tool, in order; a null list counts as empty. The sequence compares
    names as they are, the assignment without case.
    """
    c = F.col
    t = tasks.withColumns({k: F.coalesce(k, F.array().cast(tasks.schema[k].dataType)) for k in ("steps", "calls")})
    steps, calls = F.size("steps"), F.size("calls")
    t = t.withColumn("__pairs", pairs(F.to_json("steps"), F.to_json("calls"))).withColumn("__chosen", assign(steps, c("__pairs")))
    of = lambda i: F.get(F.filter("__pairs", lambda p: (p["s"] == i) & (p["c"] == F.get(c("__chosen"), i))), F.lit(0))["v"]
    t = t.withColumn("call_scores", F.transform("steps", lambda s, i: F.struct(s["id"].alias("step"), (F.get(c("__chosen"), i) >= 0).alias("matched"), F.coalesce(of(i), F.lit(0.0)).alias("args_score"), s["depends_on"].alias("depends_on"))))
    done = F.filter("call_scores", lambda s: s["matched"])
    t = t.withColumn("__done", done).withColumn("__names", F.transform("steps", lambda s: s["tool"])).withColumn("__made", F.transform("calls", lambda s: s["tool"]))
    t = t.withColumn("sequence", F.when(steps > 0, lcs(c("__names"), c("__made")) / F.greatest(steps, F.lit(1))).otherwise(1.0))
    total = F.aggregate("__done", F.lit(0.0), lambda s, x: s + x["args_score"])
    t = t.withColumn("arguments", F.when(F.size("__done") > 0, total / F.greatest(F.size("__done"), F.lit(1))).otherwise(0.0))
    t = t.withColumn("complete", F.size("__done") / F.greatest(steps, F.lit(1)))
    waits = F.filter("call_scores", lambda s: F.coalesce(F.size(s["depends_on"]), F.lit(0)) > 0)
    ids = F.transform("__done", lambda s: s["step"])
    good = F.filter(waits, lambda s: s["matched"] & F.forall(s["depends_on"], lambda d: F.array_contains(ids, d)))
    t = t.withColumn("flow", F.when(F.size(waits) > 0, F.size(good) / F.greatest(F.size(waits), F.lit(1))).otherwise(1.0))
    first = F.coalesce(F.get(c("call_scores"), F.lit(0))["matched"], F.lit(False))
    t = t.withColumn("overall", overall(c("level"), first, c("sequence"), c("arguments"), c("complete"), c("flow")))
    unknown = F.exists("__made", lambda m: ~F.array_contains("__names", m))
    low = F.exists("__done", lambda s: s["args_score"] < 0.85)
    return t.withColumn("error", error_type(calls, unknown, steps, F.lit(False), c("sequence") < 1.0, low)).drop("__pairs", "__chosen", "__done", "__names", "__made")


_NAMES, _ARGUMENTS = ("tool", "name", "function"), ("arguments", "args", "parameters")


def _call(x: object) -> dict | None:
    if not isinstance(x, dict):
        return None
    tool = next((x[k] for k in _NAMES if x.get(k)), None)
    arguments = next((x[k] for k in _ARGUMENTS if x.get(k)), None)
    return tool and {"tool": str(tool), "arguments": json.dumps(arguments if isinstance(arguments, dict) else {}, ensure_ascii=False, separators=(",", ":"))}


def heard(text: str) -> list[tuple[dict | None, str | None]]:
    """What an answer holds: its calls, or the fault of what should be one; no_call where there is nothing of the kind.

    Its fenced block, or all of it, is read as JSON; failing that, each outermost run of braces in it.
    """
    block = re.search(r"```json(.*?)(?:```|$)", text, re.S) or re.search(r"```(.*?)(?:```|$)", text, re.S)
    judged = lambda x: (c, None) if (c := _call(x)) else (None, "no_tool")
    try:
        data = json.loads((block.group(1) if block else text).strip())
        return [judged(x) for x in (data if isinstance(data, list) else [data])] or [(None, "no_call")]
    except ValueError:
        pass
    found, depth, start = [], 0, None
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            start = m.start() if depth == 0 else start
            depth += 1
            continue
        depth -= 1
        if depth == 0 and start is not None:
            try:
                found.append(judged(json.loads(text[start : m.end()])))
            except ValueError:
                found.append((None, "not_json"))
            start = None
    return found or [(None, "not_json" if start is not None else "no_call")]


def _spoken(text: str) -> list[dict]:
    return [c for c, _ in heard(text) if c]


@F.pandas_udf(CALLS)
def calls(text: pd.Series) -> pd.Series:
    """The tool calls in a model's answer, with the usual names for their fields; none where nothing parses, null of null."""
    return pd.Series([None if t is None else _spoken(t) for t in text])
