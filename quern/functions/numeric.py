"""Column functions on numbers. Undefined results are null, where a single call would be an error."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T


def percent_change(old: Column, new: Column) -> Column:
    return F.round(F.try_divide(new - old, F.abs(old)) * 100, 4)


def direction(old: Column, new: Column) -> Column:
    return F.when(new > old, "increase").when(new < old, "decrease").otherwise("no change")


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.when(low <= high, F.greatest(low, F.least(value, high)))


def convert(value: Column, of: Column, to: Column) -> Column:
    """Between the table's units, names trimmed and lower-cased; a unit to itself unrounded, an unknown pair null."""
    a, b = F.lower(F.trim(of)), F.lower(F.trim(to))
    out = F.when(a == b, value)
    for f, t, before, times, over, after in T.UNITS:
        out = out.when((a == f) & (b == t), F.round((value + before) * times / over + after, 4))
    return out


def strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size >= 0.9, "very strong").when(size >= 0.7, "strong").when(size >= 0.5, "moderate").when(size >= 0.3, "weak").when(size.isNotNull(), "negligible")


def formatted(value: Column, style: str) -> Column:
    if style == "currency":
        return F.concat(F.when(value < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(value), 2))
    if style == "percent":
        return F.format_string("%.2f%%", value * 100)
    if style == "scientific":
        return F.format_string("%.6e", value)
    return F.format_number(value, 2)


# What a formula may call, and what that is in SQL.
_CALLS = {"abs": "abs", "round": "round", "min": "least", "max": "greatest", "pow": "power", "sqrt": "sqrt", "log": "ln", "log10": "log10", "log2": "log2", "sin": "sin", "cos": "cos", "tan": "tan", "ceil": "ceil", "floor": "floor"}
_SIGNS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%"}


def formula(text: str) -> Column:
    """An arithmetic formula over column names as a column: parsed against a small grammar, never evaluated as code."""

    def sql(n: ast.AST) -> str:
        if isinstance(n, ast.Expression):
            return sql(n.body)
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return f"cast({n.value!r} as double)"
        if isinstance(n, ast.Name):
            return {"pi": "pi()", "e": "e()"}.get(n.id, f"cast(`{n.id}` as double)")
        if isinstance(n, ast.BinOp) and type(n.op) in _SIGNS:
            a, b = sql(n.left), sql(n.right)
            return f"({a} {_SIGNS[type(n.op)]} nullif({b}, 0D))" if isinstance(n.op, (ast.Div, ast.Mod)) else f"({a} {_SIGNS[type(n.op)]} {b})"
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Pow):
            return f"power({sql(n.left)}, {sql(n.right)})"
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            return f"({'-' if isinstance(n.op, ast.USub) else '+'}{sql(n.operand)})"
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in _CALLS and not n.keywords:
            if n.func.id == "round" and len(n.args) == 2 and isinstance(n.args[1], ast.Constant):
                return f"round({sql(n.args[0])}, {int(n.args[1].value)})"
            return f"{_CALLS[n.func.id]}({', '.join(map(sql, n.args))})"
        raise ValueError(f"not part of a formula: {ast.dump(n)}")

    return F.round(F.expr(sql(ast.parse(text, mode="eval"))), 6)


def array_summary(a: Column) -> Column:
    """struct(n, mean, median, stdev, low, high, total) of an array of doubles; stdev is of a sample, null for one value."""
    n = F.size(a)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = F.try_divide(total, n)
    spread = F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) - n * mean * mean
    ordered = F.array_sort(a)
    middle = lambda k: F.get(ordered, F.floor(k).cast("int"))
    median = F.when(n > 0, (middle((n - 1) / 2) + middle(n / 2)) / 2)
    return F.struct(n.alias("n"), F.round(mean, 4).alias("mean"), F.round(median, 4).alias("median"), F.round(F.sqrt(F.when(n > 1, F.greatest(spread, F.lit(0.0)) / F.when(n > 1, n - 1))), 4).alias("stdev"), F.array_min(a).alias("low"), F.array_max(a).alias("high"), F.round(total, 4).alias("total"))
