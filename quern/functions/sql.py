"""The library under SQL names: the answer parser as a table function, and column functions as SQL functions."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quern.operators.scoring import heard
from quern.session import importable


class ParseCalls:
    """parse_calls(answer, name, ...): a row for each call in a model's answer, or for the fault of what should be one.

    The columns are call_index (from 0, null with a fault), tool, arguments (JSON), fault (no_call, not_json, no_tool), and one
    for each argument named, whose names must be constants: its value as text, JSON where it is no text. A null answer gives
    no row.
    """

    @staticmethod
    def analyze(answer: AnalyzeArgument, *names: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(answer.dataType, StringType):
            raise ValueError(f"parse_calls reads text, not {answer.dataType.simpleString()}")
        if not all(n.isConstantExpression and isinstance(n.value, str) for n in names):
            raise ValueError("the names of arguments are constant texts")
        schema = StructType().add("call_index", IntegerType()).add("tool", StringType()).add("arguments", StringType()).add("fault", StringType())
        for n in names:
            schema = schema.add(n.value, StringType())
        return AnalyzeResult(schema)

    def eval(self, answer: str | None, *names: str):
        n = 0
        for call, fault in heard(answer) if answer is not None else []:
            if call is None:
                yield (None, None, None, fault, *(None for _ in names))
                continue
            given = json.loads(call["arguments"])
            said = [None if (v := given.get(k)) is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k in names]
            yield (n, call["tool"], call["arguments"], None, *said)
            n += 1


_DEFINED = {
    # name: parameters, result, body; each as the column function of the same name in this package
    "percentage_change": ("old DOUBLE, new DOUBLE", "DOUBLE", "round(try_divide(new - old, abs(old)) * 100, 4)"),
    "clamp_value": ("value DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "greatest(low, least(value, high))"),
    "match_numeric": ("expected DOUBLE, actual DOUBLE", "DOUBLE", "if(expected = actual or if(expected = 0, abs(actual) < 1e-4, abs(expected - actual) <= 1e-4 * greatest(abs(expected), abs(actual))), 1.0D, 0.0D)"),
    "match_string": ("expected STRING, actual STRING", "DOUBLE", """(select case when e = a then 1.0D when 1 - levenshtein(e, a) / greatest(length(e), length(a), 1) >= 0.85 then 1 - levenshtein(e, a) / greatest(length(e), length(a), 1) else 0.0D end
      from (select lower(trim(regexp_replace(expected, r'\\s+', ' '))) as e, lower(trim(regexp_replace(actual, r'\\s+', ' '))) as a))"""),
    "is_business_day": ("day DATE", "BOOLEAN", "weekday(day) < 5"),
    "pass_rate": ("scores ARRAY<DOUBLE>", "DOUBLE", "(select avg(if(s >= 0.85, 1.0D, 0.0D)) from (select explode(scores) as s))"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to spark.sql in this session; their names."""
    importable(spark)
    spark.udtf.register("parse_calls", udtf(ParseCalls))
    for name, (parameters, result, body) in _DEFINED.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return ["parse_calls", *_DEFINED]
