"""Readers and sinks. Schemas are given, never inferred, unless a file describes itself."""

from __future__ import annotations

import csv as csv_module
import json
import uuid
from io import StringIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quern.functions import records as R
from quern.functions import tables as fixed
from quern.operators.ordered import numbered
from quern.session import own_folder

SCORE = "struct<task_id:string,level:string,overall:double,tool_sequence_score:double,argument_score:double,completeness_score:double,data_flow_score:double,error_type:string,call_scores:array<struct<step:string,tool_correct:boolean,args_score:double,matched:boolean>>>"
RECORD = f"task_id:string,model:string,score:{SCORE},tokens:struct<input:bigint,output:bigint>,latency_ms:double,num_tool_calls:int"
RESULTS = f"models map<string,struct<model:struct<name:string,provider:string>,task_results:array<struct<{RECORD}>>>>"


def results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested results documents as (model_key, model, provider, task_id, level, ...): a row for each task. A file is one document,
    or with lines a document a line, so that files of many can be split."""
    doc = spark.read.option("multiLine", not lines).schema(RESULTS).json(path)
    models = doc.select(F.explode("models").alias("model_key", "m"))
    r = models.select("model_key", F.col("m.model.name").alias("model"), F.col("m.model.provider").alias("provider"), F.explode("m.task_results").alias("r"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return r.select("model_key", "model", "provider", "r.task_id", "r.score.level", *[zero(F.col(f"r.score.{c}")).alias(c) for c in ("overall", "tool_sequence_score", "argument_score", "completeness_score", "data_flow_score")], "r.score.error_type", "r.tokens.input", "r.tokens.output", "r.latency_ms", "r.num_tool_calls")


def records(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSON lines of scored tasks with the file's name; a malformed line is left out, or stops a strict read."""
    schema = T.StructType.fromDDL(RECORD)
    if strict:
        return spark.read.option("mode", "FAILFAST").schema(schema).json(path).withColumn("file", F.col("_metadata.file_name"))
    schema = schema.add("_corrupt", T.StringType())
    rows = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(schema).json(path)
    return rows.withColumn("file", F.col("_metadata.file_name")).where("_corrupt is null and task_id is not null").drop("_corrupt")


def first_complete(runs: list[DataFrame], least: int = 200) -> DataFrame:
    """Rows of all runs, of each model only the first run that has at least so many of its rows."""
    every = None
    for i, r in enumerate(runs):
        r = r.withColumn("run", F.lit(i))
        every = r if every is None else every.unionByName(r, allowMissingColumns=True)
    whole = every.groupBy("model", "run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return every.join(whole.groupBy("model").agg(F.min("run").alias("run")), ["model", "run"], "left_semi").select(every.columns)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def yes_no(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(t.isin("Y", "YES", "1", "TRUE", "CORRECT"), True).when(t.isin("N", "NO", "0", "FALSE", "INCORRECT"), False)


def newest(spark: SparkSession, path: str) -> str | None:
    """The path of the file changed last."""
    r = spark.read.format("binaryFile").load(path).select("path", "modificationTime").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    return r["p"]


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified), sorted by path; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("path")


def text_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.length("value").alias("size"))


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """A report of few rows as one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


EXPORT = "task_id string, level string, prompt string, available_tools array<string>, expected_trace string, expected_final_answer string, num_steps int, num_tools_offered int, category string, pattern string"


def flat_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks as the ten columns of EXPORT, nested parts as JSON: the trace with its steps' arguments as objects, and the answer.

    tasks: task_id, level, prompt, available_tools, steps array<struct<id,tool,arguments,depends_on>> with arguments as JSON text,
    answer_from, answer (JSON text), category and pattern. Null lists count as empty, a null category or pattern as no text;
    arguments that are no JSON stay null.
    """
    steps = F.transform(F.coalesce("steps", F.array().cast(tasks.schema["steps"].dataType)), lambda s: F.struct(s["id"].alias("step_id"), s["tool"].alias("tool_name"), F.try_parse_json(s["arguments"]).alias("arguments"), F.coalesce(s["depends_on"], F.array().cast("array<string>")).alias("depends_on")))
    tools = F.coalesce("available_tools", F.array().cast("array<string>"))
    made = {
        "task_id": F.col("task_id").cast("string"), "level": F.col("level"), "prompt": F.col("prompt"), "available_tools": tools, "expected_trace": F.to_json(F.struct(steps.alias("steps"), F.col("answer_from").alias("final_answer_source"))),
        "expected_final_answer": F.to_json(F.try_parse_json("answer")), "num_steps": F.size(steps), "num_tools_offered": F.size(tools), "category": F.coalesce("category", F.lit("")), "pattern": F.coalesce("pattern", F.lit("")),
    }
    return tasks.select(*[c.alias(n) for n, c in made.items()])


def violations(tasks: DataFrame) -> DataFrame:
    """(task_id, fault) for tasks without a prompt, tools or steps."""
    fault = F.when(F.coalesce(F.trim("prompt"), F.lit("")) == "", "no prompt").when(F.coalesce(F.size("available_tools"), F.lit(0)) < 1, "no tools").when(F.coalesce(F.col("num_steps"), F.lit(0)) < 1, "no steps")
    return tasks.select("task_id", fault.alias("fault")).where("fault is not null")


def converted(data: Column, of: str, to: str, schema: str) -> Column:
    """One record as JSON, CSV or "key: value" text, into another of these."""
    row = F.from_json(data, schema) if of == "json" else F.from_csv(data, schema)
    if to == "json":
        return F.to_json(row)
    if to == "csv":
        return F.to_csv(row)
    names = T.StructType.fromDDL(schema).names
    return F.concat_ws(", ", *[F.concat(F.lit(f"{n}: "), row[n].cast("string")) for n in names])


def _records(data: str, of: str) -> object:
    """What a text holds: a list of records where it is one, a record, or the text itself."""
    if of == "csv":
        head, *lines = [*csv_module.reader(StringIO(data))] or [[]]
        return [dict(zip(head, x)) for x in lines if x]
    return json.loads(data) if of == "json" else data


def _sheet(records: list[dict]) -> str:
    """Lines of the first record's fields, in its order, under a header."""
    out = StringIO()
    names = list(records[0])
    if any(not isinstance(r, dict) or r.keys() - records[0].keys() for r in records):
        raise ValueError("a record with other fields")
    csv_module.writer(out).writerows([names, *([r.get(n, "") for n in names] for r in records)])
    return out.getvalue()


def _said(record: object, between: str) -> str:
    return between.join(f"{k}: {v}" for k, v in record.items()) if isinstance(record, dict) else str(record)


def _table_text(data: str, of: str, to: str) -> str | None:
    """One text as JSON, CSV with a header or plain text, into another of these; null where it can't be read or written."""
    try:
        held = _records(data, of)
        if to == "json":
            return json.dumps(held, indent=2)
        listed = isinstance(held, list)
        if to == "csv":
            return _sheet(held) if listed and held and isinstance(held[0], dict) else str(held)
        return "\n".join(_said(r, ", ") for r in held) if listed else _said(held, "\n")
    except (ValueError, csv_module.Error):
        return None


@F.pandas_udf(T.StringType())
def transform_format(data: pd.Series, of: pd.Series, to: pd.Series) -> pd.Series:
    """Whole texts from json, csv or text into another of these; null of null and of what can't be read."""
    return pd.Series([None if d is None else _table_text(d, o, t) for d, o, t in zip(data, of, to)], dtype="object")


def markdown_document(df: DataFrame, order: list[str], digits: int = 4) -> DataFrame:
    """(place, line): a Markdown table with its header, rows by order. For reports: a row for each group."""
    names = df.columns
    rows = numbered(df, order, name="__place")
    cell = lambda f: F.coalesce(F.when(~F.isnan(f.name), F.format_string(f"%.{digits}f", F.col(f.name))), F.lit("—")) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.coalesce(F.col(f.name).cast("string"), F.lit("—"))
    body = rows.select((F.col("__place") + 1).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(f) for f in df.schema.fields]), F.lit(" |")).alias("line"))
    return _headed(body, [f"| {' | '.join(names)} |", f"| {' | '.join('---' for _ in names)} |"], [])


def _headed(body: DataFrame, head: list[str], tail: list[str]) -> DataFrame:
    """body's places with lines before and after them."""
    spark = body.sparkSession
    top = spark.createDataFrame([(i, x) for i, x in enumerate(head)], "place long, line string")
    out = top.unionByName(body.select("place", "line"))
    return out.unionByName(spark.createDataFrame([((1 << 62) + i, x) for i, x in enumerate(tail)], "place long, line string")) if tail else out


def latex_document(df: DataFrame, order: list[str], best: dict[str, bool], caption: str, label: str, titles: dict[str, str] | None = None) -> DataFrame:
    """(place, line): a LaTeX table, rows by order, shares in percent; the best value of each column of best, the largest if
    True and else the smallest, and what is within 0.0001 of it, in bold. For reports: a row for each group."""
    titles = titles or {}
    tops = df.agg(*[(F.max if high else F.min)(c).alias(f"__{c}") for c, high in best.items()])
    rows = numbered(df, order, name="__place").join(F.broadcast(tops))  # one row

    def cell(f: T.StructField) -> Column:
        if not isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.coalesce(F.col(f.name).cast("string"), F.lit("--"))
        c = F.concat(F.format_string("%.1f", F.round(F.col(f.name) * 100, 1)), F.lit("\\%"))
        shown = F.when(F.abs(F.col(f.name) - F.col(f"__{f.name}")) < 1e-4, F.concat(F.lit("\\textbf{"), c, F.lit("}"))).otherwise(c) if f.name in best else c
        return F.when(F.col(f.name).isNull(), "--").otherwise(shown)

    body = rows.select((F.col("__place") + 7).alias("place"), F.concat(F.concat_ws(" & ", *[cell(f) for f in df.schema.fields]), F.lit(" \\\\")).alias("line"))
    head = ["\\begin{table}[t]", "\\centering", f"\\caption{{{caption}}}", f"\\label{{{label}}}", f"\\begin{{tabular}}{{l{'c' * (len(df.columns) - 1)}}}", "\\toprule", " & ".join(titles.get(c, c) for c in df.columns) + " \\\\", "\\midrule"]
    return _headed(body, head, ["\\bottomrule", "\\end{tabular}", "\\end{table}"])


def markdown(df: DataFrame, digits: int = 4) -> DataFrame:
    """(line): the rows of a Markdown table, numbers rounded, null and NaN as a dash."""
    cell = lambda f: F.when(F.col(f.name).isNull() | F.isnan(f.name), "–").otherwise(F.format_string(f"%.{digits}f", F.col(f.name))) if isinstance(f.dataType, T.DoubleType) else F.coalesce(F.col(f.name).cast("string"), F.lit("–"))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(f) for f in df.schema.fields]), F.lit(" |")).alias("line"))


TASK = "struct<task_id:string,level:string,prompt:string,available_tools:array<string>,num_steps:int>"


def suite(spark: SparkSession, path: str) -> DataFrame:
    """A task suite's tasks, a row for each. A document without name, version, stats or tasks stops the read."""
    doc = spark.read.option("multiLine", True).schema(f"name string, version string, stats struct<n:int>, tasks array<{TASK}>").json(path)
    whole = F.expr("name is not null and version is not null and stats is not null and tasks is not null")
    return doc.select(F.when(whole, F.col("tasks")).otherwise(F.raise_error(F.lit("a suite has name, version, stats and tasks"))).alias("tasks")).select(F.inline("tasks"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; in a temporary one where driver and executors are one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared}/quern-{uuid.uuid4().hex}/{name}" if shared else f"{own_folder()}/{name}"


def report(title: Column, data: Column, style: str) -> Column:
    """A report on a map of texts: text, markdown or html."""
    entries = F.map_entries(data)
    each = lambda form: F.array_join(F.transform(entries, form), "\n")
    if style == "markdown":
        return F.concat(F.lit("# "), title, F.lit("\n\n## Summary\n\n"), each(lambda e: F.concat(F.lit("- **"), e["key"], F.lit("**: "), e["value"])), F.lit(f"\n\n*Report generated at {R.STAMP}*"))
    if style == "html":
        return F.concat(F.lit("<h1>"), title, F.lit("</h1>\n<h2>Summary</h2>\n<ul>\n"), each(lambda e: F.concat(F.lit("  <li><strong>"), e["key"], F.lit("</strong>: "), e["value"], F.lit("</li>"))), F.lit(f"\n</ul>\n<p><em>Report generated at {R.STAMP}</em></p>"))
    return F.concat(F.upper(title), F.lit("\n"), F.repeat(F.lit("="), F.length(title)), F.lit("\n\nSummary:\n"), each(lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"])), F.lit(f"\n\nGenerated: {R.STAMP}"))


def mime(path: Column) -> Column:
    return F.coalesce(*[F.when(path.endswith(end), kind) for end, kind in fixed.MIME_TYPES.items()], F.lit("text/plain"))


def written(log: DataFrame, order: str) -> DataFrame:
    """(path, content, size, type, overwrote_existing): files after a log of writes (path, content), the last by order."""
    last = log.groupBy("path").agg(F.max_by("content", order).alias("content"), F.count(F.lit(1)).alias("n"))
    return last.select("path", "content", F.length("content").alias("size"), mime(F.col("path")).alias("type"), (F.col("n") > 1).alias("overwrote_existing"))


def transcribed(source: Column) -> Column:
    """struct<known,text,seconds,confidence,segments>: the transcript whose word the source's name holds, else a general one."""
    def heard(known: bool, said: str, seconds: Column, confidence: Column, segments: list) -> Column:
        parts = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text")) for a, b, t in segments])
        return F.struct(F.lit(known).alias("known"), F.lit(said).alias("text"), seconds.alias("seconds"), confidence.alias("confidence"), parts.alias("segments"))

    h = R.hashed("transcribe", source)
    other = heard(False, " ".join(t for _, _, t in fixed.OTHER_TRANSCRIPT), R.remainder(h, 120) + 30, F.round(0.85 + R.remainder(h, 15) / 100, 2), fixed.OTHER_TRANSCRIPT)
    return F.coalesce(*[F.when(F.lower(source).contains(word), heard(True, t, F.lit(s).cast("long"), F.lit(0.95), g)) for word, (t, s, g) in fixed.TRANSCRIPTS.items()], other)


def latex(df: DataFrame, best: list[str], digits: int = 4) -> DataFrame:
    """(line): the rows of a LaTeX table, the largest value of each best column in bold; a row for each group."""
    def cell(f: T.StructField) -> Column:
        c = F.coalesce(F.format_string(f"%.{digits}f", f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name).cast("string"), F.lit("--"))
        top = F.col(f.name) == F.max(f.name).over(W.partitionBy(F.lit(1)))
        return F.when(top, F.concat(F.lit("\\textbf{"), c, F.lit("}"))).otherwise(c) if f.name in best else c

    return df.select(F.concat(F.concat_ws(" & ", *[cell(f) for f in df.schema.fields]), F.lit(" \\\\")).alias("line"))
