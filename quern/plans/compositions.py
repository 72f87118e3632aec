"""Composition patterns as data: each is a table's columns led through named operators, a chain, a fan-out or a DAG.

An operator has a column builder and the SQL of the same value, so that a pattern's steps make both the plan (by
``compose.run``) and the statement that it is compared with. Where a pattern compares, the comparison is a step of its own;
where it writes or sends, the step gives the record that the write or the message leaves behind.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.catalog import query, table
from quern.functions import dates, numeric, records, text
from quern.functions import tables as fixed
from quern.operators.compose import Step, run
from quern.plans import columns as cols
from quern.sources import io

R = records.remainder
_WORDS = r"list_distinct(regexp_extract_all(lower($0), '[\p{L}\p{N}_]+'))"


def _drawn(seed: str, value: Callable[[Column], Column], sql: str, upper: bool = False) -> tuple:
    """A number from the digest of seed and a name."""
    fold = (F.upper, "upper") if upper else (F.lower, "lower")
    body = f"""'["{seed}", "' || {fold[1]}($0) || '"]'"""
    return lambda name: value(records.hashed(seed, fold[0](name))), sql.replace("#", cols.digits(body))


def _named(prefix: str, *fields: str) -> tuple:
    """The identifier of a record with these fields, in the order of the arguments."""
    at = sorted(range(len(fields)), key=lambda i: fields[i])
    body = ", ".join(f""""{fields[i]}": "' || ${i}::VARCHAR || '\"""" for i in at)
    return lambda *v: records.keyed_identifier(prefix, **dict(zip(fields, v))), f"""'{prefix}_' || substr(sha256('["{prefix}", {{{body}}}]'), 1, 12)"""


def _listed(prefix: str, seed: str, n: int) -> tuple:
    """The identifier of a record known by n values."""
    body = "".join(f""", "' || ${i}::VARCHAR || '\"""" for i in range(n))
    return lambda *v: records.identifier(prefix, seed, *[x.cast("string") for x in v]), f"""'{prefix}_' || substr(sha256('["{seed}"{body}]'), 1, 12)"""


def _best_sql(scores: dict[str, str]) -> str:
    return f"(SELECT {cols._best(scores)[0]} FROM (SELECT {_WORDS} AS w, lower($0) AS t))"


def _rate(code: str) -> tuple:
    return lambda v, r=fixed.RATES[code]: F.round(v * r, 4), f"round($0 * {fixed.RATES[code]!r}::DOUBLE, 4)"


CATEGORIES = cols.CATEGORIES
OPS: dict[str, tuple[Callable[..., Column], str]] = {
    # numbers
    "comma": (lambda x: numeric.formatted(x.cast("double"), "comma"), "format('{:,.2f}', $0::DOUBLE)"),
    "currency": (lambda x: numeric.formatted(x, "currency"), "CASE WHEN $0 < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs($0))"),
    "percent_change": (numeric.percent_change, "CASE WHEN $0 <> 0 THEN round(($1 - $0) / abs($0) * 100, 4) END"),
    "difference": (lambda a, b: F.round(a - b, 4), "round($0 - $1, 4)"),
    "larger": (F.greatest, "greatest($0, $1)"),
    "spread": (lambda a, b: F.round(F.greatest(a, b) - F.least(a, b), 4), "round(greatest($0, $1) - least($0, $1), 4)"),
    "scaled": (lambda x: x * 1.5 + 10, "$0 * 1.5 + 10"),
    "rounded": (lambda x: F.round(x.cast("decimal(18,4)"), 1).cast("double"), "round($0::DECIMAL(18, 4), 1)::DOUBLE"),
    "fahrenheit": (lambda c: numeric.convert(c, F.lit("celsius"), F.lit("fahrenheit")), "round($0 * 9 / 5 + 32, 4)"),
    "doubled": (lambda n: n * 2, "$0 * 2"),
    **{code.lower(): _rate(code) for code in ("EUR", "JPY", "GBP")},
    # dates
    "weekday": (lambda d: F.date_format(d, "EEEE"), "strftime($0, '%A')"),
    "iso": (lambda d: F.date_format(d, "yyyy-MM-dd"), "strftime($0, '%Y-%m-%d')"),
    "european": (lambda d: F.date_format(d, "dd/MM/yyyy"), "strftime($0, '%d/%m/%Y')"),
    "month": (lambda d: F.date_format(d, "MMMM yyyy"), "strftime($0, '%B %Y')"),
    "later": (lambda d: F.date_add(d.cast("date"), 30), "($0::DATE + 30)"),
    "business": (dates.business_day, "isodow($0) <= 5"),
    "days_between": (lambda a, b: F.date_diff(b.cast("date"), a.cast("date")), "date_diff('day', $0::DATE, $1::DATE)::INT"),
    # texts
    "words": (lambda t: F.size(text.words(t)), r"len(regexp_extract_all($0, '[\p{L}\p{N}_]+'))::INT"),
    "summary": (lambda t: text.summary(t, 3), r"array_to_string(list_slice(string_split(regexp_replace(trim($0, ' '), '([.!?])[ \t\n\x0B\f\r]+', '\1␞', 'g'), '␞'), 1, 3), ' ')"),
    "language": (lambda t: text.language(t)["language"], _best_sql(cols._LANG)),
    "sentiment": (lambda t: text.sentiment(t)["label"], f"(SELECT CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END FROM (SELECT len(list_intersect({_WORDS}, {cols.listed(fixed.POSITIVE)})) AS p, len(list_intersect({_WORDS}, {cols.listed(fixed.NEGATIVE)})) AS n))"),
    "category": (lambda t: text.category(t, CATEGORIES)["category"], _best_sql(cols._CATS)),
    "figures": (lambda t: F.transform(text.found(t, "[0-9]+"), lambda x: F.length(x).cast("double")), "list_transform(regexp_extract_all($0, '[0-9]+'), lambda x: length(x)::DOUBLE)"),
    "mean_of": (lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0)), 4), "round(list_avg($0), 4)"),
    "least_of": (F.array_min, "list_min($0)"),
    "most_of": (F.array_max, "list_max($0)"),
    "count_of": (F.size, "len($0)::INT"),
    "masked": (text.masked, r"regexp_replace(regexp_replace(regexp_replace($0, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', '[SSN]', 'g'), '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+', '[EMAIL]', 'g'), '\+?[0-9][0-9\s\-()]{7,}[0-9]', '[PHONE]', 'g')"),
    "slug": (text.slug, r"trim(regexp_replace(regexp_replace(regexp_replace(lower($0), '[^a-z0-9_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '-')"),
    "link": (lambda s: F.concat(F.lit("https://example.com/"), s), "'https://example.com/' || $0"),
    "french": (lambda s: cols.translated(s, F.lit("fr")), "$0 || ' (French translation)'"),
    "spanish": (lambda s: cols.translated(s, F.lit("es")), "$0 || ' (Spanish translation)'"),
    "address": (lambda s: F.concat(F.lower(F.replace(s, F.lit("#"), F.lit("."))), F.lit("@example.com")), "lower(replace($0, '#', '.')) || '@example.com'"),
    "said": (lambda a, b: F.concat_ws(": ", a.cast("string"), b.cast("string")), "concat_ws(': ', $0::VARCHAR, $1::VARCHAR)"),
    "md5": (F.md5, "md5($0)"),
    "sha256": (lambda s: F.sha2(s, 256), "sha256($0)"),
    "encrypted": (lambda s: F.base64(F.unhex(F.sha2(F.concat(F.lit('{"method": "aes256", "text": '), records.json_text(s), F.lit("}")), 256))), """to_base64(unhex(sha256('{"method": "aes256", "text": "' || $0 || '"}')))"""),
    "size": (F.length, "length($0)::INT"),
    "report": (lambda title, value: io.report(title, F.create_map(F.lit("value"), value.cast("string")), "markdown"), "'# ' || $0 || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || '- **value**: ' || $1::VARCHAR || chr(10) || chr(10) || '*Report generated at 2026-02-22T12:00:00*'"),
    "mime": (io.mime, "CASE WHEN ends_with($0, '.md') THEN 'text/markdown' WHEN ends_with($0, '.json') THEN 'application/json' ELSE 'text/plain' END"),
    "path_md": (lambda s: F.concat(F.lit("/reports/"), s.cast("string"), F.lit(".md")), "'/reports/' || $0::VARCHAR || '.md'"),
    # records
    "celsius": _drawn("weather", lambda h: (R(h, 45) - 5).cast("double"), f"({cols.mod('#', 45)} - 5)::DOUBLE"),
    "price": _drawn("stock", lambda h: (R(h, 500) + 50).cast("double"), f"({cols.mod('#', 500)} + 50)::DOUBLE", upper=True),
    "price_change": _drawn("stock", lambda h: F.round((R(h, 200) - 100) / 10, 2), f"round(({cols.mod('#', 200)} - 100) / 10, 2)", upper=True),
    "latitude": _drawn("location", lambda h: (R(h, 180) - 90).cast("double"), f"({cols.mod('#', 180)} - 90)::DOUBLE"),
    "sentence": (lambda s: F.trim(F.regexp_extract(s, r"[^.!?\n]* (?:the|of|de|la|der|el) [^.!?\n]*", 0)), r"trim(regexp_extract($0, '[^.!?\n]* (?:the|of|de|la|der|el) [^.!?\n]*', 0))"),
    "knowledge": (lambda s: F.concat(F.lit("Based on available knowledge, "), s, F.lit(" relates to a topic with multiple facets. Further research may be needed for a complete answer.")), "'Based on available knowledge, ' || $0 || ' relates to a topic with multiple facets. Further research may be needed for a complete answer.'"),
    "contact": (lambda s: F.trim(F.regexp_extract(s, r"[^.!?\n]*@[^ \n]*", 0)), r"trim(regexp_extract($0, '[^.!?\n]*@[^ \n]*', 0))"),
    "mail": _named("msg", "to", "subject"),
    "notice": _named("notif", "title"),
    "task": _named("task", "title"),
    "logged": _listed("log", "log_event", 2),
    "event": _listed("evt", "cal_event", 2),
    "reminder": _listed("rem", "reminder", 2),
    "stored": (lambda k, v: F.struct(k.alias("key"), v.cast("string").alias("value")).getField("value"), "$1::VARCHAR"),
    "warmer": (lambda a, b, x, y: F.when(a >= b, x).otherwise(y), "CASE WHEN $0 >= $1 THEN $2 ELSE $3 END"),
}


@dataclass(frozen=True)
class Pattern:
    """steps: (name, operator, inputs); inputs are steps, columns, or texts after an equals sign."""

    name: str
    level: str
    table: str
    keys: tuple[str, ...]
    steps: tuple[tuple[str, str, tuple[str, ...]], ...]

    def names(self) -> list[str]:
        return [s[0] for s in self.steps]

    def sql(self) -> str:
        out = f"SELECT * FROM {self.table}"
        for name, op, inputs in self.steps:
            body = OPS[op][1]
            for i, x in enumerate(inputs):
                body = body.replace(f"${i}", cols.q(x[1:]) if x.startswith("=") else x)
            out = f"SELECT *, {body} AS {name} FROM ({out})"
        return f"SELECT {', '.join([*self.keys, *(n for n in self.names() if not n.startswith('_'))])} FROM ({out})"

    def build(self, spark, sf):
        def step(op: str, inputs: tuple[str, ...]) -> Callable[..., Column]:
            def made(*given: Column) -> Column:
                rest = iter(given)
                return OPS[op][0](*[F.lit(x[1:]) if x.startswith("=") else next(rest) for x in inputs])

            return made

        steps = [Step(name, step(op, inputs), [x for x in inputs if not x.startswith("=")]) for name, op, inputs in self.steps]
        return run(table(spark, sf, self.table), steps).select(*self.keys, *[n for n in self.names() if not n.startswith("_")])

    def parallel(self) -> bool:
        """Two steps that wait for the same steps can run side by side."""
        own = set(self.names())
        waits = [tuple(sorted(set(i) & own)) for _, _, i in self.steps]
        return len(set(waits)) < len(waits)


def _p(name: str, level: str, of: str, keys: str, *steps: str) -> Pattern:
    """Steps as 'name operator input ...'; an input after '=' is a text, with '_' for spaces."""
    made = []
    for s in steps:
        out, op, *inputs = s.split()
        made.append((out, op, tuple(x.replace("_", " ") if x.startswith("=") else x for x in inputs)))
    return Pattern(name, level, of, tuple(keys.split()), tuple(made))


N, C, D, T, O = ("nation", "n_nationkey"), ("customer", "c_custkey"), ("documents", "doc_id"), ("conversations", "conv_id turn"), ("orders", "o_orderkey")
PATTERNS = [
    # chains
    _p("search_summarize", "L1", *T, "_found sentence text", "summary summary _found"),
    _p("stock_convert", "L1", *N, "price price n_name", "euros eur price"),
    _p("entity_sentiment", "L1", *D, "_entity contact text", "label sentiment _entity"),
    _p("search_translate", "L1", *T, "_found sentence text", "translated french _found"),
    _p("weather_email", "L1", *N, "celsius celsius n_name", "body said n_name celsius", "sent mail n_name celsius"),
    _p("read_summarize", "L1", *T, "summary summary text"),
    _p("kb_translate", "L1", *N, "_known knowledge n_name", "translated spanish _known"),
    _p("search_classify", "L1", *T, "_found sentence text", "category category _found"),
    _p("word_count_format", "L1", *D, "words words text", "shown comma words"),
    _p("detect_translate", "L1", *T, "language language text", "_said said language text", "translated french _said"),
    _p("pctchange_format", "L1", *C, "changed scaled c_acctbal", "change percent_change c_acctbal changed", "shown comma change"),
    _p("read_wordcount", "L1", *T, "words words text"),
    _p("weather_log", "L1", *N, "celsius celsius n_name", "logged logged =weather celsius"),
    _p("calc_round", "L1", *C, "result scaled c_acctbal", "shown rounded result"),
    _p("extract_nums_minmax", "L1", *D, "_figures figures text", "low least_of _figures", "high most_of _figures"),
    _p("extract_nums_mean", "L1", *D, "_figures figures text", "mean mean_of _figures"),
    _p("invoice_email", "L1", *O, "total currency o_totalprice", "sent mail o_custkey total"),
    _p("report_save", "L1", *N, "report report n_name n_nationkey", "path path_md n_nationkey", "size size report", "type mime path"),
    _p("encrypt_save", "L1", *C, "secret encrypted c_name", "path path_md c_custkey", "size size secret"),
    _p("slugify_url", "L1", *C, "slug slug c_name", "link link slug"),
    _p("entity_mask", "L1", *D, "_entity contact text", "masked masked _entity"),
    _p("stock_pctchange", "L1", *N, "price price n_name", "_moved price_change n_name", "_before difference price _moved", "change percent_change _before price"),
    _p("weather_calendar", "L1", *N, "celsius celsius n_name", "event event n_name celsius"),
    _p("parse_weekday", "L1", *O, "later later o_orderdate", "weekday weekday later"),
    # fan-outs
    _p("multi_weather", "L2", *N, "_other slug n_name", "here celsius n_name", "there celsius _other", "warmer warmer here there n_name _other"),
    _p("multi_stock", "L2", *N, "_other slug n_name", "one price n_name", "two price _other", "best warmer one two n_name _other"),
    _p("multi_sentiment", "L2", *T, "_found sentence text", "first sentiment _found", "second sentiment text"),
    _p("parallel_search_kb", "L2", *T, "found sentence text", "known knowledge role"),
    _p("multi_translate", "L2", *C, "french french c_name", "spanish spanish c_name"),
    _p("multi_hash", "L2", *C, "name md5 c_name", "segment md5 c_mktsegment", "sha sha256 c_name"),
    _p("multi_format_date", "L2", *O, "iso iso o_orderdate", "european european o_orderdate", "month month o_orderdate"),
    _p("multi_detect_language", "L2", *T, "_short summary text", "whole language text", "start language _short"),
    _p("parallel_weather_stock", "L2", *N, "celsius celsius n_name", "price price n_name"),
    _p("multi_word_count", "L2", *T, "_summary summary text", "whole words text", "short words _summary", "more larger whole short"),
    _p("multi_extract_numbers", "L2", *D, "_summary summary text", "_figures figures text", "_early figures _summary", "whole count_of _figures", "start count_of _early"),
    _p("parallel_weather_location", "L2", *N, "celsius celsius n_name", "latitude latitude n_name"),
    _p("multi_business_days", "L2", *O, "later later o_orderdate", "today business o_orderdate", "due business later"),
    _p("weather_stock_location", "L2", *N, "celsius celsius n_name", "price price n_name", "latitude latitude n_name"),
    # DAGs
    _p("weather_compare_email", "L3", *N, "_other slug n_name", "here celsius n_name", "there celsius _other", "warmest larger here there", "fahrenheit fahrenheit warmest", "sent mail n_name fahrenheit"),
    _p("stock_compare_notify", "L3", *N, "_other slug n_name", "one price n_name", "two price _other", "best larger one two", "euros eur best", "notice notice euros"),
    _p("search_summarize_translate_email", "L3", *T, "_found sentence text", "summary summary _found", "translated french summary", "size size translated", "sent mail conv_id size"),
    _p("read_extract_stats_save", "L3", *D, "_figures figures text", "mean mean_of _figures", "most most_of _figures", "least least_of _figures", "spread spread most least"),
    _p("search_keyword_summarize", "L3", *T, "_found sentence text", "words words _found", "summary summary text", "short words summary"),
    _p("detect_translate_summarize_email", "L3", *T, "language language text", "_summary summary text", "translated spanish _summary", "size size translated"),
    _p("multi_stock_pctchange_notify", "L3", *N, "_other slug n_name", "one price n_name", "two price _other", "change percent_change one two", "notice notice change"),
    _p("weather_calendar_reminder", "L3", *N, "celsius celsius n_name", "event event n_name celsius", "reminder reminder n_name event"),
    _p("multi_entity_mask_save", "L3", *D, "_a contact text", "_b sentence text", "_both said _a _b", "masked masked _both", "path path_md doc_id", "size size masked"),
    _p("read_wordcount_pctchange_log", "L3", *T, "_short summary text", "whole words text", "short words _short", "change percent_change whole short", "logged logged =words change"),
    _p("search_entities_sentiment_report", "L3", *T, "_found sentence text", "label sentiment _found", "_masked masked text", "entity_label sentiment _masked", "report report role label"),
    _p("multi_currency_spread_format", "L3", *C, "euros eur c_acctbal", "pounds gbp c_acctbal", "spread spread euros pounds", "shown comma spread"),
    _p("kb_translate_hash_email", "L3", *N, "_known knowledge n_name", "translated french _known", "hash sha256 translated", "sent mail n_name hash"),
    _p("products_compare_notify", "L3", *C, "changed scaled c_acctbal", "best larger c_acctbal changed", "shown currency best", "notice notice shown"),
    _p("kb_sentiment_store", "L3", *N, "_known knowledge n_name", "label sentiment _known", "stored stored n_name label"),
    _p("entities_classify_task", "L3", *D, "_entity contact text", "category category _entity", "task task category"),
    _p("directions_weather_schedule", "L3", *N, "latitude latitude n_name", "celsius celsius n_name", "body said latitude celsius", "event event n_name body"),
]


def _register(p: Pattern) -> None:
    query(f"pattern_{p.name}", p.sql())(p.build)


for _pattern in PATTERNS:
    _register(_pattern)
