"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Built-in functions only. Positions come from cutting the text at a pattern's matches: the lengths of the
pieces and of the matches add up to code-point offsets. The patterns are written so that an attempt can
start only where a leftmost match could (look-behind or \\G) and never backtracks over a run, which keeps
them linear on very long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
RUN = 128
"""Matches whose spans are gathered together; a text's runs are joined at its end."""

THRESHOLD = 0.5
"""Least score of an added kind's span; base spans are reported whatever their score."""

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
NEEDS = {"email": "@", "phone": "+"}  # a text without it has no match

_DIGITS = "regexp_replace({m}, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + if(i % 2 = 0,
  2 * cast(substring({_DIGITS}, -i, 1) as int) - if(cast(substring({_DIGITS}, -i, 1) as int) > 4, 9, 0),
  cast(substring({_DIGITS}, -i, 1) as int))) % 10 = 0"""
_CHAR = "ascii(substring(concat(substring(replace({m}, ' ', ''), 5), left(replace({m}, ' ', ''), 4)), i, 1))"
_MOD97 = f"aggregate(sequence(1, length(replace({{m}}, ' ', ''))), 0, (s, i) -> (if({_CHAR} > 57, s * 100 + {_CHAR} - 55, s * 10 + {_CHAR} - 48)) % 97) = 1"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

VALID = {
    "email": "true",
    "ip": rf"{{m}} rlike '^{_OCTET}\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}$'".replace("\\\\.", "[.]"),
    "card": f"if(length({_DIGITS}) between 16 and 19, {_LUHN}, false)",
    "phone": f"length({_DIGITS}) between 8 and 15",
    "iban": f"if(length(replace({{m}}, ' ', '')) between 15 and 34, {_MOD97}, false)",
    "ssn": r"not ({m} rlike '^(000|666|9)|-00-|-0000$')",
}
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {  # words within 40 code points before or 20 after a span: for it, against it
    "email": ("mail|contact|write|address", "example only"),
    "ip": ("ip|host|server|address", "version|release|build"),
    "card": ("card|visa|mastercard|credit|debit|payment|karte|tarjeta|carte", "order|tracking|serial|isbn"),
    "phone": ("phone|tel|call|mobile|fax|whatsapp", "score|version"),
    "iban": ("iban|account|bank|transfer|konto|cuenta|compte", "serial|part"),
    "ssn": ("ssn|social security|social", "part|serial|order"),
}


def _proposed(text: Column, kind: str) -> Column:
    """The pattern's matches, leftmost and non-overlapping."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(none) if kind in NEEDS else found


def _score(kind: str, m: str, before: str, after: str) -> str:
    near = f"lower(concat(right({before}, 40), ' ', left({after}, 20)))"
    good, bad = CONTEXT[kind]
    return f"least(1D, greatest(0D, {PRIOR[kind]}D + if({near} rlike '\\\\b({good})\\\\b', 0.3D, 0D) - if({near} rlike '\\\\b({bad})\\\\b', 0.3D, 0D)))"


def _accepts(kind: str, m: str, before: str, after: str) -> str:
    valid = VALID[kind].replace("{m}", m)
    return f"if({valid}, {_score(kind, m, before, after)} >= {THRESHOLD}D, false)" if kind in ADDED else f"({valid})"


def _spans(kind: str, f: str, g: str) -> Column:
    m, before, after = f"get({f}, k)", f"get({g}, k)", f"get({g}, k + 1)"
    start = f"run.pos + length({before})"
    one = f"named_struct('kind', '{kind}', 'start', {start}, 'end', {start} + length({m}), 'score', {_score(kind, m, before, after)}, 'text', {m})"
    kind_of = "array<struct<kind:string,start:int,end:int,score:double,text:string>>"
    # matches are folded in runs, each with a list of its own, so that no step copies more than a run or the list of runs
    inner = f"""aggregate(sequence(c * {RUN}, least(size({f}) - 1, c * {RUN} + {RUN - 1})), named_struct('pos', acc.pos, 'out', cast(array() as {kind_of})), (run, k) -> named_struct(
      'pos', {start} + length({m}), 'out', if({_accepts(kind, m, before, after)}, concat(run.out, array({one})), run.out)))"""
    fold = f"""flatten(aggregate(sequence(0, (size({f}) - 1) div {RUN}), named_struct('pos', 0, 'out', cast(array() as array<{kind_of}>)), (acc, c) ->
      transform(array({inner}), x -> named_struct('pos', x.pos, 'out', concat(acc.out, array(x.out))))[0]).out)"""
    return F.expr(f"if(size({f}) > 0, {fold}, cast(array() as {kind_of}))")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): spans is array<struct<kind,start,end,score,text>>, kinds in order, then by start.

    start and end are code points, end exclusive. The base kinds (e-mail, IPv4, card, phone) keep every
    valid match; IBANs need mod-97 and US social security numbers a context word. A null text counts as
    empty and has no spans; repeated rows and null ids are kept; other columns are ignored.
    """
    kinds = BASE + ADDED
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", "text", *[_proposed(F.col("text"), k).alias(f"f_{k}") for k in kinds])
    gaps = [F.when(F.size(f"f_{k}") > 0, F.split("text", PATTERNS[k], -1)).alias(f"g_{k}") for k in kinds]
    rows = rows.select("doc_id", *[f"f_{k}" for k in kinds], *gaps)
    return rows.select("doc_id", F.concat(*[_spans(k, f"f_{k}", f"g_{k}") for k in kinds]).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each reported span of text replaced by its kind in brackets, kind after kind; null stays null.

    n_chars, where there is one, follows the new text. The other columns, and rows that repeat, stay as they are.
    """
    out = docs
    for k in BASE + ADDED:
        f, g = fresh(docs, f"__f_{k}"), fresh(docs, f"__g_{k}")
        out = out.withColumn(f, _proposed(F.col("text"), k))
        out = out.withColumn(g, F.when(F.size(f) > 0, F.split("text", PATTERNS[k], -1)))
        m, before, after = f"get({f}, k)", f"get({g}, k)", f"get({g}, k + 1)"
        piece = f"concat({before}, coalesce(if(k < size({f}), if({_accepts(k, m, before, after)}, '[{k.upper()}]', {m}), ''), ''))"
        out = out.withColumn("text", F.expr(f"if(size({f}) > 0, array_join(transform(sequence(0, size({f})), k -> {piece}), ''), text)")).drop(f, g)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of find(): counts of the base kinds, their digest, and all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    scores = F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",")
    return find(docs).select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))
