"""The library's column functions by name, with schemas for callers that choose functions from a list."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import dates, numeric, text, web

_JSON = {"int": "integer", "float": "number", "bool": "boolean", "list[str]": "array", "dict[str, Column]": "object", "dict[str, list[str]]": "object"}


@dataclass(frozen=True)
class Function:
    name: str
    category: str
    build: Callable[..., Column]

    def schema(self) -> dict:
        """Name, description and parameters; a parameter without a default is required."""
        shape = inspect.signature(self.build).parameters.values()
        kinds = {p.name: _JSON.get(str(p.annotation), "string") for p in shape}
        properties = {n: {"type": k, **({"items": {"type": "string"}} if k == "array" else {})} for n, k in kinds.items()}
        required = [p.name for p in shape if p.default is inspect.Parameter.empty]
        about = " ".join((inspect.getdoc(self.build) or self.name.replace("_", " ")).split())
        return {"type": "function", "function": {"name": self.name, "description": about, "parameters": {"type": "object", "properties": properties, "required": required}}}


_FUNCTIONS: dict[str, Function] = {}


def register(name: str, category: str, build: Callable[..., Column]) -> Function:
    if name in _FUNCTIONS:
        raise ValueError(f"function {name} is registered twice")
    _FUNCTIONS[name] = Function(name, category, build)
    return _FUNCTIONS[name]


def functions() -> list[Function]:
    return [_FUNCTIONS[n] for n in sorted(_FUNCTIONS)]


def call(name: str, **arguments: object) -> Column:
    """The function's column; a KeyError names the functions there are."""
    if name not in _FUNCTIONS:
        raise KeyError(f"{name} is none of {', '.join(sorted(_FUNCTIONS))}")
    return _FUNCTIONS[name].build(**arguments)


def upper(text: Column) -> Column:
    return F.upper(text)


def lower(text: Column) -> Column:
    return F.lower(text)


for _name, _build in {"percentage_change": numeric.percent_change, "clamp_value": numeric.clamp, "unit_convert": numeric.convert, "format_number": numeric.formatted, "calculator": numeric.formula, "statistical_analysis": numeric.array_summary}.items():
    register(_name, "computation", _build)
for _name, _build in {"format_date": dates.styled, "parse_date": dates.parsed, "add_duration": dates.added, "is_business_day": dates.business_day, "business_days_between": dates.business_days, "next_occurrence": dates.next_weekday, "time_since": dates.since, "convert_timezone": dates.moved, "calculate_date_diff": dates.difference}.items():
    register(_name, "time_scheduling", _build)
for _name, _build in {"tokenize_text": text.words, "text_similarity": text.overlap, "detect_language": text.language, "sentiment_analysis": text.sentiment, "classify_text": text.category, "mask_pii": text.masked, "extract_entities": text.entities, "extract_numbers": text.numbers, "spell_check": text.spelling, "generate_summary_stats": text.statistics, "summarize_text": text.summary, "truncate_text": text.truncated, "slugify": text.slug, "snake_case": text.snake, "title_case": text.title, "camel_case": text.camel, "upper_case": upper, "lower_case": lower}.items():
    register(_name, "text_processing", _build)
for _name, _build in {"url_parse": web.parts, "extract_domain": web.domain, "encode_url": web.percent_encoded, "decode_url": web.percent_decoded, "generate_url": web.built, "parse_html": web.html_text, "extract_links": web.links, "validate_email": web.valid_email, "json_extract": web.json_path, "base64_encode": web.base64_text, "base64_decode": web.unbase64_text, "hash_text": web.digest}.items():
    register(_name, "information_retrieval", _build)
