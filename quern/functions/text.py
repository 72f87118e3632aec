"""Column functions on text. A null argument gives null unless the function says otherwise."""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

from . import tables as T

WORD = r"[\p{L}\p{N}_]+"
# What is looked for in texts.
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
PHONE = r"\+?[0-9][0-9\s\-()]{7,}[0-9]"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
NUMBER = r"-?[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?|-?[0-9]+(?:\.[0-9]+)?"
ENTITIES = {  # type: pattern, in the order they are looked for
    "email": EMAIL,
    "url": r"""https?://[^\s<>"{}|\\^`\[\]]+""",
    "phone": PHONE,
    "date": r"\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[A-Za-z]*\s+[0-9]{1,2},?\s*[0-9]{4}\b",
    "number": r"\$[0-9,.]+|\b[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?\b",
    "capitalized_phrase": r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b",
}


def found(text: Column, pattern: str) -> Column:
    """All matches, leftmost and non-overlapping."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    return found(text, WORD)


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def sentences(text: Column) -> Column:
    """Cut after . ! or ? where white space follows."""
    return F.split(F.trim(text), r"(?<=[.!?])\s+")


def summary(text: Column, most: int = 3) -> Column:
    return F.array_join(F.slice(sentences(text), 1, most), " ")


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of words; 1 if both are empty."""
    x, y = word_set(a), word_set(b)
    total = F.size(F.array_union(x, y))
    return F.when(total == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.when(total > 0, total))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words_of(lists: dict[str, list[str]]) -> Column:
    return F.array(*[F.struct(F.lit(-i).alias("place"), F.lit(n).alias("name"), F.array(*map(F.lit, w)).alias("words")) for i, (n, w) in enumerate(lists.items())])


def _scores(known: Column, lists: dict[str, list[str]]) -> Column:
    """array<struct<score,place,name>>: distinct words shared with each list; the largest is the first on a tie."""
    return F.transform(_words_of(lists), lambda m: F.struct(F.size(F.array_intersect(known, m["words"])).alias("score"), m["place"].alias("place"), m["name"].alias("name")))


def _total(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(0), lambda s, x: s + x["score"])


def language(text: Column) -> Column:
    """struct(language, confidence): the language with most distinct marker words, the first on a tie.

    Confidence is its share of all languages' marker words; without any, the first language at 0.
    """
    lists = {n: w.split() for n, w in T.LANGUAGES.items()}

    def best(s: Column) -> Column:
        top = F.array_max(s)
        return F.struct(top["name"].alias("language"), F.coalesce(F.round(F.try_divide(top["score"], _total(s)), 2), F.lit(0.0)).alias("confidence"))

    return F.when(text.isNotNull(), let(word_set(text), lambda known: let(_scores(known, lists), best)))


def sentiment(text: Column) -> Column:
    """struct(label, confidence) by distinct words of two lexicons."""

    def judged(known: Column) -> Column:
        pos, neg = (F.size(F.array_intersect(known, F.array(*map(F.lit, w)))) for w in (T.POSITIVE, T.NEGATIVE))
        return let(F.struct(pos.alias("p"), neg.alias("n")), lambda s: F.struct(F.when(s["p"] > s["n"], "positive").when(s["n"] > s["p"], "negative").otherwise("neutral").alias("label"), F.coalesce(F.round(0.5 + F.try_divide(F.abs(s["p"] - s["n"]), (s["p"] + s["n"]) * 2), 2), F.lit(0.5)).alias("confidence")))

    return F.when(text.isNotNull(), let(word_set(text), judged))


def category(text: Column, categories: list[str]) -> Column:
    """struct(category, confidence): the category with the largest score, the first on a tie, and its share of all scores.

    A score counts the words that text and category share, and 3 if the category occurs as it stands.
    """
    lists = {c: sorted(set(re.findall(r"\w+", c.lower()))) for c in categories}

    def judged(low: Column) -> Column:
        plain = let(F.array_distinct(words(low)), lambda known: _scores(known, lists))
        scored = F.transform(plain, lambda s: F.struct((s["score"] + F.when(F.contains(low, F.lower(s["name"])), 3).otherwise(0)).alias("score"), s["place"].alias("place"), s["name"].alias("name")))
        return let(scored, lambda s: F.struct(F.array_max(s)["name"].alias("category"), F.round(F.array_max(s)["score"] / F.greatest(_total(s), F.lit(1)), 3).alias("confidence")))

    return F.when(text.isNotNull(), let(F.lower(text), judged))


KEYWORD = ArrayType(StructType().add("word", StringType()).add("n", LongType()).add("first", IntegerType()))
_STOP = frozenset(T.STOPWORDS)
_KEYWORD = re.compile(r"(?<![0-9A-Za-z_])[a-z]{2,}(?![0-9A-Za-z_])")


@F.pandas_udf(KEYWORD)
def keyword_counts(text: pd.Series) -> pd.Series:
    """The five most frequent words of a lower-cased text, stop words aside, the earlier first on a tie: counted where
    the text stands, so that no words are exchanged. Null of null."""

    def one(t: str | None) -> list[dict] | None:
        if t is None:
            return None
        n: dict[str, list[int]] = {}
        for i, w in enumerate(_KEYWORD.findall(t)):
            if w not in _STOP:
                n.setdefault(w, [0, i])[0] += 1
        return [{"word": w, "n": c, "first": i} for w, (c, i) in heapq.nsmallest(5, n.items(), key=lambda x: (-x[1][0], x[1][1]))]

    return pd.Series([one(t) for t in text])


def masked(text: Column) -> Column:
    """Social security numbers, then e-mail addresses, then phone numbers replaced by their kind."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SSN, "[SSN]"), EMAIL, "[EMAIL]"), PHONE, "[PHONE]")


def entities(text: Column) -> Column:
    """array<struct<text,type>>, distinct, in order of type and place."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(found(text, pattern), lambda x: F.struct(F.trim(x).alias("text"), F.lit(kind).alias("type")))

    return F.array_distinct(F.concat(*[of(k, p) for k, p in ENTITIES.items()]))


def numbers(text: Column) -> Column:
    return F.transform(found(text, NUMBER), lambda x: F.regexp_replace(x, ",", "").cast("double"))


def spelling(text: Column) -> Column:
    """Known misspellings corrected, keeping a capital first letter or all capitals."""
    wrong, right = F.array(*[F.lit(w) for w in T.MISSPELLINGS]), F.array(*[F.lit(w) for w in T.MISSPELLINGS.values()])
    mapping = F.map_from_arrays(wrong, right)
    keep, parts = words(text), F.split(text, WORD, -1)

    def fixed(w: Column) -> Column:
        to = F.try_element_at(mapping, F.lower(w))
        cased = F.when(w == F.upper(w), F.upper(to)).when(F.substring(w, 1, 1) == F.upper(F.substring(w, 1, 1)), F.concat(F.upper(F.substring(to, 1, 1)), F.substring(to, 2, 100))).otherwise(to)
        return F.coalesce(cased, w)

    return F.array_join(F.zip_with(parts, F.concat(F.transform(keep, fixed), F.array(F.lit(""))), lambda gap, w: F.concat(gap, w)), "")


def misspelled(text: Column) -> Column:
    return F.size(F.filter(words(F.lower(text)), lambda w: w.isin(*T.MISSPELLINGS)))


def statistics(text: Column, words_per_minute: int = 238) -> Column:
    """struct(word_count, sentence_count, avg_word_length, reading_seconds, complexity)."""
    ends = F.when(F.trim(text) == "", 0).otherwise(F.greatest(F.size(F.split(F.trim(text), "[.!?]+", -1)) - 1, F.lit(1)))
    counted = let(words(text), lambda w: F.struct(F.size(w).alias("n"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("letters"), ends.alias("ends")))

    def told(c: Column) -> Column:
        long = F.coalesce(F.round(F.try_divide(c["letters"], c["n"]), 2), F.lit(0.0))
        each = F.coalesce(F.round(F.try_divide(c["n"], c["ends"]), 2), F.lit(0.0))
        return F.struct(c["n"].alias("word_count"), c["ends"].alias("sentence_count"), long.alias("avg_word_length"), F.ceil(c["n"] / words_per_minute * 60).alias("reading_seconds"), F.round(long * each * 0.1, 2).alias("complexity"))

    return let(counted, told)


def white_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def sentence_ends(text: Column) -> Column:
    """How many stretches end in . ! or ?: one for each such character."""
    return F.regexp_count(text, F.lit("[.!?]"))


def occurrences(text: Column, old: str) -> Column:
    """How often a literal occurs, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)).cast("int")


def truncated(text: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, max(most - len(suffix), 0)), F.lit(suffix)))


def slug(text: Column) -> Column:
    """Lower-case ASCII letters, digits and hyphens; accents are dropped by canonical decomposition."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(ascii_text(text)), r"[^a-z0-9_\s-]", ""), r"[\s_]+", "-"), "-+", "-"), F.lit("-"))


@F.pandas_udf(StringType())
def ascii_text(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")


def snake(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), r"([a-z0-9])([A-Z])", "$1_$2"), r"[\s-]+", "_"), "_+", "_"))


def title(text: Column) -> Column:
    """A capital after every character that is not a letter."""
    return F.array_join(F.transform(found(F.lower(text), r"\p{L}+|[^\p{L}]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def camel(text: Column) -> Column:
    parts = F.filter(F.split(F.lower(text), r"[\s_-]+"), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))), "")


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9}


def _spoken(n: int) -> str:
    for name, size in reversed(_SCALES.items()):
        if n >= size:
            head = f"{_spoken(n // size)} {name}"
            return f"{head} {_spoken(n % size)}" if n % size else head
    if n >= 100:
        head = f"{_ONES[n // 100]} hundred"
        return f"{head} {_spoken(n % 100)}" if n % 100 else head
    if n < 20:
        return _ONES[n]
    return _TENS[n // 10 - 2] + (f"-{_ONES[n % 10]}" if n % 10 else "")


@F.pandas_udf(StringType())
def number_words(value: pd.Series) -> pd.Series:
    """English words for a number below a thousand billion; digits after the point one by one."""

    def one(v: float) -> str | None:
        if pd.isna(v) or abs(v) >= 10**12:
            return None
        text = repr(int(v)) if float(v).is_integer() else repr(float(v))
        whole, _, part = text.lstrip("-").partition(".")
        out = _spoken(int(whole)) + (" point " + " ".join(_ONES[int(d)] for d in part) if part else "")
        return f"minus {out}" if v < 0 else out

    return value.map(one)


@F.pandas_udf(DoubleType())
def words_number(text: pd.Series) -> pd.Series:
    """The number that English words or digits ("1.5 million") spell; null if they don't spell one."""
    values = {w: i for i, w in enumerate(_ONES)} | {w: 10 * (i + 2) for i, w in enumerate(_TENS)}

    def one(t: str) -> float | None:
        parts = [p for p in re.split(r"[\s-]+", t.lower().replace(",", "").strip()) if p and p != "and"]
        minus = t.strip().lower().startswith(("-", "minus", "negative"))
        parts = [p for p in parts if p not in ("minus", "negative")]
        total, now = 0.0, 0.0
        for p in parts:
            if p in values:
                now += values[p]
            elif p == "hundred":
                now = (now or 1) * 100
            elif p in _SCALES:
                total, now = total + (now or 1) * _SCALES[p], 0.0
            else:
                try:
                    now += float(p)
                except ValueError:
                    return None
        return (-1 if minus else 1) * (total + now) if parts else None

    return text.map(lambda t: None if t is None else one(t)).astype("float64")
