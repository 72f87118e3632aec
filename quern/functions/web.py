"""Column functions on urls, HTML, JSON, encodings and hashes."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .text import found

# What an e-mail address, a url in a text and a link in HTML look like.
ADDRESS = r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+$"
URL = r"""https?://[^\s<>"')\]]+"""
HREF = r"""(?i)href=["']([^"']+)["']"""


def parts(url: Column) -> Column:
    """struct(scheme, netloc, path, query, fragment), empty where absent."""
    pick = lambda g: F.coalesce(F.regexp_extract(url, r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", g), F.lit(""))
    return F.struct(F.lower(pick(1)).alias("scheme"), pick(2).alias("netloc"), pick(3).alias("path"), pick(4).alias("query"), pick(5).alias("fragment"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))


def domain(url: Column) -> Column:
    """struct(subdomain, domain, tld): the last two labels are the domain's name and ending."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    return F.struct(F.array_join(F.slice(labels, 1, F.greatest(n - 2, F.lit(0))), ".").alias("subdomain"), F.when(n >= 2, F.get(labels, n - 2)).otherwise(F.get(labels, n - 1)).alias("domain"), F.when(n >= 2, F.get(labels, n - 1)).otherwise("").alias("tld"))


def percent_encoded(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def percent_decoded(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def built(base: Column, path: Column, params: dict[str, Column]) -> Column:
    query = F.array_join(F.array(*[F.concat(F.url_encode(F.lit(k)), F.lit("="), F.url_encode(v.cast("string"))) for k, v in params.items()]), "&")
    tail = F.when(path == "", "").otherwise(F.concat(F.lit("/"), F.regexp_replace(path, "^/+", "")))
    return F.concat(F.regexp_replace(base, "/+$", ""), tail, F.lit("?"), query) if params else F.concat(F.regexp_replace(base, "/+$", ""), tail)


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(html: Column) -> Column:
    """Text without scripts, styles and tags, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", ""), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def link_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<a\s"))


def links(text: Column) -> Column:
    """Plain urls, then href values; end punctuation stripped, http and https only, distinct in order."""
    every = F.concat(found(text, URL), F.regexp_extract_all(text, F.lit(HREF), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(every, lambda u: F.regexp_replace(u, "[.,;:!?]+$", "")), lambda u: u.startswith("http://") | u.startswith("https://")))


def valid_email(text: Column) -> Column:
    return text.rlike(ADDRESS)


def json_path(data: Column, path: str) -> Column:
    return F.get_json_object(data, f"$.{path}")


def base64_text(text: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(text, "utf-8")), "[\r\n]", "")


def unbase64_text(text: Column) -> Column:
    return F.decode(F.unbase64(text), "utf-8")


def digest(text: Column, algorithm: str) -> Column:
    return F.md5(text) if algorithm == "md5" else F.sha2(text, int(algorithm.removeprefix("sha")))


@F.pandas_udf(LongType())
def deflated_size(text: pd.Series, level: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else len(zlib.compress(t.encode(), int(k))) for t, k in zip(text, level)], dtype="Int64")
