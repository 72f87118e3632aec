"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, line_dedup, lm, media, mixing, phrases, pii, runs, secrets, simhash, toxicity, url_filter
from ._common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.report(table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.DEFAULT_VOCABULARY))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_media": op4_media,
    "op5_url_filter": op5_url_filter,
    "op6_ann": op6_ann,
    "op7_lm": op7_lm,
    "op8_secrets": op8_secrets,
    "op9_mixing": op9_mixing,
    "op10_bpe": op10_bpe,
    "op11_line_dedup": op11_line_dedup,
    "op12_runs": op12_runs,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op11_line_dedup": line_dedup.ORACLE_SQL,
    "op13_phrases": phrases.ORACLE_SQL,
}
