"""A corpus pipeline of five operators over documents: toxic texts and near-copies go, personal data is masked,
sources are mixed to target weights, and the mix is tokenised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, mixing, pii, simhash, toxicity
from quern.llm._common import cut, importable, table, trim


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier predicts toxic; it is fitted on the labels of training rows."""
    importable(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    trim()  # the driver is done with the training rows
    return toxicity.reject(docs, model)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of texts whose sets of five-word shingles are at least 0.8 alike."""
    importable(spark)
    return simhash.deduplicate(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, shortens or leaves out documents so that the sources reach their targets."""
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text, for each document of the mix."""
    import public_tokenizers

    importable(spark)
    return bpe.report(docs, public_tokenizers.path(bpe.DEFAULT_VOCABULARY))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

ORACLE_SQL = None
"""SQL can express neither the classifier nor the tokenizer; the tests compare run() with a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; what each stage keeps is checkpointed for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
