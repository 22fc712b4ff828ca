"""A training corpus from raw documents, in five stages.

Low quality goes, exact and near copies are reduced to one, secrets are masked, and
what is left is packed into sequences. Each stage takes all rows its predecessor kept;
all but the last return the columns of ``documents``.

Defined results, for every stage: a null text counts as empty; rows with a null id stay
unless their text goes, near copies apart, which compare rows with an id only; rows that
repeat id and text are one after exact dedup; very long texts are read whole; without
labels no document is rejected; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexivane.llm import common, exact, jaccard, packing, quality, secret_scan

# Network scores and tokenizers have no SQL form.
ORACLE_SQL = None

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SEQUENCE_TOKENS = 1024


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    common.configure(spark)
    return quality.keep_good(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest id stays."""
    common.configure(spark)
    return exact.without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the smallest id stays."""
    common.configure(spark)
    return jaccard.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    common.configure(spark)
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    common.configure(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID, SEQUENCE_TOKENS)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
