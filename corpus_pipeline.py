"""A training corpus from documents: quality classifier, exact dedup, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns
of documents; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskbook.llm import exact_dedup, packing, quality_classifier, simhash, substring_dedup
from riskbook.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (operator 9) rejects go."""
    return quality_classifier.keep_quality(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays (operator 10)."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group, the document with the smallest doc_id stays (operator 4, with its own settings)."""
    return simhash.drop_near_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has too are cut out (operator 1)."""
    return substring_dedup.cut_passages(docs, batch_bytes=1 << 22)  # the stages before leave less memory


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences of 1024 (operator 3)."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), most=100_000)  # the stages before leave less memory


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("substring dedup", passages), ("packing", packed)]

#: SQL can't express the classifier, the fingerprints and the chaining; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
