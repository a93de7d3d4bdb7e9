"""Training-data pipeline: from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet in the shared folder and reread as the next stage's ``docs``.
All stages but the last return the columns of ``documents``; the last returns a
row per packed piece. What the stages do with nulls, empty and repeated rows is
said in the docstrings of the operators they call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from visitlens.llm import exact_dedup, packing, pii, quality_rules, simhash
from visitlens.llm.common import staged, table
from visitlens.session import configure, new_folder


def passes_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy keeps."""
    return quality_rules.keep_good(docs)


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest id of each group of equal texts."""
    index = exact_dedup.DigestIndex(spark, new_folder(spark, "digest-index"))
    return exact_dedup.drop_copies(docs, index)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each group of near copies."""
    return simhash.drop_near(docs, words=3, max_bits=3)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data masked; the field is trained on the stage's input."""
    return pii.mask(docs, pii.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place there."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", passes_rules),
    ("exact dedup", one_of_equal),
    ("simhash near-dedup", one_of_near),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: SQL has neither the fingerprints, nor the trained field, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from ``documents``."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
