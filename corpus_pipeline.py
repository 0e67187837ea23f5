"""The corpus pipeline: quality rules, exact dedup, near-dedup, PII, packing.

Each stage works on all that the one before kept and returns the columns of documents, in
their order and with any others that are there; the last returns pieces in sequences.

Defined cases: null, empty and blank texts fail the quality rules, so later stages meet none
of them unless they are called by themselves, and then keep them (of equal ones the first);
of equal or near texts the smallest id stays, and rows that repeat both id and text stay
together; texts of any length are handled whole; an empty table gives an empty result;
columns of any name pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm import exact_dedup, near_dedup, packing, pii, quality_rules
from studyloom.session import mark, materialize, release, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filter_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (word shingles of five, similarity 0.8) the one with the smallest id stays."""
    return near_dedup.drop_near_copies(docs, width=5, percent=80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get pseudonyms; n_chars follows the new text."""
    return pii.pseudonymise(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("pii", private), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages over documents. What was written for a stage goes as soon as its result is there."""
    docs, before = table(spark, sf_dir, "documents"), mark()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
            release(spark, before)
    return docs
