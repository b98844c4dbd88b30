"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import chosen_path, disclosure, exact_dedup, language_id, packing
from marginalia.operators.durable import stored
from marginalia.shipping import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go."""
    ship(spark)
    return language_id.keep_identified(spark, docs, sf_dir)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    ship(spark)
    return exact_dedup.keep_one_row_of_each(spark, docs, sf_dir)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the smallest id."""
    ship(spark)
    return chosen_path.keep_one_row_of_each(spark, docs, sf_dir)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that reveal it replaced or removed."""
    ship(spark)
    return disclosure.sanitise_documents(spark, docs, sf_dir)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    ship(spark)
    return packing.pack_documents(spark, docs, sf_dir)


STAGES = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("personal", personal),
    ("packed", packed),
]

ORACLE_SQL = None
"""Language ID, the near-duplicate join and the tokens have no SQL form; the run is tested
against its own stages on a fixture, and each stage against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
