"""Exact duplicates by sorting the contents; DataFrame functions only.

Texts are normalised (A-Z lower-cased, nothing else; null counts as empty) and
range-partitioned by their first bytes and a hash of all: Spark samples the splitters
(short keys only, since the samples go to the driver), each task sorts its range (spilling
to disk where needed) up to the whole text, and equal texts lie next to each other.  A
window over the sorted rows compares neighbours in full and yields each run's greatest
identifier and length.

A text that holds more than its share of the rows is dealt over several ranges: its rows
take a salt from their identifier, the salt is part of the sort key, and the few runs of
such a text are merged by digest afterwards.  The list of such texts is short whatever the
data: each holds more than one in ``HOT_LIST`` of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.one_row import chosen_rows, row_key
from marginalia.operators.durable import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HOT_LIST = 50_000
"""Greatest number of texts that get salts: a hot text has over 1/HOT_LIST of the rows."""

PREFIX = 32
"""Characters of a text in the splitters; equal beginnings are told apart by the hash."""

RUN_ROWS = 128
"""Rows of one text that are never split, however small the table."""


def normalised(text: Column) -> Column:
    """A-Z in lower case; null is empty.  Pure ASCII takes the faster ``lower``."""
    whole = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(whole) == F.char_length(whole)
    return F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))


def _hot(rows: DataFrame) -> DataFrame:
    """(_key, _parts) of texts with many rows: at most HOT_LIST of them."""
    counts = stored(
        rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > RUN_ROWS), "dedup-counts",
    )
    total = rows.count()
    share = max(RUN_ROWS, -(-total // HOT_LIST))
    return counts.filter(F.col("_n") > share).select(
        "_key", F.ceil(F.col("_n") / F.lit(share)).cast("int").alias("_parts")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The row with the greatest id of each group is kept.  Null ids are smaller than any
    other; of repeated ids exactly one row is kept; a group without ids has a null
    ``keep_id`` and keeps one row.  Other columns are not read, so their names are free.
    An empty table gives no rows.
    """
    # A coarser key is enough to find hot texts: equal texts are equal in lower case too.
    key = F.xxhash64(F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    # Rows of a hot text are dealt out by where they stand, so null and repeated ids spread too.
    place = F.xxhash64(F.monotonically_increasing_id()).alias("_place")
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), key.alias("_key"), place)
    salted = (
        base.join(F.broadcast(_hot(base.select("_key"))), "_key", "left")
        .select(
            "_id", "_key", normalised(F.col("_text")).alias("_norm"),
            F.coalesce(F.pmod("_place", F.col("_parts")).cast("int"), F.lit(-1)).alias("_salt"),
        )
    )
    salted = salted.withColumn("_start", F.substring("_norm", 1, PREFIX))
    run = Window.partitionBy("_start", "_key", "_salt", "_norm")
    ordered = run.orderBy(F.col("_id").desc_nulls_last())
    sorted_rows = (
        salted.repartitionByRange("_start", "_key", "_salt").select(
            "_id", "_salt", F.sha2("_norm", 256).alias("_sha"),
            F.first("_id").over(ordered).alias("_run_max"),
            F.count(F.lit(1)).over(run).alias("_run_n"),
            (F.row_number().over(ordered) == 1).alias("_head"),
        )
    )
    narrow = stored(sorted_rows, "dedup-runs")
    merged = (
        narrow.filter((F.col("_salt") >= 0) & F.col("_head"))
        .groupBy("_sha")
        .agg(
            F.max("_run_max").alias("_all_max"), F.sum("_run_n").alias("_all_n"),
            # Several runs can hold the greatest id, or none any: the head of one of them stays.
            F.max_by("_salt", F.struct(F.col("_run_max").isNotNull().alias("has"), F.col("_run_max"), F.col("_salt"))).alias("_kept_salt"),
        )
    )
    whole = F.col("_all_n").isNull()
    keep = F.when(whole, F.col("_run_max")).otherwise(F.col("_all_max"))
    kept = F.col("_head") & (whole | (F.col("_salt") == F.col("_kept_salt")))
    return narrow.join(F.broadcast(merged), "_sha", "left").select(
        F.col("_id").alias(id_col), keep.alias("keep_id"),
        F.coalesce("_all_n", "_run_n").cast("bigint").alias("group_size"),
        kept.alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def keep_one_row_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, with its columns: the one with the greatest id.

    Exactly one row stays of a group, whether its ids are repeated or all null.
    """
    groups = exact_groups(docs).filter("kept")
    chosen = groups.select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("_row_key"))
    return chosen_rows(docs, row_key(F.col("doc_id"), F.sha2(normalised(F.col("text")), 256)), chosen)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the document that stands for its text."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
  sha256(norm) AS text_sha256
FROM d
"""
