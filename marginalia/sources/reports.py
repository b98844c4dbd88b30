"""Report files as a table of cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import fixed
from marginalia.functions import text as tx
from marginalia.operators.joins import first_per_key, lookup_join
from marginalia.operators.parse import CARD_START


def decode(text: Column) -> Column:
    """Drop bytes that are not valid UTF-8."""
    repaired = F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)


def _cards(rows: DataFrame) -> DataFrame:
    meta = F.col("_metadata")
    return rows.select(
        meta["file_path"].alias("path"),
        meta["file_block_start"].alias("chunk"),
        F.monotonically_increasing_id().alias("card_order"),
        decode(F.col("value")).alias("card"),
    )


def is_card(card: Column) -> Column:
    return card.rlike(r'\A\d+"')


def scan_report_cards(spark: SparkSession, path: str) -> DataFrame:
    """One row per card: ``path, chunk, card_order, card``.

    The card opening is the record delimiter, so one large file is read by many
    tasks.  The opening itself is consumed, which no later pattern needs.
    """
    return _cards(spark.read.option("lineSep", CARD_START).text(path))


def stream_report_cards(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from files as they arrive."""
    return _cards(spark.readStream.option("lineSep", CARD_START).text(path))


def irregular_files(cards: DataFrame) -> DataFrame:
    """Files where the delimiter also occurs inside a card.

    Each file has exactly one piece that is no card, its head; any further one was
    cut from the card before it.
    """
    return (
        cards.groupBy("path")
        .agg(F.count_if(~is_card(F.col("card"))).alias("others"))
        .filter("others > 1").select("path")
    )


def scan_whole_reports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Cards of irregular files, split where a card really starts."""
    whole = spark.read.option("wholetext", True).text(paths)
    pieces = F.split(decode(F.col("value")), rf'(?={CARD_START}\d+")', -1)
    return whole.select(
        F.col("_metadata.file_path").alias("path"), F.posexplode(pieces).alias("pos", "piece")
    ).filter(F.col("piece").startswith(CARD_START)).select(
        "path", F.floor(F.col("pos") / 100_000).alias("chunk"),
        F.col("pos").cast("bigint").alias("card_order"),
        F.substring(F.col("piece"), len(CARD_START) + 1, 2147483647).alias("card"),
    )


def report_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, filename, size, report_id, report_name``; the id is the content hash."""
    files = spark.read.format("binaryFile").load(path)
    named = files.select(
        "path", F.col("length").alias("size"), F.sha2("content", 256).alias("report_id")
    )
    return with_report_name(
        named.withColumn("filename", F.url_decode(F.substring_index("path", "/", -1)))
    )


def safe_report_name(filename: Column, default: str = "report") -> Column:
    """File stem without review suffix, other characters as single underscores."""
    name = F.regexp_extract(filename, r"([^/]*)/*\z", 1)
    stem = F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+\z", "")
    short = F.regexp_replace(stem, tx.py_regex(fixed.REVIEW_SUFFIX, ignore_case=True), "")
    clean = tx.strip(F.regexp_replace(short, "[^A-Za-z0-9._-]+", "_"), "._-")
    return F.when(clean == "", default).otherwise(clean)


def with_report_name(files: DataFrame, default: str = "report") -> DataFrame:
    name = safe_report_name(F.col("filename"), default)
    return files.withColumns({
        "report_name": name,
        "report_key": F.concat(name, F.lit("-"), F.substring("report_id", 1, 12)),
    })


def with_report_id(cards: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cards keyed by report id in place of the path; copies of one file count once."""
    ids = first_per_key(manifest.select("report_id", "path"), ["report_id"], [F.col("path")])
    return lookup_join(cards, ids, ["path"], "inner").drop("path")
