"""Streaming counterparts: reports as they arrive, and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from marginalia.operators import classify as cl
from marginalia.operators import parse
from marginalia.operators import rulebook as rb
from marginalia.plans import flows
from marginalia.plans.store import Store
from marginalia.sources import reports as src


FILES = "path string, modificationTime timestamp, length bigint, content binary"


def distinct_events(events: DataFrame, delay: str = "1 hour",
                    time: str = "occurred_at", key: str = "event_id") -> DataFrame:
    """Audit events without repeats; state is kept only as long as repeats may come."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def reviewer_activity(events: DataFrame, width: str = "1 hour", delay: str = "1 hour",
                      time: str = "occurred_at", by: str = "reviewer_email") -> DataFrame:
    """Events per reviewer and time window; works on streams and tables."""
    rows = events.withWatermark(time, delay) if events.isStreaming else events
    counted = rows.groupBy(F.window(time, width).alias("w"), by).agg(
        F.count(F.lit(1)).alias("events")
    )
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "events"
    )


def ingest_stream(spark: SparkSession, path: str, book: rb.Rulebook, out: str, checkpoint: str,
                  files_per_trigger: int = 100) -> StreamingQuery:
    """Classify report files as they arrive and append the findings to ``out``.

    A file is one unit of the stream, so a micro-batch always holds whole reports and
    the per-report confidence check sees all of a report's findings.  Each batch goes
    to its own folder, written over when a batch is repeated after a failure.
    """
    cards = (
        spark.readStream.option("lineSep", parse.CARD_START)
        .option("maxFilesPerTrigger", files_per_trigger).text(path)
        .select(F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_block_start").alias("chunk"),
                src.decode(F.col("value")).alias("card"))
    )

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("card_order", F.monotonically_increasing_id())
        files = [r["path"] for r in rows.select("path").distinct().collect()]  # <= files_per_trigger
        if not files:
            return
        # Files that hold the delimiter inside a card are read again as a whole.
        odd = [r["path"] for r in src.irregular_files(rows).collect()]
        cards = rows.filter(src.is_card(F.col("card")) & ~F.col("path").isin(odd))
        if odd:
            cards = cards.unionByName(src.scan_whole_reports(spark, odd))
        keyed = src.with_report_id(cards, src.report_manifest(spark, files))
        found = cl.classify(parse.findings_from_cards(keyed), book, "finding_order")
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        cards.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def store_stream(store: Store, path: str, book: rb.Rulebook, checkpoint: str,
                 files_per_trigger: int = 100) -> StreamingQuery:
    """Take report files into the library as they arrive.

    Each micro-batch of whole files goes through the same steps as an upload: parse (files
    with irregular cards too), classify, store, learn, prefill.  A file is known by its
    content, so a copy or a repeated batch stores the same report once.
    """
    found = (
        store.spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger)
        .load(path).select("path")
    )

    def take(batch: DataFrame, number: int) -> None:
        files = [r["path"] for r in batch.collect()]  # <= files_per_trigger
        if files:
            flows.ingest(store, files, book, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))

    return (
        found.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
