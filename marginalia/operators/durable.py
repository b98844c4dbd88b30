"""Cutting lineage at durable storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tempfile.TemporaryDirectory] = []
"""The one folder of this process where no shared folder is named; removed at its end."""


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not _OWN:
        _OWN.append(tempfile.TemporaryDirectory(prefix="marginalia-", ignore_cleanup_errors=True))
    return _OWN[0].name


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the checkpoint folder that nothing else uses."""
    run = spark.sparkContext.applicationId
    return f"{checkpoint_dir(spark).rstrip('/')}/marginalia-{run}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """The rows written once as Parquet in the checkpoint folder and read back.

    Unlike a cached table it outlives lost executors, and later reads prune columns.
    ``file_rows`` bounds the rows of one file, so that later reads can be cut as fine.
    Texts make up most of these tables: zstd writes them smaller than Spark's default.
    """
    path = fresh_path(df.sparkSession, name)
    options = {"compression": "zstd", "maxRecordsPerFile": file_rows}
    df.write.mode("errorifexists").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
