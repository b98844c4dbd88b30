"""Sending this package to the Python workers, and rows in batches of bounded size."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()

BATCHES = {
    "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,
}
"""Sizes of the batches that go to Python workers, where the session names none: both sides
keep what their largest batch needed, and a few long texts make a batch of rows large."""


def ship(spark: SparkSession) -> None:
    """Hand the package to all executors, once per application."""
    named = spark.conf.getAll
    for key, size in BATCHES.items():
        if key not in named:
            spark.conf.set(key, str(size))
    run = spark.sparkContext.applicationId
    if run not in _SHIPPED:
        folder = tempfile.mkdtemp(prefix="marginalia-ship-")
        package = shutil.make_archive(f"{folder}/marginalia", "zip", str(ROOT), "marginalia")
        spark.sparkContext.addPyFile(package)  # Spark's own file server hands it out
        _SHIPPED.add(run)
