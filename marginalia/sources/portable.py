"""Decision memory moved between deployments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import fixed
from marginalia.operators.library import LibraryError
from marginalia.operators.merging import COLLECTIONS

FILE_ROWS = 100_000
"""Rows of one file of an export: a gzip file is read by one task."""

LONGS = ("finding_count", "reviewable_count", "upload_count", "finding_order")
# Collection names inside a single-document export.
DOCUMENT_NAMES = {
    "observations": "observations", "reports": "reports", "report_findings": "report_findings",
    "draft_reviews": "draft_reviews", "ticket_links": "jira_links", "review_events": "review_events",
}


def _ddl(fields: tuple[str, ...], sep: str) -> str:
    return ", ".join(f"{n}{sep}{'long' if n in LONGS else 'string'}" for n in fields)


def _check_versions(head: DataFrame) -> None:
    row = head.select("schema_version", "fingerprint_version").first()
    if row is None or row["schema_version"] not in fixed.MEMORY_SCHEMA_VERSIONS:
        raise LibraryError("unsupported decision-memory schema")
    if row["fingerprint_version"] != fixed.FINGERPRINT_VERSION:
        raise LibraryError("unsupported fingerprint version")


def read_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The six collections of a single-document JSON export."""
    arrays = ", ".join(
        f"{DOCUMENT_NAMES[name]} array<struct<{_ddl(fields, ': ')}>>"
        for name, (fields, _) in COLLECTIONS.items()
    )
    schema = f"schema_version long, fingerprint_version long, exported_at string, {arrays}"
    document = (
        spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)
    )
    _check_versions(document)
    tables = {
        name: document.select(F.inline(DOCUMENT_NAMES[name])) for name in COLLECTIONS
    }
    for name, (fields, _) in COLLECTIONS.items():  # required fields are never null
        missing = tables[name].filter(" OR ".join(f"{f} IS NULL" for f in fields))
        if not missing.isEmpty():
            raise LibraryError(f"{name}: an entry is missing required fields")
    return tables


def write_export(tables: dict[str, DataFrame], path: str, exported_at: str) -> None:
    """One folder of gzipped JSON lines per collection, written in parallel, and a head.

    As plain JSON, which names each field in each row, a library is many times its size.
    """
    spark = next(iter(tables.values())).sparkSession
    options = {"ignoreNullFields": "false", "compression": "gzip", "maxRecordsPerFile": FILE_ROWS}
    for name, (fields, _) in COLLECTIONS.items():
        rows = tables[name].select(*fields)
        rows.write.mode("errorifexists").options(**options).json(f"{path}/{name}")
    head = spark.range(1).select(
        F.lit(fixed.MEMORY_SCHEMA_VERSIONS[-1]).alias("schema_version"),
        F.lit(fixed.FINGERPRINT_VERSION).alias("fingerprint_version"),
        F.lit(exported_at).alias("exported_at"),
    )
    head.write.mode("errorifexists").json(f"{path}/head")


def read_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The collections of a folder written by ``write_export``."""
    head = "schema_version long, fingerprint_version long, exported_at string"
    _check_versions(spark.read.schema(head).json(f"{path}/head"))
    return {
        name: spark.read.option("mode", "FAILFAST").schema(_ddl(fields, " ")).json(f"{path}/{name}")
        for name, (fields, _) in COLLECTIONS.items()
    }


def ordered_export(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The collections in their export order."""
    order = {
        "observations": ["updated_at", "observation_id"],
        "reports": ["first_uploaded_at", "report_id"],
        "report_findings": ["report_id", "finding_order"],
        "draft_reviews": ["report_id", "issue_id"],
        "ticket_links": ["report_id"],
        "review_events": ["occurred_at", "event_id"],
    }
    return {name: tables[name].orderBy(*keys) for name, keys in order.items()}
