"""CSV exports and the rulebook file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia import fixed
from marginalia.functions.comments import finalize_training_comments
from marginalia.operators import rulebook as rb
from marginalia.operators.review import apply_reviews, review_sheet

ORDER = "finding_order"


def final_rows(merged: DataFrame) -> DataFrame:
    """Three columns with comments reduced to their reusable part."""
    more = [c for c in (ORDER,) if c in merged.columns]
    return finalize_training_comments(merged).select("report_id", *fixed.FINAL_FIELDS, *more)


def detailed_rows(findings: DataFrame) -> DataFrame:
    more = [c for c in (ORDER,) if c in findings.columns]
    return findings.select("report_id", *fixed.DETAIL_FIELDS, *more)


def write_csv(rows: DataFrame, path: str, by: str = "report_id") -> None:
    """Quoted CSV, one folder per report.

    Rows are range-partitioned by report and position: a huge report becomes several
    files in order, small ones share a task.
    """
    order = [c for c in (by, ORDER) if c in rows.columns]
    ready = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    (
        ready.drop(ORDER).write.mode("errorifexists").partitionBy(by)
        .option("header", True).option("quoteAll", True).option("escape", '"')
        .option("emptyValue", "").option("lineSep", "\r\n").csv(path)
    )


def write_rulebook(book: rb.Rulebook, path: str) -> None:
    rb.to_json(book).write.mode("errorifexists").text(path)


def write_package(findings: DataFrame, reviews: DataFrame, book: rb.Rulebook, path: str) -> None:
    """Final, flagged and detailed tables per report, and the rules that were used."""
    write_csv(final_rows(apply_reviews(findings, reviews)), f"{path}/final")
    write_csv(review_sheet(findings, reviews), f"{path}/flagged_for_review")
    write_csv(detailed_rows(findings), f"{path}/detailed")
    write_rulebook(book, f"{path}/rules_used")
