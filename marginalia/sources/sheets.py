"""Filled-in review sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SheetError(ValueError):
    """The sheet lacks a needed column."""


def read_review_sheet(spark: SparkSession, path: str, report_id: str) -> tuple[DataFrame, str]:
    """Sheet rows with ``report_id`` and ``line``, and the name of the decision column.

    The first column holds the decisions unless it is the issue id.
    """
    sheet = (
        spark.read.option("header", True).option("multiLine", True)
        .option("escape", '"').option("quote", '"').csv(path)
    )
    sheet = sheet.toDF(*[c.lstrip("﻿") for c in sheet.columns])
    if "issue_id" not in sheet.columns:
        raise SheetError("the review sheet needs an issue_id column")
    first = sheet.columns[0]
    column = first if first != "issue_id" else "decision"
    if column not in sheet.columns:
        sheet = sheet.withColumn(column, F.lit(""))
    return sheet.withColumns({
        "report_id": F.lit(report_id), "line": F.monotonically_increasing_id(),
    }), column
