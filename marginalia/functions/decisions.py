"""Reading what a reviewer typed into a decision cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia import fixed
from marginalia.functions import text as tx


def parse_decision(raw: Column, note: Column) -> Column:
    """``struct<status, note>``; both null for a blank cell."""
    value = tx.strip(tx.present(raw))
    word = F.lower(value)
    given = tx.strip(tx.present(note))
    prefix = tx.py_regex(fixed.NEEDS_CHANGE_PREFIX, ignore_case=True)
    typed = F.when(
        value.rlike(prefix), tx.strip(F.regexp_extract(value, prefix, 1))
    ).otherwise(value)
    plain = word.isin(
        "a", "approve", "approved", "r", "reject", "rejected", "needs_change", "needs change"
    )
    status = (
        F.when(word.isin("a", "approve", "approved"), fixed.APPROVED)
        .when(word.isin("r", "reject", "rejected"), fixed.REJECTED)
        .when(value != "", fixed.NEEDS_CHANGE)
    )
    text = F.when(plain | (given != ""), given).when(value != "", typed)
    return F.struct(
        status.alias("status"), F.when(value != "", text).alias("note")
    )


def ui_decision(raw: Column, note: Column) -> Column:
    """``struct<status, note>`` with '' in place of null."""
    parsed = parse_decision(raw, note)
    return F.struct(
        tx.present(parsed["status"]).alias("status"), tx.present(parsed["note"]).alias("note")
    )
