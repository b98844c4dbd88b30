"""Upserts and merges of keyed tables, as aggregates over both versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia import fixed
from marginalia.operators import library as lib
from marginalia.operators.joins import latest_per_key
from marginalia.operators.memory import OBSERVATION_FIELDS

COLLECTIONS = {
    "observations": (OBSERVATION_FIELDS, ["observation_id"]),
    "reports": (lib.REPORT_FIELDS, ["report_id"]),
    "report_findings": (lib.FINDING_FIELDS, ["finding_id"]),
    "draft_reviews": (lib.DRAFT_FIELDS, ["report_id", "issue_id"]),
    "ticket_links": (lib.LINK_FIELDS, ["report_id"]),
    "review_events": (lib.EVENT_FIELDS, ["event_id"]),
}


def both(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing rows with ``_new`` 0 and incoming rows with ``_new`` 1."""
    return existing.withColumn("_new", F.lit(0)).unionByName(
        incoming.select(*existing.columns).withColumn("_new", F.lit(1))
    )


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace existing ones of the same key."""
    rows = latest_per_key(both(existing, incoming), keys, [F.col("_new")])
    return rows.drop("_new")


def upsert_latest(rows: DataFrame, keys: list[str], updated: str, tie: str) -> DataFrame:
    """Latest version per key of a change table."""
    return latest_per_key(rows, keys, [F.col(updated), F.col(tie)])


def _taking(rows: DataFrame, keys: list[str], rules: dict) -> DataFrame:
    """Per key, columns of the newest side; ``rules`` gives the other columns."""
    plain = [c for c in rows.columns if c not in keys and c not in rules and c != "_new"]
    best = F.max_by(F.struct(*plain), "_new").alias("_best")
    return rows.groupBy(*keys).agg(best, *[rule.alias(c) for c, rule in rules.items()]).select(
        *keys, "_best.*", *rules
    )


def merge_reports(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge another deployment's reports: widest dates, highest upload count."""
    merged = _taking(both(existing, incoming), ["report_id"], {
        "first_uploaded_at": F.min("first_uploaded_at"),
        "last_uploaded_at": F.max("last_uploaded_at"),
        "upload_count": F.max("upload_count"),
    })
    return merged.select(*lib.REPORT_FIELDS)


def reupload(existing: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Store reports again: first date kept, uploads counted."""
    merged = _taking(both(existing, uploaded), ["report_id"], {
        "first_uploaded_at": F.min_by("first_uploaded_at", "_new"),
        "upload_count": F.sum("upload_count"),
    })
    return merged.select(*lib.REPORT_FIELDS)


def replace_findings(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All findings of an uploaded report are replaced."""
    reports = incoming.select("report_id").distinct()
    return existing.join(reports, "report_id", "left_anti").unionByName(
        incoming.select(*existing.columns)
    )


def merge_dated(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming values with the later of both dates (drafts and ticket links)."""
    merged = _taking(both(existing, incoming), keys, {"updated_at": F.max("updated_at")})
    return merged.select(*existing.columns)


def merge_events(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Events are added when their id is new."""
    fresh = latest_per_key(incoming, ["event_id"], [F.col("occurred_at")])
    return existing.unionByName(
        fresh.join(existing.select("event_id"), "event_id", "left_anti").select(*existing.columns)
    )


def save_drafts(existing: DataFrame, saved: DataFrame, cleared: DataFrame) -> DataFrame:
    """Upsert drafts; a blank decision removes its draft."""
    keys = ["report_id", "issue_id"]
    return upsert(existing.join(cleared.select(*keys), keys, "left_anti"), saved, keys)


def merge(existing: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Merge all six collections of another deployment."""
    check(incoming)
    return {
        "reports": merge_reports(existing["reports"], incoming["reports"]),
        "report_findings": upsert(
            existing["report_findings"], incoming["report_findings"], ["finding_id"]
        ),
        "draft_reviews": merge_dated(
            existing["draft_reviews"], incoming["draft_reviews"], ["report_id", "issue_id"]
        ),
        "ticket_links": merge_dated(
            existing["ticket_links"], incoming["ticket_links"], ["report_id"]
        ),
        "review_events": merge_events(existing["review_events"], incoming["review_events"]),
        "observations": upsert(
            existing["observations"], incoming["observations"], ["observation_id"]
        ),
    }


def check(tables: dict[str, DataFrame]) -> None:
    """Required columns and valid statuses of incoming collections."""
    for name, (fields, _) in COLLECTIONS.items():
        missing = set(fields) - set(tables[name].columns)
        if missing:
            raise lib.LibraryError(f"{name}: missing {sorted(missing)}")
    for name, column in (("observations", "status"), ("draft_reviews", "decision")):
        valid = F.coalesce(F.col(column).isin(*fixed.STATUSES), F.lit(False))
        lib.require_empty(tables[name].filter(~valid), f"{name}: invalid {column}")


def import_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows each collection brings."""
    names = {
        "imported": "observations", "reports": "reports", "findings": "report_findings",
        "drafts": "draft_reviews", "events": "review_events",
    }
    parts = [
        tables[source].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        for name, source in names.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole
