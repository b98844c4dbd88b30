"""The report library: stored reports and findings, drafts, activity, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia import fixed
from marginalia.functions import text as tx
from marginalia.functions.decisions import parse_decision
from marginalia.functions.signature import pair_id, with_signature
from marginalia.operators import durable
from marginalia.operators.joins import lookup_join, with_one_row
from marginalia.operators.overlap import common, top_overlaps
from marginalia.operators.parse import RECORD_FIELDS
from marginalia.operators.review import KEY

# Fixed: the column names and their order are those of the stored tables.
REPORT_FIELDS = (
    "report_id", "report_name", "filename", "rules_version", "finding_count",
    "reviewable_count", "first_uploaded_at", "last_uploaded_at", "upload_count",
)
FINDING_FIELDS = (
    "finding_id", "report_id", "finding_order", "issue_id", "fingerprint", "core_key",
    "anchor_kind", "anchor", "checker", "field_name", "original", "proposed",
    "initial_status", "initial_comment", "record_json",
)
DRAFT_FIELDS = ("report_id", "issue_id", "decision", "note", "updated_at")
LINK_FIELDS = ("report_id", "issue_key", "issue_summary", "issue_url", "attachment_id", "updated_at")
EVENT_FIELDS = (
    "event_id", "report_id", "issue_id", "action", "decision", "reviewer_email",
    "reviewer_name", "detail_json", "occurred_at",
)
RECORD_SCHEMA = ", ".join(
    f"{n} {'boolean' if n == 'container_cell_has_prior_text' else 'string'}" for n in RECORD_FIELDS
)


class LibraryError(ValueError):
    """A table does not meet what the library needs."""


def require_empty(bad: DataFrame, message: str) -> None:
    if not bad.isEmpty():
        raise LibraryError(message)


# --------------------------------------------------------------- snapshots
def stored_findings(rows: DataFrame) -> DataFrame:
    """Snapshot rows from classified findings that still have their raw fields.

    The raw record is kept as JSON with explicit nulls: a null container and an
    unknown container are different things when rules are applied again.
    """
    have = [n for n in RECORD_FIELDS if n in rows.columns]
    record = F.to_json(F.struct(*have), {"ignoreNullFields": "false"})
    signed = with_signature(rows)
    return signed.select(
        pair_id(F.col("report_id"), F.col("issue_id")).alias("finding_id"),
        "report_id", F.col("finding_order").cast("bigint").alias("finding_order"), "issue_id",
        "fingerprint", "core_key", "anchor_kind", "anchor",
        F.col("checker_key").alias("checker"), F.col("field_key").alias("field_name"),
        tx.present(F.col("original")).alias("original"),
        tx.present(F.col("proposed")).alias("proposed"),
        F.col("status").alias("initial_status"), F.col("comment").alias("initial_comment"),
        record.alias("record_json"),
    )


def report_rows(findings: DataFrame, manifest: DataFrame, rules_version: str,
                as_of: Column) -> DataFrame:
    """Report rows of a first upload; ``merging.reupload`` joins them to older ones."""
    counts = findings.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.count_if(F.col("status") == fixed.NEEDS_CHANGE).alias("reviewable_count"),
    )
    return manifest.join(counts, "report_id").select(
        "report_id", "report_name", "filename", F.lit(rules_version).alias("rules_version"),
        "finding_count", "reviewable_count", as_of.alias("first_uploaded_at"),
        as_of.alias("last_uploaded_at"), F.lit(1).cast("bigint").alias("upload_count"),
    )


def load_snapshot(findings: DataFrame, report_id: str) -> DataFrame:
    """Raw records of one stored report in document order."""
    one = raw_records(findings.filter(F.col("report_id") == report_id))
    return one.orderBy("finding_order")


def raw_records(findings: DataFrame) -> DataFrame:
    """Raw records of stored findings, ready to be classified again."""
    record = F.from_json("record_json", RECORD_SCHEMA)
    known = F.array_contains(F.json_object_keys("record_json"), "container_tag")
    return findings.select("report_id", "finding_order", record.alias("_r"),
                           known.alias("container_known")).select(
        "report_id", "finding_order", "_r.*", "container_known"
    )


# ------------------------------------------------------------------ drafts
def draft_rows(reviews: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Drafts to save and keys to clear (blank decisions)."""
    parsed = reviews.withColumn("_p", parse_decision(F.col("decision"), F.col("review_note")))
    saved = parsed.filter(F.col("_p.status").isNotNull()).select(
        *KEY, F.col("_p.status").alias("decision"), tx.present(F.col("_p.note")).alias("note"),
        as_of.alias("updated_at"),
    )
    return saved, parsed.filter(F.col("_p.status").isNull()).select(*KEY)


def draft_counts(saved: DataFrame, cleared: DataFrame) -> DataFrame:
    """Decisions saved and cleared per report."""
    both = saved.select("report_id", F.lit(1).alias("s"), F.lit(0).alias("c")).unionAll(
        cleared.select("report_id", F.lit(0).alias("s"), F.lit(1).alias("c"))
    )
    return both.groupBy("report_id").agg(F.sum("s").alias("saved"), F.sum("c").alias("cleared"))


def stored_counts(findings: DataFrame) -> DataFrame:
    """Findings stored per report, and how many of them can be looked up in the memory."""
    return findings.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("stored"), F.count_if(F.col("fingerprint") != "").alias("matchable")
    )


def load_drafts(drafts: DataFrame, report_id: str) -> DataFrame:
    return drafts.filter(F.col("report_id") == report_id).select(
        "issue_id", "decision", F.col("note").alias("review_note"),
        F.lit(True).alias("draft_saved"), F.col("updated_at").alias("draft_updated_at"),
    )


def ticket_link(links: DataFrame, report_id: str) -> DataFrame:
    return links.filter(F.col("report_id") == report_id).select(
        F.col("issue_key").alias("key"), F.col("issue_summary").alias("summary"),
        F.col("issue_url").alias("browse_url"), "attachment_id", "updated_at",
    )


def link_rows(links: DataFrame, reports: DataFrame, as_of: Column) -> DataFrame:
    """Report-to-ticket links; key, address and a stored report are required."""
    rows = links.select(
        "report_id", tx.strip(tx.present(F.col("key"))).alias("issue_key"),
        tx.present(F.col("summary")).alias("issue_summary"),
        tx.strip(tx.present(F.col("browse_url"))).alias("issue_url"),
        tx.present(F.col("attachment_id")).alias("attachment_id"), as_of.alias("updated_at"),
    )
    require_empty(rows.filter("issue_key = '' OR issue_url = ''"),
                  "a ticket link needs an issue key and an address")
    require_empty(unknown_reports(rows, reports), "store the report before linking a ticket")
    return rows


def unknown_reports(rows: DataFrame, reports: DataFrame) -> DataFrame:
    return rows.join(reports.select("report_id"), "report_id", "left_anti")


# ------------------------------------------------------------------ events
def event_rows(changes: DataFrame, action: str, reviewer_email: str, reviewer_name: str,
               as_of: Column) -> DataFrame:
    """Audit rows for changes (``report_id, issue_id, decision, detail_json``)."""
    email, name = reviewer_email.strip().casefold(), reviewer_name
    if not action.strip():
        raise LibraryError("a review event needs an action")
    if not email:
        raise LibraryError("a review event needs a reviewer address")
    return changes.select(
        # from the row itself, so that a retried task writes the same id
        F.md5(F.concat_ws("\u001f", *[tx.present(c) for c in (
            F.col("report_id"), F.col("issue_id"), F.lit(action), F.col("decision"), F.lit(email),
            F.col("detail_json"), as_of.cast("string"))])).alias("event_id"),
        "report_id", tx.present(F.col("issue_id")).alias("issue_id"),
        F.lit(action.strip()).alias("action"), tx.present(F.col("decision")).alias("decision"),
        F.lit(email).alias("reviewer_email"),
        F.lit(name or email).alias("reviewer_name"),
        F.coalesce("detail_json", F.lit("{}")).alias("detail_json"), as_of.alias("occurred_at"),
    )


def with_detail(events: DataFrame) -> DataFrame:
    """Event detail as a map, empty when it is not readable."""
    detail = F.from_json("detail_json", "map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    return events.withColumn("detail", F.coalesce(detail, empty)).drop("detail_json")


def report_activity(events: DataFrame, report_id: str, limit: int = 50) -> DataFrame:
    """Latest events of one report."""
    return with_detail(
        events.filter(F.col("report_id") == report_id)
        .orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(max(1, limit))
    )


def latest_activity(events: DataFrame, limit: int = 50, slices: int = 64) -> DataFrame:
    """Latest events of every report.

    Each report is cut into slices by event id; the top rows of the slices are ranked
    again, so a report with most of the events is not sorted in one task.
    """
    order = [F.desc("occurred_at"), F.desc("event_id")]
    cut = events.withColumn("_slice", F.pmod(F.xxhash64("event_id"), F.lit(slices)))
    top = cut.withColumn(
        "_r", F.row_number().over(Window.partitionBy("report_id", "_slice").orderBy(*order))
    ).filter(F.col("_r") <= limit)
    ranked = top.withColumn(
        "_r", F.row_number().over(Window.partitionBy("report_id").orderBy(*order))
    )
    return ranked.filter(F.col("_r") <= limit).drop("_slice", "_r")


def activity_view(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("reviewer_name").alias("reviewer"), F.col("reviewer_email").alias("email"),
        F.initcap(F.replace("action", F.lit("_"), F.lit(" "))).alias("action"),
        F.col("issue_id").alias("issue"), "decision", F.col("occurred_at").alias("time"),
    )


# ------------------------------------------------------------------- views
def library_list(reports: DataFrame, drafts: DataFrame, observations: DataFrame) -> DataFrame:
    """Stored reports with their draft and published counts, latest first."""
    saved = drafts.groupBy("report_id").agg(F.count(F.lit(1)).alias("draft_reviews"))
    published = observations.groupBy(F.col("source_report_id").alias("report_id")).agg(
        F.count(F.lit(1)).alias("published_reviews")
    )
    return (
        reports.join(saved, "report_id", "left").join(published, "report_id", "left")
        .na.fill(0, ["draft_reviews", "published_reviews"])
        .select(*REPORT_FIELDS, "draft_reviews", "published_reviews")
        .orderBy(F.desc("last_uploaded_at"), "report_name")
    )


def library_view(listed: DataFrame) -> DataFrame:
    return listed.select(
        F.col("report_name").alias("report"), F.col("finding_count").alias("findings"),
        F.col("reviewable_count").alias("flagged_at_upload"),
        F.col("draft_reviews").alias("saved_decisions"),
        F.col("published_reviews").alias("published_decisions"),
        F.col("upload_count").alias("uploads"), F.col("last_uploaded_at").alias("last_uploaded"),
    )


def library_stats(reports: DataFrame, findings: DataFrame, drafts: DataFrame) -> DataFrame:
    """Counts of the library; a finding recurs when several reports hold it."""
    per_fingerprint = findings.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n"),
        ((F.min("report_id") != F.max("report_id")) & (F.col("fingerprint") != "")).alias("again"),
    )
    whole = reports.agg(F.count(F.lit(1)).alias("reports"))
    parts = [
        per_fingerprint.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("findings"),
            F.count_if("again").alias("recurring_findings"),
        ),
        drafts.agg(F.count(F.lit(1)).alias("draft_reviews")),
    ]
    for part in parts:
        whole = with_one_row(whole, part)
    return whole


def similarity(findings: DataFrame, reports: DataFrame, current: DataFrame,
               limit: int | None = 12) -> DataFrame:
    """Other reports ranked by how much of the current report they share.

    ``current`` is a one-row table with ``report_id``.  Findings are reduced to
    distinct (report, key) pairs and the others only pass through a semi join with
    the current report's keys, so no pairs of findings are formed.
    """
    here = F.broadcast(current.select("report_id"))  # one row

    def shared(key: str, matches: str, total: str) -> tuple[DataFrame, DataFrame]:
        pairs = findings.filter(F.col(key) != "").select("report_id", key).distinct()
        mine = pairs.join(here, "report_id", "left_semi").select(key)
        others = pairs.join(here, "report_id", "left_anti").join(mine, key, "left_semi")
        return (
            others.groupBy("report_id").agg(F.count(F.lit(1)).alias(matches)),
            mine.agg(F.count(F.lit(1)).alias(total)),
        )

    exact, fingerprints = shared("fingerprint", "exact_findings", "_fingerprints")
    core, cores = shared("core_key", "shared_correction_pairs", "_cores")
    rows = (
        exact.join(core, "report_id", "full").na.fill(0, ["exact_findings", "shared_correction_pairs"])
        .join(reports, "report_id")
    )
    rows = with_one_row(with_one_row(rows, fingerprints), cores)

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    ranked = rows.select(
        "report_id", F.col("report_name").alias("report"), "filename",
        "exact_findings", share("exact_findings", "_fingerprints").alias("exact_overlap"),
        "shared_correction_pairs",
        share("shared_correction_pairs", "_cores").alias("correction_pair_overlap"),
        F.col("finding_count").alias("findings"), F.col("last_uploaded_at").alias("last_uploaded"),
    ).orderBy(
        F.desc("exact_overlap"), F.desc("exact_findings"),
        F.desc("shared_correction_pairs"), "report", "report_id",
    )
    return ranked if limit is None else ranked.limit(max(1, limit))


def similar_reports(findings: DataFrame, reports: DataFrame, limit: int = 12, **steps: int) -> DataFrame:
    """For every report the ``limit`` other reports that ``similarity`` ranks first for it.

    Partners come from ``top_overlaps`` on fingerprints, and for reports with fewer than
    ``limit`` of them on corrections; the corrections that two reports share are counted
    for these partners only, so findings that most reports hold form no pairs of reports.
    """
    known = reports.select(F.col("report_id").alias("owner"))

    def sets(key: str) -> DataFrame:
        rows = findings.filter(F.col(key) != "").select(F.col("report_id").alias("owner"), F.col(key).alias("key"))
        return durable.stored(lookup_join(rows.distinct(), known, ["owner"], "left_semi"), "report-keys")

    prints, cores = sets("fingerprint"), sets("core_key")
    exact = durable.stored(top_overlaps(prints, limit, **steps), "report-exact")
    full = exact.groupBy("owner").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= limit).select("owner")
    # A report whose partners by fingerprint are all known is filled up by corrections.
    by_core = durable.stored(
        top_overlaps(cores, limit, **steps).join(full, "owner", "left_anti").join(exact, ["owner", "other"], "left_anti"), "report-cores"
    )
    shared = common(exact.select("owner", "other"), cores).withColumnRenamed("n", "core")
    pairs = exact.join(shared, ["owner", "other"], "left").withColumn("core", F.coalesce("core", F.lit(0))).unionByName(
        by_core.select("owner", "other", F.lit(0).cast("bigint").alias("n"), F.col("n").alias("core"))
    )
    sizes = prints.groupBy("owner").agg(F.count(F.lit(1)).alias("_fingerprints"))
    sizes = sizes.join(cores.groupBy("owner").agg(F.count(F.lit(1)).alias("_cores")), "owner", "full")
    names = reports.select(
        F.col("report_id").alias("other"), F.col("report_name").alias("report"), "filename",
        F.col("finding_count").alias("findings"), F.col("last_uploaded_at").alias("last_uploaded"),
    )
    rows = lookup_join(lookup_join(pairs, names, ["other"], "inner"), sizes, ["owner"])
    best = Window.partitionBy("owner").orderBy(F.desc("n"), F.desc("core"), "report", "other")

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).select(
        F.col("owner").alias("current_report_id"), "rank", F.col("other").alias("report_id"), "report", "filename",
        F.col("n").alias("exact_findings"), share("n", "_fingerprints").alias("exact_overlap"),
        F.col("core").cast("bigint").alias("shared_correction_pairs"), share("core", "_cores").alias("correction_pair_overlap"),
        "findings", "last_uploaded",
    )


def current_counts(findings: DataFrame) -> DataFrame:
    """Distinct fingerprints and corrections per report; '' does not count."""
    prints = F.when(F.col("fingerprint") != "", F.col("fingerprint"))
    return findings.groupBy("report_id").agg(
        F.count_distinct(prints).alias("fingerprints"), F.count_distinct("core_key").alias("core_keys")
    )


def findings_with_names(findings: DataFrame, reports: DataFrame) -> DataFrame:
    return lookup_join(findings, reports.select("report_id", "report_name"), ["report_id"], "inner")
