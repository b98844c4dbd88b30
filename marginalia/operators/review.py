"""Review tables: flagged findings, decisions, progress and overview counts.

``findings`` are classified rows with ``report_id``; ``reviews`` have ``report_id,
issue_id, decision, review_note`` and optionally the ``memory_*`` columns, one row
per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import fixed
from marginalia.functions import text as tx
from marginalia.functions.comments import training_comment
from marginalia.functions.decisions import parse_decision, ui_decision

KEY = ["report_id", "issue_id"]
MEMORY = {
    "memory_source": "string", "memory_evidence": "bigint",
    "memory_match": "string", "memory_score": "double",
}


def flagged(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("status") == fixed.NEEDS_CHANGE)


def is_blank(decision: Column) -> Column:
    return tx.strip(tx.present(decision)) == ""


def with_memory_columns(reviews: DataFrame) -> DataFrame:
    missing = {n: F.lit(None).cast(t) for n, t in MEMORY.items() if n not in reviews.columns}
    return reviews.withColumns(missing) if missing else reviews


# ------------------------------------------------------------------- joins
def apply_reviews(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """A decision replaces status and comment; links are always approved."""
    parsed = reviews.select(
        *KEY, parse_decision(F.col("decision"), F.col("review_note")).alias("_p")
    ).filter(F.col("_p.status").isNotNull())
    is_link = F.equal_null(F.col("checker"), F.lit("check_links"))
    decided = F.col("_p").isNotNull()
    return findings.join(parsed, KEY, "left").withColumns({
        "status": F.when(is_link, fixed.APPROVED).when(decided, F.col("_p.status"))
        .otherwise(F.col("status")),
        "comment": F.when(is_link, "").when(decided, tx.present(F.col("_p.note")))
        .otherwise(F.col("comment")),
    }).drop("_p").select(*findings.columns)


def review_sheet(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Flagged findings with their current decisions, in sheet column order."""
    sheet = flagged(findings).join(reviews.select(*KEY, "decision", "review_note"), KEY, "left")
    return sheet.select(
        "report_id", tx.present(F.col("decision")).alias("decision"),
        tx.present(F.col("review_note")).alias("review_note"), *fixed.DETAIL_FIELDS,
    )


def review_frame(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Flagged findings as a reviewer reads them."""
    extra = with_memory_columns(reviews).select(*KEY, "decision", "review_note", *MEMORY)
    rows = flagged(findings).join(extra, KEY, "left")
    match = tx.present(F.col("memory_match"))
    percent = F.bround(F.coalesce("memory_score", F.lit(0.0)) * 100, 0).cast("int")
    context = F.concat(
        tx.present(F.col("context_before")), F.lit("  ‹CHANGE›  "),
        tx.present(F.col("context_after")),
    )
    return rows.select(
        "report_id", tx.present(F.col("decision")).alias("decision"),
        tx.present(F.col("review_note")).alias("review_note"),
        "checker", "field", "original", "proposed",
        tx.strip(context).alias("context"),
        F.when(tx.present(F.col("breadcrumb")) != "", F.col("breadcrumb"))
        .otherwise(F.col("node_label")).alias("location"),
        tx.present(F.col("memory_source")).alias("reused_from"),
        F.when(match == "", "").otherwise(
            F.concat(F.initcap(match), F.lit(" "), percent.cast("string"), F.lit("%"))
        ).alias("match_quality"),
        "node_link", "issue_id",
    )


def search(frame: DataFrame, query: str, checkers: list[str] | None = None) -> DataFrame:
    """Rows of some checkers whose texts or location contain a literal, case ignored."""
    if checkers is not None:
        frame = frame.filter(F.col("checker").isin(checkers))
    needle = query.strip().lower()
    if not needle:
        return frame
    texts = F.concat_ws(" ", *[tx.present(F.col(n)) for n in ("original", "proposed", "location")])
    return frame.filter(F.contains(F.lower(texts), F.lit(needle)))


def prefill(reviews: DataFrame, matches: DataFrame) -> DataFrame:
    """Fill blank decisions from memory; a given decision is never replaced."""
    base = with_memory_columns(reviews)
    renamed = matches.select(
        *KEY, *[F.col(n).alias(f"_m_{n}") for n in ("decision", "review_note", *MEMORY)]
    )
    take = is_blank(F.col("decision")) & F.col("_m_decision").isNotNull()
    columns = {
        n: F.when(take, F.col(f"_m_{n}")).otherwise(F.col(n))
        for n in ("decision", "review_note", *MEMORY)
    }
    return base.join(renamed, KEY, "left").withColumns(columns).select(*base.columns)


def session_reviews(findings: DataFrame, session: DataFrame, drafts: DataFrame) -> DataFrame:
    """Reviews of the flagged findings: open session first, then draft, then blank."""
    one = session.select(*KEY, F.struct("decision", "review_note").alias("_s"))
    two = drafts.select(*KEY, F.struct("decision", F.col("note").alias("review_note")).alias("_d"))
    blank = F.struct(F.lit("").alias("decision"), F.lit("").alias("review_note"))
    chosen = F.coalesce("_s", "_d", blank)
    return (
        flagged(findings).select(*KEY).join(one, KEY, "left").join(two, KEY, "left")
        .select(*KEY, chosen["decision"].alias("decision"),
                chosen["review_note"].alias("review_note"),
                (F.col("_s").isNull() & F.col("_d").isNotNull()).alias("draft_saved"))
    )


def import_sheet(sheet: DataFrame, findings: DataFrame,
                 decision_column: str) -> tuple[DataFrame, DataFrame]:
    """Decisions of a filled-in sheet for flagged findings, and the ids that match none.

    ``sheet`` has ``report_id, issue_id``, the decision column and a note column.
    Blank decisions are skipped.  A later line wins over an earlier one of the same
    id (``line`` column).
    """
    ids = flagged(findings).select(*KEY)
    notes = [F.col(n) for n in ("review_note", "comment") if n in sheet.columns]
    note = F.coalesce(*[F.when(n != "", n) for n in notes], F.lit(""))
    lines = sheet.withColumn("issue_id", tx.present(F.col("issue_id")))
    parsed = lines.select(
        *KEY, "line", ui_decision(F.col(decision_column), note).alias("_p")
    )
    unmatched = lines.join(ids, KEY, "left_anti")
    applied = (
        parsed.filter(F.col("_p.status") != "").join(ids, KEY, "left_semi")
        .groupBy(*KEY).agg(
            F.max_by("_p", "line").alias("_p"), F.count(F.lit(1)).alias("lines")
        )
        .select(*KEY, F.col("_p.status").alias("decision"),
                F.col("_p.note").alias("review_note"), "lines")
    )
    return applied, unmatched


def changed_decisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Decisions that differ from what was saved, for the audit log."""
    old = before.select(*KEY, F.struct("decision", "review_note").alias("_old"))
    parsed = after.select(
        *KEY, ui_decision(F.col("decision"), F.col("review_note")).alias("_p")
    ).select(*KEY, F.col("_p.status").alias("decision"), F.col("_p.note").alias("review_note"))
    same = (
        tx.present(F.col("_old.decision")).eqNullSafe(F.col("decision"))
        & tx.present(F.col("_old.review_note")).eqNullSafe(F.col("review_note"))
    )
    return parsed.join(old, KEY, "left").filter(~same).select(
        *KEY, "decision",
        F.to_json(F.struct("review_note")).alias("detail_json"),
    )


# ------------------------------------------------------------------ counts
def status_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("report_id", "status").agg(F.count(F.lit(1)).alias("findings"))


def review_progress(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    rows = flagged(findings).select(*KEY).join(reviews.select(*KEY, "decision"), KEY, "left")
    return rows.groupBy("report_id").agg(
        F.count_if(~is_blank(F.col("decision"))).alias("completed"),
        F.count(F.lit(1)).alias("flagged"),
    )


def checker_summary(findings: DataFrame, by: tuple[str, ...] = ("checker",)) -> DataFrame:
    """Checker by status with all three status columns."""
    counts = findings.groupBy(*by).pivot("status", list(fixed.STATUSES)).count()
    return counts.na.fill(0, list(fixed.STATUSES))


def headline(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings, handled automatically, sent to review and still open, per report."""
    rows = findings.select(*KEY, "status").join(reviews.select(*KEY, "decision"), KEY, "left")
    is_flagged = F.col("status") == fixed.NEEDS_CHANGE
    return rows.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.col("status").isin(fixed.APPROVED, fixed.REJECTED)).alias("automatic"),
        F.count_if(is_flagged).alias("flagged"),
        F.count_if(is_flagged & is_blank(F.col("decision"))).alias("outstanding"),
    )


def automatic_split(findings: DataFrame) -> DataFrame:
    """What the rules handled: math, standards codes, and other spacing."""
    handled = F.col("status").isin(fixed.APPROVED, fixed.REJECTED)
    standards = (
        (F.col("checker") == "check_spacing") & (F.col("status") == fixed.REJECTED)
        & F.contains(tx.fold(tx.present(F.col("comment"))), F.lit("standards code"))
    )
    return findings.groupBy("report_id").agg(
        F.count_if((F.col("checker") == "check_math") & handled).alias("math"),
        F.count_if(standards).alias("standards"),
        (F.count_if((F.col("checker") == "check_spacing") & handled)
         - F.count_if(standards)).alias("spacing"),
    )


def reuse_counts(reviews: DataFrame) -> DataFrame:
    match = F.col("memory_match")
    return reviews.groupBy("report_id").agg(
        F.count_if(tx.present(match) != "").alias("reused"),
        F.count_if(match == "exact").alias("exact"),
        F.count_if(match == "near").alias("near"),
    )


def comment_counts(merged: DataFrame, reviews: DataFrame) -> DataFrame:
    """Comments kept and suppressed by the policy, and confirmed changes, per report."""
    kept = training_comment(
        F.col("comment"), F.col("checker"), F.col("original"), F.col("proposed")
    )
    counts = merged.select(
        "report_id", (~is_blank(F.col("comment"))).alias("_raw"), (tx.strip(kept) != "").alias("_kept")
    ).groupBy("report_id").agg(
        F.count_if("_kept").alias("kept"),
        (F.count_if("_raw") - F.count_if("_kept")).alias("suppressed"),
    )
    changes = reviews.filter(F.col("decision") == fixed.NEEDS_CHANGE).groupBy("report_id").agg(
        F.count(F.lit(1)).alias("confirmed_changes")
    )
    return counts.join(changes, "report_id", "left").na.fill(0, ["confirmed_changes"])


def handoff_summary(merged: DataFrame) -> DataFrame:
    """The counts sentence of a finished report."""
    counts = checker_summary(merged, ("report_id",))
    total = F.col("approved") + F.col("rejected") + F.col("needs_change")
    return counts.select(
        "report_id",
        F.format_string(
            "All %s findings are included: %s approved, %s rejected, and %s needs change.",
            *[F.format_number(c, 0) for c in
              (total, F.col("approved"), F.col("rejected"), F.col("needs_change"))],
        ).alias("summary"),
    )
