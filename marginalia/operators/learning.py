"""Learning rules from agreeing decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import fixed
from marginalia.functions import text as tx
from marginalia.functions.decisions import parse_decision
from marginalia.functions.signature import short_id
from marginalia.operators import rulebook as rb
from marginalia.operators.joins import joined_names, lookup_join, skew_join
from marginalia.operators.memory import decided, tally

EVIDENCE_FIELDS = (
    "core_key", "checker", "field", "original", "proposed", "status", "comment",
    "human_decisions", "human_reports", "occurrences", "course_coverage",
    "reviewed_sources", "seen_in_reports",
)


SHOWN = ("checker", "field_name", "original", "proposed")


def places(findings: DataFrame, reports: DataFrame) -> DataFrame:
    """Where corrections occur: one row per (correction, report) with the number of findings
    and the first of them.  Findings of reports that are not listed do not count."""
    per_report = findings.groupBy("core_key", "report_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*SHOWN), "finding_order").alias("first")
    )
    named = lookup_join(per_report, reports.select("report_id", "report_name"), ["report_id"], "inner")
    return named.select("core_key", "report_id", "report_name", "n", "first")


def agreed_corrections(observations: DataFrame) -> DataFrame:
    return decided(tally(observations, ["core_key"]), "core_key")


def evidence(observations: DataFrame, findings: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per correction that people agree on, with its reach in the library.

    The decision comes from observations alone; stored findings only add occurrences
    and coverage.  Findings are restricted to reviewed corrections and reduced to one
    row per (correction, report) before anything is joined.
    """
    # one row per correction on the right, so this keeps findings as they are
    seen = skew_join(findings, agreed_corrections(observations).select("core_key"), ["core_key"])
    return evidence_at(observations, places(seen, reports))


def evidence_at(observations: DataFrame, named: DataFrame) -> DataFrame:
    """Evidence from ``places`` that hold all agreed corrections, and perhaps others."""
    agreed = agreed_corrections(observations)
    human = observations.groupBy("core_key").agg(
        F.count_distinct("source_report_id").alias("human_reports"),
        F.min_by(F.struct(*SHOWN), F.struct("updated_at", "observation_id")).alias("_human"),
    )
    reach = named.groupBy("core_key").agg(
        F.sum("n").alias("occurrences"), F.min_by("first", "report_id").alias("_seen")
    )
    names = joined_names(named, ["core_key"], "report_name", "seen_in_reports")
    covered = (
        named.select("core_key", "report_id")
        .unionAll(observations.select("core_key", F.col("source_report_id").alias("report_id")))
        .distinct().groupBy("core_key").agg(F.count(F.lit(1)).alias("course_coverage"))
    )
    rows = (
        agreed.join(human, "core_key").join(covered, "core_key")
        .join(reach, "core_key", "left").join(names, "core_key", "left")
    )
    shown = F.coalesce("_seen", "_human")
    return rows.select(
        "core_key", shown["checker"].alias("checker"), shown["field_name"].alias("field"),
        shown["original"].alias("original"), shown["proposed"].alias("proposed"),
        F.col("decision").alias("status"), F.col("review_note").alias("comment"),
        F.col("memory_evidence").alias("human_decisions"), "human_reports",
        F.coalesce("occurrences", F.lit(0)).cast("bigint").alias("occurrences"),
        "course_coverage", F.col("memory_source").alias("reviewed_sources"),
        tx.present(F.col("seen_in_reports")).alias("seen_in_reports"),
    )


# ------------------------------------------------------------- suggestions
GROUP = ["suggestion_type", "checker", "field", "original", "proposed", "status", "comment"]


def _grouped(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Replace the key columns: rejected unknown spellings become one term each."""
    for name in ("checker", "field", "original", "proposed", "status", "comment"):
        rows = rows.withColumn(name, tx.present(F.col(name)))
    word = F.lower(tx.strip(F.col("original")))
    spelled = (F.col("checker") == "check_spelling") & (F.col("status") == fixed.REJECTED)
    rows = rows.withColumn("_word", F.when(spelled, word))
    known = terms.select(F.col("term").alias("_word"), F.lit(True).alias("_known"))
    rows = lookup_join(rows, known, ["_word"])
    is_term = spelled & F.col("_known").isNull()
    values = {
        "suggestion_type": F.when(is_term, fixed.TERM_SUGGESTION).otherwise(fixed.RULE_SUGGESTION),
        "field": F.when(is_term, "*").otherwise(F.col("field")),
        "original": F.when(is_term, word).otherwise(F.col("original")),
        "proposed": F.when(is_term, "*").otherwise(F.col("proposed")),
        "comment": F.when(is_term, fixed.COMMENTS["learned_term"]).otherwise(F.col("comment")),
    }
    return rows.withColumns(values).drop("_word", "_known")


def suggestion_id() -> Column:
    term = short_id(F.lit("protected_term"), F.col("original"))
    rule = short_id(F.lit("exact"), *[F.col(c) for c in GROUP[1:]])
    return F.when(F.col("suggestion_type") == fixed.TERM_SUGGESTION, term).otherwise(rule)


def local_suggestions(findings: DataFrame, reviews: DataFrame, reports: DataFrame,
                      terms: DataFrame) -> DataFrame:
    """Suggestions from the decisions of open reports."""
    key = ["report_id", "issue_id"]
    parsed = reviews.select(
        *key, parse_decision(F.col("decision"), F.col("review_note")).alias("_p")
    ).filter(F.col("_p.status").isNotNull())
    names = reports.select("report_id", "report_name")
    rows = findings.select(*key, "checker", "field", "original", "proposed").join(parsed, key)
    rows = rows.select(
        "report_id", "checker", "field", "original", "proposed",
        F.col("_p.status").alias("status"), F.col("_p.note").alias("comment"),
    )
    rows = lookup_join(_grouped(rows, terms), names, ["report_id"]).withColumn(
        "report_name", F.coalesce("report_name", "report_id")
    )
    # per report first: a hot pattern meets its names as one row per report
    counted = rows.groupBy(*GROUP, "report_name").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(*GROUP).agg(
        F.sum("n").alias("evidence_count"),
        F.array_join(F.array_sort(F.collect_list("report_name")), ", ").alias("reports"),
    )
    return totals.select(
        F.lit(False).alias("selected"), suggestion_id().alias("suggestion_id"),
        *GROUP, "evidence_count", "reports",
    ).orderBy(
        F.desc("evidence_count"), "suggestion_type", F.lower("original"), "suggestion_id"
    )


def shared_suggestions(evidence_rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Suggestions from the evidence of the whole library."""
    rows = _grouped(evidence_rows, terms)
    numbers = rows.groupBy(*GROUP).agg(
        F.sum(F.coalesce("human_decisions", F.lit(0))).alias("evidence_count"),
        F.max(F.coalesce("human_reports", F.lit(0))).alias("human_reports"),
        F.max(F.coalesce("course_coverage", F.lit(0))).alias("course_coverage"),
        F.sum(F.coalesce("occurrences", F.lit(0))).alias("occurrences"),
    )
    listed = F.concat_ws(",", "reviewed_sources", "seen_in_reports")
    sources = rows.select(
        *GROUP, F.explode(F.split(listed, ",", -1)).alias("_name")
    ).withColumn("_name", tx.strip(F.col("_name"))).filter("_name <> ''")
    names = joined_names(sources, GROUP, "_name", "reports")
    return numbers.join(names, GROUP, "left").select(
        F.lit(False).alias("selected"), suggestion_id().alias("suggestion_id"), *GROUP,
        "evidence_count", "human_reports", "course_coverage", "occurrences",
        tx.present(F.col("reports")).alias("reports"),
    ).orderBy(
        F.desc("course_coverage"), F.desc("evidence_count"), F.desc("occurrences"),
        "suggestion_type", F.lower("original"), "suggestion_id",
    )


def automation_reason() -> Column:
    """Why a suggestion is safe without an editor, null when it is not."""
    status, checker = F.col("status"), F.col("checker")
    rule = F.col("suggestion_type") == fixed.RULE_SUGGESTION
    rejected = status == fixed.REJECTED
    settled = status.isin(fixed.APPROVED, fixed.REJECTED)
    decisions = F.col("evidence_count")
    wide = (decisions >= 2) & (F.col("human_reports") >= 2) & (F.col("course_coverage") >= 2)
    comment = tx.fold(tx.present(F.col("comment")))
    notation = comment.rlike(tx.any_of(fixed.NOTATION_SIGNALS))
    term = (
        (F.col("suggestion_type") == fixed.TERM_SUGGESTION) & rejected & (decisions >= 1)
        & (F.col("course_coverage") >= 2) & (F.col("occurrences") >= 2)
    )
    reasons = fixed.AUTOMATION_REASONS
    return (
        F.when(term, reasons["term"])
        .when(rule & (checker == "check_math") & rejected & (decisions >= 1), reasons["math"])
        .when(rule & (checker == "check_spacing") & settled & wide, reasons["spacing"])
        .when(rule & (checker == "check_capitalization") & rejected & wide & notation,
              reasons["capitalization"])
        .when(rule & (checker == "check_spelling") & settled & wide, reasons["spelling"])
    )


def automatic_suggestions(suggestions: DataFrame) -> DataFrame:
    return suggestions.withColumn("automation_reason", automation_reason()).filter(
        "automation_reason IS NOT NULL"
    ).withColumns({"selected": F.lit(True), "source": F.lit(fixed.AUTOMATIC_SOURCE)})


def manual_suggestions(suggestions: DataFrame) -> DataFrame:
    """Suggestions a person has to judge."""
    return suggestions.join(
        automatic_suggestions(suggestions).select("suggestion_id"), "suggestion_id", "left_anti"
    ).select(*suggestions.columns)


def above_thresholds(suggestions: DataFrame, min_evidence: int, min_coverage: int) -> DataFrame:
    return suggestions.filter(
        (F.col("evidence_count") >= min_evidence) & (F.col("course_coverage") >= min_coverage)
    )


def newly_qualified(active: DataFrame, previous_ids: DataFrame) -> DataFrame:
    return active.join(previous_ids.select("suggestion_id"), "suggestion_id", "left_anti").select(
        *active.columns
    )


def promote_automatic(book: rb.Rulebook, suggestions: DataFrame,
                      version: str) -> tuple[rb.Rulebook, DataFrame]:
    """Promote qualified suggestions the rulebook does not hold yet."""
    fresh = rb.uncovered(book, automatic_suggestions(suggestions))
    return rb.promote(book, fresh, version), fresh


def refresh(book: rb.Rulebook, evidence_rows: DataFrame, remembered_terms: DataFrame,
            version: str) -> tuple[rb.Rulebook, DataFrame, DataFrame]:
    """Rebuild the learned layer: new rulebook, active suggestions, removed count.

    One pass is enough: labels come from observations only, never from the rules.
    """
    plain, removed = rb.without_automatic(book, remembered_terms)
    active = automatic_suggestions(shared_suggestions(evidence_rows, plain.terms))
    return rb.promote(plain, active, version), active, removed


def learned_terms(active: DataFrame) -> DataFrame:
    """Terms of the learned layer, to be taken out again at the next refresh."""
    return active.filter(F.col("suggestion_type") == fixed.TERM_SUGGESTION).select(
        tx.fold(tx.strip(F.col("original"))).alias("term")
    ).distinct()
