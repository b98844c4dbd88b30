"""The flows a user runs end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import changes as changes_of
from marginalia.operators import classify as cl
from marginalia.operators import durable, learning, library, memory, merging, parse, review
from marginalia.operators import rulebook as rb
from marginalia.operators.joins import lookup_join
from marginalia.plans.store import Store
from marginalia.sources import reports as src


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Manifest and raw findings of all report files under a path.

    The texts are read twice, once to hash each file and once to parse it.  While
    parsing, pieces that are no card are counted; there is one per file unless the
    delimiter also occurs inside a card, and only such files are read again as a whole.
    """
    manifest = durable.stored(src.report_manifest(spark, path), "manifest")
    cards = src.scan_report_cards(spark, path)
    counted = Observation("cards")
    watched = cards.observe(counted, F.count_if(~src.is_card(F.col("card"))).alias("others"))
    findings = _parse(watched, manifest)
    if counted.get["others"] > manifest.count():
        odd = [r["path"] for r in src.irregular_files(cards).collect()]  # malformed files only
        whole = src.scan_whole_reports(spark, odd)
        findings = _parse(cards.filter(~F.col("path").isin(odd)).unionByName(whole), manifest)
    return manifest.dropDuplicates(["report_id"]), findings


def _parse(cards: DataFrame, manifest: DataFrame) -> DataFrame:
    keyed = src.with_report_id(cards.filter(src.is_card(F.col("card"))), manifest)
    return parse.findings_from_cards(keyed)


def ingest(store: Store, path: str, book: rb.Rulebook, as_of: Column) -> dict[str, DataFrame]:
    """Parse, classify and store reports, learn, classify again, and prefill reviews."""
    files, raw = read_reports(store.spark, path)
    raw = durable.stored(raw, "raw-findings")
    stored = store.store_findings(
        library.stored_findings(cl.with_verdict(raw, book).withColumns({
            n: F.coalesce(F.col(n), F.lit("")) for n in ("original", "proposed")
        }))
    )
    uploaded = files.select("report_id", "report_name", "filename")
    here = stored.join(uploaded.select("report_id"), "report_id", "left_semi")
    rows = library.report_rows(here.withColumnRenamed("initial_status", "status"), uploaded,
                               book.version, as_of)
    store.write("reports", merging.reupload(store.read("reports"), rows))
    rejected = parse.reports_without_findings(uploaded, here)
    new_book, active, removed, newly = refresh(store, book)
    result = reopen(store, uploaded, new_book)
    return {**result, "rejected": rejected, "active": active, "removed": removed,
            "book": new_book, "newly": newly, "counts": library.stored_counts(here)}


def refresh(store: Store, book: rb.Rulebook, version: str = "learned"):
    """Learning refresh over the whole store.

    Returns the new rulebook, the active suggestions, how many were removed, and those
    that qualify now and did not at the last refresh, whose ids the store remembers.
    """
    seen = durable.stored(learning.evidence(
        store.read("observations"), store.read("report_findings"), store.read("reports")
    ), "evidence")
    new_book, active, removed = learning.refresh(book, seen, store.read("learned_terms"), version)
    # the learned layer is read by every later step
    active = durable.stored(active, "active")
    new_book = rb.Rulebook(
        durable.stored(new_book.terms, "terms"), new_book.targets,
        durable.stored(new_book.rules, "rules"), new_book.version,
    )
    newly = durable.stored(learning.newly_qualified(active, store.read("active_rules")), "newly")
    store.write("active_rules", active.select("suggestion_id").distinct())
    store.write("learned_terms", learning.learned_terms(active))
    return new_book, active, removed, newly


def reopen(store: Store, reports: DataFrame, book: rb.Rulebook,
           session: DataFrame | None = None) -> dict[str, DataFrame]:
    """Classify stored reports again and prefill their reviews from drafts and memory."""
    chosen = lookup_join(
        store.read("report_findings"), reports.select("report_id").distinct(), ["report_id"], "inner"
    )
    raw = library.raw_records(chosen)
    findings = durable.stored(cl.classify(raw, book, "finding_order"), "findings")
    drafts = store.read("draft_reviews").join(reports.select("report_id"), "report_id", "left_semi")
    if session is None:
        session = store.spark.createDataFrame(
            [], "report_id string, issue_id string, decision string, review_note string"
        )
    reviews = review.session_reviews(findings, session, drafts)
    matches = memory.match(findings, store.read("observations"))
    return {"findings": findings, "reviews": durable.stored(review.prefill(reviews, matches), "reviews")}


def save_drafts(store: Store, reviews: DataFrame, as_of: Column, reviewer: str = "",
                reviewer_name: str = "", action: str = "save_decisions") -> DataFrame:
    """Save decisions; with a reviewer, each one that differs from the stored is an event."""
    saved, cleared = library.draft_rows(reviews, as_of)
    before = store.read("draft_reviews")
    if reviewer:
        old = before.withColumnRenamed("note", "review_note")
        changes = review.changed_decisions(old, reviews)
        events = library.event_rows(changes, action, reviewer, reviewer_name, as_of)
        store.write("review_events", merging.merge_events(store.read("review_events"), events))
    return store.write("draft_reviews", merging.save_drafts(before, saved, cleared))


def publish(store: Store, findings: DataFrame, reviews: DataFrame, book: rb.Rulebook,
            as_of: Column, reviewer: str = "", reviewer_name: str = "") -> dict[str, DataFrame]:
    """Save drafts, publish decisions, learn from them, and prefill what is still open.

    With a reviewer, changed decisions and the publishing of each report are recorded.
    """
    save_drafts(store, reviews, as_of, reviewer, reviewer_name)
    if reviewer:
        done = memory.publish_counts(findings, reviews).select(
            "report_id", F.lit("").alias("issue_id"), F.lit("").alias("decision"),
            F.to_json(F.struct("published", "skipped_blank", "skipped_unmatchable")).alias("detail_json"),
        )
        events = library.event_rows(done, "publish_decisions", reviewer, reviewer_name, as_of)
        store.write("review_events", merging.merge_events(store.read("review_events"), events))
    names = store.read("reports").select("report_id", F.col("filename").alias("source_report"))
    fresh = memory.observations_from_reviews(findings, reviews, names, as_of)
    store.write(
        "observations", merging.upsert(store.read("observations"), fresh, ["observation_id"])
    )
    new_book, active, removed, newly = refresh(store, book)
    opened = reopen(store, findings.select("report_id").distinct(), new_book)
    return {**opened, "counts": memory.publish_counts(findings, reviews), "active": active,
            "removed": removed, "book": new_book, "newly": newly}


def reclassify_changed(before: DataFrame, findings: DataFrame, flags: DataFrame, index: DataFrame,
                       old: rb.Rulebook, new: rb.Rulebook,
                       container_known: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The library's classified rows under a new rulebook, and the rows that were classified.

    ``before`` are the classified rows under the old one (with ``finding_order``), ``flags``
    the stored confidence flags of the reports, ``index`` the stored keys of the findings
    for all lookups that the two rulebooks make.  Only findings that meet what the rulebooks
    differ in are read from their records and classified; all others are taken as they are.
    ``container_known`` overrides what the records say about containers.
    """
    changes = durable.stored(changes_of.changed_keys(old, new), "changed-keys")
    met = durable.stored(changes_of.touched(index, changes), "touched")
    raw = library.raw_records(findings.join(met, ["report_id", "issue_id"], "left_semi"))
    if container_known is not None:
        raw = raw.withColumn("container_known", container_known)
    rows = cl.with_verdict(raw, new, flags)
    again = durable.stored(cl.classified_columns(rows, "finding_order"), "reclassified")
    kept = before.join(met, ["report_id", "issue_id"], "left_anti")
    return kept.unionByName(again.select(*before.columns)), again


def reclassify_library(findings: DataFrame, book: rb.Rulebook) -> DataFrame:
    """Stored findings under a new rulebook."""
    return cl.classify(library.raw_records(findings), book, "finding_order")
