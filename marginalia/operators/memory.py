"""Decision memory: reuse of earlier decisions for the same finding elsewhere.

Everything is computed once per distinct fingerprint.  A decision that has been
taken a million times, or a finding copied into a million places, is one row until
the last join writes the result back to the findings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia import fixed
from marginalia.functions.comments import training_comment
from marginalia.functions.decisions import parse_decision
from marginalia.functions.signature import SIGNATURE_COLUMNS, pair_id, with_fingerprint, with_signature
from marginalia.operators import durable, near
from marginalia.operators.joins import by_shuffle, lookup_join, skew_join, with_one_row
from marginalia.operators.review import KEY, flagged

# Fixed: the column names and their order are those of the stored table.
OBSERVATION_FIELDS = (
    "observation_id", "fingerprint", "core_key", "anchor_kind", "anchor", "checker",
    "field_name", "original", "proposed", "status", "note", "source_report",
    "source_report_id", "issue_id", "updated_at",
)

BAND = 4.0
"""Texts of one band of lengths are at most so many times as long as each other."""


# --------------------------------------------------------------- consensus
def tally(observations: DataFrame, keys: list[str]) -> DataFrame:
    """What the observations of each key say, in a fixed-size row plus source names.

    Counts go per key and source first, so a key with very many rows is reduced
    before its sources meet.  Whether statuses or notes differ is minimum against
    maximum.
    """
    note = training_comment(
        F.col("note"), F.col("checker"), F.col("original"), F.col("proposed")
    )
    clean = observations.select(
        *keys, "status", "source_report",
        F.when(note != "", note).alias("_note"),
    )
    by_source = clean.groupBy(*keys, "source_report").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("status").alias("lo_status"), F.max("status").alias("hi_status"),
        F.min("_note").alias("lo_note"), F.max("_note").alias("hi_note"),
    )
    return by_source.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.min("lo_status").alias("lo_status"), F.max("hi_status").alias("hi_status"),
        F.min("lo_note").alias("lo_note"), F.max("hi_note").alias("hi_note"),
        F.array_sort(F.collect_list("source_report")).alias("sources"),
    )


def decided(tallies: DataFrame, *keys: str) -> DataFrame:
    """Keys whose observations agree, with the shared decision."""
    one_status = F.col("lo_status") == F.col("hi_status")
    one_note = F.col("lo_note") == F.col("hi_note")  # null without any note
    usable = (
        one_status & F.col("lo_status").isin(*fixed.STATUSES)
        & ((F.col("lo_status") != fixed.NEEDS_CHANGE) | F.coalesce(one_note, F.lit(False)))
    )
    return tallies.filter(usable).select(
        *keys, F.col("lo_status").alias("decision"),
        F.when(one_note, F.col("lo_note")).otherwise("").alias("review_note"),
        F.array_join("sources", ", ").alias("memory_source"),
        F.col("rows").alias("memory_evidence"),
    )


def consensus(observations: DataFrame, keys: list[str]) -> DataFrame:
    return decided(tally(observations, keys), *keys)


def relevant_observations(findings: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations about a correction that occurs in the findings."""
    return skew_join(observations, findings.select("core_key").distinct(), ["core_key"])


# ------------------------------------------------------------------- match
def open_findings(findings: DataFrame, computed: bool = False) -> DataFrame:
    """Flagged findings that can be looked up.

    Signatures that are ``computed`` when they are read pass through a generator, below
    which Spark moves no test of them (see ``with_fingerprint``).
    """
    rows = flagged(findings)
    signature = ("fingerprint", "core_key", "anchor_kind", "anchor")
    if "fingerprint" not in rows.columns:
        rows = with_fingerprint(rows)
    elif computed:
        rows = rows.select(*KEY, F.inline(F.array(F.struct(*signature)))).filter("fingerprint <> ''")
    else:
        rows = rows.filter("fingerprint <> ''")
    return rows.select(*KEY, *signature)


def match(findings: DataFrame, observations: DataFrame,
          threshold: float = fixed.NEAR_MATCH_THRESHOLD, autojunk: bool = True,
          computed: bool = False) -> DataFrame:
    """Reusable decisions for flagged findings, exact first, then near.

    What the observations say, one row per fingerprint, is written to the checkpoint
    folder: it is far smaller than the findings, and no tally is computed again or lost
    with an executor.  ``computed`` findings are made when they are read; of them the
    open ones are written too.
    """
    rows = open_findings(findings, computed)
    if computed or "fingerprint" not in findings.columns:
        rows = durable.stored(rows, "open-findings")
    # the texts meet their tallies where both are dealt out by fingerprint
    known = durable.stored(
        by_shuffle(distinct_anchors(observations)).join(
            by_shuffle(tally(observations, ["fingerprint"])), "fingerprint"
        ), "known",
    )
    agreed = decided(known, "fingerprint")
    exact = agreed.withColumns({"memory_match": F.lit("exact"), "memory_score": F.lit(1.0)})
    rest = distinct_anchors(rows).join(by_shuffle(agreed.select("fingerprint")), "fingerprint", "left_anti")
    alike = near_decisions(rest, known, threshold, autojunk)
    return skew_join(
        rows.select(*KEY, "fingerprint"), by_shuffle(exact.unionByName(alike)), ["fingerprint"], rows=rows.count()
    ).drop("fingerprint")


def distinct_anchors(rows: DataFrame) -> DataFrame:
    """What the fingerprints stand for, one row each."""
    return rows.groupBy("fingerprint").agg(
        *[F.any_value(c).alias(c) for c in ("core_key", "anchor_kind", "anchor")]
    )


def match_exact(findings: DataFrame, observations: DataFrame) -> DataFrame:
    rows = open_findings(findings).select(*KEY, "fingerprint")
    agreed = consensus(observations, ["fingerprint"]).withColumns(
        {"memory_match": F.lit("exact"), "memory_score": F.lit(1.0)}
    )
    known = rows.count() if "fingerprint" in findings.columns else None
    return skew_join(rows, agreed, ["fingerprint"], rows=known).drop("fingerprint")


def near_pairs(probes: DataFrame, known: DataFrame, threshold: float,
               autojunk: bool = True) -> DataFrame:
    """Pairs of (probe, known) fingerprints that reach the threshold, scored; none is lost.

    Texts are dealt out once, by what must be equal and by bands of their length, and meet
    in ``near.near_copies``: pieces of texts, candidates and pairs of texts are made in the
    tasks and never written.  A group with many known characters is dealt out in parts.
    """
    block, group = ["core_key", "anchor_kind"], ["core_key", "anchor_kind", "band", "part"]
    length = F.greatest(F.length("anchor"), F.lit(1))
    reach = (2 - threshold) / threshold * (1 + 1e-6)  # a partner is at most so many times as long

    def band(characters: Column) -> Column:
        return F.floor(F.log(characters) / math.log(BAND)).cast("int")

    # the test of the fingerprint makes both readers of the probes alike, so that they are shuffled once
    usable = " AND ".join(f"{c} IS NOT NULL" for c in ("fingerprint", *block, "anchor"))
    wanted = probes.filter(usable).withColumn(
        "band", F.explode(F.sequence(band(length / reach), band(length * reach)))
    )
    held = known.select("fingerprint", *block, "anchor").filter(usable).withColumn("band", band(length))
    parts = F.lit(1)
    if (held.agg(F.sum(length)).first()[0] or 0) > near.PART_CHARS:
        # at most all characters by PART_CHARS such groups, a short list whatever the data
        large = F.broadcast(
            held.groupBy(*block, "band").agg(F.ceil(F.sum(length) / near.PART_CHARS).cast("int").alias("_parts"))
            .filter("_parts > 1")
        )
        wanted, held = (side.join(large, [*block, "band"], "left") for side in (wanted, held))
        parts = F.coalesce("_parts", F.lit(1))
    held = held.withColumn("part", F.pmod(F.xxhash64("fingerprint"), parts).cast("int"))
    wanted = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = held.select(*group, F.lit(False).alias("probe"), "fingerprint", "anchor").unionByName(
        wanted.select(*group, F.lit(True).alias("probe"), "fingerprint", "anchor")
    )
    met = rows.repartition(*group).sortWithinPartitions(*group, "probe", "fingerprint")
    alike = met.mapInArrow(near.near_copies(threshold, autojunk), near.PAIRS)
    text = ["fingerprint", F.xxhash64(*block, "anchor").alias("_text")]
    same = probes.select(*text).join(by_shuffle(known.select(*text)), ["fingerprint", "_text"]).select(
        "fingerprint", F.col("fingerprint").alias("known_fingerprint"),
        F.lit(1.0).alias("score"), F.lit(1.0).alias("rounded"),
    )
    return durable.stored(alike.unionByName(same), "near-pairs")


def near_decisions(probes: DataFrame, known: DataFrame, threshold: float,
                   autojunk: bool = True) -> DataFrame:
    """Decision of the most similar known anchors, one row per probe fingerprint."""
    pairs = near_pairs(probes, known, threshold, autojunk)
    said = known.withColumnRenamed("fingerprint", "known_fingerprint").drop("core_key", "anchor_kind", "anchor")
    scored = skew_join(pairs, by_shuffle(said), ["known_fingerprint"], rows=pairs.count())
    # A probe has few distinct scores (ratios of short lengths), however many partners.
    by_score = scored.groupBy("fingerprint", "score").agg(
        F.max("rounded").alias("rounded"),
        F.sum("rows").alias("rows"),
        F.min("lo_status").alias("lo_status"), F.max("hi_status").alias("hi_status"),
        F.min("lo_note").alias("lo_note"), F.max("hi_note").alias("hi_note"),
        F.array_distinct(F.flatten(F.collect_set("sources"))).alias("sources"),
    )
    best = F.max("score").over(Window.partitionBy("fingerprint"))
    top = by_score.withColumn("_best", best).filter(
        F.col("score") >= F.col("_best") - fixed.NEAR_MATCH_BAND
    )
    merged = top.groupBy("fingerprint").agg(
        F.max("rounded").alias("memory_score"),
        F.sum("rows").alias("rows"),
        F.min("lo_status").alias("lo_status"), F.max("hi_status").alias("hi_status"),
        F.min("lo_note").alias("lo_note"), F.max("hi_note").alias("hi_note"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
    )
    found = decided(merged, "fingerprint", "memory_score")
    return found.withColumn("memory_match", F.lit("near")).select(
        "fingerprint", "decision", "review_note", "memory_source", "memory_evidence",
        "memory_match", "memory_score",
    )


# ----------------------------------------------------------------- publish
def reviewed_rows(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Flagged findings with parsed decision."""
    rows = flagged(findings).join(reviews.select(*KEY, "decision", "review_note"), KEY, "left")
    return rows.withColumn("_p", parse_decision(F.col("decision"), F.col("review_note")))


def signed(rows: DataFrame, sign=with_signature) -> DataFrame:
    """Rows with their signature, computed only where the rows do not carry it."""
    if all(c in rows.columns for c in SIGNATURE_COLUMNS):
        return rows
    return sign(rows.drop(*[c for c in SIGNATURE_COLUMNS if c in rows.columns]))


def observations_from_reviews(findings: DataFrame, reviews: DataFrame, names: DataFrame,
                              as_of: Column) -> DataFrame:
    """Observations to publish.  ``names`` maps ``report_id`` to ``source_report``."""
    decided_rows = reviewed_rows(findings, reviews).filter(F.col("_p.status").isNotNull())
    rows = signed(decided_rows, with_fingerprint).filter(F.col("fingerprint") != "")
    note = training_comment(
        F.col("_p.note"), F.col("checker"), F.col("original"), F.col("proposed")
    )
    return lookup_join(rows, names.select("report_id", "source_report"), ["report_id"], "inner").select(
        pair_id(F.col("report_id"), F.col("issue_id")).alias("observation_id"),
        "fingerprint", "core_key", "anchor_kind", "anchor",
        F.col("checker_key").alias("checker"), F.col("field_key").alias("field_name"),
        F.col("original_key").alias("original"), F.col("proposed_key").alias("proposed"),
        F.col("_p.status").alias("status"), note.alias("note"), "source_report",
        F.col("report_id").alias("source_report_id"), "issue_id", as_of.alias("updated_at"),
    )


def publish_counts(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Published, blank and unanchored flagged findings per report."""
    rows = reviewed_rows(findings, reviews)
    anchored = F.col("fingerprint") != ""
    blank = rows.groupBy("report_id").agg(F.count_if(F.col("_p.status").isNull()).alias("skipped_blank"))
    counted = signed(rows.filter(F.col("_p.status").isNotNull())).groupBy("report_id").agg(
        F.count_if(anchored).alias("published"), F.count_if(~anchored).alias("skipped_unmatchable"),
    )
    none = F.lit(0).cast("bigint")
    return blank.join(counted, "report_id", "left").select(
        "report_id", F.coalesce("published", none).alias("published"), "skipped_blank",
        F.coalesce("skipped_unmatchable", none).alias("skipped_unmatchable"),
    )


def memory_stats(observations: DataFrame) -> DataFrame:
    """Observations, distinct findings, reports and conflicting fingerprints."""
    per_fingerprint = observations.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n"), (F.min("status") != F.max("status")).alias("conflict")
    )
    totals = per_fingerprint.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("observations"),
        F.count(F.lit(1)).alias("findings"),
        F.count_if("conflict").alias("conflicts"),
    )
    reports = observations.agg(F.count_distinct("source_report_id").alias("reports"))
    return with_one_row(totals, reports).select(
        "observations", "findings", "reports", "conflicts"
    )
