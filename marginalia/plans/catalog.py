"""Registered queries: each operator over the driver's tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.functions.comments import finalize_training_comments
from marginalia.functions.decisions import parse_decision
from marginalia.functions.signature import with_signature
from marginalia.operators import classify as cl
from marginalia.operators import changes, deltas, durable, learning, library, memory, merging, parse, review
from marginalia.operators import rulebook as rb
from marginalia.plans import bridge, flows
from marginalia.plans.bridge import table
from marginalia.plans.oracle import A, END, N, R, START, matches, quote, sql
from marginalia import fixed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(run: Query) -> Query:
        @wraps(run)
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(spark, sf_dir.rstrip("/"))

        QUERIES[name] = call
        if oracle is not None:
            ORACLES[name] = oracle
        return call
    return add


ID = "report_id, issue_id"

# ================================================================ findings
CARD_SQL = """
SELECT source AS report_id, doc_id AS chunk, doc_id * 1000000000 + pos AS card_order,
  CAST(pos AS STRING) || '" data-checker="check_spelling" data-confidence="low" data-field="' || lang || '">'
  || '<strong>Lesson</strong>: ' || 'Part ' || CAST(pos AS STRING) || '&amp; more <a href="https://x.test/'
  || CAST(doc_id AS STRING) || '">open</a><span class="breadcrumb-pill">Unit ' || CAST(pos % 9 AS STRING)
  || '</span><span class="breadcrumb-pill">' || source || '</span><div data-tab="text-diff">' || prev
  || '<span class="inline-del">' || tok1 || '</span> <span class="inline-ins">' || tok2 || '</span>' || rest
  || '</div></div><div data-tab="original">'
  || CASE pos % 4 WHEN 0 THEN '&amp;lt;table&amp;gt;&amp;lt;tr&amp;gt;&lt;th&gt;' || line || '&lt;/th&gt;'
       WHEN 1 THEN '&lt;table&gt;&lt;td&gt;‡‡ ' || line || '&lt;/td&gt;'
       WHEN 2 THEN '&lt;p&gt;' || line || '&lt;/p&gt;' ELSE line END
  || '</div> </div><div class="aggregated-issue" '
  || CASE WHEN pos % 3 = 0 THEN 'data-checker="check_math"' ELSE '' END
  || '><span class="issue-original">' || tok1 || '</span><span class="issue-proposed"><b>' || tok2
  || '</b> &lt;i&gt;</span><div class="reasoning"> so &eacute;' || tok2 || ' </div>'
  || '<input data-comment-for="' || CAST(doc_id AS STRING) || '-' || CAST(pos AS STRING) || '"></div>' AS card
FROM (SELECT *, split_part(line, ' ', 1) AS tok1, split_part(line, ' ', 2) AS tok2,
        substr(line, length(split_part(line, ' ', 1)) + 1) AS rest FROM {lines}) t
"""
PARSED_COLUMNS = (
    "report_id", "issue_id", "finding_order", "checker", "confidence", "field", "node_type",
    "node_label", "node_link", "breadcrumb", "original", "proposed", "reasoning",
    "context_before", "context_after", "container_tag", "container_cell_has_prior_text",
)


def derived_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CARD_SQL, lines=bridge.lines(spark, sf_dir))


@query("parse_cards", sql("lines", """
SELECT source AS report_id, doc_id || '-' || pos AS issue_id,
  row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1 AS finding_order,
  CASE WHEN pos % 3 = 0 THEN 'check_math' ELSE 'check_spelling' END AS checker, 'low' AS confidence,
  lang AS field, 'Lesson' AS node_type, 'Part ' || pos AS node_label,
  'https://x.test/' || doc_id AS node_link, 'Unit ' || (pos % 9) || ' > ' || source AS breadcrumb,
  tok1 AS original, tok2 || ' <i>' AS proposed, 'so é' || tok2 AS reasoning,
  right(prev, 150) AS context_before, substr(rest, 1, 150) AS context_after,
  CASE WHEN tok1 = '' THEN NULL WHEN pos % 4 = 0 THEN 'th' WHEN pos % 4 = 1 THEN 'td'
    WHEN pos % 4 = 2 THEN 'p' END AS container_tag,
  tok1 <> '' AND pos % 4 = 1 AS container_cell_has_prior_text
FROM (SELECT *, split_part(line, ' ', 1) AS tok1, split_part(line, ' ', 2) AS tok2,
  substr(line, length(split_part(line, ' ', 1)) + 1) AS rest FROM lines)
"""))
def parse_cards(spark, sf_dir):
    return parse.findings_from_cards(derived_cards(spark, sf_dir)).select(*PARSED_COLUMNS)


@query("first_of_equal_ids", sql("lines", """
SELECT report_id, issue_id, finding_order FROM (
  SELECT source AS report_id, line AS issue_id,
    row_number() OVER (PARTITION BY source ORDER BY min(doc_id * 1000000000 + pos)) - 1 AS finding_order
  FROM lines WHERE line <> '' GROUP BY source, line)
"""))
def first_of_equal_ids(spark, sf_dir):
    from marginalia.operators.joins import first_per_key, with_position

    rows = bridge.lines(spark, sf_dir).filter("line <> ''").select(
        F.col("source").alias("report_id"), F.col("line").alias("issue_id"),
        F.col("doc_id").alias("chunk"), (F.col("doc_id") * 1000000000 + F.col("pos")).alias("at"),
    )
    first = first_per_key(rows, ["report_id", "issue_id"], [F.col("at")])
    return with_position(first, ["report_id"], "chunk", ["at"], "finding_order").select(
        "report_id", "issue_id", "finding_order"
    )


@query("reports_without_findings", sql(("reports", "classified"), """
SELECT report_id, report_name, 'no annotation issues were found' AS reason FROM reports
WHERE report_id NOT IN (SELECT report_id FROM classified WHERE checker = 'check_fr' AND status = 'approved')
"""))
def reports_without_findings(spark, sf_dir):
    found = bridge.classified(spark, sf_dir).filter("checker = 'check_fr' AND status = 'approved'")
    rows = parse.reports_without_findings(bridge.reports(spark, sf_dir), found)
    return rows.select("report_id", "report_name", "reason")


@query("classify_findings", sql("classified", f"SELECT {ID}, {', '.join(fixed.DETAIL_FIELDS[1:])} FROM classified"))
def classify_findings(spark, sf_dir):
    return cl.classify(bridge.raw_findings(spark, sf_dir), bridge.rulebook(spark, sf_dir))


@query("confidence_flags", sql("flags", "SELECT report_id, TRUE AS informative FROM flags"))
def confidence_flags(spark, sf_dir):
    return cl.confidence_flags(bridge.raw_findings(spark, sf_dir))


@query("exact_rule_hits", sql(("hits", "rules"), f"""
SELECT h.report_id, h.issue_id, h.rule_rank, u.status, u.comment FROM hits h
JOIN rules u ON u.rule_rank = h.rule_rank"""))
def exact_rule_hits(spark, sf_dir):
    book = bridge.rulebook(spark, sf_dir)
    rows = cl.with_exact_rule(bridge.raw_findings(spark, sf_dir), book.rules, cl.rule_sizes(book))
    return rows.filter("rule IS NOT NULL").select("report_id", "issue_id", "rule.*")


@query("reclassify_library", sql("classified", f"SELECT {ID}, status, comment, finding_order FROM classified"))
def reclassify_library(spark, sf_dir):
    raw = library.raw_records(bridge.stored(spark, sf_dir))
    # the bridge knows containers by report, its records all carry the field
    raw = raw.withColumn("container_known", F.length("report_id") == 4)
    again = cl.classify(raw, bridge.rulebook(spark, sf_dir), "finding_order")
    return again.select("report_id", "issue_id", "status", "comment", "finding_order")


# The same library after every seventh benchmark item has left the rulebook.
@query("reclassified_changes", sql("classified", f"SELECT {ID}, status, comment, finding_order FROM classified").replace(
    "FROM benchmark", "FROM (SELECT * FROM benchmark WHERE item_id % 7 <> 0)"))
def reclassified_changes(spark, sf_dir):
    old = bridge.rulebook(spark, sf_dir)
    new = bridge.rulebook(spark, sf_dir, F.col("item_id") % 7 != 0)
    raw = bridge.raw_findings(spark, sf_dir)
    index = bridge.kept(spark, sf_dir, "keys", lambda: changes.finding_keys(raw, changes.kinds_of(old)))
    flags = bridge.kept(spark, sf_dir, "flags", lambda: cl.confidence_flags(raw))
    # the bridge knows containers by report, its records all carry the field
    known = F.length("report_id") == 4
    findings = bridge.stored(spark, sf_dir)
    before = bridge.classified(spark, sf_dir)
    after, _ = flows.reclassify_changed(before, findings, flags, index, old, new, known)
    return after.select("report_id", "issue_id", "status", "comment", "finding_order")


@query("one_edit_pairs", sql("lines", """
SELECT doc_id, pos, a, b, damerau_levenshtein(lower(a), lower(b)) = 1 AS one_edit
FROM (SELECT doc_id, pos, split_part(line, ' ', 1) AS a, split_part(line, ' ', 2) AS b FROM lines)
"""))
def one_edit_pairs(spark, sf_dir):
    pairs = bridge.lines(spark, sf_dir).select(
        "doc_id", "pos", F.split_part("line", F.lit(" "), F.lit(1)).alias("a"),
        F.split_part("line", F.lit(" "), F.lit(2)).alias("b"),
    )
    return pairs.withColumn("one_edit", tx.is_one_edit(F.col("a"), F.col("b")))


@query("edit_distance_levels", None)
def edit_distance_levels(spark, sf_dir):
    pairs = bridge.lines(spark, sf_dir).select(
        F.split_part("line", F.lit(" "), F.lit(1)).alias("a"),
        F.split_part("line", F.lit(" "), F.lit(2)).alias("b"),
    )
    return pairs.withColumn("distance", tx.osa_distance("a", "b")).groupBy("distance").agg(
        F.count(F.lit(1)).alias("pairs")
    )


@query("normalized_texts", """
SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS normal
FROM documents""")
def normalized_texts(spark, sf_dir):
    docs = bridge.documents(spark, sf_dir)
    return docs.select("doc_id", tx.normalize_match_text(F.col("text")).alias("normal"))


@query("signatures", sql("signatures", f"""
SELECT {ID}, core_key, anchor_kind, anchor, fingerprint, checker_key, original_key, proposed_key FROM signatures"""))
def signatures(spark, sf_dir):
    return with_signature(bridge.spread(bridge.classified(spark, sf_dir), bridge.TASK_FINDINGS)).select(
        "report_id", "issue_id", "core_key", "anchor_kind", "anchor", "fingerprint",
        "checker_key", "original_key", "proposed_key",
    )


# ================================================================== review
@query("parse_decisions", sql("parsed", f"SELECT {ID}, decided AS status, note FROM parsed"))
def parse_decisions(spark, sf_dir):
    return bridge.reviews(spark, sf_dir).select(
        "report_id", "issue_id", parse_decision(F.col("decision"), F.col("review_note")).alias("p")
    ).select("report_id", "issue_id", "p.*")


@query("decision_cells", r"""
SELECT conv_id, turn, CASE WHEN v = '' THEN NULL WHEN lower(v) IN ('a', 'approve', 'approved') THEN 'approved'
    WHEN lower(v) IN ('r', 'reject', 'rejected') THEN 'rejected' ELSE 'needs_change' END AS status,
  CASE WHEN v = '' THEN NULL
    WHEN regexp_matches(v, '^needs[\s_-]*change\s*[-,:]\s*([^\n]*)$', 'i')
      THEN trim(regexp_extract(v, '^needs[\s_-]*change\s*[-,:]\s*([^\n]*)$', 1, 'i'))
    WHEN lower(v) IN ('a', 'r') THEN '' ELSE v END AS note
FROM (SELECT conv_id, turn, trim(CASE (conv_id + turn) % 5 WHEN 0 THEN 'a' WHEN 1 THEN ' R ' WHEN 2 THEN
  'Needs-Change: ' || text WHEN 3 THEN '' ELSE text END, ' ' || chr(10)) AS v FROM conversations)
""")
def decision_cells(spark, sf_dir):
    kind = (F.col("conv_id") + F.col("turn")) % 5
    cell = (
        F.when(kind == 0, "a").when(kind == 1, " R ")
        .when(kind == 2, F.concat(F.lit("Needs-Change: "), "text")).when(kind == 3, "").otherwise(F.col("text"))
    )
    talks = table(spark, sf_dir, "conversations")
    return talks.select("conv_id", "turn", parse_decision(cell, F.lit("")).alias("p")).select(
        "conv_id", "turn", "p.*"
    )


@query("status_counts", sql("classified", """
SELECT report_id, status, count(*) AS findings FROM classified GROUP BY 1, 2"""))
def status_counts(spark, sf_dir):
    return review.status_counts(bridge.classified(spark, sf_dir))


@query("checker_summary", sql("classified", """
SELECT checker, count(*) FILTER (WHERE status = 'approved') AS approved,
  count(*) FILTER (WHERE status = 'rejected') AS rejected,
  count(*) FILTER (WHERE status = 'needs_change') AS needs_change FROM classified GROUP BY 1"""))
def checker_summary(spark, sf_dir):
    return review.checker_summary(bridge.classified(spark, sf_dir))


@query("apply_reviews", sql("merged", f"SELECT {ID}, status, comment FROM merged"))
def apply_reviews(spark, sf_dir):
    return review.apply_reviews(
        bridge.classified(spark, sf_dir), bridge.reviews(spark, sf_dir)
    ).select("report_id", "issue_id", "status", "comment")


@query("review_progress", sql(("classified", "reviews"), """
SELECT c.report_id, count(*) FILTER (WHERE trim(coalesce(decision, '')) <> '') AS completed, count(*) AS flagged
FROM classified c LEFT JOIN reviews r ON r.report_id = c.report_id AND r.issue_id = c.issue_id
WHERE status = 'needs_change' GROUP BY 1"""))
def review_progress(spark, sf_dir):
    return review.review_progress(bridge.classified(spark, sf_dir), bridge.reviews(spark, sf_dir))


@query("headline_metrics", sql(("classified", "reviews"), """
SELECT c.report_id, count(*) AS findings, count(*) FILTER (WHERE status <> 'needs_change') AS automatic,
  count(*) FILTER (WHERE status = 'needs_change') AS flagged,
  count(*) FILTER (WHERE status = 'needs_change' AND trim(coalesce(decision, '')) = '') AS outstanding
FROM classified c LEFT JOIN reviews r ON r.report_id = c.report_id AND r.issue_id = c.issue_id GROUP BY 1"""))
def headline_metrics(spark, sf_dir):
    return review.headline(bridge.classified(spark, sf_dir), bridge.reviews(spark, sf_dir))


@query("automatic_split", sql("classified", """
SELECT report_id, count(*) FILTER (WHERE checker = 'check_math' AND status <> 'needs_change') AS math,
  count(*) FILTER (WHERE checker = 'check_spacing' AND status = 'rejected'
    AND contains(lower(comment), 'standards code')) AS standards,
  count(*) FILTER (WHERE checker = 'check_spacing' AND status <> 'needs_change')
  - count(*) FILTER (WHERE checker = 'check_spacing' AND status = 'rejected'
    AND contains(lower(comment), 'standards code')) AS spacing
FROM classified GROUP BY 1"""))
def automatic_split(spark, sf_dir):
    return review.automatic_split(bridge.classified(spark, sf_dir))


@query("review_sheet", sql(("classified", "reviews"), f"""
SELECT c.report_id, coalesce(decision, '') AS decision, coalesce(review_note, '') AS review_note,
  {', '.join('c.' + n for n in fixed.DETAIL_FIELDS)}
FROM classified c LEFT JOIN reviews r ON r.report_id = c.report_id AND r.issue_id = c.issue_id
WHERE status = 'needs_change'"""))
def review_sheet(spark, sf_dir):
    return review.review_sheet(bridge.classified(spark, sf_dir), bridge.reviews(spark, sf_dir))


FRAME_SQL = sql(("classified", "reviews", "exact"), f"""
SELECT c.report_id, coalesce(CASE WHEN trim(coalesce(r.decision, '')) = '' AND e.decision IS NOT NULL
    THEN e.decision ELSE r.decision END, '') AS decision,
  coalesce(CASE WHEN trim(coalesce(r.decision, '')) = '' AND e.decision IS NOT NULL
    THEN e.review_note ELSE r.review_note END, '') AS review_note,
  checker, field, original, proposed,
  trim(context_before || '  ‹CHANGE›  ' || context_after, ' ' || chr(10)) AS context,
  CASE WHEN breadcrumb <> '' THEN breadcrumb ELSE node_label END AS location,
  CASE WHEN trim(coalesce(r.decision, '')) = '' THEN coalesce(e.memory_source, '') ELSE '' END AS reused_from,
  CASE WHEN trim(coalesce(r.decision, '')) = '' AND e.decision IS NOT NULL THEN 'Exact 100%' ELSE '' END AS match_quality,
  node_link, c.issue_id
FROM classified c LEFT JOIN reviews r ON r.report_id = c.report_id AND r.issue_id = c.issue_id
LEFT JOIN exact e ON e.report_id = r.report_id AND e.issue_id = r.issue_id
WHERE status = 'needs_change'""")


@query("review_frame", FRAME_SQL)
def review_frame(spark, sf_dir):
    findings = bridge.classified(spark, sf_dir)
    matched = memory.match_exact(bridge.open_findings(spark, sf_dir), bridge.observations(spark, sf_dir))
    filled = review.prefill(bridge.reviews(spark, sf_dir), matched)
    return review.review_frame(findings, filled)


@query("review_search", sql(("classified",), """
SELECT report_id, issue_id, original, proposed, location FROM (
  SELECT *, CASE WHEN breadcrumb <> '' THEN breadcrumb ELSE node_label END AS location FROM classified)
WHERE status = 'needs_change' AND checker IN ('check_spelling', 'check_spacing', 'check_fr')
  AND contains(lower(original || ' ' || proposed || ' ' || location), 'unit 4')"""))
def review_search(spark, sf_dir):
    frame = review.review_frame(bridge.classified(spark, sf_dir), bridge.reviews(spark, sf_dir))
    found = review.search(frame, " Unit 4 ", ["check_spelling", "check_spacing", "check_fr"])
    return found.select("report_id", "issue_id", "original", "proposed", "location")



@query("session_reviews", sql(("classified", "parsed"), f"""
SELECT c.report_id, c.issue_id,
  CASE WHEN p.decided = 'approved' THEN 'approved' WHEN p.decided IS NOT NULL THEN p.decided ELSE '' END AS decision,
  CASE WHEN p.decided IS NOT NULL THEN p.note ELSE '' END AS review_note,
  coalesce(p.decided, 'approved') <> 'approved' AS draft_saved
FROM classified c LEFT JOIN parsed p ON p.report_id = c.report_id AND p.issue_id = c.issue_id
WHERE c.status = 'needs_change'"""))
def session_reviews(spark, sf_dir):
    saved, _ = library.draft_rows(bridge.reviews(spark, sf_dir), F.lit(bridge.AS_OF))
    open_now = saved.filter("decision = 'approved'").withColumnRenamed("note", "review_note")
    return review.session_reviews(
        bridge.classified(spark, sf_dir), open_now, saved.filter("decision <> 'approved'")
    )


@query("import_sheet", sql(("classified", "parsed"), f"""
SELECT p.report_id, p.issue_id, p.decided AS decision, p.note AS review_note, CAST(1 AS BIGINT) AS lines
FROM parsed p JOIN classified c ON c.report_id = p.report_id AND c.issue_id = p.issue_id
WHERE c.status = 'needs_change' AND p.decided IS NOT NULL"""))
def import_sheet(spark, sf_dir):
    sheet = bridge.reviews(spark, sf_dir).withColumn("line", F.lit(0))
    return review.import_sheet(sheet, bridge.classified(spark, sf_dir), "decision")[0]


@query("import_sheet_unmatched", sql(("classified", "parsed"), f"""
SELECT p.report_id, p.issue_id FROM parsed p JOIN classified c
ON c.report_id = p.report_id AND c.issue_id = p.issue_id WHERE c.status <> 'needs_change'"""))
def import_sheet_unmatched(spark, sf_dir):
    sheet = bridge.reviews(spark, sf_dir).withColumn("line", F.lit(0))
    unmatched = review.import_sheet(sheet, bridge.classified(spark, sf_dir), "decision")[1]
    return unmatched.select("report_id", "issue_id")


@query("changed_decisions", sql(("reviews", "parsed"), f"""
SELECT report_id, issue_id, coalesce(decided, '') AS decision,
  '{{"review_note":"' || coalesce(note, '') || '"}}' AS detail_json
FROM parsed WHERE NOT (coalesce(decided, '') = 'approved' AND note = 'Looks correct.')
  AND NOT (decided IS NULL)"""))
def changed_decisions(spark, sf_dir):
    after = bridge.reviews(spark, sf_dir)
    before = after.filter("review_note = 'Looks correct.' AND decision = 'approved'")
    return review.changed_decisions(before, after)


# The id of an event is a hash of its fields, so the twin can make it too.
EVENT_SQL = """
, changed AS (SELECT report_id, issue_id, coalesce(decided, '') AS decision,
  '{"review_note":"' || coalesce(note, '') || '"}' AS detail_json
  FROM parsed WHERE NOT (coalesce(decided, '') = 'approved' AND note = 'Looks correct.') AND decided IS NOT NULL)
SELECT md5(concat_ws(chr(31), report_id, issue_id, 'save_decisions', decision, 'me@x.test', detail_json,
    '2024-05-01T00:00:00+00:00')) AS event_id, report_id, issue_id, 'save_decisions' AS action, decision,
  'me@x.test' AS reviewer_email, 'Me' AS reviewer_name, detail_json, '2024-05-01T00:00:00+00:00' AS occurred_at
FROM changed
"""


@query("recorded_events", sql(("reviews", "parsed"), EVENT_SQL))
def recorded_events(spark, sf_dir):
    after = bridge.reviews(spark, sf_dir)
    before = after.filter("review_note = 'Looks correct.' AND decision = 'approved'")
    changes = review.changed_decisions(before, after)
    return library.event_rows(changes, "save_decisions", " Me@X.test", "Me", F.lit(bridge.AS_OF))


@query("draft_counts", sql(("reviews", "parsed"), """
SELECT report_id, count(*) FILTER (WHERE decided IS NOT NULL) AS saved, count(*) FILTER (WHERE decided IS NULL) AS cleared
FROM parsed GROUP BY 1"""))
def draft_counts(spark, sf_dir):
    return library.draft_counts(*library.draft_rows(bridge.reviews(spark, sf_dir), F.lit(bridge.AS_OF)))


@query("stored_counts", sql(("signatures",), """
SELECT report_id, count(*) AS stored, count(*) FILTER (WHERE fingerprint <> '') AS matchable
FROM signatures GROUP BY 1"""))
def stored_counts(spark, sf_dir):
    return library.stored_counts(bridge.stored(spark, sf_dir))


@query("reuse_counts", sql(("reviews", "exact"), """
SELECT r.report_id, count(*) FILTER (WHERE trim(r.decision) = '' AND e.decision IS NOT NULL) AS reused,
  count(*) FILTER (WHERE trim(r.decision) = '' AND e.decision IS NOT NULL) AS exact, CAST(0 AS BIGINT) AS near
FROM reviews r LEFT JOIN exact e ON e.report_id = r.report_id AND e.issue_id = r.issue_id GROUP BY 1"""))
def reuse_counts(spark, sf_dir):
    matched = memory.match_exact(bridge.open_findings(spark, sf_dir), bridge.observations(spark, sf_dir))
    return review.reuse_counts(review.prefill(bridge.reviews(spark, sf_dir), matched))


# The comment policy in the oracle's dialect (ASCII-only \b replaced by letter classes).
def _words(phrases) -> str:
    return START + "(?:" + "|".join(phrases) + ")" + END


def clause_sql(c: str, o: str, p: str) -> str:
    def named(v: str) -> str:
        return f"(length(trim({v})) >= 2 AND contains(replace(lower({c}), 'ß', 'ss'), replace(lower(trim({v})), 'ß', 'ss')))"

    mention = f"({named(o)} OR {named(p)})"
    vague = r"^\s*(?:" + "|".join(fixed.VAGUE_PHRASES) + r")[\s.!]*$"
    direct = START + r"(?:replace|change|correct|fix|remove|add|insert|delete|should be)" + END
    return (
        f"({c} <> '' AND NOT {matches(c, vague, 'i')} AND NOT {matches(c, _words(fixed.OPERATIONAL_PHRASES), 'i')}"
        f" AND ({matches(c, _words(fixed.CONCRETE_PHRASES), 'i')} OR {matches(c, direct, 'i')}"
        f" OR ({matches(c, START + '(?:use|keep|retain)' + END, 'i')} AND ({mention}"
        f" OR {matches(c, fixed.QUOTED_TEXT)}))"
        f" OR ({mention} AND {matches(c, START + '(?:valid|correct|incorrect|wrong|preferred)' + END, 'i')})))"
    )


def policy_sql(comment: str, checker: str, o: str, p: str) -> str:
    text = rf"trim(regexp_replace(trim(regexp_replace({comment}, '\s+', ' ', 'g')), {quote(fixed.REVIEW_PREFIX)}, '', 'i'))"
    clauses = f"list_transform(string_split_regex({text}, {quote(fixed.CLAUSE_BREAK)}), lambda x: trim(x, ' ,;'))"
    useful = f"list_filter({clauses}, lambda x: {clause_sql('x', o, p)})"
    vague = r"^\s*(?:" + "|".join(fixed.VAGUE_PHRASES) + r")[\s.!]*$"
    return (
        f"CASE WHEN {text} = '' OR {checker} = 'check_links' OR {matches(text, vague, 'i')} THEN '' "
        f"WHEN len({useful}) = len({clauses}) THEN {text} "
        f"ELSE coalesce(array_to_string({useful}, '; '), '') END"
    )


NOTES_SQL = """
SELECT conv_id, turn, 'check_' || role AS checker, split_part(text, ' ', 1) AS original,
  split_part(text, ' ', 2) AS proposed,
  CASE (conv_id + turn) % 8 WHEN 0 THEN 'Human review confirmed that this is a valid term. ' || text
    WHEN 1 THEN 'Keep ' || split_part(text, ' ', 1) || '; ' || text
    WHEN 2 THEN text || ' -- replace it. No confidence.'
    WHEN 3 THEN 'Looks correct.' WHEN 4 THEN 'Use "' || split_part(text, ' ', 2) || '" here. ' || text
    WHEN 5 THEN 'reviewer: ' || split_part(text, ' ', 1) || ' is wrong; check the ' || text
    WHEN 6 THEN 'False positive; spacing error' ELSE text END AS comment
FROM {conversations}
"""


@query("training_comments", f"""
SELECT conv_id, turn, {policy_sql("comment", "checker", "original", "proposed")} AS comment
FROM ({NOTES_SQL.format(conversations="conversations")})""")
def training_comments(spark, sf_dir):
    notes = spark.sql(NOTES_SQL, conversations=table(spark, sf_dir, "conversations"))
    return finalize_training_comments(notes).select("conv_id", "turn", "comment")


@query("final_rows", sql("merged", f"""
SELECT {ID}, status, {policy_sql("comment", "checker", "original", "proposed")} AS comment FROM merged"""))
def final_rows(spark, sf_dir):
    from marginalia.sinks.exports import final_rows as rows

    merged = review.apply_reviews(bridge.classified(spark, sf_dir), bridge.reviews(spark, sf_dir))
    return rows(merged).drop("finding_order")


@query("final_csv", sql("merged", f"""
SELECT {ID}, status, {policy_sql("comment", "checker", "original", "proposed")} AS comment FROM merged"""))
def final_csv(spark, sf_dir):
    """The final rows written as CSV files, one folder per report, and read back."""
    from marginalia.sinks import exports

    merged = review.apply_reviews(bridge.classified(spark, sf_dir), bridge.reviews(spark, sf_dir))
    path = durable.fresh_path(spark, "final-csv")
    exports.write_csv(exports.final_rows(merged), path)
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    return back.select("report_id", *[tx.present(F.col(c)).alias(c) for c in fixed.FINAL_FIELDS])


@query("rulebook_file", """
SELECT 'rule' AS part, field, split_part(text, ' ', 3) AS entry, status, 'rule ' || item_id AS comment FROM (
  SELECT *, CASE WHEN item_id % 2 = 0 THEN '*' ELSE 'body_value' END AS field,
    CASE item_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'needs_change' END AS status FROM benchmark)
UNION ALL SELECT DISTINCT 'term', '', lower(trim(split_part(text, ' ', 1))), '', '' FROM benchmark
UNION ALL SELECT DISTINCT 'target', '', lower(trim(split_part(text, ' ', 2))), '', '' FROM benchmark""")
def rulebook_file(spark, sf_dir):
    """The rulebook written as the JSON document and read back."""
    from marginalia.sinks import exports

    path = durable.fresh_path(spark, "rulebook")
    exports.write_rulebook(bridge.rulebook(spark, sf_dir), path)
    book, blank = rb.load(spark, path), F.lit("")
    words = lambda rows, part: rows.select(
        F.lit(part).alias("part"), blank.alias("field"), F.col("term").alias("entry"), blank.alias("status"), blank.alias("comment")
    )
    rules = book.rules.select(F.lit("rule").alias("part"), "field", F.col("original").alias("entry"), "status", "comment")
    return rules.unionByName(words(book.terms, "term")).unionByName(words(book.targets, "target"))


@query("exported_memory", sql(("observations", "signatures", "parsed"), """
SELECT 'observations' AS collection, observation_id AS id, status AS detail FROM observations
UNION ALL SELECT 'report_findings', sha256(report_id || chr(31) || issue_id), fingerprint FROM signatures
UNION ALL SELECT 'draft_reviews', report_id || '/' || issue_id, decided FROM parsed WHERE decided IS NOT NULL"""))
def exported_memory(spark, sf_dir):
    """The library's collections written as a portable export and read back."""
    from marginalia.sources import portable

    drafts, _ = library.draft_rows(bridge.reviews(spark, sf_dir), F.lit(bridge.AS_OF))
    tables = {
        "observations": bridge.observations(spark, sf_dir), "report_findings": bridge.stored_once(spark, sf_dir),
        "reports": bridge.stored_reports(spark, sf_dir, bridge.classified_once(spark, sf_dir)), "draft_reviews": drafts,
        "review_events": recorded_events(spark, sf_dir),
        "ticket_links": spark.createDataFrame([], ", ".join(f"{n} string" for n in library.LINK_FIELDS)),
    }
    path = durable.fresh_path(spark, "export")
    with bridge.reading_in_tasks(bridge.raw_findings(spark, sf_dir), bridge.TASK_FINDINGS):
        portable.write_export(tables, path, bridge.AS_OF)
    back = portable.read_export(spark, path)
    part = lambda name, key, detail: back[name].select(
        F.lit(name).alias("collection"), key.alias("id"), F.col(detail).alias("detail")
    )
    return part("observations", F.col("observation_id"), "status").unionByName(
        part("report_findings", F.col("finding_id"), "fingerprint")
    ).unionByName(part("draft_reviews", F.concat_ws("/", "report_id", "issue_id"), "decision"))


@query("comment_counts", sql(("merged", "parsed"), f"""
SELECT m.report_id, m.kept, m.raw - m.kept AS suppressed, coalesce(c.n, 0) AS confirmed_changes FROM (
  SELECT report_id, count(*) FILTER (WHERE {policy_sql("comment", "checker", "original", "proposed")} <> '') AS kept,
    count(*) FILTER (WHERE trim(comment) <> '') AS raw FROM merged GROUP BY 1) m
LEFT JOIN (SELECT report_id, count(*) AS n FROM parsed WHERE decided = 'needs_change' GROUP BY 1) c
ON c.report_id = m.report_id"""))
def comment_counts(spark, sf_dir):
    reviews = bridge.reviews(spark, sf_dir)
    saved, _ = library.draft_rows(reviews, F.lit(bridge.AS_OF))
    merged = review.apply_reviews(bridge.classified(spark, sf_dir), reviews)
    return review.comment_counts(merged, saved)


@query("handoff_summary", sql("merged", """
SELECT report_id, 'All ' || format('{:,}', count(*)) || ' findings are included: '
  || format('{:,}', count(*) FILTER (WHERE status = 'approved')) || ' approved, '
  || format('{:,}', count(*) FILTER (WHERE status = 'rejected')) || ' rejected, and '
  || format('{:,}', count(*) FILTER (WHERE status = 'needs_change')) || ' needs change.' AS summary
FROM merged GROUP BY 1"""))
def handoff_summary(spark, sf_dir):
    return review.handoff_summary(
        review.apply_reviews(bridge.classified(spark, sf_dir), bridge.reviews(spark, sf_dir))
    )


# ================================================================== memory
@query("published_observations", sql("observations", "SELECT * FROM observations"))
def published_observations(spark, sf_dir):
    return bridge.publish(spark, sf_dir)


@query("publish_counts", sql("reviewed", """
SELECT report_id, count(*) FILTER (WHERE decided IS NOT NULL AND fingerprint <> '') AS published,
  count(*) FILTER (WHERE decided IS NULL) AS skipped_blank,
  count(*) FILTER (WHERE decided IS NOT NULL AND fingerprint = '') AS skipped_unmatchable
FROM reviewed GROUP BY 1"""))
def publish_counts(spark, sf_dir):
    return memory.publish_counts(bridge.classified(spark, sf_dir), bridge.reviews(spark, sf_dir))


@query("consensus_by_fingerprint", sql("agreed", "SELECT * FROM agreed"))
def consensus_by_fingerprint(spark, sf_dir):
    return memory.consensus(bridge.observations(spark, sf_dir), ["fingerprint"])


@query("exact_matches", sql("exact", "SELECT * FROM exact"))
def exact_matches(spark, sf_dir):
    return memory.match_exact(bridge.open_findings(spark, sf_dir), bridge.observations(spark, sf_dir))


@query("memory_matches", None)
def memory_matches(spark, sf_dir):
    with bridge.reading_in_tasks(bridge.raw_findings(spark, sf_dir), bridge.TASK_FINDINGS):
        opened = bridge.as_open(bridge.stored_once(spark, sf_dir))
        return memory.match(opened, bridge.observations(spark, sf_dir), computed=True)


# Known anchors are a line, and the line with a foreign character behind it; the open
# finding's has other foreign characters.  Then nothing but the line itself can match, and
# the similarity is known without a matcher: 2n / (2n + characters behind both).
NEAR_SQL = """
, l AS (SELECT DISTINCT line, length(line) AS n FROM lines
  WHERE length(line) BETWEEN 60 AND 180 AND strpos(line, '¤') = 0 AND strpos(line, '§') = 0),
s AS (SELECT md5(line) AS issue_id, CAST(2 * n AS DOUBLE) / (2 * n + 1 + n % 3) AS one,
    CAST(2 * n AS DOUBLE) / (2 * n + 2 + n % 3) AS two, n FROM l),
t AS (SELECT *, two >= 97e-2 AND two >= one - 5e-3 AS both_near, CASE n % 2 WHEN 0 THEN 'approved' ELSE 'rejected' END AS first,
    CASE WHEN (n % 2 = 0) = (n % 5 <> 0) THEN 'approved' ELSE 'rejected' END AS second FROM s WHERE one >= 97e-2)
SELECT 'r' AS report_id, issue_id, first AS decision, '' AS review_note,
  CASE WHEN both_near THEN 's1, s2' ELSE 's1' END AS memory_source,
  CASE WHEN both_near THEN 2 ELSE 1 END AS memory_evidence, 'near' AS memory_match, round(one, 4) AS memory_score
FROM t WHERE NOT both_near OR first = second
"""


@query("near_matches", sql(("lines",), NEAR_SQL))
def near_matches(spark, sf_dir):
    n = F.length("line")
    lines = durable.stored(bridge.lines(spark, sf_dir).filter(
        n.between(60, 180) & ~F.contains("line", F.lit("¤")) & ~F.contains("line", F.lit("§"))
    ).select("line").distinct(), "near-lines").select("line", n.alias("n"), F.md5("line").alias("core_key"))
    even, same = F.col("n") % 2 == 0, F.col("n") % 5 != 0

    def observed(source: str, anchor, approves):
        blank = F.lit("")
        return lines.select(
            F.md5(anchor).alias("fingerprint"), "core_key", F.lit("context").alias("anchor_kind"), anchor.alias("anchor"),
            blank.alias("checker"), blank.alias("original"), blank.alias("proposed"), blank.alias("note"),
            F.when(approves, "approved").otherwise("rejected").alias("status"), F.lit(source).alias("source_report"),
        )

    known = observed("s1", F.col("line"), even).unionByName(
        observed("s2", F.concat("line", F.lit("§")), even.eqNullSafe(same))
    )
    tail = F.expr("repeat('¤', cast(1 + n % 3 AS int))")
    findings = lines.select(
        F.lit("r").alias("report_id"), F.col("core_key").alias("issue_id"), F.lit("needs_change").alias("status"),
        F.md5(F.concat("line", tail)).alias("fingerprint"), "core_key", F.lit("context").alias("anchor_kind"),
        F.concat("line", tail).alias("anchor"),
    )
    return memory.match(findings, known)


@query("relevant_observations", sql(("observations", "signatures"), """
SELECT observation_id, core_key, status FROM observations
WHERE core_key IN (SELECT core_key FROM signatures WHERE status = 'needs_change' AND fingerprint <> '')"""))
def relevant_observations(spark, sf_dir):
    rows = memory.open_findings(bridge.open_findings(spark, sf_dir))
    return memory.relevant_observations(rows, bridge.observations(spark, sf_dir)).select(
        "observation_id", "core_key", "status"
    )


@query("prefilled_reviews", sql(("reviews", "exact"), """
SELECT r.report_id, r.issue_id,
  CASE WHEN trim(r.decision) = '' AND e.decision IS NOT NULL THEN e.decision ELSE r.decision END AS decision,
  CASE WHEN trim(r.decision) = '' AND e.decision IS NOT NULL THEN e.review_note ELSE r.review_note END AS review_note,
  CASE WHEN trim(r.decision) = '' THEN e.memory_source END AS memory_source,
  CASE WHEN trim(r.decision) = '' THEN e.memory_evidence END AS memory_evidence,
  CASE WHEN trim(r.decision) = '' THEN e.memory_match END AS memory_match,
  CASE WHEN trim(r.decision) = '' THEN e.memory_score END AS memory_score
FROM reviews r LEFT JOIN exact e ON e.report_id = r.report_id AND e.issue_id = r.issue_id"""))
def prefilled_reviews(spark, sf_dir):
    matched = memory.match_exact(bridge.open_findings(spark, sf_dir), bridge.observations(spark, sf_dir))
    return review.prefill(bridge.reviews(spark, sf_dir), matched)


@query("closed_by_memory", sql(("signatures", "parsed", "exact"), """
SELECT s.checker, count(*) FILTER (WHERE e.decision = 'approved') AS approved,
  count(*) FILTER (WHERE e.decision = 'rejected') AS rejected,
  count(*) FILTER (WHERE e.decision = 'needs_change') AS needs_change,
  count(*) FILTER (WHERE e.decision IS NULL) AS open
FROM signatures s LEFT JOIN parsed p ON p.report_id = s.report_id AND p.issue_id = s.issue_id
LEFT JOIN exact e ON e.report_id = s.report_id AND e.issue_id = s.issue_id
WHERE s.status = 'needs_change' AND p.decided IS NULL GROUP BY 1"""))
def closed_by_memory(spark, sf_dir):
    """Which open findings earlier decisions close, per checker."""
    findings = bridge.classified(spark, sf_dir)
    drafts, _ = library.draft_rows(bridge.reviews(spark, sf_dir), F.lit(bridge.AS_OF))
    undecided = review.flagged(findings).join(drafts.select(*review.KEY), review.KEY, "left_anti")
    matched = memory.match_exact(bridge.open_findings(spark, sf_dir), bridge.observations(spark, sf_dir))
    rows = undecided.select(*review.KEY, "checker").join(
        matched.select(*review.KEY, "decision"), review.KEY, "left"
    )
    return rows.groupBy("checker").agg(
        *[F.count_if(F.col("decision") == s).alias(s) for s in fixed.STATUSES],
        F.count_if(F.col("decision").isNull()).alias("open"),
    )


@query("memory_stats", sql("observations", """
SELECT (SELECT count(*) FROM observations) AS observations,
  (SELECT count(DISTINCT fingerprint) FROM observations) AS findings,
  (SELECT count(DISTINCT source_report_id) FROM observations) AS reports,
  (SELECT count(*) FROM (SELECT fingerprint FROM observations GROUP BY 1
    HAVING count(DISTINCT status) > 1)) AS conflicts"""))
def memory_stats(spark, sf_dir):
    return memory.memory_stats(bridge.observations(spark, sf_dir))


# ================================================================= library
@query("stored_findings", sql("signatures", f"""
SELECT sha256(report_id || chr(31) || issue_id) AS finding_id, report_id, finding_order, issue_id, fingerprint,
  core_key, anchor_kind, anchor, checker_key AS checker, field_key AS field_name, original, proposed,
  status AS initial_status, comment AS initial_comment FROM signatures"""))
def stored_findings(spark, sf_dir):
    return bridge.snapshot(spark, sf_dir).drop("record_json")


@query("stored_reports", sql("stored_reports", "SELECT * FROM stored_reports"))
def stored_reports(spark, sf_dir):
    return bridge.stored_reports(spark, sf_dir)


@query("snapshot_records", sql("classified", """
SELECT report_id, finding_order, issue_id, original, nullif(confidence, '') AS confidence FROM classified
WHERE report_id = (SELECT max(report_id) FROM classified)"""))
def snapshot_records(spark, sf_dir):
    stored = bridge.stored(spark, sf_dir)
    last = bridge.raw_findings(spark, sf_dir).agg(F.max("report_id")).first()[0]
    return library.load_snapshot(stored, last).select(
        "report_id", "finding_order", "issue_id", "original", "confidence"
    )


@query("library_list", sql(("stored_reports", "parsed", "observations"), """
SELECT s.*, coalesce(d.n, 0) AS draft_reviews, coalesce(o.n, 0) AS published_reviews FROM stored_reports s
LEFT JOIN (SELECT report_id, count(*) AS n FROM parsed WHERE decided IS NOT NULL GROUP BY 1) d
  ON d.report_id = s.report_id
LEFT JOIN (SELECT source_report_id, count(*) AS n FROM observations GROUP BY 1) o
  ON o.source_report_id = s.report_id"""))
def library_list(spark, sf_dir):
    drafts, _ = library.draft_rows(bridge.reviews(spark, sf_dir), F.lit(bridge.AS_OF))
    return library.library_list(
        bridge.stored_reports(spark, sf_dir), drafts, bridge.observations(spark, sf_dir)
    )


@query("library_stats", sql(("signatures", "parsed", "reports"), """
SELECT (SELECT count(*) FROM reports) AS reports, (SELECT count(*) FROM signatures) AS findings,
  (SELECT count(*) FROM (SELECT fingerprint FROM signatures WHERE fingerprint <> '' GROUP BY 1
    HAVING count(DISTINCT report_id) > 1)) AS recurring_findings,
  (SELECT count(*) FROM parsed WHERE decided IS NOT NULL) AS draft_reviews"""))
def library_stats(spark, sf_dir):
    drafts, _ = library.draft_rows(bridge.reviews(spark, sf_dir), F.lit(bridge.AS_OF))
    return library.library_stats(bridge.reports(spark, sf_dir), bridge.stored(spark, sf_dir), drafts)


@query("current_counts", sql("signatures", """
SELECT report_id, count(DISTINCT nullif(fingerprint, '')) AS fingerprints, count(DISTINCT core_key) AS core_keys
FROM signatures GROUP BY 1"""))
def current_counts(spark, sf_dir):
    return library.current_counts(bridge.stored(spark, sf_dir))


@query("report_similarity", sql(("signatures", "stored_reports"), """
SELECT r.report_id, r.report_name AS report, r.filename, coalesce(e.n, 0) AS exact_findings,
  coalesce(e.n, 0) / (SELECT count(DISTINCT fingerprint) FROM signatures WHERE fingerprint <> ''
    AND report_id = (SELECT min(report_id) FROM signatures)) AS exact_overlap,
  coalesce(c.n, 0) AS shared_correction_pairs,
  coalesce(c.n, 0) / (SELECT count(DISTINCT core_key) FROM signatures
    WHERE report_id = (SELECT min(report_id) FROM signatures)) AS correction_pair_overlap,
  r.finding_count AS findings, r.last_uploaded_at AS last_uploaded
FROM stored_reports r
LEFT JOIN (SELECT report_id, count(DISTINCT fingerprint) AS n FROM signatures WHERE fingerprint IN (
  SELECT fingerprint FROM signatures WHERE fingerprint <> ''
  AND report_id = (SELECT min(report_id) FROM signatures)) GROUP BY 1) e ON e.report_id = r.report_id
LEFT JOIN (SELECT report_id, count(DISTINCT core_key) AS n FROM signatures WHERE core_key IN (
  SELECT core_key FROM signatures WHERE report_id = (SELECT min(report_id) FROM signatures))
  GROUP BY 1) c ON c.report_id = r.report_id
WHERE r.report_id <> (SELECT min(report_id) FROM signatures) AND coalesce(e.n, 0) + coalesce(c.n, 0) > 0
ORDER BY exact_overlap DESC, exact_findings DESC, shared_correction_pairs DESC, report, r.report_id LIMIT 12"""))
def report_similarity(spark, sf_dir):
    current = bridge.reports(spark, sf_dir).agg(F.min("report_id").alias("report_id"))
    return library.similarity(
        bridge.stored(spark, sf_dir), bridge.stored_reports(spark, sf_dir), current, limit=12
    )


@query("similar_reports", sql(("signatures", "stored_reports"), """
, prints AS (SELECT DISTINCT report_id, fingerprint FROM signatures WHERE fingerprint <> ''),
cores AS (SELECT DISTINCT report_id, core_key FROM signatures),
e AS (SELECT a.report_id AS cur, b.report_id AS other, count(*) AS n FROM prints a JOIN prints b
  ON a.fingerprint = b.fingerprint AND a.report_id <> b.report_id GROUP BY 1, 2),
c AS (SELECT a.report_id AS cur, b.report_id AS other, count(*) AS n FROM cores a JOIN cores b
  ON a.core_key = b.core_key AND a.report_id <> b.report_id GROUP BY 1, 2),
ranked AS (
  SELECT coalesce(e.cur, c.cur) AS current_report_id, r.report_id, r.report_name AS report, r.filename,
    coalesce(e.n, 0) AS exact_findings, coalesce(c.n, 0) AS shared_correction_pairs,
    r.finding_count AS findings, r.last_uploaded_at AS last_uploaded,
    row_number() OVER (PARTITION BY coalesce(e.cur, c.cur)
      ORDER BY coalesce(e.n, 0) DESC, coalesce(c.n, 0) DESC, r.report_name, r.report_id) AS rank
  FROM e FULL JOIN c ON c.cur = e.cur AND c.other = e.other
  JOIN stored_reports r ON r.report_id = coalesce(e.other, c.other))
SELECT k.*, coalesce(exact_findings / nullif((SELECT count(*) FROM prints p WHERE p.report_id = k.current_report_id), 0), 0) AS exact_overlap,
  shared_correction_pairs / (SELECT count(*) FROM cores p WHERE p.report_id = k.current_report_id) AS correction_pair_overlap
FROM ranked k WHERE rank <= 5"""))
def similar_reports(spark, sf_dir):
    return library.similar_reports(bridge.stored(spark, sf_dir), bridge.stored_reports(spark, sf_dir), limit=5)


@query("findings_with_names", sql(("signatures", "reports"), f"""
SELECT s.report_id, issue_id, core_key, report_name FROM signatures s JOIN reports r ON r.report_id = s.report_id"""))
def findings_with_names(spark, sf_dir):
    rows = library.findings_with_names(bridge.stored(spark, sf_dir), bridge.reports(spark, sf_dir))
    return rows.select("report_id", "issue_id", "core_key", "report_name")


# ================================================================ learning
EVIDENCE_SQL = sql(("signatures", "reports", "observations"), """
, agreed_core AS (
  SELECT core_key, min(status) AS status,
    CASE WHEN count(DISTINCT nullif(note, '')) = 1 THEN max(nullif(note, '')) ELSE '' END AS comment,
    count(*) AS human_decisions, count(DISTINCT source_report_id) AS human_reports,
    string_agg(DISTINCT source_report, ', ' ORDER BY source_report) AS reviewed_sources
  FROM observations GROUP BY 1 HAVING count(DISTINCT status) = 1
    AND (min(status) <> 'needs_change' OR count(DISTINCT nullif(note, '')) = 1)),
seen AS (
  SELECT s.core_key, count(*) AS occurrences, arg_min(s.checker_key, s.report_id || lpad(CAST(finding_order AS VARCHAR), 20, '0')) AS checker,
    arg_min(s.field_key, s.report_id || lpad(CAST(finding_order AS VARCHAR), 20, '0')) AS field,
    arg_min(s.original, s.report_id || lpad(CAST(finding_order AS VARCHAR), 20, '0')) AS original,
    arg_min(s.proposed, s.report_id || lpad(CAST(finding_order AS VARCHAR), 20, '0')) AS proposed,
    string_agg(DISTINCT r.report_name, ', ' ORDER BY r.report_name) AS seen_in_reports
  FROM signatures s JOIN reports r ON r.report_id = s.report_id GROUP BY 1),
places AS (
  SELECT core_key, count(*) AS course_coverage FROM (
    SELECT core_key, report_id FROM signatures UNION SELECT core_key, source_report_id FROM observations) GROUP BY 1),
evidence AS (
  SELECT a.core_key, s.checker, s.field, s.original, s.proposed, a.status, a.comment, human_decisions,
    human_reports, occurrences, course_coverage, reviewed_sources, seen_in_reports
  FROM agreed_core a JOIN seen s ON s.core_key = a.core_key JOIN places p ON p.core_key = a.core_key)
""").replace("\n, agreed_core", ",\nagreed_core")


def evidence(spark, sf_dir):
    return learning.evidence(
        bridge.observations(spark, sf_dir), bridge.stored(spark, sf_dir), bridge.reports(spark, sf_dir)
    )


query("pattern_evidence", EVIDENCE_SQL + "SELECT * FROM evidence")(evidence)


# The library before: the last report held what is now in the first one, which had not come
# yet and was not reviewed.  Then both are uploaded as they are.
@query("evidence_after_uploads", EVIDENCE_SQL + "SELECT * FROM evidence")
def evidence_after_uploads(spark, sf_dir):
    findings, names = bridge.stored(spark, sf_dir), bridge.reports(spark, sf_dir)
    observations = bridge.observations(spark, sf_dir)
    ends = names.agg(F.min("report_id").alias("first"), F.max("report_id").alias("last")).first()
    late, again = F.col("report_id") == ends["first"], F.col("report_id") == ends["last"]
    earlier = findings.filter(~late & ~again).unionByName(
        findings.filter(late).withColumn("report_id", F.lit(ends["last"]))
    )
    new = F.col("source_report_id") == ends["first"]
    summary = bridge.kept(spark, sf_dir, "places", lambda: learning.places(earlier, names))
    before = bridge.kept(
        spark, sf_dir, "evidence-before", lambda: learning.evidence_at(observations.filter(~new), summary)
    )
    uploaded = names.filter(late | again)
    after, signed = deltas.replace_reports(
        summary, learning.places(findings.filter(late | again), names), uploaded
    )
    touched = durable.stored(deltas.touched_corrections(signed, observations.filter(new)), "touched")
    return deltas.carried_evidence(before, touched, observations, after)


def kept_evidence(spark, sf_dir):
    return bridge.kept(spark, sf_dir, "evidence", lambda: evidence(spark, sf_dir))


# base terms of the bridge keep their own spelling suggestions apart
SHARED_SQL = EVIDENCE_SQL.rstrip() + """,
known AS (SELECT DISTINCT lower(trim(split_part(text, ' ', 1))) AS term FROM benchmark),
grouped AS (
  SELECT *, checker = 'check_spelling' AND status = 'rejected'
    AND lower(trim(original)) NOT IN (SELECT term FROM known) AS is_term FROM evidence),
shaped AS (
  SELECT CASE WHEN is_term THEN 'protected spelling term' ELSE 'exact rule' END AS suggestion_type, checker,
    CASE WHEN is_term THEN '*' ELSE field END AS field,
    CASE WHEN is_term THEN lower(trim(original)) ELSE original END AS original,
    CASE WHEN is_term THEN '*' ELSE proposed END AS proposed, status,
    CASE WHEN is_term THEN 'Valid curriculum or technical term.' ELSE comment END AS comment,
    human_decisions, human_reports, course_coverage, occurrences, reviewed_sources, seen_in_reports
  FROM grouped),
numbers AS (
  SELECT suggestion_type, checker, field, original, proposed, status, comment,
    CAST(sum(human_decisions) AS BIGINT) AS evidence_count, max(human_reports) AS human_reports,
    max(course_coverage) AS course_coverage, CAST(sum(occurrences) AS BIGINT) AS occurrences
  FROM shaped GROUP BY ALL),
names AS (
  SELECT suggestion_type, checker, field, original, proposed, status, comment,
    string_agg(DISTINCT trim(name), ', ' ORDER BY trim(name)) AS reports
  FROM (SELECT *, unnest(string_split(reviewed_sources || ',' || seen_in_reports, ',')) AS name FROM shaped)
  WHERE trim(name) <> '' GROUP BY ALL),
suggestions AS (
  SELECT FALSE AS selected, substr(CASE WHEN n.suggestion_type = 'exact rule'
      THEN sha256(concat_ws(chr(31), 'exact', n.checker, n.field, n.original, n.proposed, n.status, n.comment))
      ELSE sha256('protected_term' || chr(31) || n.original) END, 1, 16) AS suggestion_id,
    n.*, m.reports
  FROM numbers n JOIN names m USING (suggestion_type, checker, field, original, proposed, status, comment)),
reasoned AS (
  SELECT *, evidence_count >= 2 AND human_reports >= 2 AND course_coverage >= 2 AS wide FROM suggestions),
active AS (
  SELECT * EXCLUDE (wide, selected), TRUE AS selected, 'automatic_pattern_learning' AS source,
    CASE WHEN suggestion_type <> 'exact rule' THEN CASE WHEN status = 'rejected' AND course_coverage >= 2
        AND occurrences >= 2 THEN 'Confirmed valid term recurring across courses.' END
      WHEN checker = 'check_math' AND status = 'rejected' THEN 'Confirmed math-checker false positive.'
      WHEN checker = 'check_spacing' AND status <> 'needs_change' AND wide
        THEN 'Consistent spacing decision across reviewed courses.'
      WHEN checker = 'check_capitalization' AND status = 'rejected' AND wide
        AND regexp_matches(lower(comment), 'math|notation|constant|standard|lowercase')
        THEN 'Consistent math or standards notation across reviewed courses.'
      WHEN checker = 'check_spelling' AND status <> 'needs_change' AND wide
        THEN 'Consistent spelling decision across reviewed courses.' END AS automation_reason
  FROM reasoned)
"""


def shared(spark, sf_dir):
    return learning.shared_suggestions(
        kept_evidence(spark, sf_dir), bridge.rulebook(spark, sf_dir).terms
    )


query("shared_suggestions", SHARED_SQL + "SELECT * FROM suggestions")(shared)


@query("automatic_suggestions", SHARED_SQL + "SELECT * FROM active WHERE automation_reason IS NOT NULL")
def automatic_suggestions(spark, sf_dir):
    return learning.automatic_suggestions(shared(spark, sf_dir))


@query("manual_suggestions", SHARED_SQL + """SELECT * FROM suggestions WHERE suggestion_id IN (
  SELECT suggestion_id FROM active WHERE automation_reason IS NULL) AND evidence_count >= 2 AND course_coverage >= 2""")
def manual_suggestions(spark, sf_dir):
    return learning.above_thresholds(learning.manual_suggestions(shared(spark, sf_dir)), 2, 2)


@query("newly_qualified", SHARED_SQL + """
SELECT suggestion_id, suggestion_type, original, automation_reason FROM active
WHERE automation_reason IS NOT NULL AND suggestion_type = 'exact rule'""")
def newly_qualified(spark, sf_dir):
    active = learning.automatic_suggestions(shared(spark, sf_dir))
    before = active.filter(F.col("suggestion_type") == fixed.TERM_SUGGESTION)
    return learning.newly_qualified(active, before).select(
        "suggestion_id", "suggestion_type", "original", "automation_reason"
    )


@query("promoted_rules", SHARED_SQL + """
SELECT checker, field, original, proposed, status, comment, source FROM active
WHERE automation_reason IS NOT NULL AND suggestion_type = 'exact rule'
UNION ALL SELECT 'term', '', term, '', '', '', '' FROM (SELECT term FROM known UNION
  SELECT original FROM active WHERE automation_reason IS NOT NULL AND suggestion_type <> 'exact rule')
UNION ALL SELECT '*', CASE WHEN item_id % 2 = 0 THEN '*' ELSE 'body_value' END, split_part(text, ' ', 3), '*',
  CASE item_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'needs_change' END, 'rule ' || item_id, ''
FROM benchmark""")
def promoted_rules(spark, sf_dir):
    book = bridge.rulebook(spark, sf_dir)
    new_book, _, _ = learning.refresh(
        book, kept_evidence(spark, sf_dir), spark.createDataFrame([], "term string"), "next"
    )
    rules = new_book.rules.select(
        *[tx.present(F.col(c)).alias(c) for c in rb.RULE_FIELDS]
    )
    blank = F.lit("")
    terms = new_book.terms.select(
        F.lit("term").alias("checker"), blank.alias("field"), F.col("term").alias("original"),
        blank.alias("proposed"), blank.alias("status"), blank.alias("comment"), blank.alias("source"),
    )
    return rules.unionByName(terms)


@query("local_suggestions", sql(("classified", "parsed", "reports", "terms"), """
, shaped AS (
  SELECT r.report_name, c.checker = 'check_spelling' AND p.decided = 'rejected'
      AND lower(trim(c.original)) NOT IN (SELECT term FROM terms) AS is_term, c.*, p.decided, p.note
  FROM classified c JOIN parsed p ON p.report_id = c.report_id AND p.issue_id = c.issue_id
  JOIN reports r ON r.report_id = c.report_id WHERE p.decided IS NOT NULL),
rows AS (
  SELECT report_name, CASE WHEN is_term THEN 'protected spelling term' ELSE 'exact rule' END AS suggestion_type,
    checker, CASE WHEN is_term THEN '*' ELSE field END AS field,
    CASE WHEN is_term THEN lower(trim(original)) ELSE original END AS original,
    CASE WHEN is_term THEN '*' ELSE proposed END AS proposed, decided AS status,
    CASE WHEN is_term THEN 'Valid curriculum or technical term.' ELSE note END AS comment FROM shaped)
SELECT FALSE AS selected, substr(CASE WHEN suggestion_type = 'exact rule'
    THEN sha256(concat_ws(chr(31), 'exact', checker, field, original, proposed, status, comment))
    ELSE sha256('protected_term' || chr(31) || original) END, 1, 16) AS suggestion_id,
  suggestion_type, checker, field, original, proposed, status, comment, count(*) AS evidence_count,
  string_agg(DISTINCT report_name, ', ' ORDER BY report_name) AS reports
FROM rows GROUP BY ALL""").replace("\n, shaped", ",\nshaped"))
def local_suggestions(spark, sf_dir):
    return learning.local_suggestions(
        bridge.classified(spark, sf_dir), bridge.reviews(spark, sf_dir),
        bridge.reports(spark, sf_dir), bridge.rulebook(spark, sf_dir).terms,
    )
