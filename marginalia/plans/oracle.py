"""The same questions as SQL over the driver's tables, for checking results.

Nothing here is used by the engine.  Every name below is one common table
expression; ``sql`` puts the needed ones in front of a query.
"""

from __future__ import annotations

from marginalia import fixed
from marginalia.plans import bridge

SEP = "chr(31)"
START, END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '\s+', ' ', 'g'))"


def json_hash(*parts: str) -> str:
    return f"sha256('[1,' || substr(CAST(json_array({', '.join(parts)}) AS VARCHAR), 2))"


def verdict(status: str, comment: str = "") -> str:
    text = fixed.COMMENTS.get(comment, comment)
    return f"{{'status': '{status}', 'comment': {quote(text)}}}"


A, R, N = fixed.APPROVED, fixed.REJECTED, fixed.NEEDS_CHANGE


def matches(x: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({x}, {quote(pattern)}{', ' + quote(flags) if flags else ''})"


def _boundary(prefix: str) -> str:
    return (
        f"CASE boundary WHEN 'boundary' THEN {verdict(A, prefix + '_sentence')} "
        f"WHEN 'abbreviation' THEN {verdict(R, prefix + '_abbreviation')} "
        f"ELSE {verdict(N, prefix + '_unclear')} END"
    )


ABBREVIATION = fixed.ABBREVIATION_TAIL.replace(r"\b", START, 1)
CODE = (
    r"[A-Z]{1,4}-[A-Z]{2,5}(\.[A-Za-z0-9]+)+|" + START
    + r"\d{1,2}\.[A-Z]{1,3}(\.[A-Za-z0-9]+)*" + END
)
LABEL = fixed.MATH_LABEL.replace(r"\b", START, 1)

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, *needs: str):
    def add(text: str) -> str:
        CTES[name] = (needs, text.strip())
        return text
    return add


cte("lines")("""
SELECT doc_id, source, lang, n_chars, pos, parts[pos + 1] AS line,
  coalesce(parts[pos], '') AS prev, coalesce(parts[pos + 2], '') AS next
FROM (SELECT *, unnest(range(len(parts))) AS pos
      FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents))
""")
cte("raw", "lines")(bridge.RAW_SQL.format(lines="lines"))
cte("reviews", "raw")(bridge.REVIEWS_SQL.format(raw="raw", labels="labels"))
cte("reports")(bridge.REPORTS_SQL.format(documents="documents"))
cte("terms")(bridge.TERMS_SQL.format(benchmark="benchmark"))
cte("targets")(bridge.TARGETS_SQL.format(benchmark="benchmark"))
cte("rules")(bridge.RULES_SQL.format(benchmark="benchmark"))
cte("flags", "raw")("""
SELECT report_id FROM raw WHERE checker = 'check_spelling' GROUP BY report_id
HAVING count(DISTINCT coalesce(confidence, chr(0))) > 1
""")
cte("hits", "raw", "rules")("""
SELECT r.report_id, r.issue_id, min(u.rule_rank) AS rule_rank
FROM raw r JOIN rules u ON r.original = u.original AND (u.field = '*' OR u.field = r.field)
GROUP BY 1, 2
""")
cte("prepared", "raw", "flags", "hits", "terms", "targets")(rf"""
SELECT r.*, f.report_id IS NOT NULL AS informative, h.rule_rank,
  t.term IS NOT NULL AS protected, g.term IS NOT NULL AS safe,
  CASE WHEN trim(context_before, ' ' || chr(10)) = '' THEN 'boundary'
    WHEN {matches("rtrim(context_before, ' ' || chr(10))", ABBREVIATION, "i")} THEN 'abbreviation'
    WHEN {matches("rtrim(context_before, ' ' || chr(10))", fixed.INITIALS_TAIL)} THEN 'abbreviation'
    WHEN {matches("rtrim(context_before, ' ' || chr(10))", fixed.LIST_MARKER_TAIL)} THEN 'boundary'
    WHEN right(rtrim(context_before, ' ' || chr(10)), 1) IN ('.', '!', '?') THEN 'boundary'
    ELSE 'unclear' END AS boundary
FROM raw r LEFT JOIN flags f ON f.report_id = r.report_id
LEFT JOIN hits h ON h.report_id = r.report_id AND h.issue_id = r.issue_id
LEFT JOIN terms t ON t.term = lower(trim(r.original))
LEFT JOIN targets g ON g.term = lower(trim(r.proposed))
""")
_reject = "|".join(p.replace(".", r"\.") for p in fixed.CAPITALIZATION_REJECT_PHRASES)
_flag = "|".join(fixed.CAPITALIZATION_FLAG_PHRASES)
cte("judged", "prepared", "rules")(rf"""
SELECT p.*, CASE
  WHEN p.rule_rank IS NOT NULL THEN {{'status': u.status, 'comment': u.comment}}
  WHEN p.checker = 'check_spelling' THEN CASE
    WHEN right(context_before, 1) = chr(92) THEN {verdict(R, "latex")}
    WHEN length(trim(p.original)) >= 3
      AND replace(lower(trim(p.original)), lower(substr(trim(p.original), 1, 1)), '') = ''
      THEN {verdict(R, "repeated")}
    WHEN informative AND confidence = 'high' THEN {verdict(A)}
    WHEN informative THEN {verdict(R, "jargon")}
    WHEN {matches("lower(trim(p.original))", "^[a-e]hs[a-z]$")} THEN {verdict(R, "code_artifact")}
    WHEN protected THEN {verdict(R, "protected")}
    WHEN safe AND damerau_levenshtein(lower(trim(p.original)), lower(trim(p.proposed))) = 1
      THEN {verdict(A)}
    ELSE {verdict(N, "no_confidence")} END
  WHEN p.checker = 'check_capitalization' THEN CASE
    WHEN NOT {matches("context_after", "^(?:[a-zA-Z]|[ ]+[a-zA-Z]{2})")} THEN {verdict(R, "bare_token")}
    WHEN {matches("context_after", fixed.MATH_SUBJECT, "i")} THEN {verdict(R, "math_subject")}
    WHEN container_tag IN ('th', 'td') AND container_cell_has_prior_text THEN {_boundary("cell")}
    WHEN container_tag IN ('th', 'td') THEN {verdict(R, "cell_label")}
    WHEN container_tag IN ('p', 'li') THEN {_boundary("text")}
    WHEN container_known AND container_tag IS NULL AND p.field = 'body_value'
      AND {matches("context_before", "['\"‘“][ ]*$")} THEN {verdict(A, "quoted")}
    WHEN container_known AND container_tag IS NULL AND p.field = 'body_value' THEN {verdict(R, "flattened")}
    WHEN reasoning <> '' AND {matches("lower(reasoning)", _reject)} THEN {verdict(R, "notation")}
    WHEN reasoning <> '' AND ({matches("lower(reasoning)", _flag)}
      OR contains(replace(lower(reasoning), 'unambiguous', ''), 'ambiguous'))
      THEN {verdict(N, "ambiguous_case")}
    WHEN reasoning <> '' THEN {verdict(A)}
    WHEN p.field = 'title' THEN {verdict(A)}
    ELSE {verdict(N, "no_reasoning")} END
  WHEN p.checker = 'check_math' THEN CASE
    WHEN contains(reasoning, 'upstream value') OR contains(p.proposed, 'upstream value')
      THEN {verdict(N, "upstream")} ELSE {verdict(R, "math_misread")} END
  WHEN p.checker = 'check_proper_nouns' THEN CASE
    WHEN lower(p.original) = 'texas' AND contains(
      lower(context_before || ' ' || p.original || ' ' || context_after), 'essential knowledge and skills')
      THEN {verdict(A, "official_title")} ELSE {verdict(R, "common_noun")} END
  WHEN p.checker = 'check_links' THEN {verdict(A)}
  WHEN p.checker = 'check_punctuation' THEN CASE
    WHEN p.original = '..' AND p.proposed = '.' AND trim(context_after) <> '' THEN {verdict(R, "trailing_off")}
    WHEN p.original = '..' AND p.proposed = '.' THEN {verdict(N, "double_period")}
    WHEN p.original LIKE '.%' AND p.proposed LIKE '. %' AND length(p.original) > 2 THEN {verdict(A)}
    ELSE {verdict(N, "punctuation")} END
  WHEN p.checker = 'check_spacing' THEN CASE
    WHEN ({matches("p.original", r"^\s[.,?);:]$")} AND ltrim(p.original) = p.proposed)
      OR ({matches("p.original", "^,[A-Za-z]$")} AND {matches("p.proposed", "^, [A-Za-z]$")})
      OR ({matches("p.original", r"^\s+$")} AND p.proposed = ' ' AND length(p.original) > 1)
      OR {matches("p.original", "^[?!][A-Z]$")} THEN {verdict(A)}
    WHEN {matches("p.original", "^[.:;][A-Za-z]$")} THEN CASE
      WHEN right(context_before, 1) = chr(92)
        OR {matches("context_before || ' ' || substr(context_after, 1, 30)", CODE)}
        OR {matches("context_before", fixed.STANDARDS_CODE_PREFIX)}
        OR {matches("context_before", LABEL)} THEN {verdict(R, "code_boundary")}
      WHEN {matches("context_before", fixed.MATH_LABEL_AMBIGUOUS)} THEN {verdict(N, "answer_label")}
      ELSE {verdict(A)} END
    ELSE {verdict(N, "spacing")} END
  ELSE {{'status': '{N}', 'comment': 'Unrecognized checker "' || p.checker || '".'}} END AS v
FROM prepared p LEFT JOIN rules u ON u.rule_rank = p.rule_rank
""")
cte("classified", "judged")("""
SELECT report_id, issue_id, v.status AS status, checker, coalesce(confidence, '') AS confidence, field,
  original, proposed, v.comment AS comment, context_before, context_after, breadcrumb, node_label,
  node_link, finding_order
FROM judged
""")
cte("keyed", "classified")(f"""
SELECT *, {norm("checker")} AS checker_key, {norm("field")} AS field_key,
  {norm("original")} AS original_key, {norm("proposed")} AS proposed_key,
  trim({norm("context_before")} || ' <change> ' || {norm("context_after")}) AS context,
  length(trim({norm("context_before")} || {norm("context_after")})) >= 20 AS in_context,
  CASE WHEN breadcrumb = '' THEN '' ELSE regexp_extract({norm("breadcrumb")}, '(unit .*)$', 1) || ' | '
    || {norm("node_label")} END AS place
FROM classified
""")
cte("signed", "keyed")(f"""
SELECT *, CASE WHEN in_context THEN 'context' WHEN length(place) >= 8 THEN 'location' ELSE '' END AS anchor_kind,
  CASE WHEN in_context THEN context WHEN length(place) >= 8 THEN place ELSE '' END AS anchor,
  {json_hash("checker_key", "field_key", "original_key", "proposed_key")} AS core_key
FROM keyed
""")
cte("signatures", "signed")(f"""
SELECT *, CASE WHEN anchor_kind = '' THEN ''
  ELSE {json_hash("core_key", "anchor_kind", "anchor")} END AS fingerprint
FROM signed
""")
cte("parsed", "reviews")("""
SELECT report_id, issue_id,
  CASE WHEN trim(decision) = '' THEN NULL WHEN decision = 'R' THEN 'rejected'
    WHEN decision = 'approved' THEN 'approved' ELSE 'needs_change' END AS decided,
  CASE WHEN trim(decision) = '' THEN NULL
    WHEN decision LIKE 'Needs%' AND review_note = '' THEN 'replace it' ELSE review_note END AS note,
  CASE WHEN decision LIKE 'Needs%' AND review_note = '' THEN 'replace it'
    WHEN review_note LIKE 'Use%' THEN 'Use the comma here'
    WHEN review_note LIKE 'Looks%' THEN '' ELSE review_note END AS clean
FROM reviews
""")
cte("reviewed", "signatures", "parsed")("""
SELECT s.*, p.decided, p.note, CASE WHEN s.checker = 'check_links' THEN '' ELSE p.clean END AS clean
FROM signatures s LEFT JOIN parsed p ON p.report_id = s.report_id AND p.issue_id = s.issue_id
WHERE s.status = 'needs_change'
""")
cte("observations", "reviewed", "reports")(f"""
SELECT sha256(w.report_id || {SEP} || issue_id) AS observation_id, fingerprint, core_key, anchor_kind,
  anchor, checker_key AS checker, field_key AS field_name, original_key AS original,
  proposed_key AS proposed, decided AS status, clean AS note, p.report_name AS source_report,
  w.report_id AS source_report_id, issue_id, '{bridge.AS_OF}' AS updated_at
FROM reviewed w JOIN reports p ON p.report_id = w.report_id
WHERE decided IS NOT NULL AND fingerprint <> ''
""")


def consensus_sql(key: str, name: str) -> str:
    return f"""
SELECT {key}, min(status) AS decision,
  CASE WHEN count(DISTINCT nullif(note, '')) = 1 THEN max(nullif(note, '')) ELSE '' END AS review_note,
  string_agg(DISTINCT source_report, ', ' ORDER BY source_report) AS memory_source,
  count(*) AS memory_evidence
FROM observations GROUP BY {key}
HAVING count(DISTINCT status) = 1
  AND (min(status) <> 'needs_change' OR count(DISTINCT nullif(note, '')) = 1)
"""


cte("agreed", "observations")(consensus_sql("fingerprint", "agreed"))
cte("exact", "signatures", "agreed")("""
SELECT s.report_id, s.issue_id, decision, review_note, memory_source, memory_evidence,
  'exact' AS memory_match, CAST(1.0 AS DOUBLE) AS memory_score
FROM signatures s JOIN agreed a ON a.fingerprint = s.fingerprint
WHERE s.status = 'needs_change' AND s.fingerprint <> ''
""")
cte("merged", "classified", "parsed")("""
SELECT c.* EXCLUDE (status, comment),
  CASE WHEN checker = 'check_links' THEN 'approved' ELSE coalesce(p.decided, status) END AS status,
  CASE WHEN checker = 'check_links' THEN '' WHEN p.decided IS NOT NULL THEN p.note ELSE comment END AS comment
FROM classified c LEFT JOIN parsed p ON p.report_id = c.report_id AND p.issue_id = c.issue_id
""")
cte("stored_reports", "classified", "reports")("""
SELECT p.report_id, report_name, filename, 'bridge' AS rules_version, count(*) AS finding_count,
  count(*) FILTER (WHERE status = 'needs_change') AS reviewable_count,
  uploaded AS first_uploaded_at, uploaded AS last_uploaded_at, CAST(1 AS BIGINT) AS upload_count
FROM classified c JOIN reports p ON p.report_id = c.report_id
GROUP BY p.report_id, report_name, filename, uploaded
""")


def sql(needs: str | tuple[str, ...], query: str) -> str:
    """A query with the expressions it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in CTES[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in (needs,) if isinstance(needs, str) else needs:
        visit(name)
    if not order:
        return query.strip()
    head = ",\n".join(f"{name} AS (\n{CTES[name][1]}\n)" for name in order)
    return f"WITH {head}\n{query.strip()}"
