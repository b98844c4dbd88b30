"""Registered queries over keyed records: merges, audit events, tickets, people, runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import fixed
from marginalia.operators import durable, library, merging, parse, tickets
from marginalia.plans import flows
from marginalia.plans.bridge import TASK_TICKETS, kept, spread, table
from marginalia.plans.catalog import derived_cards, query
from marginalia.plans.oracle import sql
from marginalia.streaming import flows as streams

# ------------------------------------------------------------------ merges
# Two deployments' reports: every order belongs to one side.
SIDE_SQL = """
SELECT 'c' || CAST(o_custkey AS STRING) AS report_id, min(o_orderpriority) AS report_name,
  max(o_orderpriority) AS filename, max(o_orderstatus) AS rules_version, count(*) AS finding_count,
  count(*) - count(DISTINCT o_orderpriority) AS reviewable_count,
  substr(CAST(min(o_orderdate) AS STRING), 1, 10) AS first_uploaded_at,
  substr(CAST(max(o_orderdate) AS STRING), 1, 10) AS last_uploaded_at, count(DISTINCT o_orderstatus) AS upload_count
FROM {orders} WHERE (o_orderkey % 2 = 0) = __SIDE__ GROUP BY o_custkey
"""
OLD, NEW = SIDE_SQL.replace("__SIDE__", "TRUE"), SIDE_SQL.replace("__SIDE__", "FALSE")
SIDES = f"WITH a AS ({OLD.format(orders='orders')}), b AS ({NEW.format(orders='orders')})\n"
TAKE = ", ".join(
    f"CASE WHEN b.report_id IS NULL THEN a.{c} ELSE b.{c} END AS {c}"
    for c in ("report_id", "report_name", "filename", "rules_version", "finding_count", "reviewable_count")
)


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    return spark.sql(OLD, orders=orders), spark.sql(NEW, orders=orders)


@query("merged_reports", SIDES + f"""
SELECT {TAKE}, least(a.first_uploaded_at, b.first_uploaded_at) AS first_uploaded_at,
  greatest(a.last_uploaded_at, b.last_uploaded_at) AS last_uploaded_at,
  greatest(a.upload_count, b.upload_count) AS upload_count
FROM a FULL JOIN b ON a.report_id = b.report_id""")
def merged_reports(spark, sf_dir):
    return merging.merge_reports(*sides(spark, sf_dir))


@query("reuploaded_reports", SIDES + f"""
SELECT {TAKE}, coalesce(a.first_uploaded_at, b.first_uploaded_at) AS first_uploaded_at,
  coalesce(b.last_uploaded_at, a.last_uploaded_at) AS last_uploaded_at,
  coalesce(a.upload_count, 0) + coalesce(b.upload_count, 0) AS upload_count
FROM a FULL JOIN b ON a.report_id = b.report_id""")
def reuploaded_reports(spark, sf_dir):
    return merging.reupload(*sides(spark, sf_dir))


DRAFT_SQL = """
SELECT 'u' || CAST(user_id AS STRING) AS report_id, event_type AS issue_id,
  max(CASE WHEN value > 50 THEN 'approved' WHEN value > 20 THEN 'rejected' ELSE 'needs_change' END) AS decision,
  max(props) AS note, substr(CAST(max(ts) AS STRING), 1, 19) AS updated_at
FROM {events} WHERE (event_id % 2 = 0) = __SIDE__ GROUP BY user_id, event_type
"""
DRAFTS_OLD, DRAFTS_NEW = DRAFT_SQL.replace("__SIDE__", "TRUE"), DRAFT_SQL.replace("__SIDE__", "FALSE")
DRAFT_SIDES = f"WITH a AS ({DRAFTS_OLD.format(events='events')}), b AS ({DRAFTS_NEW.format(events='events')})\n"


def draft_sides(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return spark.sql(DRAFTS_OLD, events=events), spark.sql(DRAFTS_NEW, events=events)


@query("merged_drafts", DRAFT_SIDES + """
SELECT coalesce(b.report_id, a.report_id) AS report_id, coalesce(b.issue_id, a.issue_id) AS issue_id,
  coalesce(b.decision, a.decision) AS decision, coalesce(b.note, a.note) AS note,
  greatest(a.updated_at, b.updated_at) AS updated_at
FROM a FULL JOIN b ON a.report_id = b.report_id AND a.issue_id = b.issue_id""")
def merged_drafts(spark, sf_dir):
    return merging.merge_dated(*draft_sides(spark, sf_dir), ["report_id", "issue_id"])


@query("saved_drafts", DRAFT_SIDES + """
SELECT * FROM b WHERE decision <> 'rejected' UNION ALL
SELECT a.* FROM a LEFT JOIN b ON a.report_id = b.report_id AND a.issue_id = b.issue_id WHERE b.report_id IS NULL""")
def saved_drafts(spark, sf_dir):
    old, new = draft_sides(spark, sf_dir)
    typed = new.withColumns({
        "review_note": F.col("note"),
        "decision": F.when(F.col("decision") != "rejected", F.col("decision")).otherwise(" "),
    })
    saved, cleared = library.draft_rows(typed, F.col("updated_at"))
    return merging.save_drafts(old, saved, cleared)


@query("latest_drafts", """
SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_drafts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return merging.upsert_latest(rows, ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("replaced_findings", """
SELECT user_id AS report_id, event_id, event_type FROM events WHERE event_type = 'purchase' OR user_id NOT IN (
  SELECT user_id FROM events WHERE event_type = 'purchase')""")
def replaced_findings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("report_id"), "event_id", "event_type")
    kinds = F.col("event_type") == "purchase"
    return merging.replace_findings(rows.filter(~kinds), rows.filter(kinds))


# ------------------------------------------------------------------ events
EVENT_SQL = """
SELECT lpad(CAST(event_id AS STRING), 12, '0') AS event_id, 'u' || CAST(user_id AS STRING) AS report_id,
  CAST(event_id % 100 AS STRING) AS issue_id, 'save_' || event_type AS action,
  CASE WHEN value > 50 THEN 'approved' ELSE '' END AS decision, event_type || '@x.test' AS reviewer_email,
  event_type AS reviewer_name, props AS detail_json, substr(CAST(ts AS STRING), 1, 19) AS occurred_at
FROM {events}
"""


def audit_events(spark, sf_dir):
    return spark.sql(EVENT_SQL, events=table(spark, sf_dir, "events"))


AUDIT = f"WITH e AS ({EVENT_SQL.format(events='events')})\n"


@query("merged_events", AUDIT + "SELECT event_id, report_id, occurred_at FROM e")
def merged_events(spark, sf_dir):
    rows = audit_events(spark, sf_dir)
    old = rows.filter("decision = ''")
    return merging.merge_events(old, rows).select("event_id", "report_id", "occurred_at")


@query("latest_activity", AUDIT + """
SELECT event_id, report_id, action, occurred_at FROM e
QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY occurred_at DESC, event_id DESC) <= 5""")
def latest_activity(spark, sf_dir):
    rows = library.latest_activity(audit_events(spark, sf_dir), limit=5)
    return rows.select("event_id", "report_id", "action", "occurred_at")


@query("report_activity", AUDIT + """
SELECT reviewer_name AS reviewer, reviewer_email AS email, 'Save ' || upper(substr(reviewer_name, 1, 1))
  || substr(reviewer_name, 2) AS action, issue_id AS issue, decision, occurred_at AS time
FROM e WHERE report_id = (SELECT min(report_id) FROM e) ORDER BY occurred_at DESC, event_id DESC LIMIT 25""")
def report_activity(spark, sf_dir):
    rows = audit_events(spark, sf_dir)
    first = rows.agg(F.min("report_id")).first()[0]
    return library.activity_view(library.report_activity(rows, first, 25))


@query("unknown_report_events", AUDIT + """
SELECT event_id, report_id FROM e WHERE report_id NOT IN (SELECT 'u' || c_custkey FROM customer WHERE c_acctbal > 0)""")
def unknown_report_events(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("report_id")
    )
    return library.unknown_reports(audit_events(spark, sf_dir), known).select("event_id", "report_id")


@query("reviewer_activity", """
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour'
  AS window_end, event_type AS reviewer_email, count(*) AS events FROM events GROUP BY 1, 2, 3""")
def reviewer_activity(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("reviewer_email"))
    return streams.reviewer_activity(rows, time="ts")


# ----------------------------------------------------------------- tickets
TICKET_SQL = """
SELECT o_orderkey AS n, '{{"id":' || CAST(o_orderkey AS STRING) || ',"key":"T-' || CAST(o_orderkey AS STRING)
  || '","fields":{{"summary":"' || CASE o_orderkey % 5 WHEN 0 THEN 'QA check of the Report' WHEN 1 THEN
  'Issue Annotation Report' ELSE o_orderpriority END || '","status":{{"name":"' || o_orderstatus
  || '"}},"assignee":' || CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE '{{"displayName":"Customer '
  || CAST(o_custkey AS STRING) || '","accountId":"c' || CAST(o_custkey AS STRING) || '"}}' END
  || ',"updated":"' || substr(CAST(o_orderdate AS STRING), 1, 10) || '","attachment":['
  || CASE WHEN o_orderkey % 11 = 0 THEN '{{"id":"a1","filename":"Course.HTM","mimeType":"","size":12}},'
    || '{{"id":"a2","filename":"b.txt","mimeType":"text/html"}}' WHEN o_orderkey % 11 = 1 THEN
    '{{"id":"a3","filename":"one.html","mimeType":"x","size":5}}' ELSE '{{"id":"a4","filename":"notes.txt","mimeType":"x"}}' END
  || '],"description":{{"type":"doc","content":[{{"type":"paragraph","content":[{{"type":"text","text":" See '
  || o_orderpriority || ' "}},{{"type":"text","text":"here","marks":[{{"type":"link","attrs":{{"href":"https://github.com/Org'
  || CAST(o_custkey % 3 AS STRING) || '/repo.git/actions/runs/' || CAST(o_orderkey % 100 AS STRING)
  || '"}}}}]}},{{"type":"text","text":"https://GitHub.com/org' || CAST(o_custkey % 3 AS STRING)
  || '/Repo/actions/runs/' || CAST(o_orderkey % 100 AS STRING) || '/attempts/2)."}},'
  || '{{"type":"text","text":"https://x.test/' || CAST(o_custkey % 10 AS STRING) || '."}}]}}]}}}}}}' AS raw
FROM {orders} WHERE TRUE
"""


def read_tickets(spark, sf_dir):
    raw = spark.sql(TICKET_SQL, orders=spread(table(spark, sf_dir, "orders"), TASK_TICKETS))
    return tickets.normalize_tickets(raw, "https://t.test")


def ticket_rows(spark, sf_dir):
    """Normalised tickets as a stored table."""
    return kept(spark, sf_dir, "tickets", lambda: read_tickets(spark, sf_dir))


LINK1 = "'https://github.com/Org' || (o_custkey % 3) || '/repo.git/actions/runs/' || (o_orderkey % 100)"
LINK2 = "'https://GitHub.com/org' || (o_custkey % 3) || '/Repo/actions/runs/' || (o_orderkey % 100) || '/attempts/2'"
LINK3 = "'https://x.test/' || (o_custkey % 10)"
SUMMARY = """CASE o_orderkey % 5 WHEN 0 THEN 'QA check of the Report' WHEN 1 THEN 'Issue Annotation Report'
  ELSE o_orderpriority END"""


@query("normalized_tickets", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS id, 'T-' || o_orderkey AS key, {SUMMARY} AS summary, o_orderstatus AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Customer ' || o_custkey END AS assignee_name,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'c' || o_custkey END AS assignee_account_id,
  substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS updated,
  'See ' || o_orderpriority || ' here ' || {LINK2} || '). ' || {LINK3} || '.' AS description,
  {LINK1} || '|' || {LINK2} || '|' || {LINK3} AS links,
  CASE o_orderkey % 11 WHEN 0 THEN 'Course.HTM|b.txt' WHEN 1 THEN 'one.html' ELSE 'notes.txt' END AS files,
  'https://t.test/browse/T-' || o_orderkey AS browse_url
FROM orders""")
def normalized_tickets(spark, sf_dir):
    rows = read_tickets(spark, sf_dir)
    return rows.withColumns({
        "links": F.array_join("links", "|"),
        "files": F.array_join(F.transform("attachments", lambda a: a["filename"]), "|"),
    }).drop("attachments")


@query("report_tickets", f"""
SELECT 'T-' || o_orderkey AS key, TRUE AS about_report, o_orderkey % 11 IN (0, 1) AS has_html FROM orders""")
def report_tickets(spark, sf_dir):
    return ticket_rows(spark, sf_dir).select(
        "key", tickets.is_report_ticket().alias("about_report"),
        F.exists("attachments", tickets.is_html_attachment).alias("has_html"),
    )


@query("tickets_without_links", f"""
SELECT 'T-' || o_orderkey AS key FROM orders WHERE o_orderkey % 5 IN (0, 1) OR o_orderkey % 11 IN (0, 1)""")
def tickets_without_links(spark, sf_dir):
    """Tickets about reports when links are not looked at."""
    bare = ticket_rows(spark, sf_dir).withColumns(
        {"links": F.array().cast("array<string>"), "description": F.lit("")}
    )
    return bare.filter(tickets.is_report_ticket()).select("key")


@query("ticket_runs", """
SELECT 'T-' || o_orderkey AS key, CAST(0 AS INTEGER) AS position, 'Org' || (o_custkey % 3) AS owner, 'repo' AS repo,
  CAST(o_orderkey % 100 AS VARCHAR) AS run_id,
  'https://github.com/Org' || (o_custkey % 3) || '/repo/actions/runs/' || (o_orderkey % 100) AS web_url
FROM orders""")
def ticket_runs(spark, sf_dir):
    return tickets.run_references(ticket_rows(spark, sf_dir))


@query("report_sources", """
SELECT 'T-' || o_orderkey AS key, CASE WHEN o_orderkey % 11 IN (0, 1) THEN 1 ELSE 2 END AS priority,
  CASE WHEN o_orderkey % 11 = 0 THEN CAST(2 AS BIGINT) ELSE 1 END AS offers,
  CASE o_orderkey % 11 WHEN 0 THEN 'ticket:T-' || o_orderkey || ':a1' WHEN 1 THEN 'ticket:T-' || o_orderkey || ':a3'
    ELSE 'T-' || o_orderkey || ':Org' || (o_custkey % 3) || ':repo:' || (o_orderkey % 100) END AS source_key,
  CASE WHEN o_orderkey % 11 = 0 THEN 'choose' WHEN o_orderkey % 11 = 1 AND o_orderstatus = 'F' THEN 'already loaded'
    ELSE 'load' END AS action
FROM orders""")
def report_sources(spark, sf_dir):
    rows = ticket_rows(spark, sf_dir)
    loaded = rows.filter("status = 'F'").select(F.concat(F.lit("ticket:"), "key", F.lit(":a3")).alias("source_key"))
    return tickets.report_sources(rows, loaded).drop("label")


@query("assigned_tickets", """
SELECT 'T-' || o_orderkey AS key, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS updated FROM orders
WHERE o_custkey = (SELECT min(o_custkey) FROM orders) AND o_orderkey % 7 <> 0 AND o_orderstatus <> 'F'
ORDER BY updated DESC, key LIMIT 50""")
def assigned_tickets(spark, sf_dir):
    account = table(spark, sf_dir, "orders").agg(F.min("o_custkey")).first()[0]
    rows = ticket_rows(spark, sf_dir).withColumn(
        "status_category", F.when(F.col("status") == "F", "Done").otherwise("Open")
    )
    return tickets.assigned_tickets(rows, f"c{account}").select("key", "updated")


@query("link_labels", r"""
SELECT page_id, host || CASE WHEN last <> '' AND length(last) <= 44 THEN ' · ' || last ELSE '' END AS label
FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\.', '') AS host,
  regexp_extract(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '([^/]*)$', 1) AS last FROM pages)""")
def link_labels(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", tickets.link_label(F.col("url"), F.lit(1)).alias("label"))


@query("page_links", r"""
SELECT page_id, array_to_string(list_distinct_sorted, '|') AS links FROM (
  SELECT page_id, list_sort(list_distinct(list_transform(
    regexp_extract_all(html, 'https?://[^\s<>"]+'), lambda x: rtrim(x, '.,);]')))) AS list_distinct_sorted FROM pages)""")
def page_links(spark, sf_dir):
    from marginalia.functions.rich_text import text_links

    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.array_join(F.array_sort(text_links(F.col("html"))), "|").alias("links"))


@query("pending_actions", """
WITH c AS (SELECT *, CASE o_orderkey % 11 WHEN 0 THEN 'Course.HTM' WHEN 1 THEN 'one.html' ELSE 'notes.txt' END AS file
  FROM orders), steps AS (
  SELECT o_orderkey, unnest(list_filter([
    CASE WHEN file <> 'notes.txt' THEN 'attach' END, CASE WHEN o_orderkey % 4 <> 0 THEN 'comment' END,
    CASE WHEN o_orderkey % 7 = 0 OR o_custkey % 2 = 1 THEN 'assign' END,
    CASE WHEN o_orderstatus <> 'F' THEN 'transition' END], lambda x: x IS NOT NULL)) AS step,
  generate_subscripts(list_filter([
    CASE WHEN file <> 'notes.txt' THEN 'attach' END, CASE WHEN o_orderkey % 4 <> 0 THEN 'comment' END,
    CASE WHEN o_orderkey % 7 = 0 OR o_custkey % 2 = 1 THEN 'assign' END,
    CASE WHEN o_orderstatus <> 'F' THEN 'transition' END], lambda x: x IS NOT NULL), 1) AS pos FROM c)
SELECT 'r' || o_orderkey AS report_id, 'T-' || o_orderkey AS key, CAST(pos - 1 AS INTEGER) AS step_order, step FROM steps""")
def pending_actions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = F.concat(F.lit("T-"), F.col("o_orderkey").cast("string"))
    marker = F.concat(F.lit("[done r"), F.col("o_orderkey").cast("string"), F.lit("]"))
    completed = orders.select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("report_id"), key.alias("key"),
        F.lit("notes.txt").alias("filename"), marker.alias("marker"),
        F.concat(F.lit("c"), (F.col("o_custkey") - F.col("o_custkey") % 2).cast("string")).alias("target_account"),
        F.lit("f").alias("target_status"),
    )
    comments = orders.filter("o_orderkey % 4 = 0").select(
        key.alias("key"), F.concat(F.lit("sent "), marker, F.lit(" ok")).alias("body")
    )
    return tickets.pending_actions(completed, ticket_rows(spark, sf_dir), comments)


# ------------------------------------------------------------------ people
PEOPLE_SQL = """
SELECT 'c' || CAST(c_custkey AS STRING) AS account_id,
  CASE n_nationkey % 4 + c_custkey % (4 - n_nationkey % 4) WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) || ' ' || c_mktsegment
    WHEN 2 THEN c_mktsegment || ' ' || n_name ELSE c_name END AS display_name,
  lower(c_name) || '@x.test' AS email, c_acctbal > 0 AS active, n_name AS label, c_custkey
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""


def people(spark, sf_dir):
    return spark.sql(
        PEOPLE_SQL, customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation")
    )


PEOPLE = f"p AS ({PEOPLE_SQL.format(customer='customer', nation='nation')})"


@query("reviewer_candidates", f"""
WITH {PEOPLE}, t AS (SELECT label, account_id, display_name, CASE WHEN lower(display_name) = lower(label) THEN 1
  WHEN lower(split_part(display_name, ' ', 1)) = lower(label) THEN 2
  WHEN list_contains(string_split(lower(display_name), ' '), lower(label)) THEN 3 ELSE 4 END AS tier
  FROM p WHERE active)
SELECT label, account_id, display_name, tier FROM t
QUALIFY tier = min(tier) OVER (PARTITION BY label)""")
def reviewer_candidates(spark, sf_dir):
    users = people(spark, sf_dir)
    hits = users.select("label", "account_id")
    return tickets.candidates_by_tier(hits, users.drop("label")).select(
        "label", "account_id", "display_name", "tier"
    )


@query("resolved_identities", f"""
WITH {PEOPLE}, s AS (SELECT email, CASE WHEN c_custkey % 2 = 0 THEN display_name ELSE 'Other' END AS name, account_id,
    c_custkey, active FROM p),
hits AS (SELECT email, account_id FROM s WHERE c_custkey % 3 = 0 UNION
  SELECT s.email, q.account_id FROM s JOIN p q ON lower(q.display_name) = lower(s.name)),
found AS (SELECT h.email, h.account_id, u.email = h.email AS by_email, lower(u.display_name) = lower(s.name) AS by_name
  FROM hits h JOIN p u ON u.account_id = h.account_id AND u.active JOIN s ON s.email = h.email),
agg AS (SELECT email, count(*) AS n, count(*) FILTER (WHERE by_name) AS names, min(account_id) AS any_account,
  min(account_id) FILTER (WHERE by_email) AS mail, min(account_id) FILTER (WHERE by_name) AS named FROM found GROUP BY 1)
SELECT s.email, CASE WHEN mail IS NOT NULL THEN mail WHEN n = 1 THEN any_account WHEN names = 1 THEN named END AS account_id,
  CASE WHEN mail IS NOT NULL OR n = 1 OR names = 1 THEN 'matched' WHEN n > 0 THEN 'ambiguous' ELSE 'none' END AS outcome
FROM s LEFT JOIN agg ON agg.email = s.email""")
def resolved_identities(spark, sf_dir):
    users = people(spark, sf_dir)
    signed_in = users.withColumn(
        "name", F.when(F.col("c_custkey") % 2 == 0, F.col("display_name")).otherwise("Other")
    )
    by_mail = signed_in.filter("c_custkey % 3 = 0").select("email", "account_id", F.lit("email").alias("query"))
    searches = signed_in.select("email", F.lower("name").alias("search"))
    answers = users.select(F.lower("display_name").alias("search"), "account_id")
    return tickets.resolve_identities(
        signed_in.select("email", "name"), by_mail, users.select("account_id", "display_name", "email", "active"),
        searches, answers,
    )


@query("mapped_accounts", f"""
WITH {PEOPLE} SELECT email, CASE WHEN c_custkey % 5 = 0 THEN 'mapped-' || c_custkey ELSE account_id END AS account_id FROM p""")
def mapped_accounts(spark, sf_dir):
    users = people(spark, sf_dir)
    mapping = users.filter("c_custkey % 5 = 0").select(
        F.concat(F.lit(" "), F.upper("email")).alias("name"),
        F.concat(F.lit("mapped-"), F.col("c_custkey").cast("string")).alias("account_id"),
    )
    return tickets.with_account_override(users.select("email", "account_id"), mapping, "email")


@query("reviewer_accounts", f"""
WITH {PEOPLE}, o AS (SELECT 'c' || o_custkey AS account_id, count(*) AS n FROM orders
  WHERE o_orderkey % 7 <> 0 AND o_orderstatus <> 'F' GROUP BY 1)
SELECT label, count(*) AS candidates, count(o.n) AS owners, CAST(coalesce(sum(o.n), 0) AS BIGINT) AS tickets,
  CASE WHEN count(o.n) = 1 THEN min(p.account_id) FILTER (WHERE o.n IS NOT NULL)
    WHEN count(*) = 1 THEN min(p.account_id) END AS account_id
FROM p LEFT JOIN o ON o.account_id = p.account_id WHERE active GROUP BY 1""")
def reviewer_accounts(spark, sf_dir):
    rows = ticket_rows(spark, sf_dir).withColumn(
        "status_category", F.when(F.col("status") == "F", "Done").otherwise("Open")
    )
    return tickets.reviewer_accounts(people(spark, sf_dir).filter("active").select("label", "account_id"), rows)


@query("normalized_emails", f"""
WITH {PEOPLE} SELECT account_id, email || '|' || lower(display_name) AS emails FROM p""")
def normalized_emails(spark, sf_dir):
    values = F.array(
        F.concat(F.lit(" "), F.upper("email")), F.lit(" "), F.col("display_name"), F.lit(None), F.col("email")
    )
    return people(spark, sf_dir).select(
        "account_id", F.array_join(tickets.normalize_emails(values), "|").alias("emails")
    )


# -------------------------------------------------------------------- runs
ARTIFACT_SQL = """
SELECT l_suppkey AS run_id, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-'
  || CAST(l_partkey AS STRING) AS id,
  CASE l_partkey % 4 WHEN 0 THEN 'QA-' WHEN 1 THEN 'my Report ' ELSE 'log ' END || l_linestatus AS name,
  CAST(floor(l_extendedprice * 10) AS BIGINT) * 1000 AS size, l_returnflag = 'R' AS expired
FROM {lineitem}
"""


@query("ranked_artifacts", f"""
SELECT run_id, id, name, size, row_number() OVER w AS rank FROM ({ARTIFACT_SQL.format(lineitem="lineitem")})
WHERE NOT expired AND size <= 419430400
WINDOW w AS (PARTITION BY run_id ORDER BY CASE WHEN regexp_matches(lower(name), 'qa|report|annotat|review') THEN 0
  ELSE 1 END, size, lower(name), id)
QUALIFY rank <= 10""")
def ranked_artifacts(spark, sf_dir):
    rows = spark.sql(ARTIFACT_SQL, lineitem=table(spark, sf_dir, "lineitem"))
    return tickets.ranked_artifacts(rows, 10, fixed.MAX_ARTIFACT_BYTES).select(
        "run_id", "id", "name", "size", F.col("rank").cast("bigint").alias("rank")
    )


@query("skipped_artifacts", f"""
SELECT coalesce(skipped, 'used') AS outcome, count(*) AS artifacts FROM (
  SELECT CASE WHEN expired THEN 'expired' WHEN size > 419430400 THEN 'too large' END AS skipped
  FROM ({ARTIFACT_SQL.format(lineitem="lineitem")})) GROUP BY 1""")
def skipped_artifacts(spark, sf_dir):
    rows = spark.sql(ARTIFACT_SQL, lineitem=table(spark, sf_dir, "lineitem"))
    return tickets.usable_artifacts(rows, fixed.MAX_ARTIFACT_BYTES).groupBy(
        F.coalesce("skipped", F.lit("used")).alias("outcome")
    ).agg(F.count(F.lit(1)).alias("artifacts"))


@query("reports_in_runs", f"""
WITH a AS (SELECT run_id, id, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN regexp_matches(lower(name),
    'qa|report|annotat|review') THEN 0 ELSE 1 END, size, lower(name), id) AS rank
  FROM ({ARTIFACT_SQL.format(lineitem="lineitem")}) WHERE NOT expired AND size <= 419430400),
m AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS artifact_id, l_shipdate AS shipped FROM lineitem
  WHERE l_quantity > 25),
f AS (SELECT run_id, min(rank) AS rank FROM a WHERE rank <= 10 AND id IN (SELECT artifact_id FROM m) GROUP BY 1)
SELECT a.run_id, a.id AS artifact_id FROM f JOIN a ON a.run_id = f.run_id AND a.rank = f.rank""")
def reports_in_runs(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    ranked = tickets.ranked_artifacts(
        spark.sql(ARTIFACT_SQL, lineitem=items), 10, fixed.MAX_ARTIFACT_BYTES
    )
    members = items.filter("l_quantity > 25").select(
        F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).alias("artifact_id")
    ).distinct()
    return tickets.reports_in_runs(ranked, members).select("run_id", "artifact_id")


# --------------------------------------------------------------- streaming
def event_stream(spark, sf_dir):
    """The events table read as a stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def drained(rows: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now into the checkpoint folder and read it back."""
    spark = rows.sparkSession
    base = f"{durable.checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    running = (
        rows.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{base}/checkpoint").start(f"{base}/rows")
    )
    running.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")


@query("streamed_distinct_events", """
SELECT event_type, count(*) AS events, count(DISTINCT event_id) AS ids FROM events GROUP BY 1""")
def streamed_distinct_events(spark, sf_dir):
    """Events sent twice arrive once."""
    rows = event_stream(spark, sf_dir).select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    once = drained(streams.distinct_events(twice, "1 hour", "ts", "event_id"), "events")
    return once.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("ids")
    )


@query("streamed_reviewer_activity", """
SELECT window_start, reviewer_email, events FROM (
  SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type AS reviewer_email, count(*) AS events
  FROM events GROUP BY 1, 2)
WHERE window_start + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'""")
def streamed_reviewer_activity(spark, sf_dir):
    """Closed windows of the live activity count."""
    rows = event_stream(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("reviewer_email")
    )
    done = drained(streams.reviewer_activity(rows, time="ts"), "activity")
    return done.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "reviewer_email", "events")


# ------------------------------------------------------------ report files
@query("scanned_reports", sql("lines", """
SELECT source AS report_name, count(*) AS findings, count(DISTINCT doc_id || '-' || pos) AS ids,
  count(*) FILTER (WHERE pos % 3 = 0) AS math, CAST(sum(length(split_part(line, ' ', 1))) AS BIGINT) AS letters
FROM lines GROUP BY 1"""))
def scanned_reports(spark, sf_dir):
    """Reports written as HTML files, split card by card on reading, and parsed."""
    cards = derived_cards(spark, sf_dir)
    folder = f"{durable.checkpoint_dir(spark).rstrip('/')}/reports-{uuid.uuid4().hex}"
    pieces = cards.select("report_id", F.concat(F.lit(parse.CARD_START), "card").alias("value"))
    pieces.write.partitionBy("report_id").text(folder)
    _, rows = flows.read_reports(spark, f"{folder}/*/*.txt")
    return rows.select(F.substring_index("breadcrumb", " > ", -1).alias("report_name"), "*").groupBy(
        "report_name"
    ).agg(
        F.count(F.lit(1)).alias("findings"), F.count_distinct("issue_id").alias("ids"),
        F.count_if(F.col("checker") == "check_math").alias("math"),
        F.sum(F.length("original")).alias("letters"),
    )
