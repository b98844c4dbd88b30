"""Tickets, people and workflow runs around a review, as table queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia import fixed
from marginalia.functions import text as tx
from marginalia.functions.rich_text import flatten_rich_text
from marginalia.operators import durable
from marginalia.operators.joins import first_per_key, skew_join

TICKET_SCHEMA = (
    "id string, key string, fields struct<summary: string, status: struct<name: string>, "
    "assignee: struct<displayName: string, accountId: string>, updated: string, "
    "attachment: array<struct<id: string, filename: string, mimeType: string, size: bigint, "
    "content: string>>, description: string>"
)


# ----------------------------------------------------------------- tickets
def normalize_tickets(raw: DataFrame, base_url: str) -> DataFrame:
    """Flat ticket rows from the JSON text column ``raw``."""
    issue = raw.select(F.from_json("raw", TICKET_SCHEMA).alias("i")).select("i.*")
    files = F.transform(
        F.coalesce("fields.attachment", F.array()),
        lambda a: F.struct(
            tx.present(a["id"]).alias("id"),
            F.when(tx.present(a["filename"]) == "", "attachment").otherwise(a["filename"]).alias("filename"),
            tx.present(a["mimeType"]).alias("mime_type"),
            F.coalesce(a["size"], F.lit(0)).alias("size"),
            tx.present(a["content"]).alias("content_url"),
        ),
    )
    key = tx.present(F.col("key"))
    quoted = F.replace(F.url_encode(key), F.lit("+"), F.lit("%20"))
    return issue.withColumn("_flat", flatten_rich_text("fields.description")).select(
        tx.present(F.col("id")).alias("id"), key.alias("key"),
        tx.present(F.col("fields.summary")).alias("summary"),
        tx.present(F.col("fields.status.name")).alias("status"),
        tx.present(F.col("fields.assignee.displayName")).alias("assignee_name"),
        tx.present(F.col("fields.assignee.accountId")).alias("assignee_account_id"),
        tx.present(F.col("fields.updated")).alias("updated"),
        F.col("_flat.text").alias("description"), F.col("_flat.links").alias("links"),
        files.alias("attachments"),
        F.concat(F.lit(f"{base_url}/browse/"), quoted).alias("browse_url"),
    )


def is_html_attachment(attachment: Column) -> Column:
    name = F.lower(tx.present(attachment["filename"]))
    mime = F.lower(tx.present(attachment["mime_type"]))
    return name.endswith(".html") | name.endswith(".htm") | mime.isin(*fixed.HTML_MIME_TYPES)


def is_report_ticket() -> Column:
    """Whether a ticket is about a report: by attachment, run link or wording."""
    wording = tx.fold(F.concat_ws(" ", tx.present(F.col("summary")), tx.present(F.col("description"))))
    by_file = F.exists(F.coalesce("attachments", F.array()), is_html_attachment)
    by_link = F.exists(
        F.coalesce("links", F.array().cast("array<string>")),
        lambda x: tx.found(tx.strip(x), fixed.RUN_LINK, ignore_case=True),
    )
    said = F.contains(wording, F.lit("issue annotation report")) | (
        F.contains(wording, F.lit("qa")) & F.contains(wording, F.lit("report"))
    )
    return F.coalesce(by_file, F.lit(False)) | F.coalesce(by_link, F.lit(False)) | said


def assigned_tickets(tickets: DataFrame, account_id: str, project: str = "",
                     limit: int = 50) -> DataFrame:
    """Open tickets of one account, newest first."""
    rows = tickets.filter(
        (F.col("assignee_account_id") == account_id) & (F.col("status_category") != "Done")
    )
    if project:
        rows = rows.filter(F.col("project_key") == project)
    return rows.orderBy(F.desc("updated"), "key").limit(limit)


def remaining_tickets(tickets: DataFrame, current_key: str) -> DataFrame:
    return tickets.filter((F.col("key") != current_key) & is_report_ticket())


def link_label(link: Column, position: Column) -> Column:
    """Short name of a link: host and last path part."""
    path = tx.present(F.regexp_extract(link, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    host = tx.present(F.regexp_extract(link, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    last = F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
    short = F.regexp_replace(host, r"\Awww\.", "")
    label = F.concat(
        short, F.when((last != "") & (F.length(last) <= 44), F.concat(F.lit(" · "), last)).otherwise("")
    )
    return F.when(label == "", F.concat(F.lit("Ticket link "), position.cast("string"))).otherwise(label)


# ------------------------------------------------------------------ people
def normalize_emails(values: Column) -> Column:
    """Stripped, folded, distinct, in order; blanks dropped."""
    clean = F.transform(values, lambda v: tx.fold(tx.strip(tx.present(v))))
    return F.array_distinct(F.filter(clean, lambda v: v != ""))


def candidates_by_tier(queries: DataFrame, users: DataFrame) -> DataFrame:
    """Active users found for short names, best kind of match only.

    ``queries`` has ``label`` and the ``user_id`` hits of a directory search;
    ``users`` has ``account_id, display_name, active``.  Tiers: full name, first
    name, any word, any hit.
    """
    wanted = tx.fold(tx.strip(F.col("label")))
    name = tx.fold(tx.strip(tx.present(F.col("display_name"))))
    words = F.split(tx.collapse(name), " ", -1)
    tier = (
        F.when(name == wanted, 1)
        .when(F.substring_index(name, " ", 1) == wanted, 2)
        .when(F.array_contains(words, wanted), 3)
        .otherwise(4)
    )
    hits = (
        queries.filter(wanted != "").join(users.filter("active"), "account_id")
        .withColumn("tier", tier).dropDuplicates(["label", "account_id"])
    )
    # best tier by aggregate and join back, so one common name is not one task
    best = hits.groupBy("label").agg(F.min("tier").alias("_best"))
    return hits.join(best, "label").filter(F.col("tier") == F.col("_best")).drop("_best")


def resolve_identities(people: DataFrame, hits: DataFrame, users: DataFrame,
                       searches: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """Account of each signed-in person, or why there is none.

    ``people`` has ``email, name``; ``hits`` the directory hits ``email, account_id,
    query`` ('email' or 'name').  An exact address wins (address search before name
    search), then a sole candidate, then a sole exact name.

    Name searches can be given apart from who made them: ``searches`` has ``email,
    search`` and ``answers`` the hits ``search, account_id``.  Accounts that the same
    searches find under the same names are then one row, whose size and least account
    are all that counts, so a name that many people share forms no pairs of them.
    """
    active = users.filter("active").select(
        "account_id", "display_name", F.col("email").alias("user_email")
    )
    found = hits.join(active, "account_id").join(people.select("email", "name"), "email")
    by_email = tx.fold(tx.strip(tx.present(F.col("user_email")))) == tx.fold(tx.strip(F.col("email")))
    name = tx.fold(tx.strip(tx.present(F.col("name"))))
    by_name = (name != "") & (tx.fold(tx.strip(tx.present(F.col("display_name")))) == name)
    candidates = found.groupBy("email", "account_id").agg(
        F.bool_or(by_email).alias("by_email"), F.bool_or(by_name).alias("by_name"),
        F.min(F.when(F.col("query") == "email", 1).otherwise(2)).alias("stage"),
    ).withColumn("size", F.lit(1))
    if searches is not None:
        candidates = _with_answers(candidates, people, active, searches, answers)
    mail = F.struct("stage", "account_id")
    summary = candidates.groupBy("email").agg(
        F.min_by("account_id", F.when(F.col("by_email"), mail)).alias("_mail"),
        F.count_if("by_email").alias("mails"),
        F.sum("size").alias("candidates"), F.min(F.when(F.col("size") > 0, F.col("account_id"))).alias("_only"),
        F.sum(F.when(F.col("by_name"), F.col("size"))).alias("names"),
        F.min(F.when(F.col("by_name"), F.col("account_id"))).alias("_name"),
    )
    account = (
        F.when(F.col("mails") > 0, F.col("_mail"))
        .when(F.col("candidates") == 1, F.col("_only"))
        .when(F.col("names") == 1, F.col("_name"))
    )
    rows = people.select("email").join(summary, "email", "left").withColumn("account_id", account)
    return rows.select(
        "email", "account_id",
        F.when(F.col("account_id").isNotNull(), "matched")
        .when(F.col("candidates") > 0, "ambiguous").otherwise("none").alias("outcome"),
    )


def _with_answers(candidates: DataFrame, people: DataFrame, active: DataFrame,
                  searches: DataFrame, answers: DataFrame) -> DataFrame:
    """The candidates of each person and, one row per class, those that name searches find.

    A class holds the accounts that the same searches find and that have the same names:
    to a person all of them are candidates or none, and all fit the name or none.
    """
    folded = lambda c: tx.fold(tx.strip(tx.present(F.col(c))))
    known = active.groupBy("account_id").agg(
        F.array_sort(F.collect_set(folded("display_name"))).alias("shown"),
        F.collect_set(folded("user_email")).alias("addresses"),
    )
    found = answers.groupBy("account_id").agg(F.array_sort(F.collect_set("search")).alias("found_by"))
    members = durable.stored(known.join(found, "account_id").select(
        "account_id", "addresses", "found_by", "shown",
        F.sha2(F.to_json(F.struct("found_by", "shown")), 256).alias("class"),
    ), "directory-members")
    classes = members.groupBy("class").agg(
        F.count(F.lit(1)).alias("size"), F.min("account_id").alias("account_id"),
        F.any_value("found_by").alias("found_by"), F.any_value("shown").alias("shown"),
    )
    mine = people.filter(F.col("email").isNotNull()).groupBy("email").agg(
        F.collect_set(folded("name")).alias("called")
    )
    wanted = searches.select("email", "search").distinct()
    reached = durable.stored(
        skew_join(wanted, classes.select("class", F.explode("found_by").alias("search")), ["search"])
        .select("email", "class").distinct().join(mine, "email"), "reached-classes"
    )
    called = F.filter("called", lambda n: n != "")
    whole = skew_join(reached, classes, ["class"]).select(
        "email", "account_id", F.lit(False).alias("by_email"),
        F.arrays_overlap(called, "shown").alias("by_name"), F.lit(2).alias("stage"), "size",
    )
    # the least account of a class under the person's own address
    own = members.select("class", "account_id", F.explode("addresses").alias("address")).groupBy("class", "address").agg(
        F.min("account_id").alias("account_id")
    )
    by_mail = reached.withColumn("address", tx.fold(tx.strip(F.col("email")))).join(own, ["class", "address"]).select(
        "email", "account_id", F.lit(True).alias("by_email"), F.lit(None).cast("boolean").alias("by_name"),
        F.lit(2).alias("stage"), F.lit(0).alias("size"),
    )
    # a candidate that a class of the person holds too counts there
    held = candidates.join(members.select("account_id", "class"), "account_id", "left").join(
        reached.select("email", "class", F.lit(0).alias("_held")), ["email", "class"], "left"
    )
    alone = held.withColumn("size", F.coalesce("_held", "size")).withColumn(
        "by_name", F.when(F.col("size") > 0, F.col("by_name"))
    )
    columns = ["email", "account_id", "by_email", "by_name", "stage", "size"]
    return alone.select(columns).unionByName(whole.select(columns)).unionByName(by_mail.select(columns))


def with_account_override(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """A mapped account (by address or label) replaces the found one."""
    clean = mapping.select(
        tx.fold(tx.strip(F.col("name"))).alias("_key"), tx.strip(F.col("account_id")).alias("_mapped")
    ).filter("_key <> '' AND _mapped <> ''")
    return (
        rows.withColumn("_key", tx.fold(tx.strip(F.col(key))))
        .join(first_per_key(clean, ["_key"], [F.col("_mapped")]), "_key", "left")
        .withColumn("account_id", F.coalesce("_mapped", "account_id")).drop("_key", "_mapped")
    )


def reviewer_accounts(candidates: DataFrame, tickets: DataFrame) -> DataFrame:
    """The one candidate account with tickets per reviewer label, else a choice.

    ``candidates`` has ``label, account_id``.
    """
    owners = tickets.filter(F.col("status_category") != "Done").groupBy(
        F.col("assignee_account_id").alias("account_id")
    ).agg(F.count(F.lit(1)).alias("tickets"))
    rows = candidates.join(owners, "account_id", "left").groupBy("label").agg(
        F.count(F.lit(1)).alias("candidates"), F.count("tickets").alias("owners"),
        F.min(F.when(F.col("tickets").isNotNull(), F.col("account_id"))).alias("_owner"),
        F.min("account_id").alias("_only"),
        F.coalesce(F.sum("tickets"), F.lit(0)).alias("tickets"),
    )
    return rows.select(
        "label", "candidates", "owners", "tickets",
        F.when(F.col("owners") == 1, F.col("_owner"))
        .when(F.col("candidates") == 1, F.col("_only")).alias("account_id"),
    )


# -------------------------------------------------------------------- runs
def run_reference(url: Column) -> Column:
    """``struct<owner, repo, run_id, web_url>`` of a workflow run address, or null."""
    clean = tx.strip(tx.present(url))
    address = r"^(?i:https)://(?:[^@/?#]*@)?(?i:" + "|".join(
        h.replace(".", r"\.") for h in fixed.RUN_HOSTS
    ) + r")(?::\d*)?(/[^?#]*)"
    path = F.rtrim(F.regexp_extract(clean, address, 1), F.lit("/"))

    def reference(place: Column) -> Column:
        part = lambda i: F.regexp_extract(place, tx.py_regex(fixed.RUN_PATH, True), i)
        repo = F.regexp_replace(part(2), r"\.git\z", "")
        web = F.concat(
            F.lit("https://github.com/"), part(1), F.lit("/"), repo, F.lit("/actions/runs/"), part(3)
        )
        return F.when(part(3) != "", F.struct(
            part(1).alias("owner"), repo.alias("repo"), part(3).alias("run_id"), web.alias("web_url")
        ))

    return tx.let(path, reference)


def run_references(tickets: DataFrame) -> DataFrame:
    """Distinct runs per ticket in link order, owner and repository case ignored."""
    links = tickets.select("key", F.posexplode("links").alias("position", "link"))
    refs = links.select("key", "position", run_reference(F.col("link")).alias("r")).filter("r IS NOT NULL")
    keyed = refs.select(
        "key", "position", "r.*", F.lower("r.owner").alias("_o"), F.lower("r.repo").alias("_r")
    )
    return first_per_key(keyed, ["key", "_o", "_r", "run_id"], [F.col("position")]).drop("_o", "_r")


def usable_artifacts(artifacts: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Artifacts with the reason an artifact is skipped (null when usable)."""
    reason = F.when(F.col("expired"), "expired")
    if max_bytes is not None:
        reason = reason.when(F.col("size") > max_bytes, "too large")
    return artifacts.withColumn("skipped", reason)


def ranked_artifacts(artifacts: DataFrame, top: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Artifacts in the order worth opening per run: telling names, then small, then by name.

    ``top`` and ``max_bytes`` are budgets of a caller who opens them one by one; without
    them every artifact that has not expired is ranked.
    """
    name = tx.fold(tx.present(F.col("name")))
    telling = reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in fixed.ARTIFACT_KEYWORDS])
    usable = usable_artifacts(artifacts, max_bytes).filter("skipped IS NULL").drop("skipped")
    order = [F.when(telling, 0).otherwise(1), F.col("size"), name, F.col("id")]
    # rank inside hash slices first: a run with very many artifacts stays spread
    if top is None:
        return usable.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)))
    cut = usable.withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(32)))
    for group in (["run_id", "_slice"], ["run_id"]):
        cut = cut.withColumn(
            "rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        ).filter(F.col("rank") <= top)
    return cut.drop("_slice")


def reports_in_runs(ranked: DataFrame, members: DataFrame) -> DataFrame:
    """Report files of the first ranked artifact that holds any, per run."""
    holding = ranked.join(members.select(F.col("artifact_id").alias("id")).distinct(), "id", "left_semi")
    first = first_per_key(holding.select("run_id", "id", "rank"), ["run_id"], [F.col("rank")])
    return first.select("run_id", F.col("id").alias("artifact_id")).join(members, "artifact_id")


def report_sources(tickets: DataFrame, loaded: DataFrame) -> DataFrame:
    """Where to load each ticket's report from.

    An HTML attachment goes before a run link, several attachments need a choice, and a
    source that is loaded already is not loaded again.
    """
    files = tickets.select(
        "key", F.posexplode(F.filter("attachments", is_html_attachment)).alias("position", "a")
    ).select(
        "key", F.lit(1).alias("priority"), "position",
        F.concat(F.lit("ticket:"), "key", F.lit(":"), "a.id").alias("source_key"),
        F.col("a.filename").alias("label"),
    )
    runs = run_references(tickets).select(
        "key", F.lit(2).alias("priority"), "position",
        F.concat_ws(":", "key", "owner", "repo", "run_id").alias("source_key"),
        F.col("web_url").alias("label"),
    )
    offers = files.unionByName(runs)
    files_first = F.count_if(F.col("priority") == 1)
    grouped = offers.groupBy("key").agg(
        F.min("priority").alias("priority"),
        F.when(files_first > 0, files_first).otherwise(F.count(F.lit(1))).alias("offers"),
        F.min(F.struct("priority", "position", "source_key", "label")).alias("_first"),
    )
    rows = grouped.select("key", "priority", "offers", "_first.source_key", "_first.label")
    known = loaded.select("source_key", F.lit(True).alias("_loaded")).distinct()
    action = (
        F.when(F.col("offers") > 1, "choose")
        .when(F.col("_loaded"), "already loaded").otherwise("load")
    )
    return rows.join(known, "source_key", "left").withColumn("action", action).drop("_loaded")


# ---------------------------------------------------------------- hand-off
def handoff_name(report_name: Column, content: Column, kind: str = "FINAL",
                 extension: str = "csv") -> Column:
    """File name carrying a short content hash, so that a retry finds its own file."""
    short = F.substring(F.sha2(content, 256), 1, 10)
    return F.concat(report_name, F.lit(f"_{kind}_"), short, F.lit(f".{extension}"))


def pending_actions(completed: DataFrame, tickets: DataFrame, comments: DataFrame) -> DataFrame:
    """Hand-off steps a ticket does not show yet.

    ``completed`` has ``report_id, key, filename, marker, target_account,
    target_status``; ``comments`` has ``key, body``.
    """
    rows = completed.join(
        tickets.select("key", "status", "assignee_account_id", "attachments"), "key", "left"
    )
    commented = (
        comments.join(completed.select("key", "marker"), "key")
        .filter(F.contains(F.col("body"), F.col("marker"))).select("key", "marker").distinct()
        .withColumn("_commented", F.lit(True))
    )
    rows = rows.join(commented, ["key", "marker"], "left")
    attached = F.coalesce(
        F.exists("attachments", lambda a: a["filename"] == F.col("filename")), F.lit(False)
    )
    wants_comment = tx.present(F.col("marker")) != ""
    steps = F.array_compact(F.array(
        F.when(~attached, F.lit("attach")),
        F.when(wants_comment & F.col("_commented").isNull(), F.lit("comment")),
        F.when(~F.equal_null("assignee_account_id", "target_account"), F.lit("assign")),
        F.when(
            ~F.equal_null(tx.fold(tx.present(F.col("status"))), tx.fold(F.col("target_status"))),
            F.lit("transition"),
        ),
    ))
    return rows.select("report_id", "key", F.posexplode(steps).alias("step_order", "step"))
