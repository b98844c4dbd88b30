"""End-to-end flows, files and streams."""

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from marginalia import fixed
from marginalia.operators import library, merging, review, tickets
from marginalia.operators import rulebook as rb
from marginalia.plans import flows
from marginalia.plans.store import Store, StoreConflict
from marginalia.sinks import exports
from marginalia.sources import portable, sheets
from marginalia.streaming import flows as streams

from test_parse import HEAD, card, change, issue

REVIEW = "report_id string, issue_id string, decision string, review_note string"
BEFORE, AFTER = "Every student writes a long sentence with ", " in the middle of it."


def report(*ids, word="blorfword", extra=""):
    diff = BEFORE + change(word, "blurb") + AFTER
    return HEAD + extra + "".join(card(i, [issue(f"{n}", word, "blurb")], diff) for i, n in enumerate(ids))


def test_library_life_cycle(spark, tmp_path):
    """Upload, review, publish, reuse in another report, learn, upload again."""
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir(), two.mkdir()
    (one / "alpha_review.html").write_text(report("a1", "a2"))
    (one / "empty.html").write_text("<html></html>")
    store = Store(spark, str(tmp_path / "store"))
    book = rb.default(spark)
    first = flows.ingest(store, str(one), book, F.lit("2024-01-01T00:00:00+00:00"))
    assert [r["filename"] for r in first["rejected"].collect()] == ["empty.html"]
    findings, reviews = first["findings"], first["reviews"]
    assert {r["status"] for r in findings.collect()} == {fixed.NEEDS_CHANGE}
    assert {r["decision"] for r in reviews.collect()} == {""}
    stored = store.read("reports").first()
    assert (stored["report_name"], stored["finding_count"], stored["reviewable_count"], stored["upload_count"]) == ("alpha", 2, 2, 1)

    done = reviews.select(*review.KEY, F.lit("R").alias("decision"), F.lit("").alias("review_note"))
    assert tuple(first["counts"].first())[1:] == (2, 2) and first["newly"].count() == 0
    published = flows.publish(store, findings, done, book, F.lit("2024-01-02T00:00:00+00:00"), "Me@x.test")
    events = store.read("review_events").collect()
    assert sorted((r["action"], r["decision"], r["reviewer_email"]) for r in events) == [
        ("publish_decisions", "", "me@x.test"), ("save_decisions", "rejected", "me@x.test"), ("save_decisions", "rejected", "me@x.test")]
    flows.save_drafts(store, done, F.lit("2024-01-03T00:00:00+00:00"), "me@x.test")
    assert store.read("review_events").count() == 3  # nothing has changed since
    assert tuple(published["counts"].first())[1:] == (2, 0, 0)
    assert store.read("observations").count() == 2 and store.read("draft_reviews").count() == 2
    # the store opened again: saved drafts come before memory
    again = flows.reopen(store, store.read("reports"), book)["reviews"]
    assert {r["decision"] for r in again.collect()} == {"rejected"}

    (two / "beta.html").write_text(report("b1", extra="<p>state edition</p>"))
    second = flows.ingest(store, str(two), published["book"], F.lit("2024-02-01T00:00:00+00:00"))
    # two courses share the rejected term now, so the rule layer answers
    assert [r["original"] for r in second["active"].collect()] == ["blorfword"]
    assert [r["original"] for r in second["newly"].collect()] == ["blorfword"]
    assert store.read("active_rules").count() == 1
    again = flows.refresh(store, published["book"])
    assert again[3].count() == 0  # known from the last refresh
    assert {r["comment"] for r in second["findings"].collect()} == {fixed.COMMENTS["protected"]}
    plain = flows.reopen(store, store.read("reports").filter("filename = 'beta.html'"), book)
    match = plain["reviews"].first()
    assert (match["decision"], match["memory_match"], match["memory_source"]) == ("rejected", "exact", "alpha_review.html")

    flows.ingest(store, str(one), book, F.lit("2024-03-01T00:00:00+00:00"))
    row = store.read("reports").filter("report_name = 'alpha'").first()
    assert (row["upload_count"], row["first_uploaded_at"], row["last_uploaded_at"]) == (
        2, "2024-01-01T00:00:00+00:00", "2024-03-01T00:00:00+00:00")
    assert store.read("report_findings").count() == 3
    relabelled = flows.reclassify_library(store.read("report_findings"), book)
    assert {r["status"] for r in relabelled.collect()} == {fixed.NEEDS_CHANGE}

    # portable export and import into an empty deployment
    data = {n: store.read(n) for n in merging.COLLECTIONS}
    portable.write_export(data, str(tmp_path / "export"), "2024-03-02T00:00:00+00:00")
    back = portable.read_export(spark, str(tmp_path / "export"))
    empty = Store(spark, str(tmp_path / "other"))
    merged = merging.merge({n: empty.read(n) for n in merging.COLLECTIONS}, back)
    for name in merging.COLLECTIONS:
        assert sorted(map(str, merged[name].collect())) == sorted(map(str, data[name].collect())), name
    ordered = portable.ordered_export(back)["report_findings"].select("finding_order").collect()
    assert len(ordered) == 3


def test_single_document_import(spark, tmp_path):
    path = tmp_path / "memory.json"
    event = dict.fromkeys(library.EVENT_FIELDS, "x")
    document = {"schema_version": 3, "fingerprint_version": 1, "exported_at": "t", "observations": [],
                "reports": [], "report_findings": [], "draft_reviews": [], "jira_links": [], "review_events": [event]}
    path.write_text(json.dumps(document, indent=2))
    assert portable.read_document(spark, str(path))["review_events"].first().asDict() == event
    for change_ in ({"schema_version": 9}, {"fingerprint_version": 2}, {"review_events": [{"event_id": "x"}]}):
        path.write_text(json.dumps({**document, **change_}))
        with pytest.raises(library.LibraryError):
            portable.read_document(spark, str(path))


def classified(spark, *items):
    names = ["report_id", *fixed.DETAIL_FIELDS, "finding_order"]
    rows = [tuple({**dict.fromkeys(fixed.DETAIL_FIELDS, ""), **item}.get(n, i) for n in names)
            for i, item in enumerate(items)]
    ddl = ", ".join(f"{n} {'long' if n == 'finding_order' else 'string'}" for n in names)
    return spark.createDataFrame(rows, ddl)


def read_csv(folder):
    files = sorted(folder.glob("*.csv"))
    rows = []
    for file in files:
        text = file.read_bytes().decode()
        assert text.endswith("\r\n")
        rows += list(csv.reader(text.splitlines()))[1:]
    return rows


def test_csv_exports_and_sheet_import(spark, tmp_path):
    findings = classified(
        spark,
        dict(report_id="r", issue_id="1", status="needs_change", checker="check_spelling", original='say "hi"',
             comment="No confidence signal is available."),
        dict(report_id="r", issue_id="2", status="approved", checker="check_links", comment="x"),
        dict(report_id="r", issue_id="3", status="needs_change", checker="check_math"),
    )
    reviews = spark.createDataFrame([("r", "1", "rejected", "This is a valid term.")], REVIEW)
    exports.write_package(findings, reviews, rb.default(spark), str(tmp_path / "p"))
    final = read_csv(tmp_path / "p/final/report_id=r")
    assert final == [["1", "rejected", "This is a valid term."], ["2", "approved", ""], ["3", "needs_change", ""]]
    flagged = read_csv(tmp_path / "p/flagged_for_review/report_id=r")
    assert [r[:3] for r in flagged] == [["rejected", "This is a valid term.", "1"], ["", "", "3"]]
    assert flagged[0][7] == 'say "hi"'
    raw = next((tmp_path / "p/detailed/report_id=r").glob("*.csv")).read_text().splitlines()
    assert raw[0].startswith('"issue_id","status"') and '"say ""hi"""' in raw[1]
    rules = json.loads("".join(f.read_text() for f in (tmp_path / "p/rules_used").glob("*.txt")))
    assert rules["schema_version"] == 1 and len(rules["exact_rules"]) == len(fixed.EXACT_RULES)

    sheet = tmp_path / "sheet.csv"
    sheet.write_text('﻿"Your call","issue_id","review_note"\r\n"R","1","a ""b"""\r\n"","3",""\r\n"a","2",""\r\n'
                     '"x\ny","3",""\r\n"a","zz",""\r\n')
    rows, column = sheets.read_review_sheet(spark, str(sheet), "r")
    assert column == "Your call"
    applied, unmatched = review.import_sheet(rows, findings, column)
    assert {r["issue_id"]: (r["decision"], r["review_note"]) for r in applied.collect()} == {
        "1": ("rejected", 'a "b"'), "3": ("needs_change", "x\ny")}
    assert sorted(r["issue_id"] for r in unmatched.collect()) == ["2", "zz"]
    sheet.write_text("decision\na\n")
    with pytest.raises(sheets.SheetError):
        sheets.read_review_sheet(spark, str(sheet), "r")


def test_review_views(spark):
    findings = classified(
        spark, dict(report_id="r", issue_id="1", status="needs_change", checker="check_links", context_before="b",
                    context_after="a", node_label="Task 7", original="Desmos"),
        dict(report_id="r", issue_id="2", status="needs_change", checker="check_math", breadcrumb="Unit 1"))
    reviews = spark.createDataFrame(
        [("r", "1", "", "", "near", 0.985), ("r", "2", "kept", "", None, None)],
        REVIEW + ", memory_match string, memory_score double")
    frame = {r["issue_id"]: r for r in review.review_frame(findings, reviews).collect()}
    assert (frame["1"]["context"], frame["1"]["location"], frame["1"]["match_quality"]) == ("b  ‹CHANGE›  a", "Task 7", "Near 98%")
    assert (frame["2"]["location"], frame["2"]["match_quality"]) == ("Unit 1", "")
    shown = review.search(review.review_frame(findings, reviews), " DESMOS task", None)
    assert shown.count() == 0 and review.search(review.review_frame(findings, reviews), "desmos", ["check_links"]).count() == 1
    merged = {r["issue_id"]: r["status"] for r in review.apply_reviews(findings, reviews).collect()}
    assert merged == {"1": "approved", "2": "needs_change"}
    memory = spark.createDataFrame([("r", i, "rejected", "", "C", 2, "exact", 1.0) for i in "12"],
                                   REVIEW + ", memory_source string, memory_evidence long, memory_match string, memory_score double")
    filled = {r["issue_id"]: (r["decision"], r["memory_match"]) for r in review.prefill(reviews, memory).collect()}
    assert filled == {"1": ("rejected", "exact"), "2": ("kept", None)}


def test_report_stream_equals_batch(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    book = rb.default(spark)
    (inbox / "a.html").write_text(report("a1", "a2"))
    streams.ingest_stream(spark, str(inbox), book, out, mark).awaitTermination()
    (inbox / "b.html").write_text(report("b1", word="blorfwords"))
    streams.ingest_stream(spark, str(inbox), book, out, mark).awaitTermination()
    got = spark.read.parquet(out).drop("batch")
    _, raw = flows.read_reports(spark, str(inbox))
    from marginalia.operators import classify as cl
    batch = cl.classify(raw, book, "finding_order")
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.select(*got.columns).collect()))
    assert got.count() == 3


def test_streams_keep_cards_of_irregular_files(spark, tmp_path):
    """The delimiter stands inside a card of one file; batch and both streams give all findings."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    book = rb.default(spark)
    odd = HEAD + card(1, [issue("id0", "blorfword", "blurb")]) + card(
        2, [issue("id1", "blorfword", "blurb")], extra='<div class="issue-card" id="annotation-card-x"></div>'
    ) + card(3, [issue("id2", "blorfword", "blurb")])
    (inbox / "odd.html").write_text(odd)
    (inbox / "copy.html").write_text(odd)
    (inbox / "plain.html").write_text(report("p1"))
    _, raw = flows.read_reports(spark, str(inbox))
    want = ["id0", "id1", "id2", "p1"]
    assert sorted(r["issue_id"] for r in raw.collect()) == want
    streams.ingest_stream(spark, str(inbox), book, str(tmp_path / "out"), str(tmp_path / "m1")).awaitTermination()
    assert sorted(r["issue_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    store = Store(spark, str(tmp_path / "store"))
    streams.store_stream(store, str(inbox), book, str(tmp_path / "m2")).awaitTermination()
    assert sorted(r["issue_id"] for r in store.read("report_findings").collect()) == want
    (inbox / "again.html").write_text(report("p1"))  # a copy of a stored report, and a new one
    (inbox / "new.html").write_text(report("n1", word="blorfwords"))
    streams.store_stream(store, str(inbox), book, str(tmp_path / "m2")).awaitTermination()
    assert sorted(r["issue_id"] for r in store.read("report_findings").collect()) == sorted([*want, "n1"])
    assert store.read("reports").count() == 3


def stored_finding(store, report_id, issue_id, text="x"):
    names = store._schema("report_findings")
    values = {f.name: (0 if f.dataType.simpleString() == "bigint" else "") for f in names.fields}
    values |= {"report_id": report_id, "issue_id": issue_id, "finding_id": f"{report_id}-{issue_id}", "original": text}
    return store.spark.createDataFrame([tuple(values[f.name] for f in names.fields)], names)


def test_store_appends_and_replaces(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read("report_findings").count() == 0
    for report in ("a", "b", "c"):
        store.store_findings(stored_finding(store, report, "1").unionByName(stored_finding(store, report, "2")))
    written = [p for p in (tmp_path / "s" / "report_findings").glob("gen-*")]
    assert len(written) == 3
    # Each upload has written its own rows only.
    assert [spark.read.parquet(str(p)).count() for p in sorted(written)] == [2, 2, 2]
    store.store_findings(stored_finding(store, "b", "9", "new"))
    rows = {(r["report_id"], r["issue_id"]) for r in store.read("report_findings").collect()}
    assert rows == {("a", "1"), ("a", "2"), ("b", "9"), ("c", "1"), ("c", "2")}
    store.compact()
    assert {(r["report_id"], r["issue_id"]) for r in store.read("report_findings").collect()} == rows
    assert store.read("finding_generations").select("generation").distinct().count() == 1


def test_two_writers_cannot_both_win(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    terms = lambda *t: spark.createDataFrame([(x,) for x in t], "term string")
    one.write("learned_terms", terms("a"))
    one.read("learned_terms"), two.read("learned_terms")
    one.write("learned_terms", terms("a", "b"))
    with pytest.raises(StoreConflict):
        two.write("learned_terms", terms("a", "c"))
    assert {r[0] for r in two.read("learned_terms").collect()} == {"a", "b"}
    two.write("learned_terms", terms("a", "b", "c"))  # after reading again
    broken = terms("x").withColumn("term", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        two.write("learned_terms", broken)
    assert two.write("learned_terms", terms("d")).count() == 1  # the failed write left nothing


def test_dead_writers_do_not_block_a_table(spark, tmp_path):
    base = str(tmp_path / "s")
    terms = lambda *t: spark.createDataFrame([(x,) for x in t], "term string")
    Store(spark, base).write("learned_terms", terms("a"))
    for number in (1, 2):  # two writers have died, the second after the first claim had expired
        claim = tmp_path / "s" / "learned_terms" / f"claim-{number:08d}"
        claim.write_text("application-gone")
        old = claim.stat().st_mtime - 7200
        os.utime(claim, (old, old))
    with pytest.raises(StoreConflict, match="being written"):
        Store(spark, base).write("learned_terms", terms("b"))
    store = Store(spark, base, expires=3600)
    assert {r[0] for r in store.write("learned_terms", terms("b")).collect()} == {"b"}
    assert store._latest("learned_terms") == 3
    # The first writer was only slow: its claim is void, and nothing of it stays.
    slow = Store(spark, base)
    slow._seen["learned_terms"], slow._claimed = 0, lambda name, number: 1
    with pytest.raises(StoreConflict, match="expired"):
        slow._append("learned_terms", terms("late"))
    assert {r[0] for r in Store(spark, base).write("learned_terms", terms("c")).collect()} == {"c"}
    assert sorted(Store(spark, base)._generations("learned_terms")) == [0, 3, 4]


TICKET = {
    "id": 7, "key": "K-42", "fields": {
        "summary": "Work", "status": {"name": "Open"}, "assignee": None, "updated": "2024",
        "attachment": [{"id": 1, "filename": "Report.HTM", "size": 5}],
        "description": {"type": "doc", "content": [
            {"type": "paragraph", "content": [{"type": "text", "text": " see https://x.test/a). "},
                                              {"type": "text", "text": "here", "marks": [{"attrs": {"href": "https://x.test/a"}}]}]},
            {"type": "card", "attrs": {"url": "https://github.com/O/r.git/actions/runs/9/job/1"}}]}}}


def test_tickets(spark):
    raw = spark.createDataFrame([(json.dumps(TICKET),), (json.dumps({"key": "K 1", "fields": {"description": "plain QA"}}),)], "raw string")
    rows = tickets.normalize_tickets(raw, "https://t.test").collect()
    one, two = rows
    assert one["description"] == "see https://x.test/a). here"
    assert one["links"] == ["https://x.test/a", "https://github.com/O/r.git/actions/runs/9/job/1"]
    assert (one["assignee_account_id"], one["attachments"][0]["mime_type"], one["id"]) == ("", "", "7")
    assert (two["description"], two["browse_url"], two["attachments"]) == ("plain QA", "https://t.test/browse/K%201", [])
    df = tickets.normalize_tickets(raw, "https://t.test")
    about = {r[0]: r[1] for r in df.select("key", tickets.is_report_ticket()).collect()}
    assert about == {"K-42": True, "K 1": False}
    run = tickets.run_references(df).first()
    assert (run["owner"], run["repo"], run["run_id"]) == ("O", "r", "9")
    urls = spark.createDataFrame([("http://github.com/a/b/actions/runs/1",), ("https://www.GitHub.com/a/b/actions/runs/1/",),
                                  ("https://evil.test/a/b/actions/runs/1",), ("https://github.com/a/b/actions/runs/x",), (None,)], "u string")
    got = [r[0] for r in urls.select(tickets.run_reference(F.col("u"))).collect()]
    assert [g and g["run_id"] for g in got] == [None, "1", None, None, None]


def test_people(spark):
    users = spark.createDataFrame([
        ("1", "Steve Reviewer", "s@x.test", True), ("2", "Stephen Reviewer", "", True), ("3", "Steve Former", "", False),
        ("4", "Same Person", "", True), ("5", "same person", "", True),
    ], "account_id string, display_name string, email string, active boolean")
    hits = spark.createDataFrame([("Steve", "1"), ("Steve", "2"), ("Steve", "3"), ("zoe", "2")], "label string, account_id string")
    got = {(r["label"], r["account_id"]) for r in tickets.candidates_by_tier(hits, users).collect()}
    assert got == {("Steve", "1"), ("zoe", "2")}
    people = spark.createDataFrame([("S@x.test", "nobody"), ("h@x.test", "Same Person"), ("n@x.test", "None"), ("o@x.test", "Other")],
                                   "email string, name string")
    found = spark.createDataFrame([("S@x.test", "1", "email"), ("S@x.test", "2", "name"), ("h@x.test", "4", "name"),
                                   ("h@x.test", "5", "name"), ("n@x.test", "3", "name"), ("o@x.test", "2", "email")],
                                  "email string, account_id string, query string")
    out = {r["email"]: (r["account_id"], r["outcome"]) for r in tickets.resolve_identities(people, found, users).collect()}
    assert out == {"S@x.test": ("1", "matched"), "h@x.test": (None, "ambiguous"), "n@x.test": (None, "none"), "o@x.test": ("2", "matched")}


def test_rows_of_a_file_with_few_splits_go_to_tasks_of_a_bounded_size(spark, tmp_path):
    from marginalia.plans import bridge

    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    rows = bridge.table(spark, str(tmp_path), "t")
    many = bridge.spread(rows, 50)
    assert many.rdd.getNumPartitions() == 20 and many.distinct().count() == 1000
    assert bridge.spread(rows, 1000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_name_searches_give_the_same_accounts_as_their_pairs(spark):
    shown = ["Ann Lee", "ann lee", " Ann Lee", "Bo", "Bo", "", None, "Cy"]
    users = spark.createDataFrame(
        [(f"a{i % 9}" if i % 10 else None, shown[i % 8], [f"P{i % 6}@x.test ", "", None][i % 3], i % 7 != 3) for i in range(40)],
        "account_id string, display_name string, email string, active boolean")
    people = spark.createDataFrame(
        [(f"p{i % 11}@x.test" if i % 12 else None, shown[i % 5] if i % 4 else ["Other", "", None, "Cy"][i % 3]) for i in range(30)],
        "email string, name string")
    by_mail = spark.createDataFrame(
        [(f"p{i}@x.test", f"a{i * 2 % 9}", "email") for i in range(0, 11, 2)] + [("p1@x.test", "a3", "name")],
        "email string, account_id string, query string")
    searches = people.select("email", F.lower("name").alias("search"))
    answers = users.select(F.lower("display_name").alias("search"), "account_id")
    pairs = searches.join(answers, "search").select("email", "account_id", F.lit("name").alias("query"))
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    whole = order(tickets.resolve_identities(people, by_mail.unionByName(pairs), users))
    assert {r[2] for r in whole} == {"matched", "ambiguous", "none"} and len(whole) == 30
    assert order(tickets.resolve_identities(people, by_mail, users, searches, answers)) == whole


def test_handoff_steps(spark):
    df = spark.createDataFrame([("K-1", "Ready", "qa", [("done_FINAL_1.csv",)])],
                               "key string, status string, assignee_account_id string, attachments array<struct<filename: string>>")
    completed = spark.createDataFrame(
        [("r1", "K-1", "done_FINAL_1.csv", "[m1]", "qa", "ready"), ("r2", "K-1", "other.csv", "[m2]", "me", "Done")],
        "report_id string, key string, filename string, marker string, target_account string, target_status string")
    comments = spark.createDataFrame([("K-1", "text [m1]")], "key string, body string")
    got = {}
    for r in tickets.pending_actions(completed, df, comments).collect():
        got.setdefault(r["report_id"], []).append(r["step"])
    assert got == {"r2": ["attach", "comment", "assign", "transition"]}
    name = spark.range(1).select(tickets.handoff_name(F.lit("x"), F.lit("abc"))).first()[0]
    assert name == "x_FINAL_ba7816bf8f.csv"


def test_a_text_is_split_into_lines_once(spark, tmp_path):
    from marginalia.plans import bridge

    spark.createDataFrame([(1, "a\nb\n\nc", "s", "en", 6), (2, "", "s", "en", 0), (None, None, None, None, None)],
                          "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = bridge.lines(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["pos"], r["line"], r["prev"], r["next"]) for r in rows.collect()) == [
        (1, 0, "a", "", "b"), (1, 1, "b", "a", ""), (1, 2, "", "b", "c"), (1, 3, "c", "", ""), (2, 0, "", "", "")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_stored_rows_are_read_by_small_tasks_without_a_shuffle(spark):
    from marginalia.operators import durable
    from marginalia.plans import bridge

    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(900)), lambda i: F.sha2(F.concat("id", i).cast("string"), 512)))
    stored = durable.stored(spark.range(1000, numPartitions=1).withColumn("t", text), "texts", 50)
    assert stored.rdd.getNumPartitions() < 20
    name = "spark.sql.files.minPartitionNum"
    with bridge.reading_in_tasks(stored, 50) as rows:
        again = rows.select("*")
        parts = again.rdd.glom().map(len).collect()
        assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
    assert sum(parts) == 1000 and max(parts) <= 100 and spark.conf.get(name, None) is None
