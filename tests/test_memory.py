"""Decision memory: reuse, publishing, merging, learning."""

import json
import random
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia import fixed
from marginalia.functions.signature import with_signature
from marginalia.operators import joins, learning, library, memory, merging, near
from marginalia.operators import rulebook as rb

ROW = (
    "report_id string, issue_id string, status string, checker string, field string, original string, "
    "proposed string, context_before string, context_after string, breadcrumb string, node_label string"
)
REVIEW = "report_id string, issue_id string, decision string, review_note string"
def now():
    return F.lit("2024-01-01T00:00:00+00:00")


def row(report, issue, before="", after="", **more):
    base = dict(report_id=report, issue_id=issue, status="needs_change", checker="check_capitalization",
                field="body_value", original="i", proposed="I", context_before=before, context_after=after,
                breadcrumb="Unit 2 > Lesson 4", node_label="Task")
    return tuple({**base, **more}.values())


def rows(spark, *items):
    return spark.createDataFrame(list(items), ROW)


def publish(spark, findings, *reviews):
    names = findings.select("report_id", F.concat(F.lit("Course "), "report_id").alias("source_report")).distinct()
    return memory.observations_from_reviews(
        findings, spark.createDataFrame(list(reviews), REVIEW), names, now()
    )


def matched(df):
    return {r["issue_id"]: r for r in df.collect()}


LONG = (
    "Students compare two strategies and explain why the relation between the quantities remains "
    "constant throughout the activity. "
)
TAIL = "They record the conclusion in their workbook."
URL_A = "Open https://a.test/old and item 44365624-cc6f-11ef-a9a4-066a39b724af before "
URL_B = "Open https://b.test/new/x and item EE4874C3-24fc-11ef-aff7-02fe2bddb0a9 before "


def test_exact_near_conflict_and_notes(spark):
    source = rows(
        spark, row("a", "1", URL_A, " the same sentence continues here."), row("a", "2", LONG, TAIL),
        row("a", "3", "A long identical sentence before.", "And after."),
        row("b", "3", "A long identical sentence before.", "And after."),
        row("a", "4", "Some other long context before", "and after", original="k"),
        row("a", "5", breadcrumb="", node_label=""),
        row("a", "6", "Yet another long context before", "and after", original="m"),
        row("b", "6", "Yet another long context before", "and after", original="m"),
    )
    seen = publish(
        spark, source, ("a", "1", "R", ""), ("a", "2", "approved", ""), ("a", "3", "a", ""), ("b", "3", "r", ""),
        ("a", "4", "rejected", "Human review confirmed that this is a valid term."), ("a", "5", "a", ""),
        ("a", "6", "use a comma", ""), ("b", "6", "use a colon", ""),
    )
    assert seen.count() == 7  # the unanchored finding is not published
    target = rows(
        spark, row("t", "exact", URL_B, " the same sentence continues here."),
        row("t", "near", LONG.replace("the activity", "the State activity"), TAIL),
        row("t", "far", LONG[:60], TAIL), row("t", "conflict", "A long identical sentence before.", "And after."),
        row("t", "note", "Some other long context before", "and after", original="k"),
        row("t", "two notes", "Yet another long context before", "and after", original="m"),
        row("t", "done", URL_A, " the same sentence continues here.", status="approved"),
    )
    got = matched(memory.match(target, seen))
    assert set(got) == {"exact", "near", "note"}
    assert (got["exact"]["decision"], got["exact"]["memory_match"], got["exact"]["memory_score"]) == ("rejected", "exact", 1.0)
    assert got["exact"]["memory_source"] == "Course a" and got["exact"]["memory_evidence"] == 1
    assert got["near"]["memory_match"] == "near" and 0.97 <= got["near"]["memory_score"] < 1
    assert got["note"]["review_note"] == "this is a valid term."
    assert memory.memory_stats(seen).first()["conflicts"] == 1
    exact = matched(memory.match_exact(target, seen))
    assert set(exact) == {"exact", "note"}


def brute_force(targets, observations, threshold=0.97):
    out = {}
    for t in targets:
        mine = [o for o in observations if o["core_key"] == t["core_key"]]
        same = [o for o in mine if o["fingerprint"] == t["fingerprint"]]
        agreed = agree(same)
        if agreed:
            out[t["issue_id"]] = (*agreed, "exact", 1.0)
            continue
        scored = [(SequenceMatcher(None, t["anchor"], o["anchor"]).ratio(), o) for o in mine
                  if o["anchor_kind"] == t["anchor_kind"]]
        scored = [s for s in scored if s[0] >= threshold]
        if scored:
            best = max(s for s, _ in scored)
            agreed = agree([o for s, o in scored if s >= best - 0.005])
            if agreed:
                out[t["issue_id"]] = (*agreed, "near", round(best, 4))
    return out


def agree(observations):
    statuses = {o["status"] for o in observations}
    notes = {o["note"] for o in observations} - {""}
    if len(statuses) != 1 or (statuses == {"needs_change"} and len(notes) != 1):
        return None
    note = notes.pop() if len(notes) == 1 else ""
    return statuses.pop(), note, ", ".join(sorted({o["source_report"] for o in observations})), len(observations)


def near_copies(seed, threshold):
    rng = random.Random(seed)
    words = "angle area line graph unit slope point value table number share equal group ratio".split()
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (5, 6, 8, 12, 20, 20, 26, 30)]

    def edited(text):
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            i = rng.randrange(len(text))
            text = rng.choice([text[:i] + text[i + 1:], text[:i] + rng.choice("xyz ") + text[i:],
                               text[:i] + rng.choice(words) + text[i:]])
        return text

    def split(text):
        return text[: len(text) // 2], text[len(text) // 2:]

    source, reviews, target = [], [], []
    for i in range(90):
        source.append(row(f"r{i % 3}", f"s{i}", *split(edited(rng.choice(texts))), original=rng.choice("ij")))
        note = rng.choice(["", "This is a valid term.", "replace it"])
        reviews.append((f"r{i % 3}", f"s{i}", rng.choice(["a", "a", "a", "r", "needs change: fix it"]), note))
    for i in range(90):
        target.append(row("t", f"t{i}", *split(edited(rng.choice(texts))), original=rng.choice("ij")))
    return source, reviews, target


@pytest.mark.parametrize("seed, threshold, hot", [(1, 0.97, False), (2, 0.9, True)])
def test_near_matches_equal_brute_force(spark, monkeypatch, seed, threshold, hot):
    if hot:  # every repeated key counts as hot and is split
        monkeypatch.setattr(joins, "HOT_ROWS", 2)
    source, reviews, target = near_copies(seed, threshold)
    seen = publish(spark, rows(spark, *source), *reviews)
    targets = rows(spark, *target)
    signed = [r for r in with_signature(targets).collect() if r["fingerprint"]]
    expected = brute_force(signed, seen.collect(), threshold)
    got = {
        k: (r["decision"], r["review_note"], r["memory_source"], r["memory_evidence"], r["memory_match"], r["memory_score"])
        for k, r in matched(memory.match(targets, seen, threshold)).items()
    }
    assert any(v[4] == "near" for v in expected.values()) and any(v[4] == "exact" for v in expected.values())
    assert got == expected


@pytest.mark.parametrize("held_chars, part_chars", [(1 << 20, 2 << 20), (300, 500), (1, 1)])
def test_near_copies_in_small_parts_lose_no_pair(spark, monkeypatch, held_chars, part_chars):
    monkeypatch.setattr(near, "PART_CHARS", part_chars)
    plain = near.near_copies
    monkeypatch.setattr(near, "near_copies", lambda *a: plain(*a, held_chars=held_chars))
    source, _, target = near_copies(3, 0.9)
    columns = ("fingerprint", "core_key", "anchor_kind", "anchor")
    known, probes = (
        with_signature(rows(spark, *items)).filter("fingerprint <> ''").select(*columns).distinct() for items in (source, target)
    )
    pairs = memory.near_pairs(probes, known, 0.9).collect()
    expected = {}
    for p in probes.collect():
        for k in known.collect():
            score = SequenceMatcher(None, p["anchor"], k["anchor"]).ratio()
            if p[1:3] == k[1:3] and score >= 0.9:
                expected[p["fingerprint"], k["fingerprint"]] = (score, round(score, 4))
    assert len(pairs) == len(expected) > 90 and {(r[0], r[1]): (r[2], r[3]) for r in pairs} == expected


@pytest.mark.parametrize("hits", [1 << 20, 50, 1])
def test_near_copies_of_long_repetitive_and_short_texts(monkeypatch, hits):
    monkeypatch.setattr(near, "HITS", hits)
    texts = ["a" * 300, "a" * 296, "ab" * 150, "ab" * 148, "", "a", "abcdefg", "abcdefgh", "abcdefghi", "é" * 40 + "\U0001f600",
             "\U0001f600" + "é" * 40, "one line of words that is here twice " * 8, "one line of words that is here twice " * 8 + "!"]
    columns = [[t] * len(texts) * 2 for t in ("c", "context", 0, 0)]
    side = [False] * len(texts) + [True] * len(texts)
    names = [f"{s}{i}" for s in "kp" for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, side, names, texts * 2)], names=list("abcdefg"))
    for threshold in (0.97, 0.9, 0.7):
        got = {(r["fingerprint"], r["known_fingerprint"]): r["score"]
               for out in near.near_copies(threshold)(iter([batch])) for r in out.to_pylist()}
        scores = {(f"p{i}", f"k{j}"): SequenceMatcher(None, a, b).ratio() for i, a in enumerate(texts) for j, b in enumerate(texts)}
        size = near.gram_size(threshold)
        assert got == {k: s for k, s in scores.items() if s >= threshold and len(texts[int(k[0][1:])]) >= size}


def test_near_matches_write_no_pieces_of_texts(spark, tmp_path, monkeypatch):
    """Texts cut into pieces at every place were many times larger than the texts themselves."""
    plans, keep = [], memory.durable.stored
    monkeypatch.setattr(memory.durable, "stored", lambda df, name: plans.append((name, df)) or keep(df, name))
    source, reviews, target = near_copies(4, 0.97)
    memory.match(rows(spark, *target), publish(spark, rows(spark, *source), *reviews)).collect()
    assert {n for n, _ in plans} == {"open-findings", "known", "near-pairs"}
    for name, df in plans:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "piece" not in plan and not any("sequence(1" in x and "length" in x for x in plan.splitlines()), name


def test_similarity_of_contained_texts(spark):
    from marginalia.functions import text as tx

    rng = random.Random(5)
    texts = ["", "a", "aa", *("".join(rng.choice("ab c") for _ in range(n)) for n in (9, 30, 198, 199, 200, 260))]
    texts += [t[1:] for t in texts] + [t + "x" for t in texts] + ["x" + t + "ab" for t in texts]
    for autojunk in (True, False):
        pairs = [(a, b) for b in texts for a in texts]
        expected = [SequenceMatcher(None, a, b, autojunk).ratio() for a, b in pairs]
        assert [s for s, _ in tx.similarities(pairs, 0.0, autojunk)] == expected


def test_publish_counts(spark):
    findings = rows(spark, row("a", "1", LONG), row("a", "2", LONG), row("a", "3", breadcrumb="", node_label=""),
                    row("a", "4", LONG, status="approved"))
    reviews = spark.createDataFrame([("a", "1", "a", ""), ("a", "2", " ", ""), ("a", "3", "r", ""), ("a", "4", "r", "")], REVIEW)
    assert tuple(memory.publish_counts(findings, reviews).first()) == ("a", 1, 1, 1)


def stored(spark, *items):
    df = rows(spark, *items).withColumns({
        "finding_order": F.monotonically_increasing_id(), "comment": F.lit(""),
    })
    return library.stored_findings(df)


def test_evidence_counts_unreviewed_reports_for_coverage_only(spark):
    source = row("a", "1", "A long repeated context appears before.", "And after in both.", original="RAW i")
    reports = spark.createDataFrame([("a", "Name A"), ("b", "Name B")], "report_id string, report_name string")
    seen = publish(spark, rows(spark, source), ("a", "1", "rejected", ""))
    one = learning.evidence(seen, stored(spark, source), reports).first()
    other = ("b", *source[1:])
    two = learning.evidence(seen, stored(spark, source, other, ("b", "2", *source[2:])), reports).first()
    assert (one["human_decisions"], one["occurrences"], one["course_coverage"]) == (1, 1, 1)
    assert (two["human_decisions"], two["human_reports"], two["occurrences"], two["course_coverage"]) == (1, 1, 3, 2)
    assert two["seen_in_reports"] == "Name A, Name B" and two["original"] == "RAW i"
    assert {k: one[k] for k in ("status", "comment", "checker", "original")} == {
        k: two[k] for k in ("status", "comment", "checker", "original")}
    none = learning.evidence(seen, stored(spark, source).limit(0), reports).first()
    assert (none["occurrences"], none["course_coverage"], none["original"], none["seen_in_reports"]) == (0, 1, "raw i", "")


EVIDENCE = (
    "checker string, field string, original string, proposed string, status string, comment string, "
    "human_decisions long, human_reports long, occurrences long, course_coverage long, "
    "reviewed_sources string, seen_in_reports string"
)


def test_automation_policy_and_promotion(spark):
    spacing = ("check_spacing", "body_value", ":y", ": y", "rejected", "Boundary.")
    items = [
        ("check_spelling", "f", "NewJargon ", "new", "rejected", "", 1, 1, 2, 2, "C", "C, D"),
        ("check_spelling", "g", "newjargon", "x", "rejected", "", 2, 2, 1, 1, "E", "C"),
        ("check_math", "f", "f(0)=6", "f(0)=0", "rejected", "ok", 1, 1, 1, 1, "A", "A"),
        (*spacing, 1, 1, 2, 2, "A", "A, B"),
        ("check_spacing", "h", ":y", ": y", "rejected", "Boundary.", 2, 2, 2, 2, "A", "A, B"),
        ("check_spacing", "f", "A", " A", "needs_change", "Use it.", 5, 5, 8, 5, "A, B", "A"),
        ("check_capitalization", "f", "x", "X", "rejected", "Math notation", 2, 2, 2, 2, "A", "B"),
        ("check_capitalization", "f", "y", "Y", "rejected", "other", 2, 2, 2, 2, "A", "B"),
        ("check_spelling", "f", "desmos", "demos", "rejected", "", 2, 2, 2, 2, "A", "B"),
    ]
    book = rb.default(spark)
    suggestions = learning.shared_suggestions(spark.createDataFrame(items, EVIDENCE), book.terms)
    got = {(r["suggestion_type"], r["original"], r["field"]): r for r in suggestions.collect()}
    term = got[(fixed.TERM_SUGGESTION, "newjargon", "*")]
    assert (term["evidence_count"], term["human_reports"], term["occurrences"], term["course_coverage"]) == (3, 2, 3, 2)
    assert term["reports"] == "C, D, E"
    active = {r["original"]: r["automation_reason"] for r in learning.automatic_suggestions(suggestions).collect()}
    reasons = fixed.AUTOMATION_REASONS
    assert active == {
        "newjargon": reasons["term"], "f(0)=6": reasons["math"], ":y": reasons["spacing"],
        "x": reasons["capitalization"], "desmos": reasons["spelling"],
    }
    updated, fresh = learning.promote_automatic(book, suggestions, "v2")
    assert fresh.count() == 5
    assert {"newjargon", "desmos"} <= {r[0] for r in updated.terms.collect()}
    learned = updated.rules.filter(F.col("source") == fixed.AUTOMATIC_SOURCE)
    assert learned.count() == 4 and updated.rules.count() == len(fixed.EXACT_RULES) + 4
    # promoting again adds nothing; removing the layer gives the first rulebook back
    again, fresh = learning.promote_automatic(updated, suggestions, "v3")
    assert fresh.count() == 0 and again.rules.count() == updated.rules.count()
    terms = learning.learned_terms(learning.automatic_suggestions(suggestions))
    plain, removed = rb.without_automatic(updated, terms)
    assert removed.first()[0] == 5
    assert plain.rules.count() == book.rules.count() and plain.terms.count() == book.terms.count()
    order = [r["original"] for r in learned.orderBy("rule_rank").collect()]
    assert order == [":y", "desmos", "x", "f(0)=6"]


def tables(spark, **rows_by_name):
    out = {}
    for name, (fields, _) in merging.COLLECTIONS.items():
        ddl = ", ".join(f"{f} {'long' if f in ('finding_count', 'reviewable_count', 'upload_count', 'finding_order') else 'string'}" for f in fields)
        items = [tuple(r.get(f, 0 if "count" in f or f == "finding_order" else "") for f in fields) for r in rows_by_name.get(name, [])]
        out[name] = spark.createDataFrame(items, ddl)
    return out


def test_merge_of_another_deployment(spark):
    ours = tables(
        spark, reports=[dict(report_id="a", report_name="old", first_uploaded_at="2", last_uploaded_at="5", upload_count=4)],
        draft_reviews=[dict(report_id="a", issue_id="1", decision="approved", updated_at="9")],
        review_events=[dict(event_id="e1", action="old")],
        observations=[dict(observation_id="o1", status="approved"), dict(observation_id="o2", status="rejected")],
    )
    theirs = tables(
        spark, reports=[dict(report_id="a", report_name="new", first_uploaded_at="3", last_uploaded_at="4", upload_count=2),
                        dict(report_id="b", report_name="b")],
        draft_reviews=[dict(report_id="a", issue_id="1", decision="rejected", updated_at="7")],
        review_events=[dict(event_id="e1", action="new"), dict(event_id="e2", action="x")],
        observations=[dict(observation_id="o1", status="needs_change")],
        ticket_links=[dict(report_id="a", issue_key="K-1", issue_url="u")],
    )
    merged = merging.merge(ours, theirs)
    a = merged["reports"].filter("report_id = 'a'").first()
    assert (a["report_name"], a["first_uploaded_at"], a["last_uploaded_at"], a["upload_count"]) == ("new", "2", "5", 4)
    draft = merged["draft_reviews"].first()
    assert (draft["decision"], draft["updated_at"]) == ("rejected", "9")
    assert {r["event_id"]: r["action"] for r in merged["review_events"].collect()} == {"e1": "old", "e2": "x"}
    assert {r["observation_id"]: r["status"] for r in merged["observations"].collect()} == {"o1": "needs_change", "o2": "rejected"}
    twice = merging.merge(merged, theirs)
    for name in merged:
        assert sorted(map(str, twice[name].collect())) == sorted(map(str, merged[name].collect())), name
    counts = {r["name"]: r["rows"] for r in merging.import_counts(theirs).collect()}
    assert counts == {"imported": 1, "reports": 2, "findings": 0, "drafts": 1, "events": 2}
    with pytest.raises(library.LibraryError):
        merging.check(tables(spark, observations=[dict(observation_id="x", status="maybe")]))
    with pytest.raises(library.LibraryError):
        merging.check({**theirs, "reports": theirs["reports"].drop("filename")})


def test_similarity_of_one_report(spark):
    shared = ("Students compare the same quantities in this context.", "They explain it.")
    findings = stored(spark, row("a", "1", *shared), row("a", "2", *shared, original="zz"), row("b", "1", *shared),
                      row("c", "9", "Other long context before the change", "", original="q"))
    reports = spark.createDataFrame(
        [(r, f"Name {r}", f"{r}.html", "v", 2, 1, "1", "2", 1) for r in "abc"],
        "report_id string, report_name string, filename string, rules_version string, finding_count long, "
        "reviewable_count long, first_uploaded_at string, last_uploaded_at string, upload_count long",
    )
    current = spark.createDataFrame([("b",)], "report_id string")
    got = library.similarity(findings, reports, current).collect()
    assert [(r["report_id"], r["exact_findings"], r["exact_overlap"], r["shared_correction_pairs"]) for r in got] == [("a", 1, 1.0, 1)]


def test_hot_keys_are_split_without_changing_results(spark, monkeypatch):
    facts = spark.range(4000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), "id")
    lookup = spark.range(0, 4000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionAll(
        spark.createDataFrame([(1, 7)], "k long, v long"))
    monkeypatch.setattr(joins, "HOT_ROWS", 100)
    for how in ("inner", "left"):
        plain = facts.join(lookup, "k", how)
        split = joins.skew_join(facts, lookup, ["k"], how)
        assert sorted(map(str, split.select("k", "id", "v").collect())) == sorted(map(str, plain.select("k", "id", "v").collect()))


def test_rows_with_null_keys_are_dealt_out(spark, monkeypatch):
    facts = spark.range(4000).select(F.when(F.col("id") % 100 == 0, F.col("id")).alias("k"), "id")
    lookup = spark.range(0, 4000, 2).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    monkeypatch.setattr(joins, "HOT_ROWS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        split = joins.skew_join(facts, lookup, ["k"], "left")
        sizes = [r["n"] for r in split.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 4000 and max(sizes) < 1500
        assert split.filter("v IS NOT NULL").count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_ids_tell_nulls_apart(spark):
    from marginalia.functions.signature import pair_id, short_id

    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert df.select(short_id(F.col("x"), F.col("y"), F.col("z"))).distinct().count() == 2
    assert df.select(pair_id(F.col("y"), F.col("z"))).distinct().count() == 2


def test_event_rows_and_link_rules(spark):
    changes = spark.createDataFrame([("a", "1", "approved", json.dumps({"review_note": "x"}))],
                                    "report_id string, issue_id string, decision string, detail_json string")
    events = library.event_rows(changes, "save_decisions", " Me@X.test ", "Me", now())
    one = library.with_detail(events).first()
    assert (one["reviewer_email"], one["detail"]) == ("me@x.test", {"review_note": "x"})
    assert library.activity_view(events).first()["action"] == "Save Decisions"
    for action, email in (("", "a"), ("x", " ")):
        with pytest.raises(library.LibraryError):
            library.event_rows(changes, action, email, "", now())
    reports = spark.createDataFrame([("a",)], "report_id string")
    link = "report_id string, key string, summary string, browse_url string, attachment_id string"
    good = spark.createDataFrame([("a", " K-1 ", None, "u", None)], link)
    assert library.link_rows(good, reports, now()).first()["issue_key"] == "K-1"
    for bad in (("a", "", "", "u", ""), ("zz", "K", "", "u", "")):
        with pytest.raises(library.LibraryError):
            library.link_rows(spark.createDataFrame([bad], link), reports, now())


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    plans = {}
    keep = memory.durable.stored

    def stored(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(memory.durable, "stored", stored)
    rows = spark.range(40).select(
        F.concat(F.lit("f"), "id").alias("fingerprint"), F.lit("c").alias("core_key"), F.lit("context").alias("anchor_kind"),
        F.concat(F.lit("some longer text around the change number "), F.col("id")).alias("anchor"))
    pairs = memory.near_pairs(rows, rows, 0.97)
    assert {(r[0], r[1]) for r in pairs.collect()} >= {(f"f{i}", f"f{i}") for i in range(40)}
    assert "SortMergeJoin" in plans["near-pairs"] and "BroadcastHashJoin" not in "".join(plans.values())


def test_the_test_of_a_fingerprint_does_not_compute_it_again(spark):
    from marginalia.functions.signature import with_fingerprint, with_signature

    names = ("checker", "field", "original", "proposed", "context_before", "context_after", "node_label", "breadcrumb")
    rows = spark.createDataFrame(
        [("c", "f", "a", "b", "long text before it &amp; more", "after", "n", "Unit 1 > x"), ("c", "f", "a", "b", "", "", "", ""),
         (None,) * 8, ("c", "f", "a", "b", "", "", "Label of it", "Course > Unit 2")], ", ".join(f"{n} string" for n in names))
    found, plain = with_fingerprint(rows), with_signature(rows).filter("fingerprint <> ''")
    assert sorted(map(str, found.select(*plain.columns).collect())) == sorted(map(str, plain.collect())) and found.count() == 2

    def lowered(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")

    assert lowered(found) == lowered(with_signature(rows)) < lowered(plain)
