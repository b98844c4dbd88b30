"""Rule outcomes on single findings."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia import fixed
from marginalia.operators import classify as cl
from marginalia.operators import library
from marginalia.operators import rulebook as rb

SCHEMA = (
    "report_id string, issue_id string, checker string, confidence string, field string, "
    "original string, proposed string, reasoning string, context_before string, "
    "context_after string, breadcrumb string, node_label string, node_link string, "
    "container_tag string, container_cell_has_prior_text boolean, container_known boolean"
)
BASE = dict(
    report_id="r", issue_id="", checker="check_spelling", confidence="low", field="body_value",
    original="word", proposed="ward", reasoning="", context_before="", context_after="",
    breadcrumb="", node_label="", node_link="", container_tag=None,
    container_cell_has_prior_text=False, container_known=False,
)
CAP = dict(checker="check_capitalization", original="t", proposed="T", context_after="he word")
GAP = dict(checker="check_spacing", original=".A", proposed=". A")
A, R, N = fixed.APPROVED, fixed.REJECTED, fixed.NEEDS_CHANGE

CASES = [
    # spelling, no confidence signal
    (dict(original="desmos", proposed="demos"), R, "protected"),
    (dict(original=" DESMOS "), R, "protected"),
    (dict(original="traingle", proposed="triangle"), N, "no_confidence"),
    (dict(original="teh", proposed="the"), A, None),
    (dict(original="tha", proposed="that"), A, None),
    (dict(original="hte", proposed="that"), N, "no_confidence"),
    (dict(original="ahsx"), R, "code_artifact"),
    (dict(original="sSs"), R, "repeated"),
    (dict(original="ss"), N, "no_confidence"),
    (dict(context_before="Use \\"), R, "latex"),
    (dict(original="unkown", proposed="unknown"), A, 'Confirmed typo: replace "unkown" with "unknown".'),
    # capitalization
    (dict(CAP, context_after="=4"), R, "bare_token"),
    (dict(CAP, context_after=""), R, "bare_token"),
    (dict(CAP, context_after=" a bc"), R, "bare_token"),
    (dict(CAP, context_after=" is the independent variable"), R, "math_subject"),
    (dict(CAP, container_tag="th"), R, "cell_label"),
    (dict(CAP, container_tag="td", container_cell_has_prior_text=True, context_before="End. "), A, "cell_sentence"),
    (dict(CAP, container_tag="td", container_cell_has_prior_text=True, context_before="see vs. "), R, "cell_abbreviation"),
    (dict(CAP, container_tag="td", container_cell_has_prior_text=True, context_before="and "), N, "cell_unclear"),
    (dict(CAP, container_tag="p"), A, "text_sentence"),
    (dict(CAP, container_tag="li", context_before="1. "), A, "text_sentence"),
    (dict(CAP, container_tag="p", context_before="U.S. "), R, "text_abbreviation"),
    (dict(CAP, container_tag="p", context_before="then"), N, "text_unclear"),
    (dict(CAP, container_known=True, context_before='said "'), A, "quoted"),
    (dict(CAP, container_known=True), R, "flattened"),
    (dict(CAP, container_known=False), N, "no_reasoning"),
    (dict(CAP, container_known=True, field="title"), A, None),
    (dict(CAP, container_tag="table", field="x", reasoning="This is a Greek letter"), R, "notation"),
    (dict(CAP, reasoning="It is unclear"), N, "ambiguous_case"),
    (dict(CAP, reasoning="This is ambiguous"), N, "ambiguous_case"),
    (dict(CAP, reasoning="This is unambiguous"), A, None),
    # math, proper nouns, links
    (dict(checker="check_math"), R, "math_misread"),
    (dict(checker="check_math", proposed="see upstream value"), N, "upstream"),
    (dict(checker="check_proper_nouns", original="texas", context_after=" Essential Knowledge and Skills"), A, "official_title"),
    (dict(checker="check_proper_nouns", original="texas"), R, "common_noun"),
    (dict(checker="check_links"), A, None),
    # punctuation
    (dict(checker="check_punctuation", original="..", proposed=".", context_after='" then'), R, "trailing_off"),
    (dict(checker="check_punctuation", original="..", proposed=".", context_after=" "), N, "double_period"),
    (dict(checker="check_punctuation", original=".Go", proposed=". Go"), A, None),
    (dict(checker="check_punctuation", original=";", proposed=","), N, "punctuation"),
    # spacing
    (dict(GAP, original=" :", proposed=":"), A, None),
    (dict(GAP, original=" :", proposed=";"), N, "spacing"),
    (dict(GAP, original=",a", proposed=", a"), A, None),
    (dict(GAP, original="  ", proposed=" "), A, None),
    (dict(GAP, original=" ", proposed=" "), N, "spacing"),
    (dict(GAP, original="?A", proposed="x"), A, None),
    (dict(GAP, context_before="HSA-APR"), R, "code_boundary"),
    (dict(GAP, context_before="see 5.NF"), R, "code_boundary"),
    (dict(GAP, context_before="Use \\"), R, "code_boundary"),
    (dict(GAP, context_before="from Card B "), R, "code_boundary"),
    (dict(GAP, context_before="answer\n B "), N, "answer_label"),
    (dict(GAP, context_before="After \\(x=4\\), explain."), A, None),
    (dict(checker="check_else"), N, 'Unrecognized checker "check_else".'),
    (dict(checker=None), N, 'Unrecognized checker "".'),
]


def frame(spark, rows):
    full = [{**BASE, **row, "issue_id": row.get("issue_id") or f"i{i}"} for i, row in enumerate(rows)]
    names = list(BASE)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], SCHEMA)


def statuses(df):
    return {r["issue_id"]: (r["status"], r["comment"]) for r in df.collect()}


def test_every_branch(spark):
    got = statuses(cl.classify(frame(spark, [c for c, _, _ in CASES]), rb.default(spark)))
    for i, (case, status, key) in enumerate(CASES):
        comment = fixed.COMMENTS.get(key, key) if key else ""
        assert got[f"i{i}"] == (status, comment), case


def test_confidence_is_a_property_of_the_report(spark):
    rows = [
        dict(report_id="a", issue_id="hi", confidence="high"), dict(report_id="a", issue_id="lo"),
        dict(report_id="b", issue_id="hi2", confidence="high"),
        dict(report_id="c", issue_id="hi3", confidence="high"), dict(report_id="c", issue_id="nul", confidence=None),
        dict(report_id="b", issue_id="m", checker="check_math", confidence="low"),
    ]
    got = statuses(cl.classify(frame(spark, rows), rb.default(spark)))
    assert got["hi"] == (A, "") and got["lo"][0] == R
    assert got["hi2"] == (N, fixed.COMMENTS["no_confidence"])
    assert got["hi3"] == (A, "") and got["nul"] == (R, fixed.COMMENTS["jargon"])


def test_exact_rules_in_order_with_wildcards(spark):
    book = rb.default(spark)
    rules = [
        ("00", "check_math", "*", "x", "*", R, "first", None),
        ("01", None, None, "x", None, A, "second", None),
        ("02", "check_math", "body_value", "y", "z", A, None, None),
        ("03", "*", "", "*", "*", N, "empty field", None),
    ]
    book = rb.Rulebook(book.terms, book.targets, spark.createDataFrame(rules, f"rule_rank string, {rb.RULE_SCHEMA}"))
    got = statuses(cl.classify(frame(spark, [
        dict(checker="check_math", original="x"), dict(checker="check_links", original="x"),
        dict(checker="check_math", original="y", proposed="z"),
        dict(checker="check_links", field=None), dict(checker="check_links", field="", original="x"),
    ]), book))
    assert got == {"i0": (R, "first"), "i1": (A, "second"), "i2": (A, ""),
                   "i3": (N, "empty field"), "i4": (A, "second")}
    everything = spark.createDataFrame([("00", "*", "*", "*", "*", A, "all", None)], f"rule_rank string, {rb.RULE_SCHEMA}")
    got = statuses(cl.classify(frame(spark, [dict()]), rb.Rulebook(book.terms, book.targets, everything)))
    assert got == {"i0": (A, "all")}
    none = rb.Rulebook(book.terms, book.targets, everything.limit(0))
    assert statuses(cl.classify(frame(spark, [dict()]), none))["i0"][0] == N


def test_large_lookup_path_gives_the_same(spark, monkeypatch):
    df = frame(spark, [c for c, _, _ in CASES])
    book = rb.default(spark)
    small = statuses(cl.classify(df, book))
    from marginalia.operators import joins
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(joins, "HOT_ROWS", 3)
    assert statuses(cl.classify(df, book)) == small


def test_stored_record_keeps_unknown_container(spark):
    rows = frame(spark, [dict(CAP, issue_id="known", container_known=True), dict(CAP, issue_id="old")])
    raw = rows.withColumn("finding_order", F.lit(0))
    rows = cl.with_verdict(raw, rb.default(spark))
    stored = library.stored_findings(rows)
    records = {r["issue_id"]: json.loads(r["record_json"]) for r in stored.collect()}
    assert records["known"]["container_tag"] is None
    legacy = stored.withColumn(
        "record_json",
        F.when(F.col("issue_id") == "old", F.regexp_replace("record_json", '"container_tag":null,', "")).otherwise(F.col("record_json")),
    )
    again = statuses(cl.classify(library.raw_records(legacy), rb.default(spark)))
    assert again["known"] == (R, fixed.COMMENTS["flattened"])
    assert again["old"] == (N, fixed.COMMENTS["no_reasoning"])


def test_rulebook_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    document = {
        "schema_version": 1, "rules_version": "t", "protected_spelling_terms": [" Zed ", "zed", ""],
        "safe_typo_targets": ["The"], "exact_rules": [
            {"checker": "check_math", "original": "1", "status": R}, {"status": A, "comment": "c", "field": "*"}],
    }
    path.write_text(json.dumps(document, indent=1))
    book = rb.load(spark, str(path))
    assert [r[0] for r in book.terms.collect()] == ["zed"]
    assert [r[0] for r in book.targets.collect()] == ["the"]
    out = json.loads(rb.to_json(book).first()[0])
    assert out["protected_spelling_terms"] == ["zed"] and out["rules_version"] == "t"
    assert out["exact_rules"][0] == {"checker": "check_math", "original": "1", "status": R}
    for change in ({"schema_version": 2}, {"exact_rules": [{"status": "maybe"}]}, {"exact_rules": ["x"]},
                   {"protected_spelling_terms": "x"}):
        path.write_text(json.dumps({**document, **change}))
        spark.catalog.clearCache()
        with pytest.raises(rb.RulebookError):
            rb.load(spark, str(path))


def test_promotions_keep_their_order(spark, tmp_path):
    """Rules of a later promotion come last, whatever the versions are called."""
    book = rb.default(spark)
    kind = "selected boolean, suggestion_type string, suggestion_id string, checker string, field string, " \
        "original string, proposed string, status string, comment string, evidence_count long"
    for version, comment in (("v9", "first"), ("v10", "second"), ("a", "third")):
        chosen = spark.createDataFrame([(True, "exact rule", comment, "*", "*", "word", "*", A, comment, 3)], kind)
        book = rb.promote(book, chosen, version)
    added = book.rules.filter("rule_rank LIKE '1|%'").orderBy("rule_rank").collect()
    assert [r["comment"] for r in added] == ["first", "second", "third"]
    assert book.rules.agg({"rule_rank": "max"}).first()[0] == added[-1]["rule_rank"]
    rb.save_tables(book, str(tmp_path / "book"))
    again = rb.load_tables(spark, str(tmp_path / "book"))
    assert again.version == "a" and again.terms.count() == book.terms.count()
    assert sorted(map(str, again.rules.collect())) == sorted(map(str, book.rules.select(*again.rules.columns).collect()))


def test_default_rulebook(spark):
    book = rb.default(spark)
    terms = {r[0] for r in book.terms.collect()}
    assert {"preimage", "emoji", "teks", "subitize"} <= terms and len(terms) == len(fixed.PROTECTED_SPELLING_TERMS)
