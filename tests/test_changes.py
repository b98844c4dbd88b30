"""Reclassification of what a rulebook change touches, against reclassifying everything."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import changes, library
from marginalia.operators import classify as cl
from marginalia.operators import rulebook as rb
from marginalia.plans import flows

FIELDS = ("checker", "field", "original", "proposed")
SCHEMA = (
    "report_id string, issue_id string, finding_order long, checker string, confidence string, field string, original string, "
    "proposed string, reasoning string, context_before string, context_after string, breadcrumb string, node_label string, "
    "node_link string, container_tag string, container_cell_has_prior_text boolean, container_known boolean"
)


def findings(spark, n=400):
    rng, rows = random.Random(7), []
    for i in range(n):
        rows.append((
            f"r{i % 5}", str(i), i, rng.choice(["check_spelling", "check_math", "check_links", "check_spacing"]),
            rng.choice(["low", None]) if i % 5 else "low", rng.choice(["body_value", "title", None]),
            rng.choice(["wrod", " Desmos ", "a", ""]) + str(rng.randrange(4)) if rng.random() < 0.7 else rng.choice(["teh", None]),
            rng.choice(["word", "the", "x", None]), "", "before ", " after", "Unit 1", "node", "", None, False, False,
        ))
    return spark.createDataFrame(rows, SCHEMA)


def book(spark, rules, terms, targets):
    rows = [(f"{rank:013d}", *(r.get(f) for f in FIELDS), r.get("status", "approved"), r.get("comment", ""), None) for rank, r in rules.items()]
    words = lambda some: spark.createDataFrame([(w,) for w in some], "term string")
    return rb.Rulebook(words(terms), words(targets), spark.createDataFrame(rows, f"rule_rank string, {rb.RULE_SCHEMA}"), "v")


RULES = {
    0: dict(checker="check_math", field="*", original="wrod1", proposed="*"),
    1: dict(checker="*", original="wrod1", status="rejected"),
    2: dict(checker="check_spelling", proposed="the", status="needs_change", comment="look"),
    3: dict(field="title", status="rejected"),
    4: dict(checker="check_links", field="body_value", original="teh", proposed="x"),
}


@pytest.mark.parametrize("change", ["rule gone", "order", "new mask", "words", "all"])
def test_equals_classifying_everything(spark, change):
    raw = findings(spark)
    terms, targets, rules = ["wrod2", "desmos 1"], ["the"], dict(RULES)
    old = book(spark, rules, terms, targets)
    if change == "rule gone":
        del rules[1]
    elif change == "order":
        rules[0], rules[1] = rules[1], rules[0]
    elif change == "comment":
        rules[2] = dict(rules[2], comment="look again")
    elif change == "new mask":
        rules[9] = dict(field="body_value", proposed="word", status="rejected")
    elif change == "words":
        terms, targets = ["wrod2", "wrod0"], ["the", "word"]
    elif change == "all":
        rules[99] = dict(status="rejected", comment="whatever is left")
    new = book(spark, rules, terms, targets)
    stored = library.stored_findings(cl.with_verdict(raw, old).withColumns({n: F.coalesce(n, F.lit("")) for n in ("original", "proposed")}))
    records = library.raw_records(stored)
    index = changes.finding_keys(records, changes.kinds_of(old, new))
    flags = cl.confidence_flags(records)
    before = cl.classify(records, old, "finding_order")
    after, again = flows.reclassify_changed(before, stored, flags, index, old, new)
    want = sorted(map(tuple, cl.classify(records, new, "finding_order").collect()))
    assert sorted(map(tuple, after.collect())) == want
    was = {r.issue_id: (r.status, r.comment) for r in before.collect()}
    differ = {r.issue_id for r in after.collect() if (r.status, r.comment) != was[r.issue_id]}
    read = [r.issue_id for r in again.collect()]
    assert differ <= set(read) and len(read) == len(set(read))
    assert len(read) == 400 if change == "all" else 0 < len(read) < 250


def test_only_what_the_change_meets_is_read(spark):
    """The rows that are classified are counted: one term of many, in few findings."""
    raw = findings(spark, 300).withColumn("original", F.when(F.col("issue_id").isin("3", "77"), F.lit(" RareWord ")).otherwise(F.col("original")))
    raw = raw.withColumn("checker", F.when(F.col("issue_id") == "3", "check_spelling").when(F.col("issue_id") == "77", "check_math").otherwise(F.col("checker")))
    old, new = book(spark, RULES, ["wrod2"], ["the"]), book(spark, RULES, ["wrod2", "rareword"], ["the"])
    met = changes.touched(changes.finding_keys(raw, changes.kinds_of(old, new)), changes.changed_keys(old, new))
    assert [tuple(r) for r in met.collect()] == [("r3", "3")]


def test_empty(spark):
    empty = findings(spark, 1).filter("false")
    one, two = book(spark, {}, [], []), book(spark, RULES, ["a"], ["b"])
    assert changes.changed_keys(one, one).count() == 0 and changes.changed_keys(one, two).count() == len(RULES) + 2
    assert changes.touched(changes.finding_keys(empty, changes.kinds_of(one, two)), changes.changed_keys(one, two)).count() == 0
