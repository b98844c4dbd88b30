"""Native text functions against plain Python."""

import html
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from marginalia import fixed
from marginalia.functions import comments, decisions, signature
from marginalia.functions import text as tx

TEXTS = [
    "", "  plain  words ", "Straße UND Größe", "ΌΣΟΣ ς", "ﬁsh ﬂow", "a&amp;b &lt;i&gt;",
    "Open https://a.test/x?y=1 and 44365624-CC6F-11ef-a9a4-066a39b724af now",
    "tab\tnew\nline\x1csep\x85nel nbsp　wide", "&&& &notit; &copy2024", "İstanbul ſ µ",
    "HTTPS://A.TEST next", "x" * 30, "Ꭰ cherokee ꭰ",
]


def one_column(spark, values, name="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def collect(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def reference_normal(value):
    text = html.unescape(value or "").casefold()
    text = re.sub(r"https?://\S+", " <url> ", text, flags=re.I)
    uuid = r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
    text = re.sub(uuid, " <uuid> ", text, flags=re.I)
    return re.sub(r"\s+", " ", text).strip()


def test_normalize_matches_python(spark):
    df = one_column(spark, [*TEXTS, None])
    assert collect(df, tx.normalize_match_text(F.col("t"))) == [
        reference_normal(t) for t in [*TEXTS, None]
    ]


def test_native_and_slow_path_agree(spark):
    plain = [t for t in TEXTS if not re.search(r"&[#a-zA-Z]|[ﬁﬂᎠꭰİ]", t)]
    df = one_column(spark, plain)
    assert collect(df, tx.normalize_native(F.col("t"))) == [tx.normalize_value(t) for t in plain]


def test_strip_and_regex_follow_python(spark):
    df = one_column(spark, TEXTS)
    assert collect(df, tx.strip(F.col("t"))) == [t.strip() for t in TEXTS]
    for pattern in (r"\s[a-z]", r"[^\s&]+;", r"\S{12}", r"line$", r"e\b", r"^\s*\w+\s+\w+"):
        expected = [bool(re.search(pattern, t)) for t in TEXTS]
        assert collect(df, tx.found(F.col("t"), pattern)) == expected, pattern


@pytest.mark.parametrize("value, expected", [
    ("State Grade 2 > Unit 2 > Lesson 4", "unit 2 > lesson 4"),
    ("A > B > C > D > E > F", "c > d > e > f"),
    ("Book", "book"), ("", ""), (" > > ", ""),
    ("Unit 1 > a > b > c > d", "a > b > c > d"),
    ("Commune > Discheck > Section 3 > x", "section 3 > x"),
    ("See https://a.test/b>c Unit > LESSON  4 > é", "c unit > lesson 4 > é"),
    ("a &gt; b > ﬁ Unit 3 > z", "fi unit 3 > z"),
])
def test_breadcrumb(spark, value, expected):
    df = one_column(spark, [value])
    assert collect(df, tx.normalize_breadcrumb(F.col("t"))) == [expected]


def plain_osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost = a[i - 1] != b[j - 1]
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + cost)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + cost)
    return d[len(a), len(b)]


def test_one_edit_and_osa(spark):
    words = ["the", "teh", "te", "then", "hte", "eht", "a", "", "ca", "abc", "aa", "aaa", "THE", "form", "from"]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in words for b in words)]
    df = spark.createDataFrame(pairs, "i int, a string, b string")
    rows = df.select(
        "a", "b", tx.is_one_edit(F.col("a"), F.col("b")).alias("one"),
        tx.osa_distance("a", "b").alias("d"),
    ).collect()
    for r in rows:
        expected = plain_osa(r["a"].lower(), r["b"].lower())
        assert r["d"] == expected, r
        assert r["one"] == (expected == 1), r


def test_similarity_is_the_stdlib_ratio(spark):
    long = "Students compare two strategies and explain why the relation stays constant over time. " * 3
    pairs = [(long, long.replace("two", "2")), (long.replace("why", "how"), long), ("abc", "abd"), (long, long)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r["s"]["score"] for r in df.select(tx.similarity_udf(0.0)("a", "b").alias("s")).collect()]
    assert got == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


DECISIONS = [
    ("a", "", ("approved", "")), (" Approve ", " x ", ("approved", "x")), ("R", "n", ("rejected", "n")),
    ("needs change", "", ("needs_change", "")), ("", "note", (None, None)), (None, None, (None, None)),
    ("Needs-Change:  use it ", "", ("needs_change", "use it")),
    ("needs_change, text", "given", ("needs_change", "given")),
    ("make it shorter", "", ("needs_change", "make it shorter")),
    ("needs change: a\nb", "", ("needs_change", "needs change: a\nb")),
]


def test_parse_decision(spark):
    df = spark.createDataFrame([(i, d, n) for i, (d, n, _) in enumerate(DECISIONS)], "i int, d string, n string")
    got = [tuple(v) for v in collect(df, decisions.parse_decision(F.col("d"), F.col("n")))]
    assert got == [expected for _, _, expected in DECISIONS]
    plain = [tuple(v) for v in collect(df, decisions.ui_decision(F.col("d"), F.col("n")))]
    assert plain == [(s or "", n or "") for _, _, (s, n) in DECISIONS]


COMMENTS = [
    ("Human review confirmed that this is a valid curriculum-specific term.", "check_spelling", "Geogebra",
     "geo", "this is a valid curriculum-specific term."),
    ("No AI confidence here. Needs human review.", "check_spelling", "traingle", "triangle", ""),
    ('Use a dash ("-"), not a comma.', "check_punctuation", ",", "-", 'Use a dash ("-"), not a comma.'),
    ("Looks correct.", "check_spelling", "", "", ""),
    ("Broken link needs replacement.", "check_links", "", "", ""),
    ("Typo; possible name", "check_spelling", "a", "b", "Typo"),
    ("keep desmos as is", "check_spelling", "Desmos", "demos", "keep desmos as is"),
    ("keep it as is", "check_spelling", "Desmos", "demos", ""),
    ("desmos is correct", "check_spelling", "Desmos", "demos", "desmos is correct"),
    (None, "check_math", None, None, ""),
    ("Approved", "check_math", None, None, ""),
    ("fix the comma;", "x", None, None, "fix the comma"),
]


def test_training_comment(spark):
    df = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(COMMENTS)], "i int, c string, k string, o string, p string, e string"
    )
    got = collect(df, comments.training_comment(F.col("c"), F.col("k"), F.col("o"), F.col("p")))
    assert got == [row[-1] for row in COMMENTS]


def test_signature_hash_is_compact_json(spark):
    import hashlib
    import json

    values = ["plain", 'quo"te\\', "Größe ½", "ctl\x0e\x1b\x01", "tab\tx"]
    df = one_column(spark, values)
    got = collect(df, signature.json_hash(F.col("t"), F.lit("z")))
    expected = [
        hashlib.sha256(json.dumps([1, v, "z"], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
        for v in values
    ]
    assert got == expected


FINDING = (
    "issue_id string, checker string, field string, original string, proposed string, "
    "context_before string, context_after string, breadcrumb string, node_label string"
)


def test_anchor_kinds(spark):
    rows = [
        ("ctx", "c", "f", "i", "I", "A long context before", " and after it", "", ""),
        ("loc", "c", "f", "i", "I", "", "", "State Course > Unit 2 > Check", "Task"),
        ("none", "c", "f", "i", "I", "short", "", "", ""),
        ("loc2", "c", "f", "i", "I", None, None, "Unit 2 > Check", "Task"),
    ]
    got = {r["issue_id"]: r for r in signature.with_signature(spark.createDataFrame(rows, FINDING)).collect()}
    assert got["ctx"]["anchor"] == "a long context before <change> and after it"
    assert got["loc"]["anchor"] == "unit 2 > check | task" == got["loc2"]["anchor"]
    assert got["loc"]["fingerprint"] == got["loc2"]["fingerprint"] != ""
    assert got["none"]["fingerprint"] == "" and got["none"]["anchor_kind"] == ""
    assert len({r["core_key"] for r in got.values()}) == 1
    assert fixed.FINGERPRINT_VERSION == 1


def test_match_form_names_each_step_once(spark):
    assert str(tx.normalize_native(F.col("a"))).count("lower(") == 1


def test_blanks_are_all_white_space(spark):
    every = [chr(c) for c in range(1, 0x3100)]
    rows = spark.createDataFrame([(c, f"a{c}{c}b") for c in every], "c string, t string")
    white = {r["c"] for r in rows.filter(tx.collapse(F.col("t")) == "a b").collect()}
    assert white == {c for c in every if c.isspace()}
