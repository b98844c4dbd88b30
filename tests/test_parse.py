"""Report scanning and parsing on small report files."""

import html
import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import parse
from marginalia.plans import flows
from marginalia.sources import archives
from marginalia.sources import reports as src


def issue(issue_id, original, proposed, attrs="", reasoning=None):
    note = f'<div class="reasoning">{reasoning}</div>' if reasoning is not None else ""
    comment = f'<input data-comment-for="{issue_id}">' if issue_id else ""
    return (
        f'<div class="aggregated-issue"{attrs}><span class="issue-original">{original}</span>'
        f'<span class="issue-proposed">{proposed}</span>{comment}{note}</div>'
    )


def card(number, issues, diff="", original=None, checker="check_spelling", extra="", pills=("Unit 1", "Lesson 2")):
    crumbs = "".join(f'<span class="breadcrumb-pill">{p}</span>' for p in pills)
    tab = f'<div data-tab="original">{original}</div>\n</div>' if original is not None else ""
    return (
        f'<div class="issue-card" id="annotation-card-{number}" data-checker="{checker}" '
        f'data-confidence="low" data-field="body_value"><strong>Lesson</strong>: My Lesson &amp; more'
        f'<a href="https://x.test/n/{number}">open</a>{crumbs}{extra}'
        f'<div data-tab="text-diff">{diff}</div> </div>{tab}{"".join(issues)}</div>\n'
    )


def change(a, b):
    return f'<span class="inline-del">{a}</span> <span class="inline-ins">{b}</span>'


HEAD = "<!doctype html><html><body>\n"


@pytest.fixture
def parsed(spark, tmp_path):
    def run(*cards, head=HEAD, name="a.html", count=None):
        (tmp_path / name).write_text(head + "".join(cards), encoding="utf-8")
        _, rows = flows.read_reports(spark, str(tmp_path))
        return sorted((r.asDict() for r in rows.collect()), key=lambda r: r["finding_order"])
    return run


def test_fields_and_first_of_equal_ids(parsed):
    one = card(1, [issue("i-1", "gogle", "Google")], "Use " + change("gogle", "Google") + " here")
    rows = parsed(one, one)
    assert len(rows) == 1
    row = rows[0]
    assert (row["issue_id"], row["original"], row["proposed"]) == ("i-1", "gogle", "Google")
    assert (row["node_type"], row["node_label"], row["node_link"]) == ("Lesson", "My Lesson", "https://x.test/n/1")
    assert row["breadcrumb"] == "Unit 1 > Lesson 2"
    assert (row["context_before"], row["context_after"]) == ("Use ", " here")
    assert row["context"] == "Use  <<DIFF>>  here"
    assert (row["checker"], row["confidence"], row["field"]) == ("check_spelling", "low", "body_value")
    assert row["container_tag"] is None and row["container_known"]


def test_issue_attributes_before_card_attributes(parsed):
    rows = parsed(card(1, [
        issue("a", "x", "y", ' data-checker="check_math" data-confidence=""'),
        issue("b", "x", "y"), issue("", "x", "y"),
    ]))
    assert [(r["issue_id"], r["checker"], r["confidence"]) for r in rows] == [
        ("a", "check_math", "low"), ("b", "check_spelling", "low"),
    ]


def test_issues_pair_with_changes_by_position(parsed):
    diff = "one " + change("a", "b") + " two"
    rows = parsed(card(1, [issue("p", "a", "b"), issue("q", "c", "d")], diff))
    assert [(r["context_before"], r["context_after"]) for r in rows] == [("one ", " two"), ("", "")]


def test_window_may_cut_a_tag(parsed):
    # the 600-character window starts inside the attribute of the tag
    lead = '<em title="' + "t" * 30 + '">' + "w" * 590
    rows = parsed(card(1, [issue("p", "a", "b")], lead + change("a", "b") + "z" * 900))
    raw = lead[-600:]
    import re
    assert rows[0]["context_before"] == html.unescape(re.sub("<[^>]+>", "", raw))[-150:]
    assert rows[0]["context_after"] == "z" * 150


def test_entities_and_reasoning(parsed):
    rows = parsed(card(1, [issue("p", "a &lt;b&gt; <i>c</i>", "&eacute;", reasoning=" so <b>it</b> is ")]))
    assert (rows[0]["original"], rows[0]["proposed"], rows[0]["reasoning"]) == ("a <b> c", "é", "so it is")


@pytest.mark.parametrize("markup, original, after, tag, prior", [
    ("<table><tr><th>temperature</th></tr></table>", "t", "emperature", "th", False),
    ("<table><tr><td>First one. second one</td></tr></table>", "s", "econd one", "td", True),
    ("<p>Hello there. we go</p>", "w", "e go", "p", False),
    ("<ul><li>alpha</li><li>beta</li></ul>", "b", "eta", "li", False),
    ("<p>closed</p> loose text", "l", "oose text", None, False),
    ("<table><tr><td><table><tr><td>in</td></tr></table> tail words</td></tr></table>", "t", "ail words", "td", True),
    ("<p>nothing here</p>", "q", "zzzzzzzz", None, False),
    ("<p>starts right but the ending differs</p>", "s", "tarts right but the end was changed", "p", False),
    ("<p>a < b and more", "m", "ore", None, False),
])
def test_containers(parsed, markup, original, after, tag, prior):
    escaped = html.escape(html.escape(markup, quote=False), quote=False)
    diff = change(html.escape(original), "X") + html.escape(after)
    rows = parsed(card(1, [issue("p", html.escape(original), "X")], diff, escaped))
    assert (rows[0]["container_tag"], rows[0]["container_cell_has_prior_text"]) == (tag, prior)


def test_order_over_many_blocks(spark, tmp_path):
    cards = [card(i, [issue(f"id-{i}-{j}", "a", "b") for j in range(2)], "filler " * 50) for i in range(400)]
    (tmp_path / "big.html").write_text(HEAD + "".join(cards))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        cards_df = src.scan_report_cards(spark, str(tmp_path))
        assert cards_df.rdd.getNumPartitions() > 3
        _, rows = flows.read_reports(spark, str(tmp_path))
        got = [r["issue_id"] for r in rows.orderBy("finding_order").select("issue_id").collect()]
        orders = [r[0] for r in rows.orderBy("finding_order").select("finding_order").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"id-{i}-{j}" for i in range(400) for j in range(2)]
    assert orders == list(range(800))


def test_delimiter_inside_a_card(parsed):
    inner = '<div class="issue-card" id="annotation-card-x">not a card</div>'
    rows = parsed(card(1, [issue("a", "x", "y")], extra=inner), card(2, [issue("b", "x", "y")]))
    assert [(r["issue_id"], r["node_link"]) for r in rows] == [
        ("a", "https://x.test/n/1"), ("b", "https://x.test/n/2"),
    ]
    assert rows[0]["original"] == "x"


def test_invalid_bytes_are_dropped(spark, tmp_path):
    body = (HEAD + card(1, [issue("a", "xQQy", "y")])).encode().replace(b"QQ", b"\xff\xfe")
    (tmp_path / "bad.html").write_bytes(body)
    _, rows = flows.read_reports(spark, str(tmp_path))
    assert rows.first()["original"] == "xy"


def test_report_without_findings(spark, tmp_path):
    (tmp_path / "empty.html").write_text("<html>nothing</html>")
    (tmp_path / "full_review.html").write_text(HEAD + card(1, [issue("a", "x", "y")]))
    manifest, rows = flows.read_reports(spark, str(tmp_path))
    assert [r["filename"] for r in parse.reports_without_findings(manifest, rows).collect()] == ["empty.html"]
    assert sorted(r["report_name"] for r in manifest.collect()) == ["empty", "full"]


def test_report_names(spark):
    names = {
        "Grade 2 (v1)_review_detailed.html": "Grade_2_v1",
        "x_REVIEW.htm": "x", "...html": "report", "a.b.c.html": "a.b.c", "dir/é.html": "report",
    }
    df = spark.createDataFrame([(n,) for n in names], "filename string")
    got = {r[0]: r[1] for r in df.select("filename", src.safe_report_name(F.col("filename"))).collect()}
    assert got == names


def test_archives(spark, tmp_path):
    report = HEAD + card(1, [issue("a", "x", "y")]) + card(2, [issue("b", "x", "y")])
    with zipfile.ZipFile(tmp_path / "77.zip", "w") as z:
        z.writestr("deep/Report.HTML", report)
        z.writestr("index.html", "<html></html>")
        z.writestr("notes.txt", report)
        z.writestr("copy.htm", report)
        z.writestr("long.html", report + " " * 4000)
    (tmp_path / "78.zip").write_bytes(b"not a zip")
    found = archives.scan_report_archives(spark, str(tmp_path))
    rows = {(r["artifact_id"], r["filename"]): r for r in found.collect()}
    assert {k: r["status"] for k, r in rows.items()} == {
        ("77", "Report.HTML"): "report", ("77", "index.html"): "no report", ("77", "notes.txt"): "no report",
        ("77", "copy.htm"): "report", ("77", "long.html"): "report", ("78", None): "invalid archive",
    }
    assert rows["77", "Report.HTML"]["archive_path"] == "deep/Report.HTML"
    assert bytes(rows["77", "Report.HTML"]["payload"]).decode() == report
    # Reports of archives go through the parser; copies count once.
    assert archives.report_members(found).select("report_id").distinct().count() == 2
    parsed = parse.findings_from_cards(archives.cards_from_members(found))
    assert sorted((r["issue_id"], r["finding_order"]) for r in parsed.collect()) == [("a", 0), ("a", 0), ("b", 1), ("b", 1)]
    # A limit concerns the member or archive that exceeds it, and says so.
    small = archives.scan_report_archives(spark, str(tmp_path), max_report_bytes=len(report) + 10)
    assert {r["filename"]: r["status"] for r in small.collect() if r["artifact_id"] == "77"} == {
        "Report.HTML": "report", "index.html": "no report", "notes.txt": "no report", "copy.htm": "report", "long.html": "too large",
    }
    tiny = archives.scan_report_archives(spark, str(tmp_path), max_archive_bytes=50)
    assert {r["artifact_id"]: r["status"] for r in tiny.collect()} == {"77": "archive too large", "78": "invalid archive"}


def test_html_unescape(spark):
    df = spark.createDataFrame([("&lt;p&gt; &amp;amp;",)], "t string")
    assert df.select(tx.html_unescape("t")).first()[0] == "<p> &amp;"


def test_issues_are_taken_out_of_a_card_once(spark):
    card = ('<div data-tab="text-diff">a</div> </div>' + parse.ISSUE_START + ' data-checker="c"><input data-comment-for="{}"></div>')
    texts = [card.format("1") + parse.ISSUE_START + "><input data-comment-for=\"2\"></div>", "no issue", None, parse.ISSUE_START]
    cards = spark.createDataFrame(
        [("r", i, i, t) for i, t in enumerate(texts)], "report_id string, chunk long, card_order long, card string"
    )
    rows = parse.issues_from_cards(cards)
    found = sorted((r["card_order"], r["issue_order"], r["issue_id"]) for r in rows.select("card_order", "issue_order", "issue_id").collect())
    assert [f[:2] for f in found] == [(0, 0), (0, 1), (3, 0)] and [f[2] for f in found] == ["1", "2", None]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("issue-proposed") == 2 and plan.count("split(") == 1  # its test and its value, in one place
