"""Findings from report cards.

One input row is one card, so a report of any size is parsed in parallel.  Plain
attributes come from native expressions.  Everything that depends on positions
inside the markup (diff windows, the surrounding container) and HTML character
references is done for a whole card in one Arrow UDF call.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import text as tx
from marginalia.operators import durable
from marginalia.operators.joins import lookup_join, with_position

CARD_START = '<div class="issue-card" id="annotation-card-'
ISSUE_START = '<div class="aggregated-issue"'
# Sizes of the windows around a change.
RAW_WINDOW, CONTEXT, ANCHOR_CONTEXT = 600, 150, 60
ANCHOR_BACKOFF = (60, 40, 25, 15, 8)

_PAIR = re.compile(
    r'<span class="inline-del">.*?</span>\s*<span class="inline-ins">.*?</span>', re.S
)
_TAG = re.compile(r"<[^>]+>")
_CELL = re.compile(r"<(/?)(td|th)\b")
_BLOCK = re.compile(r"</?(th|td|p|li|tr|table)\b")
_MARKUP = re.compile(r"<[^>]*(?:>|\Z)")


def plain_text(markup: str) -> str:
    return html.unescape(_TAG.sub("", markup))


class OriginalMarkup:
    """Where a text sits in the original markup of a card."""

    def __init__(self, markup: str):
        self.markup = markup
        # runs of visible text, and how many non-blank characters precede each
        spans, at = [], 0
        for tag in _MARKUP.finditer(markup):
            spans.append((at, tag.start()))
            at = tag.end()
        spans.append((at, len(markup)))
        runs = [(s, "".join(markup[s:e].split()), e) for s, e in spans if s < e]
        self.starts = [s for s, _, _ in runs]
        self.ends = [e for _, _, e in runs]
        self.before = list(accumulate((len(t) for _, t, _ in runs), initial=0))
        self.dense = "".join(t for _, t, _ in runs)
        self.cells = [(m.start(), m.end(), bool(m[1]), m[2]) for m in _CELL.finditer(markup)]
        self.blocks = [(m.start(), m[0].startswith("</"), m[1]) for m in _BLOCK.finditer(markup)]

    def locate(self, anchor: str) -> int | None:
        """Position in the markup of the first place the anchor appears, blanks ignored."""
        needle = "".join(anchor.split())
        if not needle:
            return None
        tries = [needle] + [needle[:n] for n in ANCHOR_BACKOFF if len(needle) > n]
        at = next((p for p in map(self.dense.find, tries) if p >= 0), None)
        if at is None or at >= len(self.dense):
            return None
        run = bisect_right(self.before, at) - 1
        skip = at - self.before[run]
        for position in range(self.starts[run], self.ends[run]):
            if not self.markup[position].isspace():
                if skip == 0:
                    return position
                skip -= 1
        return None

    def container(self, anchor: str) -> tuple[str | None, bool]:
        """Tag around the anchor, and whether its table cell has earlier text."""
        position = self.locate(anchor)
        if position is None:
            return None, False
        depth = {"td": 0, "th": 0}
        opened = None
        for start, end, closes, tag in self.cells[: bisect_left(self.cells, (position,))]:
            outside = depth["td"] + depth["th"] <= 0
            depth[tag] += -1 if closes else 1
            if not closes and outside:
                close = self.markup.find(">", end)
                opened = close + 1 if close >= 0 else end
        for tag in ("td", "th"):
            if depth[tag] > 0:
                inner = "" if opened is None else self.markup[opened:position]
                return tag, bool(_MARKUP.sub("", inner).strip())
        known = bisect_left(self.blocks, (position,))
        if known == 0 or self.blocks[known - 1][1]:
            return None, False
        return self.blocks[known - 1][2], False


ISSUE = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("original", "proposed", "reasoning", "context_before", "context_after",
                 "container_tag")
] + [T.StructField("container_cell_has_prior_text", T.BooleanType())])


def read_issues(diff: str, original_tab: str | None, issues) -> list[dict]:
    """Decode the issues of one card; the i-th issue goes with the i-th change."""
    pairs = [m.span() for m in _PAIR.finditer(diff)]
    source = html.unescape(html.unescape(original_tab or ""))
    markup = OriginalMarkup(source) if source else None
    out = []
    for i, raw in enumerate(issues):
        row = {
            name: None if raw[name] is None else plain_text(raw[name])
            for name in ("original", "proposed", "reasoning")
        }
        if row["reasoning"] is not None:
            row["reasoning"] = row["reasoning"].strip()
        before = after = ""
        if i < len(pairs):
            start, end = pairs[i]
            before = plain_text(diff[max(0, start - RAW_WINDOW):start])[-CONTEXT:]
            after = plain_text(diff[end:end + RAW_WINDOW])[:CONTEXT]
        tag, prior = None, False
        if markup and row["original"]:
            tag, prior = markup.container(row["original"] + after[:ANCHOR_CONTEXT])
        out.append({
            **row, "context_before": before, "context_after": after,
            "container_tag": tag, "container_cell_has_prior_text": prior,
        })
    return out


@F.pandas_udf(T.ArrayType(ISSUE))
def _read_issues(diff: pd.Series, original_tab: pd.Series, issues: pd.Series) -> pd.Series:
    return pd.Series(
        [read_issues(d, o, i) for d, o, i in zip(diff, original_tab, issues)], dtype=object
    )


def attribute(block: Column, name: str) -> Column:
    return tx.extract_or_null(block, f'{name}="([^"]*)"')


def _tab(card: Column, name: str) -> Column:
    # looked for once: a test before it would read the tab twice
    pattern = tx.py_regex(rf'(?s)data-tab="{name}">(.*?)</div>\s*</div>')
    return F.get(F.regexp_extract_all(card, F.lit(pattern), F.lit(1)), 0)


RECORD_FIELDS = (
    "issue_id", "checker", "confidence", "field", "node_type", "node_label", "node_link",
    "breadcrumb", "original", "proposed", "reasoning", "context", "context_before",
    "context_after", "container_tag", "container_cell_has_prior_text",
)


def issues_from_cards(cards: DataFrame) -> DataFrame:
    """Every issue of every card, in order, duplicates included.

    ``cards`` has ``report_id``, ``chunk`` and ``card_order`` (increasing within a
    report) and ``card``.
    """
    card = F.col("card")
    node = tx.py_regex(r"<strong>([^<]+)</strong>:\s*([^&<]+)")
    # what stands behind each opening of an issue; no card holds so many as the slice may
    chunks = F.slice(F.split(card, ISSUE_START, -1), 2, 1 << 30)

    def issue(chunk: Column) -> Column:
        return F.struct(
            tx.extract_or_null(chunk, 'data-comment-for="([^"]+)"').alias("issue_id"),
            *[attribute(chunk, f"data-{n}").alias(n) for n in ("checker", "confidence", "field")],
            tx.extract_or_null(chunk, '(?s)issue-original">(.*?)</span>').alias("original"),
            tx.extract_or_null(chunk, '(?s)issue-proposed">(.*?)</span>').alias("proposed"),
            tx.extract_or_null(chunk, '(?s)class="reasoning">(.*?)</div>').alias("reasoning"),
        )

    # Cards without an issue go by a test of their text: one of the issues taken out of it
    # would have Spark take them out twice, below the columns and again in them.
    parsed = cards.filter(F.contains(card, F.lit(ISSUE_START))).select(
        "report_id", "chunk", "card_order",
        *[attribute(card, f"data-{n}").alias(f"card_{n}") for n in ("checker", "confidence", "field")],
        tx.strip(tx.extract_or_null(card, node, 1)).alias("node_type"),
        tx.strip(tx.extract_or_null(card, node, 2)).alias("node_label"),
        tx.extract_or_null(card, 'href="([^"]+)"').alias("node_link"),
        F.array_join(
            F.regexp_extract_all(card, F.lit('breadcrumb-pill">([^<]*)</span>'), F.lit(1)), " > "
        ).alias("breadcrumb"),
        tx.present(_tab(card, "text-diff")).alias("_diff"),
        _tab(card, "original").alias("_original_tab"),
        F.transform(chunks, issue).alias("_issues"),
    )
    decoded = parsed.withColumn("_decoded", _read_issues("_diff", "_original_tab", "_issues"))
    rows = decoded.select(
        "*", F.posexplode(F.arrays_zip("_issues", "_decoded")).alias("issue_order", "_issue")
    )

    def own_or_card(name: str) -> Column:
        own = F.col(f"_issue._issues.{name}")
        return F.when(tx.present(own) != "", own).otherwise(F.col(f"card_{name}")).alias(name)

    decoded_names = [f.name for f in ISSUE.fields]
    before, after = F.col("_issue._decoded.context_before"), F.col("_issue._decoded.context_after")
    return rows.select(
        "report_id", "chunk", "card_order", "issue_order",
        F.col("_issue._issues.issue_id").alias("issue_id"),
        *[own_or_card(n) for n in ("checker", "confidence", "field")],
        "node_type", "node_label", "node_link", "breadcrumb",
        *[F.col(f"_issue._decoded.{n}").alias(n) for n in decoded_names],
        F.concat(before, F.lit(" <<DIFF>> "), after).alias("context"),
    )


def findings_from_cards(cards: DataFrame) -> DataFrame:
    """One row per finding: first issue of each id, numbered in document order."""
    key, place = ["report_id", "issue_id"], F.struct("chunk", "card_order", "issue_order")
    # stored, so that what follows does not read the report texts a second time
    issues = durable.stored(
        issues_from_cards(cards).filter(tx.present(F.col("issue_id")) != ""), "issues"
    )
    # Ids are nearly unique: only the few repeated ones are looked up, on narrow rows.
    repeated = durable.stored(
        issues.groupBy(*key).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1).drop("_n"), "repeated",
    )
    first = lookup_join(issues, repeated, key).filter(F.col("_first").isNull() | (F.col("_first") == place))
    placed = with_position(
        first.drop("_first"), ["report_id"], "chunk", ["card_order", "issue_order"], "finding_order"
    )
    return placed.select(
        "report_id", "finding_order", *RECORD_FIELDS, F.lit(True).alias("container_known")
    )


def reports_without_findings(manifest: DataFrame, findings: DataFrame) -> DataFrame:
    """Reports that yielded nothing; the batch goes on without them."""
    return manifest.join(
        findings.select("report_id").distinct(), "report_id", "left_anti"
    ).withColumn("reason", F.lit("no annotation issues were found"))
