"""Rule classification of findings as one projection.

Two things need other rows: whether a report's spelling confidences differ at all
(one small aggregate per report) and the rulebook lookups (equi-joins).  The rest
is a chain of ``when`` that runs inside the scan stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import fixed
from marginalia.fixed import APPROVED, COMMENTS, NEEDS_CHANGE, REJECTED
from marginalia.functions import text as tx
from marginalia.operators import joins
from marginalia.operators import rulebook as rb


def verdict(status: str, comment: str | Column = "") -> Column:
    text = comment if isinstance(comment, Column) else F.lit(COMMENTS.get(comment, comment))
    return F.struct(F.lit(status).alias("status"), text.alias("comment"))


def chain(cases: list[tuple[Column, Column]], default: Column) -> Column:
    """First case that holds."""
    first, *rest = cases
    start = F.when(*first)
    return reduce(lambda c, case: c.when(*case), rest, start).otherwise(default)


def text_of(name: str) -> Column:
    return tx.present(F.col(name))


def confidence_flags(findings: DataFrame) -> DataFrame:
    """Reports whose spelling findings carry more than one confidence, null included.

    Minimum against maximum needs constant memory per report, however many rows or
    confidences it has.
    """
    c = F.col("confidence")
    several = (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1))))
    return (
        findings.filter(F.col("checker") == "check_spelling")
        .groupBy("report_id").agg(F.coalesce(several, F.lit(False)).alias("informative"))
        .filter("informative")
    )


# ------------------------------------------------------------- exact rules
def masked_rules(rules: DataFrame) -> DataFrame:
    """Rules with a ``mask`` that says which fields are fixed ('1') or free ('0')."""
    bits = [
        F.when(F.col(k).isNotNull() & (F.col(k) != "*"), "1").otherwise("0") for k in rb.RULE_KEYS
    ]
    return rules.select(
        F.concat(*bits).alias("mask"), *rb.RULE_KEYS, "rule_rank", "status",
        tx.present(F.col("comment")).alias("comment"),
    )


def rule_sizes(book: rb.Rulebook) -> dict[str, int]:
    """Bytes of each lookup the rulebook makes: one row per mask in use (at most
    sixteen) and one for terms and targets."""
    def sized(rows: DataFrame, part) -> DataFrame:
        text = F.octet_length(F.to_json(F.struct(*rows.columns)))
        return rows.select(part.alias("part"), text.cast("bigint").alias("bytes"))

    rules = sized(masked_rules(book.rules), F.col("mask"))
    words = sized(book.terms, F.lit("terms")).unionAll(sized(book.targets, F.lit("targets")))
    found = rules.unionAll(words).groupBy("part").agg(F.sum("bytes").alias("bytes")).collect()
    return {row["part"]: row["bytes"] for row in found}


def join_sized(facts: DataFrame, lookup: DataFrame, keys: list[str], size: int) -> DataFrame:
    if size <= joins.BROADCAST_BYTES:
        return facts.join(F.broadcast(lookup), keys, "left")
    return joins.skew_join(facts, lookup, keys, "left")


def with_exact_rule(findings: DataFrame, rules: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Add ``rule``: the first matching exact rule, or null.

    Ordered wildcard rules become plain equi-joins, one per mask in use; in each,
    the first rule per key is the only one that can win.
    """
    hits = []
    masked = masked_rules(rules)
    for mask in sorted(m for m in sizes if m not in ("terms", "targets")):
        names = [k for k, bit in zip(rb.RULE_KEYS, mask) if bit == "1"]
        part = masked.filter(F.col("mask") == mask)
        hits.append(f"_hit_{mask}")
        if not names:  # a rule without any fixed field matches every finding
            top = part.agg(F.min(F.struct("rule_rank", "status", "comment")).alias(f"_hit_{mask}"))
            findings = joins.with_one_row(findings, top)
            continue
        keys = [f"_k_{n}" for n in names]
        best = part.groupBy(*names).agg(
            F.min(F.struct("rule_rank", "status", "comment")).alias(f"_hit_{mask}")
        )
        lookup = best.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], f"_hit_{mask}")
        keyed = findings.withColumns({k: text_of(n) for n, k in zip(names, keys)})
        findings = join_sized(keyed, lookup, keys, sizes[mask]).drop(*keys)
    if not hits:
        none = F.lit(None).cast("struct<rule_rank:string,status:string,comment:string>")
        return findings.withColumn("rule", none)
    first = F.least(*hits) if len(hits) > 1 else F.col(hits[0])
    return findings.withColumn("rule", first).drop(*hits)


# ---------------------------------------------------------------- branches
def looks_like_code(before: Column, after: Column) -> Column:
    """A standards code, a cut LaTeX escape or a math label around the gap."""
    around = F.concat(before, F.lit(" "), F.substring(after, 1, 30))
    return (
        before.endswith("\\")
        | tx.found(around, fixed.STANDARDS_CODE)
        | tx.found(before, fixed.STANDARDS_CODE_PREFIX)
        | tx.found(before, fixed.MATH_LABEL)
    )


def is_bare_token(after: Column) -> Column:
    return ~after.rlike(r"\A(?:[a-zA-Z]|[ \t\xa0]+[a-zA-Z]{2})")


def is_math_subject(after: Column) -> Column:
    return tx.found(after, fixed.MATH_SUBJECT, ignore_case=True)


def sentence_boundary(before: Column) -> Column:
    """``boundary``, ``abbreviation`` or ``unclear``."""
    tail = tx.rstrip(before)
    return (
        F.when(tail == "", "boundary")
        .when(tx.found(tail, fixed.ABBREVIATION_TAIL, ignore_case=True), "abbreviation")
        .when(tx.found(tail, fixed.INITIALS_TAIL), "abbreviation")
        .when(tx.found(tail, fixed.LIST_MARKER_TAIL), "boundary")
        .when(F.right(tail, F.lit(1)).isin(".", "!", "?"), "boundary")
        .otherwise("unclear")
    )


def asks_for_review(reasoning: Column) -> Column:
    return reasoning.rlike(tx.any_of(fixed.CAPITALIZATION_FLAG_PHRASES)) | reasoning.rlike(
        "(?<!un)ambiguous"
    )


def is_notation(reasoning: Column) -> Column:
    return reasoning.rlike(tx.any_of(fixed.CAPITALIZATION_REJECT_PHRASES))


def spelling(informative: Column, protected: Column, safe_target: Column) -> Column:
    original = F.lower(tx.strip(text_of("original")))
    proposed = F.lower(tx.strip(text_of("proposed")))
    return chain(
        [
            (text_of("context_before").endswith("\\"), verdict(REJECTED, "latex")),
            (original.rlike(r"(?di)\A(.)\1{2,}\z"), verdict(REJECTED, "repeated")),
            (informative & F.equal_null(F.col("confidence"), F.lit("high")), verdict(APPROVED)),
            (informative, verdict(REJECTED, "jargon")),
            (original.rlike(r"\A[a-e]hs[a-z]\z"), verdict(REJECTED, "code_artifact")),
            (protected, verdict(REJECTED, "protected")),
            (safe_target & tx.is_one_edit(original, proposed), verdict(APPROVED)),
        ],
        verdict(NEEDS_CHANGE, "no_confidence"),
    )


def capitalization(container_known: Column) -> Column:
    before, after = text_of("context_before"), text_of("context_after")
    raw = text_of("reasoning")
    reasoning = F.lower(raw)
    tag = F.col("container_tag")
    in_cell = F.coalesce(tag.isin("th", "td"), F.lit(False))
    in_text = F.coalesce(tag.isin("p", "li"), F.lit(False))
    prior = F.coalesce(F.col("container_cell_has_prior_text"), F.lit(False))
    flattened = container_known & tag.isNull() & F.equal_null(F.col("field"), F.lit("body_value"))

    def by_boundary(where: str) -> Column:
        kind = F.col("_boundary")
        return chain(
            [
                (kind == "boundary", verdict(APPROVED, f"{where}_sentence")),
                (kind == "abbreviation", verdict(REJECTED, f"{where}_abbreviation")),
            ],
            verdict(NEEDS_CHANGE, f"{where}_unclear"),
        )

    return chain(
        [
            (is_bare_token(after), verdict(REJECTED, "bare_token")),
            (is_math_subject(after), verdict(REJECTED, "math_subject")),
            (in_cell & prior, by_boundary("cell")),
            (in_cell, verdict(REJECTED, "cell_label")),
            (in_text, by_boundary("text")),
            (flattened & tx.found(before, fixed.OPENING_QUOTE_TAIL), verdict(APPROVED, "quoted")),
            (flattened, verdict(REJECTED, "flattened")),
            ((raw != "") & is_notation(reasoning), verdict(REJECTED, "notation")),
            ((raw != "") & asks_for_review(reasoning), verdict(NEEDS_CHANGE, "ambiguous_case")),
            (raw != "", verdict(APPROVED)),
            (F.equal_null(F.col("field"), F.lit("title")), verdict(APPROVED)),
        ],
        verdict(NEEDS_CHANGE, "no_reasoning"),
    )


def math() -> Column:
    upstream = F.contains(text_of("reasoning"), F.lit("upstream value")) | F.contains(
        text_of("proposed"), F.lit("upstream value")
    )
    return F.when(upstream, verdict(NEEDS_CHANGE, "upstream")).otherwise(
        verdict(REJECTED, "math_misread")
    )


def proper_nouns() -> Column:
    around = F.lower(F.concat_ws(
        " ", text_of("context_before"), text_of("original"), text_of("context_after")
    ))
    official = (F.lower(text_of("original")) == "texas") & F.contains(
        around, F.lit("essential knowledge and skills")
    )
    return F.when(official, verdict(APPROVED, "official_title")).otherwise(
        verdict(REJECTED, "common_noun")
    )


def punctuation() -> Column:
    original, proposed = text_of("original"), text_of("proposed")
    doubled = (original == "..") & (proposed == ".")
    return chain(
        [
            (doubled & (tx.strip(text_of("context_after")) != ""),
             verdict(REJECTED, "trailing_off")),
            (doubled, verdict(NEEDS_CHANGE, "double_period")),
            (original.startswith(".") & proposed.startswith(". ") & (F.length(original) > 2),
             verdict(APPROVED)),
        ],
        verdict(NEEDS_CHANGE, "punctuation"),
    )


def spacing() -> Column:
    original, proposed = text_of("original"), text_of("proposed")
    before, after = text_of("context_before"), text_of("context_after")
    led = F.regexp_replace(original, tx.py_regex(r"^\s+"), "")
    gap = tx.found(original, r"^[.:;][A-Za-z]$")
    safe = (
        (tx.found(original, r"^\s[.,?);:]$") & (led == proposed))
        | (tx.found(original, "^,[A-Za-z]$") & tx.found(proposed, "^, [A-Za-z]$"))
        | (tx.found(original, r"^\s+$") & (proposed == " ") & (F.length(original) > 1))
        | tx.found(original, "^[?!][A-Z]$")
    )
    return chain(
        [
            (safe, verdict(APPROVED)),
            (gap & looks_like_code(before, after), verdict(REJECTED, "code_boundary")),
            (gap & tx.found(before, fixed.MATH_LABEL_AMBIGUOUS),
             verdict(NEEDS_CHANGE, "answer_label")),
            (gap, verdict(APPROVED)),
        ],
        verdict(NEEDS_CHANGE, "spacing"),
    )


# ------------------------------------------------------------------ driver
def with_verdict(findings: DataFrame, book: rb.Rulebook,
                 flags: DataFrame | None = None) -> DataFrame:
    """Add ``status`` and ``comment`` to raw findings of many reports.

    ``flags`` may hand in the confidence flags when they are stored already.
    ``container_known`` says whether a finding was parsed with container data;
    without that column, having a ``container_tag`` column decides.
    """
    known = "container_tag" in findings.columns
    extra = {
        "reasoning": "string", "container_tag": "string",
        "container_cell_has_prior_text": "boolean",
    }
    work = findings
    for name, kind in extra.items():
        if name not in work.columns:
            work = work.withColumn(name, F.lit(None).cast(kind))
    if "container_known" not in work.columns:
        work = work.withColumn("container_known", F.lit(known))
    if flags is None:
        flags = confidence_flags(work)
    sizes = rule_sizes(book)
    work = joins.lookup_join(work, flags, ["report_id"])
    work = with_exact_rule(work, book.rules, sizes)
    # Only spelling rows look words up; other rows carry null keys.
    is_spelling = F.col("checker") == "check_spelling"
    work = work.withColumns({
        "_word": F.when(is_spelling, F.lower(tx.strip(text_of("original")))),
        "_target": F.when(is_spelling, F.lower(tx.strip(text_of("proposed")))),
        "_boundary": F.when(
            F.col("checker") == "check_capitalization", sentence_boundary(text_of("context_before"))
        ),
    })
    terms = book.terms.select(F.col("term").alias("_word"), F.lit(True).alias("_protected"))
    targets = book.targets.select(F.col("term").alias("_target"), F.lit(True).alias("_safe"))
    work = join_sized(work, terms, ["_word"], sizes.get("terms", 0))
    work = join_sized(work, targets, ["_target"], sizes.get("targets", 0))

    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    checker = text_of("checker")
    unknown = F.concat(F.lit('Unrecognized checker "'), checker, F.lit('".'))
    result = chain(
        [
            (F.col("rule").isNotNull(),
             F.struct(F.col("rule.status").alias("status"), F.col("rule.comment").alias("comment"))),
            (checker == "check_spelling", spelling(yes("informative"), yes("_protected"), yes("_safe"))),
            (checker == "check_capitalization", capitalization(yes("container_known"))),
            (checker == "check_math", math()),
            (checker == "check_proper_nouns", proper_nouns()),
            (checker == "check_links", verdict(APPROVED)),
            (checker == "check_punctuation", punctuation()),
            (checker == "check_spacing", spacing()),
        ],
        verdict(NEEDS_CHANGE, unknown),
    )
    return work.withColumn("_v", result).withColumns(
        {"status": F.col("_v.status"), "comment": F.col("_v.comment")}
    ).drop("_v", "_word", "_target", "_protected", "_safe", "_boundary", "informative", "rule")


def classified_columns(rows: DataFrame, *more: str) -> DataFrame:
    """The classified row: null as '' and the detail columns in order."""
    return rows.select(
        "report_id", *[text_of(n).alias(n) for n in fixed.DETAIL_FIELDS], *more
    )


def classify(findings: DataFrame, book: rb.Rulebook, *more: str) -> DataFrame:
    """Classified rows of many reports, one per finding."""
    return classified_columns(with_verdict(findings, book), *more)
