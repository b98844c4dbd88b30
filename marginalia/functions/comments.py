"""Which part of a comment may leave the review as training text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import fixed
from marginalia.functions import text as tx


def _whole(phrases) -> str:
    return rf"\A\s*(?:{'|'.join(phrases)})[\s.!]*\z"


def _words(phrases) -> str:
    return rf"\b(?:{'|'.join(phrases)})\b"


def _mentions(clause: Column, original: Column, proposed: Column) -> Column:
    folded = tx.fold(clause)

    def named(value: Column) -> Column:
        token = tx.fold(tx.strip(tx.present(value)))
        return (F.length(token) >= 2) & F.contains(folded, token)

    return named(original) | named(proposed)


def is_training_clause(clause: Column, original: Column, proposed: Column) -> Column:
    def says(pattern: str) -> Column:
        return tx.found(clause, pattern, ignore_case=True)

    mentioned = _mentions(clause, original, proposed)
    useful = (
        says(_words(fixed.CONCRETE_PHRASES))
        | says(fixed.DIRECT_ACTION)
        | (says(fixed.CONDITIONAL_ACTION) & (mentioned | says(fixed.QUOTED_TEXT)))
        | (mentioned & says(fixed.JUDGEMENT))
    )
    return (
        (clause != "")
        & ~says(_whole(fixed.VAGUE_PHRASES))
        & ~says(_words(fixed.OPERATIONAL_PHRASES))
        & useful
    )


def training_comment(
    comment: Column, checker: Column, original: Column, proposed: Column
) -> Column:
    """The reusable clauses of a comment, '' when there are none."""
    prefix = tx.py_regex(fixed.REVIEW_PREFIX, ignore_case=True)
    cleaned = tx.strip(F.regexp_replace(tx.collapse(tx.present(comment)), prefix, ""))

    def choose(text: Column) -> Column:
        clauses = F.transform(
            F.split(text, tx.py_regex(fixed.CLAUSE_BREAK), -1), lambda c: tx.strip(c, " \t,;")
        )
        parts = F.struct(
            F.filter(clauses, lambda c: is_training_clause(c, original, proposed)).alias("useful"),
            F.size(clauses).alias("total"),
        )
        kept = tx.let(
            parts,
            lambda p: F.when(F.size(p["useful"]) == p["total"], text)
            .otherwise(F.array_join(p["useful"], "; ")),
        )
        vague = tx.found(text, _whole(fixed.VAGUE_PHRASES), ignore_case=True)
        return F.when((text == "") | vague, "").otherwise(kept)

    return F.when(
        F.equal_null(checker, F.lit("check_links")) | (tx.present(comment) == ""), ""
    ).otherwise(tx.let(cleaned, choose))


def finalize_training_comments(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "comment",
        training_comment(
            F.col("comment"), F.col("checker"), F.col("original"), F.col("proposed")
        ),
    )
