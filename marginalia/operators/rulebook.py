"""The rulebook: protected terms, safe typo targets and ordered exact rules."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia import fixed
from marginalia.functions import text as tx
from marginalia.operators.joins import first_per_key, with_one_row

RULE_FIELDS = ("checker", "field", "original", "proposed", "status", "comment", "source")
RULE_KEYS = ("checker", "field", "original", "proposed")
RULE_SCHEMA = ", ".join(f"{name} string" for name in RULE_FIELDS)
JSON_SCHEMA = (
    "schema_version long, rules_version string, protected_spelling_terms array<string>, "
    "safe_typo_targets array<string>, "
    f"exact_rules array<struct<{', '.join(f'{name}: string' for name in RULE_FIELDS)}>>"
)


class RulebookError(ValueError):
    """The rulebook does not have the expected form."""


@dataclass(frozen=True)
class Rulebook:
    """Three tables; ``rule_rank`` is a text that sorts rules in matching order."""

    terms: DataFrame
    targets: DataFrame
    rules: DataFrame
    version: str = "custom"


def normalize_terms(words: DataFrame) -> DataFrame:
    """Strip, lower-case and de-duplicate a ``term`` column."""
    term = F.lower(tx.strip(F.col("term")))
    return words.select(term.alias("term")).filter("term <> ''").distinct()


def base_rank(position: Column) -> Column:
    return F.concat(F.lit("0"), F.lpad(position.cast("string"), 12, "0"))


def default(spark: SparkSession) -> Rulebook:
    words = spark.createDataFrame([(w,) for w in fixed.PROTECTED_SPELLING_TERMS], "term string")
    targets = spark.createDataFrame([(w,) for w in fixed.SAFE_TYPO_TARGETS], "term string")
    rules = spark.createDataFrame(
        [(f"0{i:012d}", c, "*", o, p, s, n, None)
         for i, (c, o, p, s, n) in enumerate(fixed.EXACT_RULES)],
        f"rule_rank string, {RULE_SCHEMA}",
    )
    return Rulebook(words, targets, rules, fixed.RULES_VERSION)


def from_document(document: DataFrame) -> Rulebook:
    """Rulebook from a one-row table with the columns of the JSON file.

    A misspelt file is reported in one go: every check is a column of one small
    aggregate row.
    """
    names = dict(document.dtypes)
    for name, kind in _columns():
        if name not in names:
            document = document.withColumn(name, F.lit(None).cast(kind))
    bad_rules = F.exists(
        F.coalesce(F.col("exact_rules"), F.array()),
        lambda r: r.isNull() | ~F.coalesce(r["status"].isin(*fixed.STATUSES), F.lit(False)),
    )

    def has_null(name: str) -> Column:
        return F.exists(F.coalesce(F.col(name), F.array()), lambda w: w.isNull())

    checks = document.agg(
        F.coalesce(F.bool_and(F.col("schema_version").eqNullSafe(1)), F.lit(False)).alias("version"),
        F.bool_or(bad_rules).alias("bad_rules"),
        F.bool_or(has_null("protected_spelling_terms") | has_null("safe_typo_targets")).alias("bad_words"),
        F.first(F.coalesce("rules_version", F.lit("custom"))).alias("rules_version"),
    ).first()
    if not checks["version"]:
        raise RulebookError("unsupported rules schema, expected schema_version 1")
    if checks["bad_words"]:
        raise RulebookError("terms and targets must be lists of texts")
    if checks["bad_rules"]:
        raise RulebookError("every exact rule needs a valid status")
    rules = document.select(F.posexplode("exact_rules").alias("pos", "rule")).select(
        base_rank(F.col("pos")).alias("rule_rank"), "rule.*"
    )
    return Rulebook(
        normalize_terms(document.select(F.explode("protected_spelling_terms").alias("term"))),
        normalize_terms(document.select(F.explode("safe_typo_targets").alias("term"))),
        rules.select("rule_rank", *RULE_FIELDS),
        checks["rules_version"],
    )


def _columns() -> list[tuple[str, str]]:
    schema = T.StructType.fromDDL(JSON_SCHEMA)
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def load(spark: SparkSession, path: str) -> Rulebook:
    """Read and check a rulebook JSON file."""
    document = (
        spark.read.option("multiLine", True).option("mode", "FAILFAST")
        .schema(JSON_SCHEMA).json(path)
    )
    try:
        return from_document(document)
    except RulebookError:
        raise
    except Exception as error:  # wrong JSON types surface while reading
        raise RulebookError(f"unreadable rulebook {path}") from error


def without_automatic(book: Rulebook, remembered_terms: DataFrame) -> tuple[Rulebook, DataFrame]:
    """Drop the learned layer; also a one-row table with how much went.

    Terms carry no source, so the ones learned earlier are passed in.
    """
    automatic = F.col("source").eqNullSafe(fixed.AUTOMATIC_SOURCE)
    known = remembered_terms.select("term").distinct()
    removed = (
        book.rules.filter(automatic).select(F.lit(1).alias("n"))
        .unionAll(known.select(F.lit(1).alias("n")))
        .agg(F.count("n").alias("removed"))
    )
    return replace(
        book,
        terms=book.terms.join(known, "term", "left_anti"),
        rules=book.rules.filter(~automatic),
    ), removed


def rule_signature(rows: DataFrame) -> DataFrame:
    """Key columns used to tell rules apart, with the defaults of absent fields."""
    keyed = {k: F.coalesce(F.col(k), F.lit("*")) for k in RULE_KEYS}
    keyed["comment"] = tx.present(F.col("comment"))
    return rows.withColumns(keyed)


SIGNATURE = [*RULE_KEYS, "status", "comment"]


def uncovered(book: Rulebook, suggestions: DataFrame) -> DataFrame:
    """Suggestions the rulebook does not hold yet."""
    is_term = F.col("suggestion_type") == fixed.TERM_SUGGESTION
    new_terms = (
        suggestions.filter(is_term)
        .withColumn("term", tx.fold(tx.strip(tx.present(F.col("original")))))
        .join(book.terms, "term", "left_anti").drop("term")
    )
    have = rule_signature(book.rules).select(*SIGNATURE).distinct()
    new_rules = rule_signature(suggestions.filter(~is_term)).join(have, SIGNATURE, "left_anti")
    return new_terms.unionByName(new_rules)


def promote(book: Rulebook, suggestions: DataFrame, version: str) -> Rulebook:
    """Add selected suggestions: terms to the terms, new rules after the old ones.

    Added rules come after those of all earlier promotions, whatever the versions are
    called: the rank starts with the number of the promotion.  Within one they follow the
    order of the suggestions (coverage, evidence, occurrences, text), written as
    fixed-width digits so that no global sort is needed to number them.
    """
    chosen = suggestions.filter("selected")
    is_term = F.col("suggestion_type") == fixed.TERM_SUGGESTION
    terms = book.terms.unionByName(
        chosen.filter(is_term).select(F.lower(tx.strip(F.col("original"))).alias("term"))
    )
    candidates = rule_signature(chosen.filter(~is_term))
    for name in ("course_coverage", "occurrences"):
        if name not in candidates.columns:
            candidates = candidates.withColumn(name, F.lit(0).cast("bigint"))
    if "source" not in candidates.columns:
        candidates = candidates.withColumn("source", F.lit(fixed.HUMAN_SOURCE))
    promoted = F.when(F.col("rule_rank").startswith("1|"), F.substring("rule_rank", 3, 12).try_cast("bigint"))
    latest = book.rules.agg(F.max(promoted).alias("n")).first()["n"] or 0
    digits = [
        F.lpad((F.lit(10**15) - F.col(n)).cast("string"), 16, "0")
        for n in ("course_coverage", "evidence_count", "occurrences")
    ]
    rank = F.concat(
        F.lit(f"1|{latest + 1:012d}|"), *digits,
        F.lower(F.col("original")), F.lit("\u0000"), F.col("suggestion_id"),
    )
    have = rule_signature(book.rules).select(*SIGNATURE).distinct()
    added = (
        candidates.join(have, SIGNATURE, "left_anti")
        .withColumn("rule_rank", rank)
        .withColumn("source", F.coalesce("source", F.lit(fixed.HUMAN_SOURCE)))
        .select("rule_rank", *RULE_FIELDS)
    )
    added = first_per_key(added, SIGNATURE, [F.col("rule_rank")])
    return Rulebook(
        normalize_terms(terms), book.targets, book.rules.unionByName(added), version
    )


TABLES = ("terms", "targets", "rules")


def save_tables(book: Rulebook, path: str) -> None:
    """The rulebook as JSON lines, one folder per part, of any size."""
    for name in TABLES:
        getattr(book, name).write.mode("errorifexists").json(f"{path}/{name}")
    version = book.rules.sparkSession.range(1).select(F.lit(book.version).alias("rules_version"))
    version.write.mode("errorifexists").json(f"{path}/version")


def load_tables(spark: SparkSession, path: str) -> Rulebook:
    """What ``save_tables`` has written."""
    kinds = {"terms": "term string", "targets": "term string", "rules": f"rule_rank string, {RULE_SCHEMA}"}
    parts = [spark.read.schema(kinds[name]).json(f"{path}/{name}") for name in TABLES]
    version = spark.read.schema("rules_version string").json(f"{path}/version").first()["rules_version"]
    return Rulebook(*parts, version)


def to_json(book: Rulebook) -> DataFrame:
    """One-row table with the rulebook document as JSON text, the reference form of a
    rulebook that people edit.  ``save_tables`` writes one of any size."""
    spark = book.rules.sparkSession
    entry = F.struct("rule_rank", F.struct(*RULE_FIELDS).alias("rule"))
    rules = book.rules.agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda r: r["rule"]).alias("exact_rules")
    )
    terms = book.terms.agg(F.array_sort(F.collect_list("term")).alias("protected_spelling_terms"))
    targets = book.targets.agg(F.array_sort(F.collect_list("term")).alias("safe_typo_targets"))
    one = spark.range(1).select(
        F.lit(1).alias("schema_version"), F.lit(book.version).alias("rules_version")
    )
    whole = one
    for part in (terms, targets, rules):
        whole = with_one_row(whole, part)
    return whole.select(F.to_json(F.struct("*")).alias("value"))
