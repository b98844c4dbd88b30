"""Which findings a change of the rulebook can touch.

A verdict depends on the rulebook through three lookups only: the first exact rule whose
fixed fields a finding has, whether its word is protected, and whether its replacement is a
safe target.  So it can change only where a rule, term or target that one of two rulebooks
holds and the other does not meets the finding.  ``finding_keys`` is the inverted index from
what rules can ask for to the findings; ``changed_keys`` is what two rulebooks differ in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import durable
from marginalia.operators import rulebook as rb
from marginalia.operators.classify import masked_rules, text_of
from marginalia.operators.joins import skew_join

TERMS, TARGETS = "terms", "targets"


def _key(kind: str, values: list[Column]) -> Column:
    """What a lookup asks for: the lookup's kind with its values, as 128 bits."""
    parts = [F.concat(F.length(v).cast("string"), F.lit(":"), v) for v in values]
    return F.unhex(F.md5(F.concat(F.lit(f"{kind}|"), *parts).cast("binary")))


def kinds_of(*books: rb.Rulebook) -> set[str]:
    """The lookups that rulebooks make: masks of their rules (sixteen at most) and words."""
    found = {TERMS, TARGETS}
    for book in books:
        found |= {r["mask"] for r in masked_rules(book.rules).select("mask").distinct().collect()}
    return found


def finding_keys(findings: DataFrame, kinds: set[str]) -> DataFrame:
    """(kind, key, report_id, issue_id) of raw findings for each of the lookups.

    Spelling findings alone look words up.  A rule without fixed fields asks for nothing,
    so all findings have its key.
    """
    spelling = F.col("checker") == "check_spelling"
    entries = []
    for kind in sorted(kinds):
        if kind in (TERMS, TARGETS):
            word = F.lower(tx.strip(text_of("original" if kind == TERMS else "proposed")))
            key = F.when(spelling, _key(kind, [word]))
        else:
            key = _key(kind, [text_of(n) for n, bit in zip(rb.RULE_KEYS, kind) if bit == "1"])
        entries.append(F.struct(F.lit(kind).alias("kind"), key.alias("key")))
    rows = findings.select("report_id", "issue_id", F.explode(F.array(*entries)).alias("e"))
    return rows.select("e.kind", "e.key", "report_id", "issue_id").filter(F.col("key").isNotNull())


def changed_keys(old: rb.Rulebook, new: rb.Rulebook) -> DataFrame:
    """(kind, key) of everything that only one of two rulebooks holds.

    A rule that has moved in the order, or has another status or comment, counts as one that
    went and one that came.
    """
    def only_one(a: DataFrame, b: DataFrame) -> DataFrame:
        marked = a.withColumn("_a", F.lit(1)).unionByName(b.withColumn("_a", F.lit(2)))
        names = a.columns
        return marked.groupBy(*names).agg(F.min("_a").alias("lo"), F.max("_a").alias("hi")).filter("lo = hi").select(*names)

    rules = durable.stored(only_one(masked_rules(old.rules), masked_rules(new.rules)), "changed-rules")
    found = None
    for kind in sorted(r["mask"] for r in rules.select("mask").distinct().collect()):
        values = [F.col(n) for n, bit in zip(rb.RULE_KEYS, kind) if bit == "1"]
        part = rules.filter(F.col("mask") == kind).select(F.lit(kind).alias("kind"), _key(kind, values).alias("key"))
        found = part if found is None else found.unionByName(part)
    for kind, a, b in ((TERMS, old.terms, new.terms), (TARGETS, old.targets, new.targets)):
        words = only_one(a.select("term"), b.select("term"))
        part = words.select(F.lit(kind).alias("kind"), _key(kind, [F.col("term")]).alias("key"))
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def touched(index: DataFrame, changes: DataFrame) -> DataFrame:
    """(report_id, issue_id) of the findings that a change can touch, each once.

    Common keys (a word found everywhere) are split over tasks."""
    met = skew_join(index, changes.select("kind", "key"), ["kind", "key"])
    return met.select("report_id", "issue_id").distinct()
