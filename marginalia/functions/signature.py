"""Content fingerprints of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import fixed
from marginalia.functions import text as tx

SEPARATOR = "\u001f"


def json_hash(*values: Column) -> Column:
    """sha256 of the compact JSON array ``[version, value, ...]``."""
    body = F.to_json(F.array(*values))
    for code in ("0E", "0F", "1A", "1B"):  # control escapes are written in lower case
        body = F.replace(body, F.lit(f"\\u00{code}"), F.lit(f"\\u00{code.lower()}"))
    head = F.lit(f"[{fixed.FINGERPRINT_VERSION},")
    return F.sha2(F.concat(head, F.substring(body, 2, 2147483647)), 256)


def pair_id(report_id: Column, issue_id: Column) -> Column:
    """Id of a finding or observation."""
    return F.sha2(F.concat_ws(SEPARATOR, tx.present(report_id), tx.present(issue_id)), 256)


def short_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *map(tx.present, parts)), 256), 1, 16)


SIGNATURE_COLUMNS = (
    "fingerprint", "core_key", "anchor_kind", "anchor",
    "checker_key", "field_key", "original_key", "proposed_key",
)


def with_signature(findings: DataFrame) -> DataFrame:
    """Add the signature columns; '' where a finding has no usable anchor."""
    names = ("checker", "field", "original", "proposed",
             "context_before", "context_after", "node_label")
    normal, segments = tx.normalize_all(
        [F.col(n) for n in names], F.col("breadcrumb")
    )
    work = findings.withColumns({
        "checker_key": normal[0], "field_key": normal[1],
        "original_key": normal[2], "proposed_key": normal[3],
        "_before": normal[4], "_after": normal[5], "_label": normal[6],
        "_path": tx.breadcrumb_path(segments),
    })
    in_context = F.length(tx.strip(F.concat("_before", "_after"))) >= 20
    context = tx.strip(F.concat("_before", F.lit(" <change> "), "_after"))
    place = tx.strip(F.concat("_path", F.lit(" | "), "_label"), " |")
    kind = F.when(in_context, "context").when(F.length(place) >= 8, "location").otherwise("")
    work = work.withColumns({
        "anchor_kind": kind,
        "anchor": F.when(in_context, context).when(F.length(place) >= 8, place).otherwise(""),
        "core_key": json_hash(*[F.col(f"{n}_key") for n in names[:4]]),
    })
    fingerprint = json_hash(F.col("core_key"), F.col("anchor_kind"), F.col("anchor"))
    return work.withColumn(
        "fingerprint", F.when(F.col("anchor_kind") != "", fingerprint).otherwise("")
    ).drop("_before", "_after", "_label", "_path")


def with_fingerprint(findings: DataFrame) -> DataFrame:
    """Findings that have a fingerprint, with their signature.

    The signature passes through a generator, below which Spark moves no test of it: there
    each name in the test would be the whole normalisation of the texts, made again.
    """
    signed = with_signature(findings)
    others = [c for c in signed.columns if c not in SIGNATURE_COLUMNS]
    once = F.inline(F.array(F.struct(*SIGNATURE_COLUMNS)))
    return signed.select(*others, once).filter(F.col("fingerprint") != "")
