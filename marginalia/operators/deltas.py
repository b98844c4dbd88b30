"""Learning evidence carried from upload to upload by signed changes.

``learning.places`` sums the library up, one row per (correction, report).  An upload makes
the places of its own reports and compares them with what the summary held of these
reports: equal rows cancel, the rest are retractions (-1) and additions (+1).  Evidence is
made again for the corrections that such a change or a changed observation names, from the
summary; all other evidence rows are carried over.  Findings of earlier uploads are not
read.

A report that is stored again replaces all its places, also when it has none left.  Repeated
rows of an upload count as they do from scratch; a null correction is a key like any other
and never agreed, so it makes no evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import learning

PLACE = ["core_key", "report_id", "report_name", "n", "first"]


def signed_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Places that differ: those that go with ``sign`` -1, those that come with +1."""
    both = before.select(*PLACE, F.lit(-1).alias("sign")).unionAll(
        after.select(*PLACE, F.lit(1).alias("sign"))
    )
    return both.groupBy(*PLACE).agg(F.sum("sign").alias("sign")).filter("sign <> 0")


def replace_reports(summary: DataFrame, uploaded: DataFrame,
                    reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The summary after an upload of these reports, and its signed changes.

    ``uploaded`` are the places of the uploaded findings, ``reports`` the uploaded reports,
    those without findings included.
    """
    ids = reports.select("report_id").distinct()
    before = summary.join(ids, "report_id", "left_semi")
    others = summary.join(ids, "report_id", "left_anti")
    after = others.select(*PLACE).unionAll(uploaded.select(*PLACE))
    return after, signed_changes(before, uploaded)


def touched_corrections(changes: DataFrame, changed_observations: DataFrame) -> DataFrame:
    """Corrections whose evidence may differ.  Changed observations are those that came, went
    or were rewritten, in the old form or the new."""
    return changes.select("core_key").unionAll(changed_observations.select("core_key")).distinct()


def carried_evidence(evidence: DataFrame, touched: DataFrame, observations: DataFrame,
                     summary: DataFrame) -> DataFrame:
    """Evidence after an upload: that of touched corrections anew, the rest as it was."""
    again = learning.evidence_at(
        observations.join(touched, "core_key", "left_semi"),
        summary.join(touched, "core_key", "left_semi"),
    )
    rest = evidence.join(touched, "core_key", "left_anti")
    return rest.select(*learning.EVIDENCE_FIELDS).unionAll(again.select(*learning.EVIDENCE_FIELDS))
