"""Learning evidence kept in the store and carried on from refresh to refresh.

The store remembers which generation of each report's findings, under which name, and which
generation of the observations the evidence was made from.  What differs from that now is
what has changed, whoever wrote it and whether or not an earlier refresh was broken off:

* of reports that came, changed or were renamed the findings are read, from the generations
  that hold them, and their places are stored as a generation of their own;
* of observations both generations are compared, if there are two;
* evidence is made again for the corrections that either names, and kept for all others.

``learned_from`` is written last and in one step: it names the generations of evidence, of
the places' holders and of the observations that belong together.  What a refresh that died
before has written is never read.  The first refresh finds that everything has changed, and
so does one whose noted generations have been removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import deltas, durable, learning
from marginalia.operators.memory import OBSERVATION_FIELDS
from marginalia.plans.store import Store

STATE = ["report_id", "report_name", "findings"]
MADE_FROM = ("place_generations", "evidence", "observations")


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of the left side without an equal row, nulls equal to nulls, on the right."""
    same = [left[c].eqNullSafe(right[c]) for c in STATE]
    return left.join(right.select(*STATE), same, "left_anti")


def _changed_observations(now: DataFrame, before: DataFrame) -> DataFrame:
    """Observations that came or went; a rewritten one is here in both forms."""
    signs = now.select(*OBSERVATION_FIELDS).withColumn("_sign", F.lit(1)).unionAll(
        before.select(*OBSERVATION_FIELDS).withColumn("_sign", F.lit(-1))
    )
    return signs.groupBy(*OBSERVATION_FIELDS).agg(F.sum("_sign").alias("_sign")).filter("_sign <> 0")


def _noted(store: Store) -> dict[str, int]:
    row = store.read("learned_from").first()
    if row is None or not all(store.holds(name, row[name]) for name in MADE_FROM):
        return dict.fromkeys(MADE_FROM, -1)
    return {name: row[name] for name in MADE_FROM}


def evidence(store: Store) -> DataFrame:
    """Evidence of the whole library, brought up to date and stored.

    Equal to ``learning.evidence`` over all stored findings.  Findings of reports that have
    not changed are not read.  A report without a row in ``reports`` does not count yet.
    """
    noted = _noted(store)
    at = dict(noted)
    placed, kept = (store.read_at(name, noted[name]) for name in ("place_generations", "evidence"))
    listed = store.read("reports").select("report_id", "report_name")
    current = store.read("finding_generations").withColumnRenamed("generation", "findings").join(listed, "report_id")
    fresh = durable.stored(_differing(current, placed), "fresh-reports")
    gone = _differing(placed, current).select("report_id")
    reports = durable.stored(fresh.select("report_id").unionAll(gone).distinct(), "changed-reports")

    holders = placed
    if not reports.isEmpty():
        found = store.held("report_findings", fresh.withColumnRenamed("findings", "generation"))
        number = store.append("places", learning.places(found, fresh))
        new = fresh.withColumn("generation", F.lit(number).cast("bigint")).select(*placed.columns)
        others = placed.join(reports, "report_id", "left_anti")
        at["place_generations"] = store.append("place_generations", others.unionByName(new))
        holders = store.read_at("place_generations", at["place_generations"])
    signed = deltas.signed_changes(
        *(store.held("places", side.join(reports, "report_id", "left_semi")) for side in (placed, holders))
    )

    observations = store.read("observations")
    at["observations"] = store.generation("observations")
    changed = observations.limit(0)
    if at["observations"] != noted["observations"]:
        changed = _changed_observations(observations, store.read_at("observations", noted["observations"]))
    touched = durable.stored(deltas.touched_corrections(signed, changed), "touched")
    if not touched.isEmpty():
        again = deltas.carried_evidence(kept, touched, observations, store.held("places", holders))
        at["evidence"] = store.append("evidence", again)
    if at != noted:
        numbers = [F.lit(number).cast("bigint").alias(name) for name, number in at.items()]
        store.write("learned_from", store.spark.range(1, numPartitions=1).select(*numbers))
    return store.read_at("evidence", at["evidence"])
