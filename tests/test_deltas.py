"""Evidence carried by signed changes, against evidence from scratch after each upload."""

import random

from marginalia.operators import deltas, durable, learning

FINDINGS = (
    "core_key string, report_id string, checker string, field_name string, original string, "
    "proposed string, finding_order long"
)
OBSERVATIONS = (
    "core_key string, source_report_id string, source_report string, checker string, field_name string, "
    "original string, proposed string, status string, note string, updated_at string, observation_id string"
)


def found(rng, report, n):
    keys = [rng.choice(["k0", "k1", "k2", "k3", "k4", None]) for _ in range(n)]
    return [(k, report, "check_spelling", "body", rng.choice(["teh", None, ""]), "the", i) for i, k in enumerate(keys)]


def observed(rng, report, n):
    return [
        (f"k{rng.randrange(6)}", report, f"Course {report}", "check_spelling", "body", "teh", "the",
         rng.choice(["approved"] * 5 + ["rejected"]), "", f"2024-01-{i + 1:02d}", f"{report}-{i}")
        for i in range(n)
    ]


def rows_of(df):
    return sorted(map(repr, df.select(*learning.EVIDENCE_FIELDS).collect()))


def test_each_upload_gives_what_the_whole_library_gives(spark):
    rng = random.Random(3)
    table = spark.createDataFrame
    library, names, seen = {}, {}, {}
    summary = learning.places(table([], FINDINGS), table([], "report_id string, report_name string"))
    evidence = learning.evidence_at(table([], OBSERVATIONS), summary)
    assert evidence.count() == 0
    steps = [
        ("a", 9, "A", 4), ("b", 7, "B", 3), ("c", 8, "C", 0),
        ("a", 6, "A", None),  # stored again with other findings
        ("b", 0, "B", None),  # stored again without any
        ("c", None, "C renamed", None),  # the same findings under another name
        ("a", None, "A", 6),  # reviewed again, the report as it was
    ]
    for report, n, name, reviewed in steps:
        if n is not None:
            library[report] = found(rng, report, n)
        names[report] = name
        changed = []
        if reviewed is not None:
            changed = seen.get(report, [])
            seen[report] = observed(rng, report, reviewed)
            changed = changed + seen[report]
        reports = table(list(names.items()), "report_id string, report_name string")
        upload = learning.places(table(library[report], FINDINGS), reports)
        summary, signed = deltas.replace_reports(summary, upload, table([(report,)], "report_id string"))
        summary, signed = durable.stored(summary, "places"), durable.stored(signed, "signed")
        observations = table([r for rs in seen.values() for r in rs], OBSERVATIONS)
        touched = deltas.touched_corrections(signed, table(changed, OBSERVATIONS))
        evidence = durable.stored(deltas.carried_evidence(evidence, touched, observations, summary), "evidence")
        whole = table([r for rs in library.values() for r in rs], FINDINGS)
        assert rows_of(evidence) == rows_of(learning.evidence(observations, whole, reports)), (report, n, name)


def test_equal_places_cancel(spark):
    rows = learning.places(
        spark.createDataFrame(found(random.Random(1), "a", 9), FINDINGS),
        spark.createDataFrame([("a", "A")], "report_id string, report_name string"),
    )
    assert deltas.signed_changes(rows, rows).count() == 0
    signed = deltas.signed_changes(rows.filter("core_key <> 'k0'"), rows.filter("core_key <> 'k1'")).collect()
    assert {r["core_key"]: r["sign"] for r in signed} == {"k0": 1, "k1": -1}
