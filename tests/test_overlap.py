"""Top-k overlap joins against counting all pairs."""

import random

import pytest

from marginalia.operators import library, overlap


def brute(rows, k):
    sets = {}
    for owner, key in rows:
        if owner is not None and key is not None:
            sets.setdefault(owner, set()).add(key)
    out = set()
    for a, mine in sets.items():
        counts = sorted(((len(mine & theirs), b) for b, theirs in sets.items() if b != a and mine & theirs), reverse=True)
        least = counts[min(k, len(counts)) - 1][0] if counts else 0
        out |= {(a, b, n) for n, b in counts if n >= least}
    return out


def drawn(seed, owners=60, hot=4):
    """Sets with rare keys, keys of some sets, and keys that nearly all sets hold."""
    rng = random.Random(seed)
    rows = [(f"r{o:03}", f"hot{h}") for o in range(owners) for h in range(hot) if rng.random() < 0.95]
    rows += [(f"r{o:03}", f"mid{rng.randrange(12)}") for o in range(owners) for _ in range(3)]
    rows += [(f"r{o:03}", f"rare{rng.randrange(150)}") for o in range(owners) for _ in range(rng.randrange(9))]
    return sorted(set(rows)) + [("alone", "nobody else"), (None, "hot0"), ("r001", None)]


@pytest.mark.parametrize(("seed", "k", "steps"), [
    (1, 3, {"first": 2, "factor": 2}), (2, 1, {"first": 4, "factor": 3}), (3, 200, {"first": 2, "factor": 4}), (4, 5, {}),
])
def test_against_all_pairs(spark, monkeypatch, seed, k, steps):
    monkeypatch.setattr(overlap, "PART", 7)  # frequent keys are dealt to several tasks
    rows = drawn(seed)
    got = overlap.top_overlaps(spark.createDataFrame(rows, "owner string, key string"), k, **steps)
    assert {tuple(r) for r in got.collect()} == brute(rows, k)


def test_a_key_of_all_sets_forms_no_pairs(spark, monkeypatch):
    """Sets in families of three: the best two are known before the common keys are reached."""
    rows = [(f"r{i:03}", f"family{i // 3}-{j}") for i in range(120) for j in range(4)]
    rows += [(f"r{i:03}", f"all{j}") for i in range(120) for j in range(2)]
    formed, plain = [], overlap._met
    monkeypatch.setattr(overlap, "_met", lambda mine, level: formed.append(mine.count()) or plain(mine, level))
    sets = spark.createDataFrame(rows, "owner string, key string")
    got = {tuple(r) for r in overlap.top_overlaps(sets, 2, first=4, factor=100).collect()}
    assert got == brute(rows, 2) and all(n == 6 for _, _, n in got)
    assert formed == [480]  # the keys that all sets hold never came to a join


def test_empty_and_small(spark):
    empty = spark.createDataFrame([], "owner string, key string")
    assert overlap.top_overlaps(empty, 3).collect() == []
    assert overlap.top_overlaps(spark.createDataFrame([("a", "x"), ("b", "y")], "owner string, key string"), 3).collect() == []
    with pytest.raises(ValueError):
        overlap.top_overlaps(empty, 0)


@pytest.mark.parametrize("limit", [2, 50])
def test_every_report_gets_what_a_single_search_gives(spark, limit):
    rng = random.Random(limit)
    findings = [
        (f"r{r:02}", rng.choice(["", f"f{rng.randrange(40)}", "everywhere"]), f"c{rng.randrange(25)}")
        for r in range(8) for _ in range(rng.randrange(1, 9))
    ] + [("r90", "", "c-alone"), ("r91", "", "c3"), ("unlisted", "everywhere", "c1")]
    findings = spark.createDataFrame(findings, "report_id string, fingerprint string, core_key string")
    ids = [r[0] for r in findings.select("report_id").distinct().filter("report_id <> 'unlisted'").collect()]
    reports = spark.createDataFrame(
        [(r, f"Name {int(r[1:]) % 3}", f"{r}.html", 7, "2024") for r in ids],
        "report_id string, report_name string, filename string, finding_count long, last_uploaded_at string",
    )
    got = {}
    rows = library.similar_reports(findings, reports, limit, first=2, factor=2).orderBy("current_report_id", "rank").collect()
    for r in rows:
        got.setdefault(r.current_report_id, []).append(tuple(r)[2:])
        assert r["rank"] == len(got[r.current_report_id])
    for one in ids:
        current = spark.createDataFrame([(one,)], "report_id string")
        want = library.similarity(findings, reports, current, limit).collect()
        columns = ["report_id", "report", "filename", "exact_findings", "exact_overlap", "shared_correction_pairs",
                   "correction_pair_overlap", "findings", "last_uploaded"]
        assert got.get(one, []) == [tuple(r[c] for c in columns) for r in want], one
