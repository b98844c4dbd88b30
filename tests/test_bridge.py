"""What queries over the library write besides their result."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marginalia.operators import durable, memory
from marginalia.plans import bridge, catalog

WORDS = "angle area line graph unit slope point value table number share equal group ratio".split()


@pytest.fixture
def tables(spark, tmp_path, monkeypatch):
    """A folder of small tables; the second half of the texts are near copies of the first."""
    rng = random.Random(1)

    def text():
        return "\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 40))) for _ in range(4))

    texts = [text() for _ in range(20)]
    texts += [t.replace("graph", "graphs", 1) for t in texts]
    documents = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    labels = [(i, i % 2, i % 3 % 2) for i in range(20)]
    for name, items, columns in (
        ("documents", documents, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality long, toxic long"),
        ("benchmark", [(0, "area unit slope")], "item_id long, text string"),
    ):
        spark.createDataFrame(items, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(bridge, "_KEPT", {})
    return str(tmp_path)


def written(tables):
    return {name for _, folder, name in bridge._KEPT if folder == tables}


def test_memory_matches_write_open_findings_only(spark, tables, monkeypatch):
    """Findings with their records, and all classified ones, were written to read a few columns."""
    names, keep = [], durable.stored
    monkeypatch.setattr(durable, "stored", lambda df, name, *a: names.append(name) or keep(df, name, *a))
    got = sorted(map(str, catalog.QUERIES["memory_matches"](spark, tables).collect()))
    assert written(tables) == {"raw", "reviews", "observations"}
    assert not {"stored", "classified", "probes"} & set(names)
    plain = memory.match(bridge.open_findings(spark, tables), bridge.observations(spark, tables))
    assert got == sorted(map(str, plain.collect())) and any("near" in r for r in got) and any("exact" in r for r in got)
    assert sorted(map(str, catalog.QUERIES["memory_matches"](spark, tables).collect())) == got  # from the kept table


def test_computed_signatures_are_not_made_again_for_their_test(spark, tables):
    opened = memory.open_findings(bridge.as_open(bridge.stored_once(spark, tables)), computed=True)
    plain = memory.open_findings(bridge.open_findings(spark, tables))
    assert sorted(map(str, opened.collect())) == sorted(map(str, plain.collect()))

    def folded(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")

    bridge._KEPT.pop(next(k for k in bridge._KEPT if k[2] == "stored"))
    lazy = bridge.as_open(bridge.stored_once(spark, tables))
    assert folded(memory.open_findings(lazy, computed=True)) < folded(memory.open_findings(lazy))


def test_exported_memory_writes_each_text_once_and_packed(spark, tables, monkeypatch):
    """The export was plain JSON of a table that had been written for it before."""
    paths, fresh = [], durable.fresh_path
    monkeypatch.setattr(durable, "fresh_path", lambda *a: paths.append(fresh(*a)) or paths[-1])
    got = sorted(map(str, catalog.QUERIES["exported_memory"](spark, tables).collect()))
    assert written(tables) == {"raw", "reviews", "observations"}
    export = Path(next(p for p in paths if "/export-" in p).removeprefix("file:"))
    parts = [p for p in export.rglob("part-*") if p.parent.name != "head"]
    assert parts and all(p.name.endswith(".json.gz") for p in parts)
    findings = bridge.stored(spark, tables)
    expected = findings.select(F.lit("report_findings"), "finding_id", "fingerprint").unionAll(
        bridge.observations(spark, tables).select(F.lit("observations"), "observation_id", "status"))
    assert {r for r in got if "draft_reviews" not in r} == {
        str(r) for r in expected.toDF("collection", "id", "detail").collect()}
    assert findings.count() == 160 and sum("draft_reviews" in r for r in got) > 0


def test_reviews_shuffle_no_contexts(spark, tables):
    """Findings went to their labels with the whole text behind each, of which only the length counts."""
    with_texts = spark.sql(bridge.REVIEWS_SQL, raw=bridge.raw_findings(spark, tables), labels=bridge.table(spark, tables, "labels"))
    expected = sorted(map(str, with_texts.collect()))
    seen, keep = [], durable.stored

    def stored(df, name, *a):
        seen.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return keep(df, name, *a)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(durable, "stored", stored)
        got = bridge.reviews(spark, tables)
    assert sorted(map(str, got.collect())) == expected and len(expected) == 80
    plan = dict(seen)["reviews"]
    join = plan.index("Join Inner")
    assert "repeat(" in plan[join:] and "repeat(" not in plan[:join]
