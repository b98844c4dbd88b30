from pathlib import Path

import __spark_entry__ as entry
import corpus_pipeline
from marginalia.llm import registry
from marginalia.operators.durable import stored


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "personal", "packed"]
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert {*registry.QUERIES, "pipeline"} <= set(entry.queries())
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).parents[2]
    others = [p for p in (root / "marginalia").rglob("*.py") if "llm" not in p.parts] + [root / "bench.py", root / "compare.py"]
    assert not [p for p in others if "marginalia.llm" in p.read_text()]


def test_stages_on_a_fixture(spark, documents):
    en = "the quick brown fox jumps over a lazy dog and runs away from there with speed number"
    rows = [(i, f"{en} {i} {i * 7} {i * 13}", "en") for i in range(20)]
    copy = "One exact copy of a longer piece of text that stands twice in this table of texts"
    near = " ".join(f"word{k}" for k in range(100))
    rows += [(30, copy, "en"), (31, copy.upper(), "en"), (40, near, "en"), (41, near + " more", "en")]
    rows += [(50, "write to someone@mail.example.com about the lazy dog and the brown fox please", "en"), (60, None, "en"), (61, "12345", None)]
    docs, left = documents(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, ""), "test-stage")
        if name != "packed":
            assert docs.columns == before.columns
            left[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(left["language"]) == {i for i, _, _ in rows} - {60, 61}
    assert set(left["language"]) - set(left["exact"]) == {30}
    assert set(left["exact"]) - set(left["near"]) == {41}
    assert set(left["personal"]) == set(left["near"])
    assert left["personal"][50].startswith("write to [EMAIL] about")
    assert {r.doc_id for r in docs.collect()} == set(left["personal"])


def test_run_is_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"test-{name}")
    got = corpus_pipeline.run(spark, sf_dir)
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect())
    assert key(got) == key(docs)


def test_repeated_rows_and_null_ids_stay_once(spark, documents):
    long = " ".join(f"word{k}" for k in range(100))
    rows = [(1, "One text that stands here"), (1, "one TEXT that stands here"), (1, "One text that stands here")]
    rows += [(None, "no id has this text at all")] * 3 + [(None, "One text that stands here"), (2, None), (2, None), (None, ""), (5, "!!"), (5, "??")]
    rows += [(7, long), (7, long), (None, long + " more"), (7, "another text under the same id seven")]
    rows += [(None, "alpha " + long.upper().replace("WORD", "t")), (None, "beta " + long.upper().replace("WORD", "t"))]
    docs, stages = documents(rows), dict(corpus_pipeline.STAGES)
    exact = stored(stages["exact"](spark, docs, ""), "test-exact")
    got = sorted([(r.doc_id, (r.text or "").lower()) for r in exact.collect()], key=repr)
    best = {}
    for i, t in rows:
        t = (t or "").lower()
        best[t] = i if best.get(t) is None else best[t] if i is None else max(i, best[t])
    assert got == sorted([(i, t) for t, i in best.items()], key=repr)
    left = [(r.doc_id, r.text) for r in stages["near"](spark, docs, "").collect()]
    assert sum(t == long for _, t in left) == 1 and sum("more" in (t or "") for _, t in left) == 0
    assert sum((t or "").lower().startswith("one text") for _, t in left) == 1 and sum((t or "").startswith("no id") for _, t in left) == 1
    assert sum((t or "").startswith(("alpha", "beta")) for _, t in left) == 1 and (7, "another text under the same id seven") in left
    empty = sorted((str(i), t or "") for i, t in left if not (t or "").strip("!?"))
    assert empty == [("2", ""), ("5", "!!"), ("5", "??"), ("None", "")]
