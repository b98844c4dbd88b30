import hashlib

from marginalia.llm import exact_dedup


def brute(rows):
    low = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(low), []).append(i)
    out, seen = [], set()
    for i, t in rows:
        norm = (t or "").translate(low)
        ids = [x for x in groups[norm] if x is not None]
        keep = max(ids, default=None)
        first = i == keep and (norm, i) not in seen
        if first:
            seen.add((norm, i))
        out.append((i, keep, len(groups[norm]), first, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    (1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, "Äpfel"), (5, "äpfel"), (6, ""), (7, None), (None, "alone"),
    (8, "twice"), (8, "twice"), (9, "x" * 300_000), (10, "X" * 300_000), (None, "same text"), (11, "same text "), (12, "É é É"), (13, "É É É"),
]


def result(df):
    return sorted([tuple(r)[:5] for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()], key=repr)


def test_against_brute_force(documents):
    assert result(exact_dedup.exact_groups(documents(ROWS))) == brute(ROWS)


def test_hot_texts_are_dealt_out_and_merged(documents, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 3)
    monkeypatch.setattr(exact_dedup, "HOT_LIST", 1000)
    rows = [(i, "Hot" if i % 2 else "hot") for i in range(60)] + [(i, f"t{i % 9}") for i in range(60, 90)] + [(5, "hot")]
    assert result(exact_dedup.exact_groups(documents(rows))) == brute(rows)


def test_texts_without_any_id_keep_one(documents, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 2)
    got = exact_dedup.exact_groups(documents([(None, "a")] * 7 + [(1, "b")])).collect()
    assert sum(r.kept for r in got) == 2 and sorted(r.group_size for r in got) == [1] + [7] * 7


def test_a_hot_text_spreads_whatever_its_ids(spark, documents, monkeypatch):
    """Null and repeated ids of one hot text go to many salts, and one row of it stays."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 10)
    monkeypatch.setattr(exact_dedup, "HOT_LIST", 1000)
    for ids in ([None] * 400, [7] * 400, [None, 7, 8, 8] * 100):
        rows = [(i, "Hot" if k % 3 else "hot") for k, i in enumerate(ids)] + [(1000 + k, f"t{k}") for k in range(50)]
        seen = []
        keep = exact_dedup.stored
        monkeypatch.setattr(exact_dedup, "stored", lambda df, name: seen.append(keep(df, name)) or seen[-1])
        got = exact_dedup.exact_groups(documents(rows)).collect()
        monkeypatch.setattr(exact_dedup, "stored", keep)
        sizes = [r["n"] for r in seen[-1].filter("_salt >= 0").groupBy("_salt").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 10 and max(sizes) < 60
        hot = [r for r in got if r.group_size == 400]
        assert len(hot) == 400 and sum(r.kept for r in hot) == 1 and len({r.keep_id for r in hot}) == 1
        best = max((i for i in ids if i is not None), default=None)
        assert hot[0].keep_id == best and [r.doc_id for r in hot if r.kept] == [best]


def test_empty_and_stage(documents, spark):
    assert exact_dedup.exact_groups(documents([])).count() == 0
    docs = documents(ROWS)
    kept = exact_dedup.keep_one_row_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [3, 4, 5, 7, 8, 10, 11, 12, 13]


def test_main_path_is_native(documents):
    plan = exact_dedup.exact_groups(documents(ROWS))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "MapInArrow"))
