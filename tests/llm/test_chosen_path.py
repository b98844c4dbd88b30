import random
import re
import sys

import numpy as np
import pytest

from marginalia.llm import chosen_path as cp
from marginalia.llm.components import components
from marginalia.llm.words import batched_words, pieces, word_hashes
from marginalia.operators.durable import stored

WORD = re.compile("[a-z0-9_\x80-\U0010ffff]+")


def runs(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [runs(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    classes = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            classes[find(k)] = min(classes.get(find(k), i), i)
    return sorted([(i, classes.get(find(k)), links[k], len(sets[k])) for k, (i, _) in enumerate(rows)], key=repr)


def result(df):
    return sorted([tuple(r) for r in df.select("doc_id", "class_id", "n_links", "n_shingles").collect()], key=repr)


def family(rng, base, copies, changes, start):
    out = []
    for k in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        out.append((start + k, " ".join(words)))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, rows = text(40), []
    for f in range(12):
        rows += family(rng, text(rng.choice([6, 30, 120, 400])), rng.randint(2, 9), 4, 100 * f)
    rows += [(5000 + i, " ".join(text(60) + passage + text(50))) for i in range(120)]  # a shared passage
    rows += family(rng, text(150), 130, 3, 8000)  # a large group of near copies
    return rows


ODD = [
    (1, "Same words in here now."), (2, "same WORDS in; here now"), (3, None), (4, ""), (5, "!!"), (6, "two words"), (7, "Two words"),
    (8, "two"), (None, "same words in here now"), (None, "lonely text that nobody else has at all"), (9, "x " * 200_000), (10, "x " * 5),
    (11, "again"), (11, "again"),
]


def test_against_brute_force(documents):
    rows = corpus() + ODD
    assert result(cp.similar_sets(documents(rows))) == brute(rows)


def test_splitting_and_tiles_lose_nothing(documents, monkeypatch):
    """Buckets are split from four members, blocks hold eight, so every way is taken."""
    monkeypatch.setattr(cp, "SMALL", 4)
    monkeypatch.setattr(cp, "TILE", 8)
    rows = corpus(2)
    assert result(cp.similar_sets(documents(rows))) == brute(rows)


def test_empty_and_stage(documents, spark):
    assert cp.similar_sets(documents([])).count() == 0
    docs = documents(ODD)
    kept = cp.keep_one_row_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 4, 5, 6, 8, 9, 11]


def test_runs_reach_the_recall():
    """Measured: pairs exactly at the threshold, one set within the other, at full depth."""
    rng = np.random.default_rng(3)
    total, met = 400, 0
    n = cp.runs_for(0.95)
    for _ in range(total):
        big = np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64))
        small = np.sort(rng.permutation(big)[:80])
        met += bool(np.intersect1d(cp.paths(big, n)[-1][1], cp.paths(small, n)[-1][1]).size)
    assert met >= 0.93 * total


def test_pairs_at_the_threshold_are_linked(documents):
    """End to end, votes of the sketches included: pairs of similarity 0.8 exactly."""
    rng = random.Random(12)
    rows = []
    for k in range(300):
        n = 5 * rng.randint(10, 100)  # shingles of the longer text
        words = [f"p{k}w{i}" for i in range(n + 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: n * 4 // 5 + 4]))]
    assert cp.vote_miss() < 0.001 and cp.runs_for(0.995) > cp.math.log(0.005) / cp.math.log(0.6)
    linked = sum(r.n_links for r in cp.similar_sets(documents(rows)).collect()) / 2
    assert linked >= 0.985 * 300


def test_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, k).astype(np.uint64)) for k in (1, 50, 200, 90, 3)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = cp.intersections(sets, sets)
    np.fill_diagonal(got, [len(s) for s in sets])  # a set is not compared with itself
    assert got.tolist() == want
    assert cp.intersections(sets[:2], sets[2:]).tolist() == [w[2:] for w in want[:2]]


@pytest.mark.parametrize("size", [7, 64])
def test_long_texts_are_cut_between_words(monkeypatch, size):
    from marginalia.llm import words

    text = "Ab cd-é_f  " * 9 + "y" * 200 + " end"
    whole = word_hashes(text)
    monkeypatch.setattr(words, "CHUNK", size)
    assert b"".join(pieces(text.encode())) == text.encode()
    assert (word_hashes(text) == whole).all()
    assert [len(x) for x in batched_words([text, "", "one two", text])] == [len(whole), 0, 2, len(whole)]


def test_components_of_a_path_and_a_hub(spark):
    edges = [(f"a{i:03}", f"a{i + 1:03}") for i in range(60)] + [("h", f"k{i}") for i in range(50)] + [("z", "z"), ("q", None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert all(got[f"a{i:03}"] == "a000" for i in range(61)) and all(got[f"k{i}"] == "h" for i in range(50))
    assert "z" not in got and "q" not in got and len(got) == 112
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_rounds_of_a_small_graph_are_one_file_each(spark, monkeypatch):
    """Whatever the session's shuffles are: each file costs a process or a request or two."""
    module, files = sys.modules["marginalia.llm.components"], []

    def counted(rows, name):
        kept = stored(rows, name)
        files.append(len(kept.inputFiles()))
        return kept

    monkeypatch.setattr(module, "stored", counted)
    edges = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}") for i in range(300) if i % 10 < 9], "a string, b string")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merging)
    spark.conf.set(merging, "false")
    try:
        got = {r.node: r.root for r in module.components(edges).collect()}
    finally:
        spark.conf.set(merging, before)
    assert got == {f"{i:04}": f"{i - i % 10:04}" for i in range(300)}
    assert len(files) > 5 and set(files[1:]) == {1}
