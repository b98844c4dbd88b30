"""The pairwise quality ranking: held-out accuracy, a plain restatement, odd rows."""

import zlib

import numpy as np

from marginalia.llm import quality


def labels(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, score string")


def test_held_out_documents_are_ranked_right(spark):
    sf_dir = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = quality.op12_quality(spark, sf_dir).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(marks[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in marks]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert sum(b for a, b in held if a) >= 0.97 * sum(a for a, _ in held)


def test_scores_follow_from_ranking_and_quantile(spark, documents):
    """The cut is the quantile of all labelled training scores, found here by sorting."""
    docs = [(i, ("good words stand here " if i % 3 else "## || ## ") * (1 + i % 7) + f"n{i}") for i in range(240)]
    marks = [(i, int(i % 3 > 0), 0) for i in range(200)] + [(7, 0, 0), (8, 1, 0)]  # 7 contradicts itself
    frame = documents(docs)
    numbers = quality.described(frame)
    model, cut = quality.fit(numbers, labels(spark, marks))
    train = [(i, text, int(i % 3 > 0)) for i, text in docs[:200] if zlib.crc32(str(i).encode()) % 3 != 1 and i != 7]
    x = np.array([quality.describe(t).astype("<f4").astype(float) for _, t, _ in train])
    scores = np.sort(model.scores(x))
    low = sum(1 for *_, y in train if y == 0)
    assert scores[low - 1] < cut <= scores[low]
    got = {r.doc_id: r for r in quality.score(frame, labels(spark, marks)).collect()}
    for i, text in docs:
        s = model.scores(quality.describe(text).astype("<f4").astype(float)[None])[0]
        assert abs(got[i].score - 1 / (1 + np.exp(-(s - cut)))) < 1e-9
        assert got[i].predicted == int(i % 3 > 0)


def test_pairs_decide_and_not_the_sizes_of_the_sides():
    rng = np.random.default_rng(2)
    better, worse = rng.normal(1, 1, (30, quality.SIZE)), rng.normal(0, 1, (900, quality.SIZE))
    model = quality.rank(better, worse)
    assert (model.scores(better)[:, None] > model.scores(worse)[None]).mean() > 0.99
    assert not quality.rank(better, worse[:0]).weights.any()


def test_odd_rows(spark, documents):
    rows = [(None, "some words"), (1, None), (2, ""), (3, "   \n "), (4, "fine words here"), (4, "## ||"), (5, "long words. " * 400_000), (6, "\x00 é"), (8, "x")]
    marks = [(4, 1, 0), (6, 0, 0), (8, None, 0), (None, 1, 1), (1, 0, 0), (2, 1, 0), (3, 0, 1), (5, 1, 1)]
    got = quality.score(documents(rows), labels(spark, marks)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert quality.score(documents([]), labels(spark, marks)).count() == 0
    assert {r.score for r in quality.score(documents(rows), labels(spark, [])).collect()} == {0.5}
    assert {r.predicted for r in quality.score(documents(rows), labels(spark, [(4, 1, 0), (6, 1, 0)])).collect()} == {1}
    assert {r.predicted for r in quality.score(documents(rows), labels(spark, [(6, 0, 0), (8, 0, 0)])).collect()} == {0}


def test_long_texts_are_the_mean_of_their_blocks():
    text = "plain words stand here. " * 20_000
    whole = quality.describe(text)
    n = quality.BLOCK
    parts = [text[i : i + n] for i in range(0, len(text), n)]
    assert len(parts) > 3
    assert np.allclose(whole, sum(quality.describe(p) * len(p) for p in parts) / len(text))
