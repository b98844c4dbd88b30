"""Whitening and vector codes against plain restatements."""

import hashlib
import math

import numpy as np
import pytest

from marginalia.llm import code_refinement, whitening

ODD = [None, [], [0.1] * 15 + [None], [0.2] * 15 + [float("nan")], [0.2] * 15 + [float("inf")], [1.0, 2.0]]


def embeddings(spark, rows):
    """rows of (vec_id, vector, label), with clashing extra columns."""
    schema = "vec_id long, embedding array<float>, label string, _id string, _x string, code string, n int, w string, component int"
    return spark.createDataFrame([(*r, "a", "b", "c", 1, "d", 2) for r in rows], schema)


def vectors(n, size=32, seed=3, levels=40):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(v / 64)) for v in row] for row in rng.integers(-levels, levels, (n, size)).tolist()]


# ---- eigenvectors and whitening

@pytest.mark.parametrize("values", [
    np.arange(1.0, 25), np.repeat([1.0, 2.0, 3.0], 8), 1 + np.arange(24) * 1e-7, 10.0 ** -np.arange(24.0), np.zeros(24),
    np.concatenate([np.ones(12), 1 + 1e-11 * np.arange(12)]),
])
def test_eigenvectors_in_double_precision(values):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.eigenvectors(a.astype(np.longdouble))
    scale = max(np.abs(values).max(), 1e-300)
    assert np.abs(np.sort(values)[::-1] - found).max() <= 1e-14 * scale
    assert np.abs(x.T @ x - np.eye(24)).max() < 1e-13
    wide, exact = x.astype(np.longdouble), a.astype(np.longdouble)
    assert np.abs(exact @ wide - wide * found).max() < 1e-14 * scale


def plainly_whitened(rows, components=16):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, _ in rows]
    fit = sorted({tuple(x) for _, x in kept})
    n, size = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(size)]
    centred = np.array([[(n * v - s) / n for v, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    out = []
    for i, x in kept:
        y = np.array([(n * v - s) / n for v, s in zip(x, sums)])
        deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums))
        out.append((i, n, deviation, y @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()))
    return out


def test_whitening_is_that_of_the_plain_way(spark):
    rows = [(i, v, "x") for i, v in enumerate(vectors(300))]
    rows += [(1000 + i, rows[7][1], None) for i in range(40)] + [(None, rows[3][1], "y"), (5, rows[9][1], "y")]
    got = whitening.whitened(embeddings(spark, rows + [(2000 + i, v, "x") for i, v in enumerate(ODD)])).collect()
    want = plainly_whitened(rows)
    assert len(got) == 16 * len(rows) == 16 * len(want)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10
    ours = sorted(((r.vec_id is None, r.vec_id or 0, r.deviation, r.component, r.n, r.whitened, r.explained) for r in got))
    theirs = sorted((i is None, i or 0, d, c + 1, n, w[c], e[c]) for i, n, d, w, e in want for c in range(16))
    assert [r[:5] for r in ours] == [r[:5] for r in theirs]
    for c in range(1, 17):
        a = np.array([r[5] for r in ours if r[3] == c])
        b = np.array([r[5] for r in theirs if r[3] == c])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert abs(next(r[6] for r in ours if r[3] == c) - next(r[6] for r in theirs if r[3] == c)) < 1e-12


def test_whitening_without_variance(spark):
    assert whitening.whitened(embeddings(spark, [])).collect() == []
    assert whitening.whitened(embeddings(spark, [(1, None, "a"), (2, [], None)])).columns[0] == "vec_id"
    same = whitening.whitened(embeddings(spark, [(i, [0.5] * 4, "a") for i in range(3)])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, None, None)] * 12
    few = whitening.whitened(embeddings(spark, [(1, [0.0, 0.0, 1.0], "a"), (2, [1.0, 0.0, 0.0], "a")])).collect()
    by = {(r.vec_id, r.component): r for r in few}
    assert abs(abs(by[1, 1].whitened) - 1) < 1e-12 and by[1, 1].whitened == -by[2, 1].whitened and by[1, 1].explained == 1.0
    assert by[1, 2].whitened is None and by[1, 2].explained == 0.0 and len(few) == 6
    # a spread far from the offset and deviations beyond a long
    far = whitening.whitened(embeddings(spark, [(i, [float(i) * 1e9, 1.0], "a") for i in range(3)])).collect()
    assert all(r.deviation is None or r.deviation >= 0 for r in far) and far[0].identity_error < 1e-4


# ---- codes

def plainly_coded(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * c) for c in v], label) for i, v, label in rows]
    width = len(kept[0][1]) // parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(r[1], p) for r in first] for p in range(parts)]
    square = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))
    nearest = lambda x, p: min((square(cut(x, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        members = [[[] for _ in first] for _ in range(parts)]
        for _, x, _ in kept:
            for p in range(parts):
                members[p][nearest(x, p)[1]].append(cut(x, p))
        books = [[[sum(c) // len(m) for c in zip(*m)] if m else books[p][k] for k, m in enumerate(members[p])] for p in range(parts)]
    codes, by = [], {}
    for i, x, label in kept:
        found = [nearest(x, p) for p in range(parts)]
        codes.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        by[label] = by.get(label, 0) + codes[-1][2]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [(i, code, error, by[label], digest) for i, code, error, label in codes]


def coded(spark, rows, **sizes):
    got = code_refinement.compressed(embeddings(spark, rows).repartition(3), **sizes).collect()
    return [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got]


@pytest.mark.parametrize("sizes", [{}, {"entries": 5, "rounds": 5}, {"entries": 200, "rounds": 1}, {"entries": 1}, {"entries": 2, "rounds": 3}, {"rounds": 0}])
def test_codes_are_those_of_the_plain_way(spark, sizes):
    rows = [(700 - i, v, ["a", "b", None][i % 3]) for i, v in enumerate(vectors(260, levels=7))]  # few levels: many ties
    rows += [(5000 + i, rows[11][1], "hot") for i in range(200)] + [(None, rows[3][1], "a"), (450, rows[9][1], None)]
    got = coded(spark, rows + [(8000 + i, v, "a") for i, v in enumerate(ODD)], **sizes)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(plainly_coded(rows, **sizes), key=key)


def test_codes_of_large_and_few_values(spark):
    rows = [(i, [1000.0 * ((i * 7919 + 31 * k) % 1000) - 5e5 for k in range(16)], None) for i in range(150)]
    assert sorted(coded(spark, rows)) == sorted(plainly_coded(rows))
    assert coded(spark, []) == [] and coded(spark, [(1, None, "a")]) == []
    assert sorted(coded(spark, rows[:3])) == sorted(plainly_coded(rows[:3]))
    with pytest.raises(Exception, match="outside what integer distances can hold"):
        coded(spark, [(1, [3e30] * 16, "a")])


def test_bounds_save_comparisons_and_lose_nothing():
    rng = np.random.default_rng(9)
    x = rng.integers(-200, 200, (4000, 4))
    book = rng.integers(-200, 200, (64, 4))
    state = code_refinement.compared(x, book, 8)
    for turn in range(6):
        after = book + rng.integers(-8, 9, book.shape)
        shift = np.sqrt(((after - book) ** 2).sum(axis=1)) * (1 + 1e-9)
        state, need = code_refinement.moved(x, after, shift, code_refinement.unpacked(code_refinement.packed(state.listed(8 - turn % 3))))
        book, whole = after, code_refinement.compared(x, after, 8)
        assert (state.own == whole.own).all() and (state.distance == whole.distance).all()
        assert (need <= 8).mean() > 0.7  # few parts were compared with the whole codebook
        distances = np.sqrt(((x[:, None] - after) ** 2).sum(axis=2))
        assert (np.take_along_axis(distances, state.near, axis=1) >= state.lower).all()
        distances[np.arange(len(x)), state.own] = np.inf
        np.put_along_axis(distances, state.near, np.inf, axis=1)
        assert (distances.min(axis=1) >= state.outer).all()
