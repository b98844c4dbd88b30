import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import block_knn


def brute(rows, step, k):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = min(usable.get(i, v), v)
    out = []
    for q, v in usable.items():
        if q % step == 0:
            scores = [(-float(np.dot(np.float64(np.float32(v)), np.float64(np.float32(w)))), i)
                      for i, w in usable.items() if i != q and len(w) == len(v)]
            out += [(q, n + 1, i, round(-s, 9)) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def result(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, rank string, score string")


def test_against_brute_force_in_many_tiles(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=12))]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 390)]  # a frequent vector
    got = block_knn.nearest(table(spark, rows), F.col("_id") % 5 == 0, k=7, candidate_block=60, query_block=30)
    assert result(got) == brute(rows, 5, 7)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (5, [1.0, 0.0]), (10, [0.0, 2.0]), (3, None), (15, []), (20, [0.0, 0.0]), (25, [float("nan"), 1.0]),
        (30, [float("inf"), 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (35, [1.0, 2.0, 3.0]), (40, [-1.0, 0.5]), (40, [-1.0, 0.5]),
    ]
    assert result(block_knn.nearest(table(spark, rows), F.col("_id") % 5 == 0, k=20)) == brute(rows, 5, 20)
    assert block_knn.nearest(table(spark, []), F.col("_id") % 5 == 0).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(50, 9)) * 10.0 ** rng.integers(-6, 6, (50, 1)), rng.normal(size=(60, 9))
    qa, sa, na, ea = block_knn.quantise(a)
    qb, sb, nb, eb = block_knn.quantise(b)
    approx = (qa.astype(float) @ qb.T) * sa[:, None] * sb
    bound = ea[:, None] * nb + na[:, None] * eb + ea[:, None] * eb + 1e-12
    assert (np.abs(a @ b.T - approx) <= bound).all()
