"""Exact nearest neighbours by inner product with a block matrix join.

Distinct vectors are quantised to int8 with one scale each.  Query blocks and candidate
blocks meet in tiles: one integer product gives all approximate scores of a tile, and the
quantisation errors of both sides bound how far each can be off.  Only pairs whose upper
bound reaches the k-th best lower bound of their query are computed again in double
precision and merged by a heap per query; the tiles' best are then merged once more.

The query set is dealt to all candidate blocks (each tile is one bounded group); neither
side is broadcast.  Equal vectors have equal scores, and only the k + 1 smallest ids among
them can ever be among the k nearest of a query that is one of them, so the others are not
scored at all; that is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.durable import stored

K = 20
QUERY_STEP = 20
CANDIDATE_BLOCK = 16_384
QUERY_BLOCK = 4_096
SLICE = 256
"""Queries of a tile that are multiplied at a time, which bounds the product's memory."""


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, norm of the decoded vector, norm of the error) per row."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    decoded = codes * scale[:, None]
    up = 1 + 1e-9  # the norms themselves are rounded up
    return codes, scale, np.linalg.norm(decoded, axis=1) * up, np.linalg.norm(x - decoded, axis=1) * up


def tile_neighbours(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray,
                    members: list[list[int]], k: int) -> list[tuple[int, float, int]]:
    """(query id, score, candidate id) of at most k nearest per query within a tile."""
    q8, qs, qn, qe = quantise(queries)
    c8, cs, cn, ce = quantise(candidates)
    wide = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums stay exact
    c8 = c8.astype(wide).T
    sizes = np.fromiter((min(len(m), k + 1) for m in members), np.int64, len(members))
    single = bool((sizes == 1).all())
    out = []
    for start in range(0, len(queries), SLICE):
        rows = slice(start, start + SLICE)
        approx = (q8[rows].astype(wide) @ c8) * qs[rows, None] * cs
        error = qe[rows, None] * cn + qn[rows, None] * ce + qe[rows, None] * ce + 1e-12
        lower = approx - error
        # k + 1 vectors: one of them may hold nothing but the query itself.
        keep = min(k + 1, len(members))
        floor = np.partition(lower, len(members) - keep, axis=1)[:, len(members) - keep]
        for i in range(approx.shape[0]):
            near = np.flatnonzero(approx[i] + error[i] >= floor[i])
            exact = np.einsum("ij,j->i", candidates[near], queries[start + i])
            own, heap = int(query_ids[start + i]), []
            for at, score in zip(near.tolist(), exact.tolist()):
                for other in members[at] if not single else members[at][:1]:
                    if other != own:
                        entry = (score, -other)
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
            out += [(own, score, -other) for score, other in heap]
    return out


def nearest(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
            candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), id, score: the k nearest other rows of each query.

    ``is_query`` is a condition on ``_id``.  Rows with a null id, and null, empty, zero
    or non-finite vectors, take no part.  Vectors meet those of their own length only.
    An id that is repeated stands once, with its smallest vector.  Ties go to the smaller
    id; a query with fewer candidates gets them all.  An empty table gives no rows.
    """
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = (
        vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
        .filter(F.col("_id").isNotNull() & F.col("_v").isNotNull()).filter(~bad)
        .filter(F.exists("_v", lambda x: x != 0)).groupBy("_id").agg(F.min("_v").alias("_v"))
    )
    usable = stored(usable, "knn-vectors")
    smallest = Window.partitionBy("_v").orderBy("_id")
    distinct = stored(
        usable.withColumn("_n", F.row_number().over(smallest)).filter(F.col("_n") <= k + 1)
        .groupBy("_v").agg(F.array_sort(F.collect_list("_id")).alias("_ids")), "knn-distinct",
    )
    queries = usable.filter(is_query)
    blocks = max(1, -(-distinct.count() // candidate_block))
    parts = max(1, -(-queries.count() // query_block))
    size = F.size("_v").alias("_dim")
    left = queries.select(
        size, F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int").alias("_part"), F.col("_id"), F.col("_v"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"),
    )
    right = distinct.select(
        size, F.pmod(F.xxhash64("_v"), F.lit(blocks)).cast("int").alias("_block"), F.col("_ids"), F.col("_v"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"),
    )
    kind = usable.schema["_id"].dataType.simpleString()
    keys = ["_dim", "_block", "_part"]

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
        return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            found = tile_neighbours(
                matrix(a["_v"]), a["_id"].to_numpy(), matrix(b["_v"]), b["_ids"].to_pylist(), k
            )
        columns = list(zip(*found)) or [[], [], []]
        return pa.table({
            "query_id": pa.array(columns[0], a.schema.field("_id").type), "score": pa.array(columns[1], pa.float64()),
            "_other": pa.array(columns[2], a.schema.field("_id").type),
        })

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        tile, f"query_id {kind}, score double, _other {kind}"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "_other")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("_other").alias(id_col), "score")
    )


def op4_block_knn(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("_id") % QUERY_STEP == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
