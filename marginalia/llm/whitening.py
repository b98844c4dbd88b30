"""Whitening of embeddings by refined eigenvectors of their distributed covariance.

Vectors become integers, and each distinct one counts once.  Tasks add up integer sums,
then products of rows centred at the rounded mean (so the products are small and their
sums exact), which Spark adds; the driver gets one covariance matrix, whose size is that of
the dimension.  Its eigenvectors start from a decomposition in 32-bit floats and are
corrected by Ogita and Aishima's iteration: a few matrix products in extended precision
raise all eigenvectors at once, quadratically.  Where eigenvalues lie so close together
that the correction cannot tell them apart, the cluster's block is solved by itself,
relative to its own mean value, and the iteration goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.vectors import common_size, finite, matrix
from marginalia.operators.durable import stored

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
LONG_MAX = (1 << 63) - 1
_SLICE = 4096

LEAST_GAP = 1e-13
"""Eigenvalues nearer than this share of the greatest are one cluster: what extended
precision still tells of their vectors is less than the matrix's own rounding."""


# ---- eigenvectors

def _clusters(values: np.ndarray, gap: float) -> list[slice]:
    """Runs of neighbouring sorted eigenvalues closer than ``gap``, longer than one."""
    cuts = np.flatnonzero(np.diff(values) > gap) + 1
    edges = [0, *cuts.tolist(), len(values)]
    return [slice(a, b) for a, b in zip(edges, edges[1:]) if b - a > 1]


def _corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One step of the iteration: (eigenvalues, better vectors, size of the correction,
    the gap below which eigenvalues count as clustered)."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding, divided by small gaps, undoes orthogonality
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    size = lambda m: float(np.sqrt((m * m).sum()))  # noqa: E731  at least the spectral norm
    most = float(np.abs(values).max(initial=0))
    gap = max(2 * (size(off) + most * size(r)), LEAST_GAP * most)
    differ = values[None, :] - values[:, None]
    apart = np.abs(differ) > gap
    np.fill_diagonal(apart, False)
    step = np.where(apart, (s + values[None, :] * r) / np.where(apart, differ, 1), r / 2)
    return values, x + x @ step, size(step), gap


def eigenvectors(covariance: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix in double precision,
    by falling eigenvalue.

    Vectors of equal eigenvalues are any orthonormal basis of their space.
    """
    scale = float(np.abs(covariance).max(initial=0))
    if scale == 0:
        return np.zeros(len(covariance)), np.eye(len(covariance))
    a = (covariance / np.longdouble(scale)).astype(np.longdouble)
    a = (a + a.T) / 2
    _, first = np.linalg.eigh(a.astype(np.float32))
    x = first.astype(np.longdouble)
    done = 64 * float(np.finfo(np.longdouble).eps) * len(a)
    before = np.inf
    for turn in range(rounds):
        values, x, change, gap = _corrected(a, x)
        order = np.argsort(values, kind="stable")
        values, x = values[order], x[:, order]
        for run in _clusters(values, max(gap, 1e-6)) if turn < 4 else []:
            block = x[:, run]
            middle = values[run].mean()
            part = block.T @ (a @ block - middle * block)  # small numbers with their own digits
            part = ((part + part.T) / 2).astype(np.float64)
            _, turned = np.linalg.eigh(part / max(float(np.abs(part).max()), np.finfo(np.float64).tiny))
            x[:, run] = block @ turned.astype(np.longdouble)
        if change < done or (turn > 8 and change >= before / 2):
            break
        before = change
    values = np.array([(v @ (a @ v)) / (v @ v) for v in x.T])
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    return np.asarray(values[order] * np.longdouble(scale), np.float64), np.asarray(x, np.float64)


# ---- sums over distinct rows

def _integers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _summed(rows: DataFrame, cells: int, of_batch: Callable[[np.ndarray], tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """(rows, the sum over all batches of the ``cells`` numbers that ``of_batch`` gives),
    added up per task and then by Spark; as many numbers as the model has reach the driver."""
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(cells)
        for batch in batches:
            x = _integers(batch.column(0)) if batch.num_rows else np.zeros((0, 1), np.int64)
            for start in range(0, len(x), _SLICE):
                total += of_batch(x[start : start + _SLICE])
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, cells), pa.int64()), pa.array(np.concatenate([[float(n)], total]), pa.float64())], ["slot", "v"]
            )

    # Whole numbers below 2**53 add up exactly in any order.
    found = rows.mapInArrow(tasks, "slot bigint, v double").groupBy("slot").agg(F.sum("v").alias("v")).collect()
    out, n = np.zeros(cells), 0
    for r in found:
        if r.slot < 0:
            n = int(r.v)
        else:
            out[r.slot] = r.v
    return n, out


class Whitening:
    """n, integer sums, unit components (columns) with their eigenvalues, the trace, and how
    far the whitened fit list is from unit covariance."""

    def __init__(self, n, sums, components, values, trace, identity_error):
        self.n, self.sums, self.components = n, sums, components
        self.values, self.trace, self.identity_error = values, trace, identity_error

    def transformed(self, x: np.ndarray) -> np.ndarray:
        """The whitened rows; null (nan) in components without variance."""
        middle = [round(s / self.n) for s in self.sums]
        rest = np.array([(s - m * self.n) / self.n for s, m in zip(self.sums, middle)])
        y = (x - np.array(middle, np.int64)).astype(np.float64) - rest
        spread = np.where(self.values > 0, self.values, np.nan)
        return (y @ self.components) / np.sqrt(spread)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of (n * x - sum)**2 as integers; None beyond a long."""
        n, sums = self.n, self.sums
        most = int(max(np.abs(x).max(initial=0), 1)) * n + max(map(abs, sums))
        if most < 1 << 62:
            gap = x * n - np.array(sums, np.int64)
            top = int(np.abs(gap).max(initial=0))
            if top * top * x.shape[1] <= LONG_MAX:
                return (gap * gap).sum(axis=1).tolist()
        exact = [sum((int(v) * n - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
        return [e if e <= LONG_MAX else None for e in exact]


def fit(distinct: DataFrame, size: int, components: int) -> Whitening:
    """Learn from rows of one column of integer vectors, each row counting once."""
    # The high and low half of each number are summed apart, so that sums stay exact.
    low, high = (1 << 20) - 1, 20
    n, halves = _summed(distinct, 2 * size, lambda x: np.concatenate([(x >> high).sum(axis=0), (x & low).sum(axis=0)]).astype(float))
    sums = [(int(a) << high) + int(b) for a, b in zip(halves[:size], halves[size:])]
    middle = np.array([round(s / n) for s in sums], np.int64)

    def products(x: np.ndarray) -> np.ndarray:
        z = (x - middle).astype(np.float64)
        return (z.T @ z).reshape(-1)

    _, second = _summed(distinct, size * size, products)
    rest = np.array([np.longdouble(s - int(m) * n) / n for s, m in zip(sums, middle)], np.longdouble)
    covariance = second.reshape(size, size).astype(np.longdouble) / n - np.outer(rest, rest)
    values, vectors = eigenvectors(covariance)
    trace = float(np.trace(covariance))
    values = np.where(values > trace * 1e-13, values, 0.0)[:components]  # below: rounding of a value of zero
    model = Whitening(n, sums, vectors[:, :components], values, trace, None)

    used = np.flatnonzero(model.values > 0)

    def whitened_products(x: np.ndarray) -> np.ndarray:
        w = np.concatenate([np.ones((len(x), 1)), model.transformed(x)[:, used]], axis=1)
        return (w.T @ w).reshape(-1)

    if len(used):
        k = len(used) + 1
        _, third = _summed(distinct, k * k, whitened_products)
        third = third.reshape(k, k) / n
        unit = third[1:, 1:] - np.outer(third[0, 1:], third[0, 1:])
        model.identity_error = float(np.abs(unit - np.eye(k - 1)).max())
    return model


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per kept vector and component: id, component, n, deviation, whitened,
    explained, identity_error.

    Dropped are vectors that are null, empty or hold null or non-finite components, and
    those whose length is not the most frequent one.  There are as many components as the
    vectors have dimensions, ``components`` at most.  Repeated rows are returned each and
    count once in the fit.  A component without variance (fewer distinct vectors than
    dimensions, say) has ``whitened`` null and ``explained`` 0 and takes no part in
    ``identity_error``; both are null if nothing varies.  ``deviation`` is null where it
    does not fit a long.  Components from 2**40 on in magnitude raise an error.  An empty
    table gives no rows.
    """
    whole = rows.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector")).filter(finite(F.col("_vector")))
    size = common_size(whole, F.col("_vector"))
    kept = whole.filter(F.size("_vector") == size)
    id_type = kept.schema["_id"].dataType.simpleString()
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    if not size:
        empty = f"_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], empty).withColumnRenamed("_id", id_col)

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(matrix(batch.column(1), size) * SCALE)
            if np.abs(x).max(initial=0) >= 1 << 46:
                raise ValueError("components beyond 2**40 are outside what integer sums can hold")
            x = x.astype(np.int64) + OFFSET
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))], ["_id", "x"])

    turned = kept.mapInArrow(integers, f"_id {id_type}, x array<bigint>")
    distinct = stored(turned.select("x").distinct(), "whitening-fit")
    model = fit(distinct, size, min(components, size))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _integers(batch.column(1))
            w = model.transformed(x)
            flat = pa.array(w.reshape(-1), from_pandas=True)  # nan is null
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.deviations(x), pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                ["_id", "deviation", "w"],
            )

    out = turned.mapInArrow(projected, f"_id {id_type}, deviation bigint, w array<double>")
    share = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
    return (
        out.select("_id", "deviation", F.posexplode("w").alias("_at", "whitened"))
        .select(
            F.col("_id").alias(id_col), (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"),
            "deviation", "whitened",
            F.element_at(F.array(*[F.lit(s).cast("double") for s in share]), F.col("_at") + 1).alias("explained"),
            F.lit(model.identity_error).cast("double").alias("identity_error"),
        )
        .select(id_col, *names)
    )


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings whitened by the 16 components of greatest variance."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
