"""Vector codes by parts, with codebooks refined under adaptive distance bounds.

A vector of integers is cut into equal parts; each part position has a codebook, and a
vector's code names the nearest entry of each part.  Codebooks are refined by rounds of
assignment and integer averaging.

Rounds after the first avoid most distances (Drake and Hamerly's adaptive bounds).  Every
part carries its entry, its ``b`` next closest entries with a lower bound of the distance
to each, and one outer bound for all entries beyond them.  When entries move, the bounds
shrink by how far they moved.  The distance to the own entry is computed exactly; listed
entries whose bound does not exceed it are verified with integers, and only a part whose
outer bound fails as well is compared with the whole codebook.  ``b`` follows what the
parts of a batch needed last.  Bounds are always rounded down, so the result is that of
comparing everything.

The bounds travel with the rows as Parquet (two bytes per listed entry and part), together
with the sums of each task, which make the next codebooks.  Only those sums, added up by
Spark, go to the driver: their number is that of the codebooks' components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from marginalia.llm.vectors import common_size, finite, matrix
from marginalia.operators.durable import stored
from marginalia.operators.joins import lookup_join

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
GREATEST = 1 << 28
"""Magnitude of integer components up to which all sums of squares fit 64 bits."""

LIST_SHARE, LEAST_SHARE = 8, 16
"""A list starts with one in eight of the entries and never has fewer than one in sixteen."""

_UP, _DOWN = 1 + 1e-9, 1 - 1e-9


# ---- one part position: exact distances and bounds

def _exact(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one entry each, in integers."""
    gap = x - entries
    return (gap * gap).sum(axis=1)


def _all(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to all entries: a matrix product where it is exact in
    double precision, else integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        f, c = x.astype(np.float64), book.astype(np.float64)
        return ((f * f).sum(axis=1)[:, None] - 2 * (f @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([_exact(x, entry) for entry in book], axis=1)


class Bounds:
    """What is known of the parts of one position: ``own`` entry and its squared distance,
    ``near`` entries with their ``lower`` bounds in order, and the ``outer`` bound."""

    def __init__(self, own, distance, near, lower, outer):
        self.own, self.distance, self.near, self.lower, self.outer = own, distance, near, lower, outer

    def listed(self, b: int) -> Bounds:
        """With lists of ``b`` entries at most; the others fall under the outer bound."""
        if b >= self.near.shape[1]:
            return self
        outer = np.minimum(self.outer, self.lower[:, b])
        return Bounds(self.own, self.distance, self.near[:, :b], self.lower[:, :b], outer)


def compared(x: np.ndarray, book: np.ndarray, b: int) -> Bounds:
    """Bounds from the distances to all entries; the nearest wins, the first of equals."""
    squares = _all(x, book)
    n, k = squares.shape
    own = squares.argmin(axis=1)
    rows = np.arange(n)
    distance = squares[rows, own]
    rest = np.sqrt(squares.astype(np.float64))
    rest[rows, own] = np.inf
    b = min(b, max(0, k - 2))
    if k == 1:
        return Bounds(own, distance, np.empty((n, 0), np.int64), np.empty((n, 0)), np.full(n, np.inf))
    some = np.argpartition(rest, b, axis=1)[:, : b + 1]
    values = np.take_along_axis(rest, some, axis=1)
    order = np.argsort(values, axis=1)
    some, values = np.take_along_axis(some, order, axis=1), np.take_along_axis(values, order, axis=1) * _DOWN
    return Bounds(own, distance, some[:, :b], values[:, :b], values[:, b])


def moved(x: np.ndarray, book: np.ndarray, shift: np.ndarray, old: Bounds) -> tuple[Bounds, np.ndarray]:
    """Bounds after each entry moved by ``shift`` at most, and how many listed entries every
    part had to verify (one more than the list is long: all entries)."""
    own = old.own.astype(np.int64)
    near = old.near.astype(np.int64)
    distance = _exact(x, book[own])
    reach = np.sqrt(distance.astype(np.float64)) * _UP
    lower = np.maximum(0, old.lower - shift[near])
    outer = np.maximum(0, old.outer - shift.max(initial=0))
    order = np.argsort(lower, axis=1, kind="stable")
    near, lower = np.take_along_axis(near, order, axis=1), np.take_along_axis(lower, order, axis=1)
    whole = outer <= reach
    unsure = (lower <= reach[:, None]) & ~whole[:, None]
    need = np.where(whole, near.shape[1] + 1, unsure.sum(axis=1))
    for j in range(near.shape[1]):
        rows = np.flatnonzero(unsure[:, j])
        if not len(rows):
            break  # lists are in the order of their bounds
        other = near[rows, j]
        d = _exact(x[rows], book[other])
        wins = (d < distance[rows]) | ((d == distance[rows]) & (other < own[rows]))
        lower[rows, j] = np.sqrt(np.where(wins, distance[rows], d).astype(np.float64)) * _DOWN
        near[rows, j] = np.where(wins, own[rows], other)
        own[rows], distance[rows] = np.where(wins, other, own[rows]), np.where(wins, d, distance[rows])
    order = np.argsort(lower, axis=1, kind="stable")
    near, lower = np.take_along_axis(near, order, axis=1), np.take_along_axis(lower, order, axis=1)
    found = Bounds(own, distance, near, np.minimum(lower, outer[:, None]), outer)
    rows = np.flatnonzero(whole)
    if len(rows):
        fresh = compared(x[rows], book, near.shape[1])
        found.own[rows], found.distance[rows], found.outer[rows] = fresh.own, fresh.distance, fresh.outer
        found.near[rows], found.lower[rows] = fresh.near, fresh.lower
    return found, need


# ---- bounds as bytes

def packed(bounds: Bounds) -> np.ndarray:
    """Per row: own entry, listed entries, their bounds in 255ths of the outer bound, and
    the outer bound as a 32-bit float; all rounded down."""
    n = len(bounds.own)
    with np.errstate(over="ignore"):
        outer = bounds.outer.astype("<f4")
    outer = np.where(outer > bounds.outer, np.nextafter(outer, np.float32(0)), outer).astype("<f4")
    outer = np.minimum(outer, np.where(np.isinf(bounds.outer), np.float32(np.inf), np.finfo("<f4").max)).astype("<f4")
    scale = np.where((outer > 0) & np.isfinite(outer), outer, 1).astype(np.float64)[:, None]
    shares = np.clip(np.floor(255 * (bounds.lower / scale)), 0, 255)
    return np.concatenate(
        [bounds.own.astype(np.uint8)[:, None], bounds.near.astype(np.uint8), shares.astype(np.uint8),
         np.ascontiguousarray(outer).view(np.uint8).reshape(n, 4)], axis=1,
    )


def unpacked(raw: np.ndarray) -> Bounds:
    b = (raw.shape[1] - 5) // 2
    outer = np.ascontiguousarray(raw[:, 1 + 2 * b :]).view("<f4")[:, 0].astype(np.float64)
    scale = np.where(np.isfinite(outer), outer, 0)[:, None]
    lower = raw[:, 1 + b : 1 + 2 * b] / 255 * scale * _DOWN
    return Bounds(raw[:, 0].astype(np.int64), None, raw[:, 1 : 1 + b].astype(np.int64), lower, outer)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of an array of bytes."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their bytes) of a binary column, one array for each length in it."""
    values = column.to_pylist()
    lengths = np.array([len(v) for v in values])
    return [
        (rows := np.flatnonzero(lengths == w), np.frombuffer(b"".join(values[i] for i in rows), np.uint8).reshape(-1, w))
        for w in np.unique(lengths).tolist()
    ]


# ---- tasks

_NARROW = [np.dtype("<i1"), np.dtype("<i2"), np.dtype("<i4")]


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(np.abs(x).max(initial=0))
    kind = next(k for k in _NARROW if most <= np.iinfo(k).max)
    return np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(len(x), -1)


class _Totals:
    """Sums and counts per part and entry of a task's rows."""

    def __init__(self, books: np.ndarray):
        parts, k, width = books.shape
        self.sums, self.counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)

    def add(self, part: int, x: np.ndarray, own: np.ndarray) -> None:
        k = self.counts.shape[1]
        self.counts[part] += np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.diff(own[order], prepend=-1))
        self.sums[part, own[order][starts]] += np.add.reduceat(x[order], starts, axis=0)

    def bytes(self) -> bytes:
        return np.concatenate([self.sums, self.counts[:, :, None]], axis=2).astype("<i8").tobytes()


def _integers(column: pa.Array, size: int, scale: int) -> np.ndarray:
    x = np.floor(matrix(column, size) * scale)
    if np.abs(x).max(initial=0) > GREATEST:
        raise ValueError(f"components beyond {GREATEST // scale} are outside what integer distances can hold")
    return x.astype(np.int64)


def _step(x: np.ndarray, books: np.ndarray, shifts: np.ndarray | None, raw: np.ndarray | None):
    """Bounds of all parts of a batch, and the length of the lists they need."""
    parts, k, width = books.shape
    found, needs = [], []
    for p in range(parts):
        mine = x[:, p * width : (p + 1) * width]
        if raw is None:
            found.append(compared(mine, books[p], max(1, k // LIST_SHARE)))
        else:
            each = raw.shape[1] // parts
            bounds, need = moved(mine, books[p], shifts[p], unpacked(raw[:, p * each : (p + 1) * each]))
            found.append(bounds)
            needs.append(need)
    b = found[0].near.shape[1]
    if needs:
        b = max(min(b, int(np.quantile(np.concatenate(needs), 0.99))), k // LEAST_SHARE)
    return found, b


def _assigned(books: np.ndarray, shifts: np.ndarray | None, size: int, scale: int, last: bool):
    """The function of an assignment's tasks: state and sums, or at last codes and errors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = _Totals(books)
        for batch in batches:
            if not batch.num_rows:
                continue
            if shifts is None:
                groups = [(np.arange(batch.num_rows), _integers(batch.column(2), size, scale), None)]
            else:
                groups = []
                for rows, raw in _bytes(batch.column(2)):
                    x = np.ascontiguousarray(raw).view(_NARROW[raw.shape[1] // size // 2]).astype(np.int64).reshape(-1, size)
                    of_rows = batch.column(3).take(pa.array(rows))
                    groups += [(rows[at], x[at], state) for at, state in _bytes(of_rows)]
            for rows, x, raw in groups:
                found, b = _step(x, books, shifts, raw)
                head = [batch.column(i).take(pa.array(rows)) for i in (0, 1)]
                if last:
                    codes = np.stack([f.own for f in found], axis=1).astype(np.uint8)
                    text = codes.tobytes().hex()
                    wide = 2 * len(found)
                    error = np.sum([f.distance for f in found], axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [*head, pa.array([text[i : i + wide] for i in range(0, len(text), wide)]), pa.array(error, pa.int64())],
                        ["_id", "_label", "code", "error"],
                    )
                    continue
                width = books.shape[2]
                for p, f in enumerate(found):
                    totals.add(p, x[:, p * width : (p + 1) * width], f.own)
                state = np.concatenate([packed(f.listed(b)) for f in found], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*head, _binary(_narrow(x)), _binary(state), pa.nulls(len(rows), pa.binary())],
                    ["_id", "_label", "_x", "_state", "_sums"],
                )
        if not last and totals.counts.any():
            kinds = [head[0].type, head[1].type, pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, kind) for kind in kinds), pa.array([totals.bytes()], pa.binary())],
                ["_id", "_label", "_x", "_state", "_sums"],
            )

    return run


def _averaged(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks: floors of the means; entries that no part uses stay."""
    parts, k, width = books.shape

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts * k * (width + 1), np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw, "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["slot", "n"])

    sums = state.filter(F.col("_sums").isNotNull()).select("_sums").mapInArrow(unpack, "slot bigint, n bigint")
    total = np.zeros(parts * k * (width + 1), np.int64)
    for r in sums.groupBy("slot").agg(F.sum("n").alias("n")).collect():  # as many as the books have components
        total[r.slot] = r.n
    total = total.reshape(parts, k, width + 1)
    counts = total[:, :, width:]
    return np.where(counts > 0, total[:, :, :width] // np.maximum(counts, 1), books)


# ---- the operator

def _smallest(kept: DataFrame, entries: int, scale: int) -> list[Row]:
    """The rows of the smallest ids.  Tasks give ids only, until the greatest of them is known."""
    order = F.asc_nulls_last("_id")
    ids = [r["_id"] for r in stored(kept.select("_id").orderBy(order).limit(entries), "codes-ids").collect()]
    if ids and None not in ids:
        kept = kept.filter(F.col("_id") <= F.lit(max(ids)))
    start = kept.select("_id", F.transform("_vector", lambda c: F.floor(c.cast("double") * scale)).alias("x"))
    return stored(start.orderBy(order, "x").limit(entries), "codes-start").orderBy(order, "x").collect()


def refined_codes(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """(one row per kept vector: id, label, code, error; the final codebooks).

    Dropped are vectors that are null, empty or hold null or non-finite components, and
    those whose length is not the table's (the most frequent one that ``parts`` divides).
    Codebooks start from the ``entries`` smallest ids (nulls last; rows of equal ids in the
    order of their vectors); with fewer rows they are as much smaller.  Repeated rows are
    coded each and count each.  Components beyond 2**28 after scaling raise an error.  An
    empty table gives no rows and empty codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits per part")
    whole = rows.select(
        F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_vector")
    ).filter(finite(F.col("_vector")))
    size = common_size(whole, F.col("_vector"), parts)
    kept = whole.filter(F.size("_vector") == size)
    first = _smallest(kept, entries, scale)
    id_type, label_type = (kept.schema[c].dataType.simpleString() for c in ("_id", "_label"))
    final = f"_id {id_type}, _label {label_type}, code string, error bigint"
    if not first:
        return rows.sparkSession.createDataFrame([], final), np.zeros((parts, 0, 0), np.int64)
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    shifts, state = None, kept
    persisted = f"_id {id_type}, _label {label_type}, _x binary, _state binary, _sums binary"
    for turn in range(rounds):
        state = stored(state.mapInArrow(_assigned(books, shifts, size, scale, False), persisted), f"codes-{turn}")
        moving = _averaged(state, books)
        shifts = np.sqrt(((moving - books).astype(np.float64) ** 2).sum(axis=2)) * _UP
        books, state = moving, state.filter(F.col("_x").isNotNull()).select("_id", "_label", "_x", "_state")
    codes = stored(state.mapInArrow(_assigned(books, shifts, size, scale, True), final), "codes")
    return codes, books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
               **sizes: int) -> DataFrame:
    """One row per kept vector: id, code, error, label_error, codebooks_sha256.

    ``label_error`` is the sum of errors over equal labels, null labels together.  For
    the rest see ``refined_codes``.
    """
    codes, books = refined_codes(rows, id_col, vector_col, label_col, **sizes)
    label = F.coalesce(F.concat(F.lit("="), F.col("_label").cast("string")), F.lit("-"))
    codes = codes.withColumn("_of", label)
    totals = codes.groupBy("_of").agg(F.sum("error").alias("label_error"))
    return lookup_join(codes, totals, ["_of"]).select(
        F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )


def op13_code_refinement(spark, sf_dir: str) -> DataFrame:
    """The codes of all embeddings under codebooks refined twice."""
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    dist = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"near{r} AS (SELECT a.rn, a.p, min({dist} * {ENTRIES} + b.e) AS k FROM parts a JOIN book{r} b ON a.p = b.p GROUP BY a.rn, a.p)"
        )
        if r < ROUNDS:
            steps.append(f"""flat{r} AS (SELECT n.p, CAST(n.k % {ENTRIES} AS BIGINT) AS e, i, a.v[i] AS c
                FROM near{r} n JOIN parts a ON a.rn = n.rn AND a.p = n.p, range(1, (SELECT width FROM shape) + 1) t(i)),
            mean{r} AS (SELECT p, e, i, CAST((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS c
                FROM flat{r} GROUP BY p, e, i),
            used{r} AS (SELECT p, e, list(c ORDER BY i) AS v FROM mean{r} GROUP BY p, e),
            book{r + 1} AS (SELECT b.p, b.e, coalesce(u.v, b.v) AS v FROM book{r} b LEFT JOIN used{r} u ON u.p = b.p AND u.e = b.e)""")
    return f"""
WITH kept AS (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS rn,
           list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
shape AS (SELECT CAST(max(len(x)) // {PARTS} AS BIGINT) AS width FROM kept),
parts AS (
    SELECT rn, p, list_slice(x, p * (SELECT width FROM shape) + 1, (p + 1) * (SELECT width FROM shape)) AS v
    FROM kept, range({PARTS}) t(p)),
book0 AS (SELECT p, rn AS e, v FROM parts WHERE rn < {ENTRIES}),
{", ".join(steps)},
coded AS (
    SELECT rn, string_agg(printf('%02x', CAST(k % {ENTRIES} AS INTEGER)), '' ORDER BY p) AS code,
           CAST(sum(k // {ENTRIES}) AS BIGINT) AS error
    FROM near{ROUNDS} GROUP BY rn),
digest AS (
    SELECT sha256(string_agg(CAST(v[i] AS VARCHAR), ',' ORDER BY p, e, i)) AS h
    FROM book{ROUNDS}, range(1, (SELECT width FROM shape) + 1) t(i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT h FROM digest) AS codebooks_sha256
FROM kept JOIN coded USING (rn)
"""


ORACLE = _oracle()
"""The same refinement with all distances computed; for ids that do not repeat."""
