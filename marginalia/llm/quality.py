"""Document quality by Bradley-Terry ranking of preference pairs.

A text becomes some sixty numbers about its characters, words and lines.  Of two labelled
documents of different quality the better one is preferred; a document's score is linear
in its numbers and learned from such pairs by logistic loss on the difference of their
numbers (Newton's method in numpy).  Where the ranking is cut is a quantile of the scores
of all labelled training documents: the share of them that is labelled low lies below it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.held import released
from marginalia.operators.durable import stored
from marginalia.operators.joins import skew_join

SAMPLE = 3000
"""Greatest number of training documents of each label that pairs are made of."""

PAIRS = 12
"""Preference pairs per sampled document of the greater label."""

RIDGE = 1e-3
THRESHOLD = 0.5
BLOCK = 1 << 16
"""Characters that are described together; a longer text is the mean of its blocks."""

CUTS = 4096
"""Steps of the scores' distribution within which the quantile is found at a time."""

_SYMBOLS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_CLASS = np.zeros(256, np.intp)  # 0 control, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 32]], _CLASS[[10, 13]], _CLASS[128:] = 4, 5, 6
_CLASS[_SYMBOLS] = 7 + np.arange(len(_SYMBOLS))
_CLASSES = 7 + len(_SYMBOLS)
_ENDS = frozenset(".,;:!?")
SIZE = _CLASSES + 19


def _described(text: str) -> np.ndarray:
    """The numbers of one block that is not empty."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    shares = np.bincount(_CLASS[raw], minlength=_CLASSES) / len(raw)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(words)
    out = np.zeros(19)
    if n:
        lengths = np.fromiter(map(len, words), np.int64, n)
        counts = Counter(words)
        freq = np.fromiter(counts.values(), np.float64, len(counts))
        out[:14] = (
            min(lengths.mean(), 40), min(lengths.std(), 40), (lengths <= 2).mean(), (lengths >= 15).mean(),
            np.log(len(counts)) / np.log(n + 1), freq.max() / n,
            -(freq / n * np.log(freq / n)).sum() / np.log(n + 1),
            sum(map(str.__eq__, words, words[1:])) / n,
            len(set(zip(words, words[1:]))) / max(1, n - 1),
            len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2),
            sum(map(str.isupper, words)) / n, sum(w[0].isupper() for w in words) / n,
            sum(w[-1] in _ENDS for w in words) / n, sum(not w[-1].isalnum() for w in words) / n,
        )
    if lines:
        out[14:] = (
            1 - len(set(lines)) / len(lines), np.log(len(text) / len(lines)),
            sum(len(x) < 30 for x in lines) / len(lines), sum(x.rstrip()[-1:].isalnum() for x in lines) / len(lines),
            np.log(n + 1),
        )
    return np.concatenate([np.sqrt(shares), out])


def describe(text: str | None) -> np.ndarray:
    """The numbers of a whole text (zeros if it is null or empty): the mean over its blocks,
    weighted by their length."""
    if not text:
        return np.zeros(SIZE)
    if len(text) <= BLOCK:
        return _described(text)
    total = np.zeros(SIZE)
    for start in range(0, len(text), BLOCK):
        block = text[start : start + BLOCK]
        total += _described(block) * len(block)
    return total / len(text)


class Ranking:
    """Scores of described texts: standardised numbers and their squares, weighted."""

    def __init__(self, mean, spread, weights):
        self.mean, self.spread, self.weights = mean, spread, weights

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.concatenate([z, np.minimum(z * z, 12)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights


def rank(better: np.ndarray, worse: np.ndarray, rounds: int = 25) -> Ranking:
    """The ranking that prefers the rows of ``better`` to those of ``worse``.

    Every row of the larger side meets PAIRS rows of the other, so that each row of a side
    is in about as many pairs as any other.
    """
    both = np.concatenate([better, worse])
    model = Ranking(both.mean(axis=0), np.maximum(both.std(axis=0), 1e-3), np.zeros(2 * both.shape[1]))
    if not len(better) or not len(worse):
        return model
    n = PAIRS * max(len(better), len(worse))
    rng = np.random.default_rng(41)
    dealt = lambda k: np.concatenate([rng.permutation(k) for _ in range(-(-n // k))])[:n]
    differ = model.inputs(better)[dealt(len(better))] - model.inputs(worse)[dealt(len(worse))]
    w, ridge = model.weights, RIDGE * np.eye(differ.shape[1])
    loss = lambda w: np.logaddexp(0, -(differ @ w)).mean() + RIDGE / 2 * w @ w
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(differ @ w, -50, 50)))  # of the pair the other way round
        gradient = -(differ.T @ p) / n + RIDGE * w
        curve = (differ.T * (p * (1 - p))) @ differ / n + ridge
        step = np.linalg.solve(curve, gradient)
        size = 1.0
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-10:
            break
    model.weights = w
    return model


# ---- Spark

def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and the numbers of each text as 32-bit floats; the texts are read here alone."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            x = [describe(texts[i].as_py()).astype("<f4").tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["_id", "_x"])

    return rows.mapInArrow(released(tasks), f"_id {kind}, _x binary")


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, SIZE).astype(np.float64)


def held_out(id_col: Column) -> Column:
    """The third of the ids whose labels are not learned from; false for null ids."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """_id and _y (0 or 1) of the ids that labels are learned from: not null, not held out,
    and with the same label wherever they have one."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
    marks = marks.filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    found = marks.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_most"))
    return found.filter(F.col("_y") == F.col("_most")).select("_id", F.col("_y").cast("int").alias("_y"))


def _cut(train: DataFrame, model: Ranking) -> float:
    """The score below which as many of all training rows lie as are labelled 0.

    The distribution of the scores is counted in CUTS steps, and the step that holds the
    quantile again in as many, until it holds no two different scores or has the width of
    rounding.
    """
    def counted(low: float, high: float):
        def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, worse = np.zeros(CUTS + 2, np.int64), 0
            for batch in batches:
                if batch.num_rows:
                    s = model.scores(_numbers(batch.column(0)))
                    step = np.floor((s - low) / (high - low) * CUTS)
                    n += np.bincount(np.clip(step, -1, CUTS).astype(int) + 1, minlength=CUTS + 2)
                    worse += int((batch.column(1).to_numpy() == 0).sum())
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *used.tolist()], pa.int32()), pa.array([worse, *n[used].tolist()], pa.int64())], ["step", "n"]
            )

        found = train.select("_x", "_y").mapInArrow(tasks, "step int, n bigint")
        n, worse = np.zeros(CUTS + 2, np.int64), 0
        for r in found.groupBy("step").agg(F.sum("n").alias("n")).collect():  # CUTS rows at most
            if r.step < 0:
                worse = r.n
            else:
                n[r.step] = r.n
        return n, worse

    reach = float(np.abs(model.weights) @ np.concatenate([np.full(SIZE, 6.0), np.full(SIZE, 12.0)])) or 1.0
    low, high = -reach, reach
    for _ in range(4):
        n, worse = counted(low, high)
        total = int(n.sum())
        if not worse or worse == total:
            return -np.inf if not worse else np.inf
        upto = np.cumsum(n)
        at = int(np.searchsorted(upto, worse, side="left"))  # the step that holds the last of them
        width = (high - low) / CUTS
        if not 1 <= at <= CUTS:
            break
        low, high = low + (at - 1) * width, low + at * width
        if upto[at] == worse or high - low < 1e-9 * reach:
            break
    return high


def fit(numbers: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        sample: int = SAMPLE) -> tuple[Ranking, float]:
    """(ranking, cut) from described texts (``_id``, ``_x``) and labels.

    Pairs are made of at most ``sample`` rows of each label, chosen by a hash of the id; the
    cut comes from all labelled training rows.  Both are of fixed size on the driver.
    """
    train = stored(skew_join(numbers, training_labels(labels, id_col, label_col), ["_id"]), "quality-training")
    sizes = {r["_y"]: r["n"] for r in train.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("_id", F.lit(29)), F.lit(1 << 40))
    sides = []
    for label in (1, 0):
        # Tasks give about twice the sample together, whatever their number.
        some = train.filter((F.col("_y") == label) & (draw <= int(min(1.0, 2 * sample / max(1, sizes.get(label, 0))) * (1 << 40))))
        rows = stored(some.orderBy(draw, "_id", "_x").limit(sample).select("_x"), "quality-sample")
        taken = sorted(bytes(r["_x"]) for r in rows.collect())  # sample rows at most
        sides.append(np.frombuffer(b"".join(taken), "<f4").reshape(-1, SIZE).astype(np.float64))
    if not len(sides[0]) + len(sides[1]):
        return Ranking(np.zeros(SIZE), np.ones(SIZE), np.zeros(2 * SIZE)), 0.0
    model = rank(*sides)
    return model, _cut(train, model)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    The score is the logistic function of how far a text's rank lies above the cut, so 0.5
    is the cut itself.  Null and empty texts are described by zeros and scored like others.
    Null ids are neither held out nor learned from; ids with contradicting labels teach
    nothing; repeated rows are scored each.  Without labels every score is 0.5; with one
    label only, every text is predicted to have it.  Other columns are not read.
    """
    numbers = stored(described(docs, id_col, text_col), "quality-numbers")
    model, cut = fit(numbers, labels, id_col, label_col, sample)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                above = np.clip(model.scores(_numbers(batch.column(1))) - cut, -500, 500)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-above)))], ["_id", "score"])

    kind = numbers.schema["_id"].dataType.simpleString()
    out = numbers.mapInArrow(tasks, f"_id {kind}, score double")
    return out.select(
        F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op12_quality(spark, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from two thirds of the labels."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
