"""Toxicity by averaged subword embeddings and a linear softmax, learned together.

Words are bags of hashed byte 3- to 5-grams with word ends; a word of more than three
letters has no feature of its own.  A window of a few words is the average of its words' averages; a softmax over the window's
vector gives its score, and a text scores as its worst window.  Embeddings and softmax are
trained together in numpy on texts that are labelled as a whole: each round takes the
windows that score worst now, so the windows that make a text toxic are found while
learning, and clean texts contribute their hardest windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.words import CHUNK, mix, pieces, spans

BUCKETS = 1 << 17
WIDTH = 8
"""Dimensions of an embedding."""

WINDOW = 4
"""Words in a window."""

SAMPLE = 2500
"""Greatest number of training texts of each label."""

PRIOR = 0.05
"""The score of a window whose subwords were never met in training."""

THRESHOLD = 0.3
_GRAMS = (3, 4, 5)


def subwords(raw: bytes) -> tuple[list[tuple[np.ndarray, np.ndarray]], int, np.ndarray]:
    """([(bucket, word number)] for each kind of subword, number of words, word starts)."""
    data, starts, ends = spans(b" " + raw + b" ")
    if not len(starts):
        return [], 0, starts
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    text = np.where(inside, data, 32).astype(np.uint64)
    marks = np.zeros(len(data), np.int32)
    marks[starts] = 1
    owner = np.cumsum(marks) - 1
    found = []
    for n in _GRAMS:
        m = len(text) - n + 1
        if m < 1:
            continue
        valid = inside[1 : 1 + m].copy()
        for k in range(2, n - 1):
            valid &= inside[k : k + m]
        at = np.flatnonzero(valid)
        code = np.full(len(at), n, np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + text[at + k]
        found.append(((mix(code) % np.uint64(BUCKETS)).astype(np.int32), owner[at + 1]))
    return found, len(starts), starts - 1


def word_scores(raw: bytes, weights: np.ndarray) -> np.ndarray:
    """The mean weight of each word's subwords."""
    found, n, _ = subwords(raw)
    total, size = np.zeros(n), np.zeros(n)
    for bucket, owner in found:
        total += np.bincount(owner, weights[bucket], n)
        size += np.bincount(owner, minlength=n)
    return total / np.maximum(size, 1)


def worst_window(words: np.ndarray) -> float:
    """The greatest mean over runs of WINDOW words; a shorter text is one run."""
    if len(words) <= WINDOW:
        return float(words.mean())
    sums = np.concatenate([[0.0], np.cumsum(words)])
    return float((sums[WINDOW:] - sums[:-WINDOW]).max() / WINDOW)


def text_logits(texts: list[str], weights: np.ndarray) -> list[float | None]:
    """The worst window of each text; None without words.  Short texts share arrays."""
    out: list[float | None] = [None] * len(texts)
    group: list[tuple[int, bytes]] = []

    def flush() -> None:
        if not group:
            return
        joined = b"\n".join(raw for _, raw in group)
        found, n, starts = subwords(joined)
        total, size = np.zeros(n), np.zeros(n)
        for bucket, owner in found:
            total += np.bincount(owner, weights[bucket], n)
            size += np.bincount(owner, minlength=n)
        scores = total / np.maximum(size, 1)
        cuts = np.searchsorted(starts, np.cumsum([len(raw) + 1 for _, raw in group]))
        first = 0
        for (i, _), end in zip(group, cuts.tolist()):
            if end > first:
                out[i] = worst_window(scores[first:end])
            first = end
        group.clear()

    held = 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        if len(raw) > CHUNK:  # windows run on over the parts of a long text
            scores = np.concatenate([word_scores(p, weights) for p in pieces(raw)])
            if len(scores):
                out[i] = worst_window(scores)
            continue
        if held + len(raw) > CHUNK:
            flush()
            held = 0
        group.append((i, raw))
        held += len(raw) + 1
    flush()
    return out


class Model:
    """Subword weights (embedding times softmax difference) and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: list[str | None]) -> list[float]:
        """Probability of the label per text; 0 for texts without words."""
        logits = text_logits([t or "" for t in texts], self.weights)
        return [0.0 if x is None else float(1 / (1 + np.exp(-np.clip(x + self.bias, -50, 50)))) for x in logits]


def train(texts: list[str], labels: list[int], rounds: int = 30, seed: int = 7) -> Model:
    """Embeddings and softmax from texts labelled 0 or 1; both labels are needed."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 50.0 if len(y) and y[0] else -50.0)
    # Distinct words with their subwords; texts as word numbers.
    numbers: dict[bytes, int] = {}
    docs = []
    for text in texts:
        ids = []
        for part in pieces(text.encode("utf-8", "surrogatepass")):
            data, starts, ends = spans(part)
            low = data.tobytes()
            ids += [numbers.setdefault(low[s:e], len(numbers)) for s, e in zip(starts.tolist(), ends.tolist())]
        docs.append(np.array(ids, np.int64))
    if not numbers:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(PRIOR / (1 - PRIOR))))
    joined = b"\n".join(numbers)
    found, n_words, _ = subwords(joined)
    bucket = np.concatenate([b for b, _ in found])
    owner = np.concatenate([o for _, o in found])
    order = np.argsort(owner, kind="stable")
    used, bucket = np.unique(bucket, return_inverse=True)  # only met buckets are trained
    bucket, owner, size_used = bucket[order], owner[order], len(used)
    first = np.searchsorted(owner, np.arange(n_words + 1))
    size = np.maximum(np.diff(first), 1)

    def per_word(weights: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights[bucket], n_words) / size

    # The first guess at the telling windows: smoothed log odds of subwords over texts.
    seen = np.zeros((2, size_used))
    for ids, label in zip(docs, y):
        if len(ids):
            words = np.unique(ids)
            parts = [bucket[first[w] : first[w + 1]] for w in words.tolist()]
            seen[label, np.unique(np.concatenate(parts))] += 1
    n = np.bincount(y, minlength=2)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    odds *= (seen.sum(axis=0) > 1)

    embed = rng.normal(0, 0.1, (size_used, WIDTH))
    soft = rng.normal(0, 0.3, (2, WIDTH))
    bias = np.zeros(2)
    m1 = {k: np.zeros_like(v) for k, v in (("e", embed), ("s", soft), ("b", bias))}
    m2 = {k: np.zeros_like(v) for k, v in (("e", embed), ("s", soft), ("b", bias))}
    step = 0

    def adam(key: str, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
        m1[key] += 0.1 * (grad - m1[key])
        m2[key] += 0.01 * (grad * grad - m2[key])
        value -= rate * (m1[key] / (1 - 0.9**step)) / (np.sqrt(m2[key] / (1 - 0.99**step)) + 1e-8)

    words_now = per_word(odds)
    for turn in range(rounds):
        windows, target = [], []
        for ids, label in zip(docs, y):
            if not len(ids):
                continue
            starts = np.arange(max(1, len(ids) - WINDOW + 1))
            if len(ids) > WINDOW:
                sums = np.concatenate([[0.0], np.cumsum(words_now[ids])])
                value = sums[WINDOW:] - sums[:-WINDOW]
                worst = int(np.argmax(value))
                take = [worst]
                if not label:  # the worst two of a clean text, and others for breadth
                    value[max(0, worst - WINDOW + 1) : worst + WINDOW] = -np.inf
                    take += [int(np.argmax(value))] if np.isfinite(value).any() else []
                    take += rng.choice(starts, min(3, len(starts)), replace=False).tolist()
            else:
                take = [0]
            for s in take:
                windows.append(ids[s : s + WINDOW])
                target.append(label)
        if not windows:
            break
        target = np.array(target)
        share = np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum()))
        mass = share * len(target)
        for some in np.array_split(rng.permutation(len(windows)), max(8, len(windows) // 1024)):
            if not len(some):
                continue
            step += 1
            ids = np.concatenate([windows[i] for i in some])
            lengths = np.array([len(windows[i]) for i in some])
            reps = (first[ids + 1] - first[ids])
            at = np.repeat(first[ids] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
            slots = bucket[at]
            row = np.repeat(np.repeat(np.arange(len(some)), lengths), reps)
            weight = np.repeat(1 / (np.repeat(lengths, lengths) * np.maximum(reps, 1)), reps)
            hidden = np.stack([np.bincount(row, embed[slots, d] * weight, len(some)) for d in range(WIDTH)], axis=1)
            logits = hidden @ soft.T + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), target[some]] -= 1
            p *= mass[some, None] / len(some)
            back = p @ soft
            grad = np.stack([np.bincount(slots, back[row, d] * weight, size_used) for d in range(WIDTH)], axis=1)
            adam("s", soft, p.T @ hidden, 0.05)
            adam("b", bias, p.sum(axis=0), 0.05)
            adam("e", embed, grad + 1e-6 * embed, 0.05)
        words_now = per_word(embed @ (soft[1] - soft[0]))
    offset = float(bias[1] - bias[0])
    weights = np.full(BUCKETS, np.log(PRIOR / (1 - PRIOR)) - offset)
    weights[used] = embed @ (soft[1] - soft[0])
    return Model(weights.astype(np.float32), offset)


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows given; at most ``sample`` of each label are used,
    chosen by a hash of the id.  Null ids, texts and labels teach nothing; an id with
    several labels counts as its greatest.  The training runs in one task on this sample;
    its model is of fixed size."""
    marks = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1)).groupBy("_id").agg(F.max("_y").alias("_y"))
    )
    wanted = marks.filter(F.crc32(F.col("_id").cast("string")) % 4 != 2)
    sizes = {r["_y"]: r["n"] for r in wanted.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model(np.zeros(BUCKETS, np.float32), -50.0)
    # The ids of the sample are bounded by its size, so they can go to every task.
    ids = None
    for label, n in sorted(sizes.items()):
        part = wanted.filter(F.col("_y") == label).orderBy(F.xxhash64("_id", F.lit(23)), "_id").limit(sample)
        ids = part if ids is None else ids.unionByName(part)
    chosen = (
        rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
        .join(F.broadcast(ids), "_id").groupBy("_id", "_y").agg(F.max("_text").alias("_text"))
    )

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        model = train(pdf["_text"].tolist(), pdf["_y"].astype(int).tolist())
        return pd.DataFrame({"weights": [zlib.compress(model.weights.tobytes(), 1)], "bias": [model.bias]})

    found = chosen.groupBy(F.lit(1).alias("_one")).applyInPandas(learn, "weights binary, bias double").collect()
    if not found:
        return Model(np.zeros(BUCKETS, np.float32), -50.0)
    return Model(np.frombuffer(zlib.decompress(found[0]["weights"]), np.float32), found[0]["bias"])


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of the ids whose labels are not learned from; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Null and empty texts, and texts without words, score 0.  Repeated rows are scored
    each; other columns of either table are not read.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("_held"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(model.scores(batch.column(2).to_pylist()), pa.float64())],
                ["_id", "held_out", "score"],
            )

    out = rows.mapInArrow(scored, f"_id {kind}, held_out boolean, score double")
    return out.select(F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from three quarters of the labels."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
