"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed character 1- to 3-grams (letters lower-cased, everything
else a space), weighted by (1 + ln tf) * idf and scaled to length one.  Document
frequencies come from all labelled training rows.  The training vectors of each language
are clustered (spherical k-means); a text takes the language of the centroid of greatest
cosine, and is rejected when it lies farther from it than the language's own texts do.

Weights are not negative, so the cosine of unrelated text grows with the number of distinct
n-grams.  The floor of a language is therefore a function of that number: beginnings of
different lengths of the training texts tell what its own texts reach, and the other
languages' texts and texts with their characters shuffled what unrelated ones do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.held import released

DIMENSIONS = 4096
CLUSTERS = 3
"""Centroids per language."""

SAMPLE = 1500
"""Greatest number of training rows per language whose vectors are clustered."""

CUTS = (16, 64, 256, 1024, 4096, 16_384)
"""Characters of the beginnings that are measured beside the whole text."""

MARGIN = 0.25
"""Share of the way from unrelated to own texts at which a text is rejected."""

STRENGTH = 50
"""Training texts by which the mean floor of all languages counts beside a language's own:
the fewer texts a language has, the nearer its floor is to that mean.  In the same way that
mean is drawn to ``UNSURE`` by few texts of all languages."""

UNSURE = 0.1
"""Floor where there are no texts to tell one."""

BINS = 13
"""Floors per language: one for each power of two of distinct n-gram slots."""

UNKNOWN = "und"
_CHUNK = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts of the whole text; None if it has no letter.

    Long texts are counted part by part; the last two characters of a part go before the
    next one, so no n-gram is lost between them.
    """
    total, found = np.zeros(DIMENSIONS, np.float64), False
    before, follows = np.empty(0, np.uint32), True
    for start in range(0, len(text), _CHUNK):
        part = text[start : start + _CHUNK].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        found |= bool(letter.any())
        kept = letter.copy()
        kept[0] |= follows
        kept[1:] |= letter[:-1]  # a run of other characters is one space
        follows = bool(letter[-1])
        first, last = [32] if not start else [], [32] if start + _CHUNK >= len(text) else []
        c = np.concatenate([before, first, np.where(letter, codes, 32)[kept], last]).astype(np.uint32)
        old = len(before)
        gram = c * np.uint32(0x9E3779B1)
        grams = [gram[old:]]
        for n in (1, 2):
            gram = (gram[:-1] ^ (c[n:] + np.uint32(n))) * np.uint32(0x85EBCA6B)
            gram = gram ^ (gram >> np.uint32(13))
            grams.append(gram[max(0, old - n) :])
        hashed = np.concatenate(grams) * np.uint32(0xC2B2AE35) >> np.uint32(32 - 12)
        total += np.bincount(hashed, minlength=DIMENSIONS)
        before = c[-2:]
    return total if found else None


def vector(text: str, idf: np.ndarray) -> np.ndarray | None:
    """The unit TF-IDF vector of a text; None if it has no letter."""
    tf = counts(text)
    if tf is None:
        return None
    weighted = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    return weighted / np.linalg.norm(weighted)


def cluster(vectors: np.ndarray, k: int = CLUSTERS, rounds: int = 12) -> np.ndarray:
    """Unit centroids by spherical k-means from farthest-first starts."""
    mean = vectors.mean(axis=0)
    centres = [vectors[np.argmax(vectors @ mean)]]
    for _ in range(min(k, len(vectors)) - 1):
        centres.append(vectors[np.argmin(np.max(vectors @ np.array(centres).T, axis=1))])
    centres = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        sums = np.array([vectors[own == i].sum(axis=0) if (own == i).any() else c for i, c in enumerate(centres)])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


class Model:
    """idf, centroids, and per centroid its language and the cosines (one for each power of
    two of distinct slots) below which it rejects."""

    def __init__(self, idf, centroids, languages, floors):
        self.idf, self.centroids, self.languages, self.floors = idf, centroids, languages, floors

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected): ``und``, 0 and rejected for null texts, texts without
        letters, and all texts if no language was learned."""
        v = vector(text, self.idf) if text and len(self.languages) else None
        if v is None:
            return UNKNOWN, 0.0, True
        near = self.centroids @ v
        best = int(np.argmax(near))
        score = float(min(1.0, max(0.0, near[best])))
        floor = np.interp(np.log2(np.count_nonzero(v)), np.arange(BINS) + 0.5, self.floors[best])
        return self.languages[best], score, bool(near[best] < floor)


def measured(text: str, idf: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[bool, int, np.ndarray]]:
    """(shuffled, bin, cosines) of the beginnings of a text as they are and shuffled."""
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace")))
    for part in [text[:n] for n in CUTS if n < len(text)] + [text]:
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        mixed = rng.permutation(codes).tobytes().decode("utf-32-le", "surrogatepass")
        for shuffled, piece in ((False, part), (True, mixed)):
            if (v := vector(piece, idf)) is not None:
                yield shuffled, int(np.log2(np.count_nonzero(v))), centroids @ v


def floors(own: dict[int, float], unrelated: dict[int, float]) -> list[float]:
    """The floor of each bin: a MARGIN of the way from what unrelated texts reach to what
    nearly all own texts exceed, or the latter where the two overlap."""
    at = np.arange(BINS)
    low = np.interp(at, sorted(own), [own[b] for b in sorted(own)])
    far = np.interp(at, sorted(unrelated), [unrelated[b] for b in sorted(unrelated)]) if unrelated else low
    return np.minimum(low, far + MARGIN * (low - far)).tolist()


def shrunk(own: dict[str, list[float]], sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """The floors drawn towards their mean over all training texts, the more the fewer texts
    a language has."""
    total = sum(sizes[x] for x in own)
    mean = (sum(sizes[x] * np.array(f) for x, f in own.items()) + STRENGTH * UNSURE) / (total + STRENGTH)
    return {x: (sizes[x] * np.array(f) + STRENGTH * mean) / (sizes[x] + STRENGTH) for x, f in own.items()}


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample: int = SAMPLE) -> Model:
    """Learn from all rows given; those without language, id or letters teach nothing.

    Document frequencies cover every row.  Only the clustering uses a sample: at most
    ``sample`` rows per language, chosen by a hash of the id.  The model is of fixed size
    per language and goes to the driver.
    """
    train = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    train = train.filter(F.col("_lang").isNotNull() & F.col("_id").isNotNull() & F.col("_text").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (tf := counts(text)) is not None:
                    df += tf > 0
                    n += 1
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *used.tolist()], pa.int32()), pa.array([n, *df[used].tolist()], pa.int64())], ["slot", "n"]
        )

    found = (
        train.select("_text").mapInArrow(frequencies, "slot int, n bigint")
        .groupBy("slot").agg(F.sum("n").alias("n")).collect()  # DIMENSIONS rows and one
    )
    total = next((r.n for r in found if r.slot < 0), 0)
    df = np.zeros(DIMENSIONS)
    for r in found:
        if r.slot >= 0:
            df[r.slot] = r.n
    idf = np.log((1 + total) / (1 + df)) + 1

    sizes = {r["_lang"]: r["n"] for r in train.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model(idf, np.zeros((0, DIMENSIONS)), [], [])
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2 * sample / n))])
    draw = F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id", F.lit(17)), "_id", F.xxhash64("_text"))
    chosen = (
        train.filter(draw <= share[F.col("_lang")])
        .withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= sample)
    )

    def centres(rows: pa.Table) -> pa.Table:
        vectors = [v.astype(np.float32) for t in rows["_text"] if (v := vector(t.as_py(), idf)) is not None]
        found = cluster(np.array(vectors)).astype(float).tolist() if vectors else []
        lang = pa.array([rows["_lang"][0].as_py()] * len(found), pa.string())
        return pa.table({"lang": lang, "centroid": pa.array(found, pa.list_(pa.float64()))})

    chosen = chosen.withColumn("_lang", F.col("_lang").cast("string")).select("_lang", "_text")
    learned = chosen.groupBy("_lang").applyInArrow(centres, "lang string, centroid array<double>").collect()
    learned = sorted(learned, key=lambda r: (r.lang, r.centroid))
    centroids, languages = np.array([r.centroid for r in learned]).reshape(-1, DIMENSIONS), [r.lang for r in learned]

    def reached(rows: pa.Table) -> pa.Table:
        own, met = rows["_lang"][0].as_py(), {}
        for text in rows["_text"]:
            for shuffled, b, near in measured(text.as_py(), idf, centroids):
                best = {}
                for lang, cosine in zip(languages, near.tolist()):
                    best[lang] = max(best.get(lang, 0.0), cosine)
                for lang, cosine in best.items():
                    met.setdefault((lang, not shuffled and lang == own, shuffled, b), []).append(cosine)
        found = [(lang, mine, b, float(np.quantile(x, 0.01 if mine else 0.99))) for (lang, mine, _, b), x in met.items()]
        kinds = {"lang": pa.string(), "own": pa.bool_(), "bin": pa.int32(), "cosine": pa.float64()}
        return pa.table({name: pa.array([f[i] for f in found], kind) for i, (name, kind) in enumerate(kinds.items())})

    own, unrelated = {}, {}
    for r in chosen.groupBy("_lang").applyInArrow(reached, "lang string, own boolean, bin int, cosine double").collect():
        of = (own if r.own else unrelated).setdefault(r.lang, {})
        of[r.bin] = max(of.get(r.bin, 0.0), r.cosine)
    final = shrunk({lang: floors(own[lang], unrelated.get(lang, {})) for lang in own}, {str(lang): n for lang, n in sizes.items()})
    return Model(idf, centroids, languages, [final[lang] for lang in languages])


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """False for null ids and for the third of the ids that is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 != 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, rejected.

    Learns from the rows that are not held out.  A null id is neither held out nor
    learned from; repeated rows are predicted each; other columns are not read.
    """
    model = fit(docs.filter(training_rows(docs, id_col)), id_col, text_col, lang_col)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col(id_col).alias("_id"), held.alias("_held"), F.col(text_col).alias("_text"))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(2)]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["_id", "held_out", "lang_pred", "score", "rejected"],
            )

    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(released(predicted), f"_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("_id", id_col)


def keep_identified(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is recognised, with their columns; the others go."""
    model = fit(docs.filter(training_rows(docs)))
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not model.predict(t.as_py())[2] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(released(kept), docs.schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
