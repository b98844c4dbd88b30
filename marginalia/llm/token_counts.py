"""Token counts with a shortcut for words that are whole tokens.

Which vocabulary strings encode alone as one token is proved on the driver before the
texts are read, by merging each of them; a word of a text that is such a string counts one without merging.  Only the other
words are merged, each distinct one once while a worker remembers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.bpe_tables import Remembered, vocabulary, words_of
from marginalia.llm.held import released

REMEMBERED = 96 << 20
"""Bytes of words and counts that a worker keeps."""

TOKEN_LIMIT = 512


class _Counts(Remembered):
    """Tokens per word: one for whole tokens, the length of the merge for the rest."""

    def __init__(self, path: str, proved: bytes | None):
        super().__init__(REMEMBERED)
        self.vocabulary = vocabulary(path)
        self.whole = self.vocabulary.whole(proved)

    def __missing__(self, word: str) -> int:
        n = self.recall(word)
        if n is None:
            raw = word.encode()
            n = 1 if raw in self.whole else len(self.vocabulary.merge(raw))
            if len(word) <= 64:
                self.keep(word, n)
        return n


_COUNTS: dict[str, _Counts] = {}


def count_tokens(text: str, path: str, proved: bytes | None = None) -> int:
    """Tokens of one text, special strings in it counting one each.

    ``proved`` are the ids of the whole tokens if they are known already.
    """
    if path not in _COUNTS:
        _COUNTS[path] = _Counts(path, proved)
    counts = _COUNTS[path]
    parts = counts.vocabulary.parts(text)
    return len(parts) - 1 + sum(sum(map(counts.__getitem__, words_of(p))) for p in parts)


def token_counts(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit.

    A null text counts as empty (0 bytes, 0 tokens).  Ids may be null or repeated: each
    row is counted on its own.  Texts of any length are counted whole.  Other columns are
    not read.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    proved = vocabulary(path).proved

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count_tokens(t, path, proved) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["_id", "n_bytes", "n_tokens"]
            )

    size = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("bigint")
    out = rows.withColumn("n_bytes", size).mapInArrow(released(counted), f"_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document by the byte-level vocabulary."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
