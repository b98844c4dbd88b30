"""BPE encoding by speculation, and decoding.

For each new word a greedy longest match proposes tokens.  A row of tokens is the true
encoding exactly if each token alone encodes to itself and every two neighbours encode
together to just these two.  The first holds by construction (only such tokens are
proposed); the second is looked up for all neighbouring pairs of a batch at once in a
table of verdicts, which grows by merging each pair that is met for the first time.  Only
words with a bad pair are merged exactly.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.bpe_tables import LONG_TEXT, SPECIAL, Remembered, vocabulary, words_of
from marginalia.llm.held import released

REMEMBERED = 192 << 20
"""Bytes of encoded words that a worker keeps."""

JUDGED = 1 << 20
"""Judged pairs a worker keeps; beyond that, those of the batch at hand stay (the frequent
ones are among them) and others are judged again when they are met again."""

LISTED = 1 << 16
"""Words of a long text that are encoded together."""

LONG_WORD = 64
"""Longer words are encoded where they stand and not remembered."""


class _Entries(Remembered):
    """Words with (ids as text, their number, decoded)."""

    ENTRY = 370


class Codec:
    """Encodes and decodes words of one vocabulary, remembering what it has met."""

    def __init__(self, path: str, proved: bytes | None = None):
        self.vocabulary = vocabulary(path)
        self.whole = self.vocabulary.whole(proved)
        self.longest = max(map(len, self.whole))
        self.pairs = np.empty(0, np.int64)  # sorted keys of judged pairs
        self.good = np.empty(0, bool)
        self.words = _Entries(REMEMBERED)
        self.merged = self.proposed = 0

    def propose(self, raw: bytes) -> list[int]:
        """Greedy longest match among tokens that encode to themselves."""
        whole, ids, at, n = self.whole, [], 0, len(raw)
        while at < n:
            end = min(n, at + self.longest)
            while (found := whole.get(raw[at:end])) is None:
                end -= 1
            ids.append(found)
            at = end
        return ids

    def _judge(self, keys: np.ndarray) -> np.ndarray:
        """For each pair key whether the two tokens stay apart when encoded together."""
        new = np.unique(keys)
        if len(self.pairs):
            new = new[self.pairs[np.minimum(np.searchsorted(self.pairs, new), len(self.pairs) - 1)] != new]
        if len(new):
            v = self.vocabulary
            verdict = np.empty(len(new), bool)
            for i, key in enumerate(new.tolist()):
                a, b = divmod(key, v.size)
                verdict[i] = v.merge(v.token_bytes[a] + v.token_bytes[b]) == [a, b]
            at = np.searchsorted(self.pairs, new)
            self.pairs, self.good = np.insert(self.pairs, at, new), np.insert(self.good, at, verdict)
        found = np.searchsorted(self.pairs, keys)
        good = self.good[found]
        if len(self.pairs) > JUDGED:
            met = np.unique(found)
            self.pairs, self.good = self.pairs[met], self.good[met]
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word: proposals, one vectorised check of all pairs, repairs."""
        raws = [w.encode() for w in words]
        rows = [self.propose(r) for r in raws]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((i for row in rows for i in row), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(rows)), lengths)
        inside = owner[:-1] == owner[1:]
        keys = (flat[:-1] * self.vocabulary.size + flat[1:])[inside]
        failing = np.unique(owner[:-1][inside][~self._judge(keys)]) if len(keys) else []
        for i in failing:
            rows[i] = self.vocabulary.merge(raws[i])
        self.proposed, self.merged = self.proposed + len(rows), self.merged + len(failing)
        return rows

    def _entry(self, ids: list[int]) -> tuple[str, int, bytes]:
        return ",".join(map(str, ids)), len(ids), b"".join(map(self.vocabulary.token_bytes.__getitem__, ids))

    def learn(self, distinct: set[str]) -> dict[str, tuple[str, int, bytes]]:
        """The entry of each word, new words encoded together."""
        met, new = {}, []
        for w in distinct:
            entry = self.words.get(w) or self.words.recall(w)
            if entry is None:
                new.append(w)
            else:
                met[w] = entry
        for w, ids in zip(new, self.encode_words(new)):
            met[w] = entry = self._entry(ids)
            if len(w) <= LONG_WORD:
                self.words.keep(w, entry, len(entry[0]))
        return met

    def _runs(self, text: str) -> Iterator[tuple[str, int, bytes]]:
        """(ids joined by commas, their number, decoded) of one run of words of a long text
        after the other."""
        special = self._entry([self.vocabulary.special[SPECIAL]])
        for i, part in enumerate(self.vocabulary.parts(text)):
            if i:
                yield special
            words = iter(words_of(part))
            while some := list(islice(words, LISTED)):
                met = self.learn(set(some))
                ids, n, raw = zip(*(met[w] for w in some))
                yield ",".join(ids), sum(n), b"".join(raw)

    def encoded(self, texts: list[str]) -> Iterator[Iterator[tuple[str, int, bytes]]]:
        """Per text the runs of (ids joined by commas, their number, decoded bytes).

        Short texts are learned together and are one run each; a long text gives its runs
        one by one and is never held as a list of words.
        """
        special = self._entry([self.vocabulary.special[SPECIAL]])
        for some in _slices(texts):
            if len(some[0]) > LONG_TEXT:
                yield self._runs(some[0])
                continue
            cut = [[words_of(p) for p in self.vocabulary.parts(t)] for t in some]
            met = self.learn({w for parts in cut for words in parts for w in words})
            for parts in cut:
                found = [met[w] for w in parts[0]]
                for words in parts[1:]:
                    found.append(special)
                    found += [met[w] for w in words]
                if found:
                    ids, n, raw = zip(*found)
                    yield iter([(",".join(ids), sum(n), b"".join(raw))])
                else:
                    yield iter(())

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Per text (number of ids, digest of the ids joined by commas, of the decoded text)."""
        for runs in self.encoded(texts):
            total, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
            decoder = codecs.getincrementaldecoder("utf-8")("replace")
            for joined, n, raw in runs:
                ids.update(f",{joined}".encode() if total else joined.encode())
                decoded.update(decoder.decode(raw).encode())
                total += n
            decoded.update(decoder.decode(b"", True).encode())
            yield total, ids.hexdigest(), decoded.hexdigest()

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        for runs in self.encoded(texts):
            yield [int(x) for joined, _, _ in runs for x in joined.split(",")]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocabulary.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str, proved: bytes | None = None) -> Codec:
    """The worker's codec of a vocabulary file."""
    return _CODECS.get(path) or _CODECS.setdefault(path, Codec(path, proved))


def _slices(texts: list[str], most: int = 4 << 20) -> Iterator[list[str]]:
    """Consecutive texts of a few million characters together; long texts alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > most or len(t) > LONG_TEXT or len(texts[start]) > LONG_TEXT):
            yield texts[start:i]
            start, size = i, 0
        size += len(t)
    if texts:
        yield texts[start:]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and its tokens as ``ids`` (array<int>).

    A null text gives an empty array; ids may be null or repeated.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    proved = vocabulary(path).proved

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, proved)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = list(own.encode_all(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["_id", "ids"])

    return rows.mapInArrow(released(encoded), f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256.

    Each text is encoded whole and decoded again from its tokens.  A null text counts as
    empty (no tokens; the digests are those of the empty string).  Ids may be null or
    repeated; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    proved = vocabulary(path).proved

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, proved)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for n, of_ids, of_text in own.digests([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(n)
                ids.append(of_ids)
                decoded.append(of_text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    out = rows.mapInArrow(released(digested), f"_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_id", id_col)


def op10_bpe_codec(spark, sf_dir: str) -> DataFrame:
    """Every document encoded by the byte-level vocabulary and decoded again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trips(docs, public_tokenizers.path("byte_bpe_50k.json"))
