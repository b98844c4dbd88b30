"""Packing of documents into fixed sequences by cutting-stock column generation.

Documents longer than a sequence give whole sequences and one rest.  The rests are
counted by length class (a histogram of fixed size).  A linear program asks how often each
pattern of classes should fill a sequence; its columns are generated: a knapsack dynamic
program finds the pattern of greatest value at the current prices, until none improves.
The solution is rounded down, what is left of the demand is placed by first fit on the
classes, and the patterns' slots are given to the pieces of each class by their rank.

Only the histogram and the patterns pass through the driver.  Pieces are numbered by
(task, class) while they are cut; starts of the tasks make the ranks global, so no class is
ever sorted in one task.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.bpe_tables import Remembered, byte_of_char
from marginalia.llm.held import released
from marginalia.operators.durable import stored

SEQUENCE = 4096
CLASS_WIDTH = 8
"""Lengths are rounded up to multiples of this when patterns are made."""

END_ID = 2
REMEMBERED = 64 << 20
"""Bytes of encoded words that a worker keeps, and a quarter of that for words of texts
beyond Latin-1."""

POINTS = 1 << 20
"""Bytes of encoded runs of symbols that it keeps."""

RUN = 1 << 18
"""Characters of a text that are cut into words together."""

LONG_WORD = 64
"""Longer words are encoded where they stand and not remembered."""


# ---- tokens

# Letters of Latin-1 and symbols behind them.  An apostrophe can belong to what follows it.
_STEM = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
# Texts of Latin-1 without rare blanks and controls are lower-cased and cut here, as the
# vocabulary's own rules do: its contractions, runs of letters, single digits, other runs.
_ODD = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\xa0]|[^\x00-\xff]")
_CUT = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    r"|[^\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
)
_STAND_INS = {b: c for c, b in byte_of_char().items()}


class _Cut(Remembered):
    """Ids of what the vocabulary's own rules cut: words of the tokenizer's model."""

    def __init__(self, encode):
        super().__init__(REMEMBERED)
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        found = self.recall(word)
        if found is None:
            found = self.encode(word)
            if len(word) <= LONG_WORD:
                self.keep(word, found, len(found))
        return found


class _Words(Remembered):
    """Ids of blank-separated words as little-endian bytes, encoded by the tokenizer."""

    def __init__(self, path: str):
        super().__init__(REMEMBERED // 4)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer  # loaded by workers only

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.points = Remembered(POINTS)
        self.cut = _Cut(self._part)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _encoded(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a run of lower-case letters or of symbols: a word of the tokenizer's model."""
        units = part if part.isascii() else part.encode().decode("latin-1").translate(_STAND_INS)
        return array("I", [t.id for t in self.model.tokenize(units)]).tobytes()

    def _points(self, run: str) -> bytes:
        found = self.points.get(run) or self.points.recall(run)
        if found is None:
            found = self._part(run)
            self.points.keep(run, found, len(found))
        return found

    def __missing__(self, word: str) -> bytes:
        """Latin letters, with symbols behind them or without, are lower-cased and go to the
        model directly; all other words take the tokenizer's whole way."""
        if len(word) > LONG_WORD:
            return self._encoded(word)
        found = self.recall(word)
        if found is None:
            plain = _STEM.fullmatch(word)
            if plain is None:
                found = self._encoded(word)
            elif (stem := plain[1].lower()) == word:
                found = self._part(word)
            else:
                found = self[stem] + (self._points(plain[2]) if plain[2] else b"")
            self.keep(word, found, len(found))
        return found

    def runs(self, text: str) -> Iterator[bytes]:
        """The ids of a text, one run of whole words after the other.

        The vocabulary drops white space before it cuts words, so the words between
        blanks are encoded apart.
        """
        start = 0
        while len(text) - start > RUN:
            end = max(text.rfind(" ", start, start + RUN), text.rfind("\n", start, start + RUN))
            if end < 0:  # a word longer than a run
                ends = [e for e in (text.find(" ", start + RUN), text.find("\n", start + RUN)) if e >= 0]
                end = min(ends, default=len(text))
            yield self._ids(text[start:end])
            start = end + 1
        yield self._ids(text[start:])

    def _ids(self, text: str) -> bytes:
        if not _ODD.search(text) and not any(s in text for s in self.special):
            return b"".join(map(self.cut.__getitem__, _CUT.findall(text.lower())))
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_WORDS: dict[str, _Words] = {}


def words(path: str) -> _Words:
    """The worker's encoder of a vocabulary file."""
    return _WORDS.get(path) or _WORDS.setdefault(path, _Words(path))


def token_ids(text: str, path: str) -> bytes:
    """Ids of a text (little-endian unsigned 32-bit)."""
    return b"".join(words(path).runs(text))


def _pieces(runs: Iterator[bytes], sequence: int) -> Iterator[bytes]:
    """The same bytes in pieces of ``sequence`` ids, the last one shorter."""
    held, most = b"", 4 * sequence
    for run in runs:
        held += run
        whole = len(held) - len(held) % most
        for at in range(0, whole, most):
            yield held[at : at + most]
        held = held[whole:]
    if held:
        yield held


# ---- the cutting-stock problem on classes

def _knapsack(values: np.ndarray, sizes: np.ndarray, room: int, most: int = 40) -> list[np.ndarray]:
    """Patterns of the greatest value within the room, best first: how many of each size.

    One pattern is the optimum; the others are the optimum among those with a given size.
    """
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        best[r] = best[r - 1]
        fits = np.searchsorted(sizes, r, side="right")
        if fits:
            total = best[r - sizes[:fits]] + values[:fits]
            i = int(np.argmax(total))
            if total[i] > best[r] + 1e-12:
                best[r], pick[r] = total[i], i
    found: dict[bytes, np.ndarray] = {}
    for first in np.argsort(-(values + best[room - sizes]), kind="stable")[:most].tolist():
        counts, r = np.zeros(len(sizes), np.int64), int(room - sizes[first])
        counts[first] = 1
        while r > 0:
            if pick[r] < 0:
                r -= 1
            else:
                counts[pick[r]] += 1
                r -= int(sizes[pick[r]])
        found.setdefault(counts.tobytes(), counts)
    return list(found.values())


def _best_fit(demand: dict[int, int], room: int) -> list[dict[int, int]]:
    """Patterns that place the pieces one by one, largest first, each into the open
    sequence with the least room that takes it."""
    open_by_room: list[list[dict[int, int]]] = [[] for _ in range(room + 1)]
    for size, n in sorted(demand.items(), reverse=True):
        for _ in range(n):
            free = next((r for r in range(size, room) if open_by_room[r]), room)
            pattern = open_by_room[free].pop() if open_by_room[free] else {}
            pattern[size] = pattern.get(size, 0) + 1
            open_by_room[free - size].append(pattern)
    return [p for some in open_by_room for p in some]


SEED_PIECES = 4000
"""Pieces of the scaled-down problem whose best-fit patterns seed the linear program."""


def patterns_for(demand: dict[int, int], room: int, rounds: int = 120) -> list[tuple[int, dict[int, int]]]:
    """[(times, {class: pieces per sequence})] that together place all demanded pieces.

    ``demand`` counts pieces per class (size in units); no pattern exceeds the room.  The
    linear program starts from patterns of one class each, takes in those of best fit on
    a scaled-down demand, and then generates its own columns; it is feasible after any
    number of rounds, so ``rounds`` limits its time, not its validity.
    """
    sizes = np.array(sorted(c for c, n in demand.items() if n), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], np.float64)
    m = len(sizes)
    columns = [np.eye(1, m, i, dtype=np.int64)[0] * (room // sizes[i]) for i in range(m)]
    inverse = np.diag(1.0 / (room // sizes))
    amount = inverse @ need
    prices = inverse.sum(axis=0)

    def enter(column: np.ndarray) -> bool:
        """Take a pattern into the basis if it gains at the prices of now."""
        nonlocal inverse, amount, prices
        if prices @ column <= 1 + 1e-6:
            return False
        step = inverse @ column
        usable = step > 1e-9
        ratio = np.full(m, np.inf)
        ratio[usable] = amount[usable] / step[usable]
        leave = int(np.argmin(ratio))
        if not usable[leave]:
            return False
        amount -= ratio[leave] * step
        amount[leave] = ratio[leave]
        amount = np.maximum(amount, 0)
        pivot = inverse[leave] / step[leave]
        inverse -= np.outer(step, pivot)
        inverse[leave] = pivot
        columns[leave] = column
        prices = inverse.sum(axis=0)
        return True

    scaled = np.ceil(need * min(1.0, SEED_PIECES / need.sum())).astype(np.int64)
    place = {int(s): i for i, s in enumerate(sizes)}
    seeds: dict[bytes, np.ndarray] = {}
    for pattern in _best_fit(dict(zip(sizes.tolist(), scaled.tolist())), room):
        column = np.zeros(m, np.int64)
        for s, n in pattern.items():
            column[place[s]] = n
        seeds.setdefault(column.tobytes(), column)
    for _ in range(4):
        if not sum(enter(column) for column in seeds.values()):
            break
    for _ in range(rounds):
        if not sum(enter(column) for column in _knapsack(prices, sizes, room)):
            break
    times = np.floor(amount + 1e-9).astype(np.int64)
    left = need.astype(np.int64)
    made = []
    for n, column in sorted(zip(times.tolist(), columns), key=lambda x: -x[0]):
        # Rounding errors must never place more pieces than there are.
        used = column > 0
        n = min([n, *(left[used] // column[used]).tolist()])
        if n > 0:
            left -= n * column
            made.append((n, {int(s): int(a) for s, a in zip(sizes[used], column[used])}))
    return made + [(1, p) for p in _best_fit(dict(zip(sizes.tolist(), left.tolist())), room)]


def slots_by_class(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per class the rows (first rank, first sequence, pieces per sequence) of its patterns."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, pattern in patterns:
        for c, per in pattern.items():
            rows.setdefault(c, []).append((taken.get(c, 0), sequence, per))
            taken[c] = taken.get(c, 0) + times * per
        sequence += times
    return {c: np.array(r, np.int64) for c, r in rows.items()}


# ---- the operator

def cut(docs: DataFrame, path: str, sequence: int = SEQUENCE, id_col: str = "doc_id",
        text_col: str = "text") -> DataFrame:
    """Pieces of all documents: _id, start, length, ids_crc32, doc_tokens, _class, _task, _nth."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()
    names = ["_row", "start", "length", "ids_crc32", "doc_tokens", "_class", "_nth"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, own = TaskContext.get().partitionId(), {}, words(path)
        for batch in batches:
            out, texts = [], batch.column(1)
            for i in range(batch.num_rows):
                found = [(len(p) // 4, zlib.crc32(p)) for p in _pieces(chain(own.runs(texts[i].as_py() or ""), [end]), sequence)]
                n, start = sum(length for length, _ in found), 0
                for length, crc in found:
                    c = -(-length // CLASS_WIDTH) if length < sequence else 0  # 0: a whole sequence
                    nth[c] = nth.get(c, -1) + 1
                    out.append((i, start, length, crc, n, c, nth[c]))
                    start += length
            if out:
                data = dict(zip(names, map(np.array, zip(*out))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(data["_row"])), *(pa.array(data[x], pa.int64()) for x in names[1:]),
                     pa.array(np.full(len(out), task), pa.int64())],
                    ["_id", *names[1:], "_task"],
                )

    schema = f"_id {kind}, " + ", ".join(f"{x} bigint" for x in names[1:]) + ", _task bigint"
    return rows.mapInArrow(released(pieces), schema)


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty: its document is the end id alone.  Ids may be null or
    repeated, each row is packed on its own.  Offsets of a sequence are gapless from 0 and
    its lengths sum to at most ``sequence``.  Other columns are not read; an empty table
    gives no rows.
    """
    pieces = stored(cut(docs, path, sequence, id_col, text_col), "pack-pieces")
    counts = stored(pieces.groupBy("_class", "_task").agg(F.count(F.lit(1)).alias("_n")), "pack-counts")
    totals = {r["_class"]: r["n"] for r in counts.groupBy("_class").agg(F.sum("_n").alias("n")).collect()}
    whole = totals.pop(0, 0)
    found = patterns_for(totals, sequence // CLASS_WIDTH)
    slots = slots_by_class(found)
    before = Window.partitionBy("_class").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_class", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = r.copy()  # whole sequences are numbered first, by their rank
            for one in np.unique(c):
                if one:
                    mine = c == one
                    first, seq, per = slots[int(one)].T
                    at = np.searchsorted(first, r[mine], side="right") - 1
                    out[mine] = whole + seq[at] + (r[mine] - first[at]) // per[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "sequence_id"])

    placed = pieces.join(starts, ["_class", "_task"]).select(
        "_class", (F.col("_first") + F.col("_nth")).alias("_rank"), "_id", "start", "length", "ids_crc32", "doc_tokens"
    )
    kind = placed.schema["_id"].dataType.simpleString()
    numbered = placed.mapInArrow(
        sequences, f"_class bigint, _rank bigint, _id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint"
    )
    earlier = (
        Window.partitionBy("sequence_id").orderBy(F.col("_class").desc(), "_rank")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return numbered.select(
        F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("bigint").alias("offset"),
    )


def pack_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
