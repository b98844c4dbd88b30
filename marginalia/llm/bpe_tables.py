"""A byte-level BPE vocabulary as bytes, with exact merging of single words."""

from __future__ import annotations

import heapq
import json
from array import array
from functools import cached_property, lru_cache

import public_tokenizers
import regex

SPECIAL = "<|endoftext|>"
_ID_BITS = 24
_ID = (1 << _ID_BITS) - 1
_NO_MERGE = 1 << 62

WORDS = regex.compile(public_tokenizers.PATTERN)
"""What the byte-level tokenizer cuts a text into before it merges."""


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes: visible Latin-1 stays, the rest moves up from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens by id, ranks of merges, and the ids of texts that are special."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        back = byte_of_char()
        ids = model["model"]["vocab"]
        self.token_bytes: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in ids.items()}
        self.id_of = {b: i for i, b in self.token_bytes.items()}
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]
        self.merges = {
            (ids[a], ids[b]): rank << _ID_BITS | ids[a + b]
            for rank, (a, b) in enumerate(model["model"]["merges"])
        }
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.size = max(self.token_bytes) + 1

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the merge of lowest rank first, leftmost among equals."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > 200:
            return self._merge_long(ids)
        get = self.merges.get
        found = [get(pair, _NO_MERGE) for pair in zip(ids, ids[1:])]
        while found and (best := min(found)) != _NO_MERGE:
            at, new = found.index(best), best & _ID
            ids[at : at + 2] = [new]
            del found[at]
            if at:
                found[at - 1] = get((ids[at - 1], new), _NO_MERGE)
            if at < len(found):
                found[at] = get((new, ids[at + 1]), _NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words of any length."""
        get, n = self.merges.get, len(ids)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := get((ids[i], ids[j]))):
                heapq.heappush(heap, (found, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            found, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = found & _ID, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    @cached_property
    def proved(self) -> bytes:
        """Ids of the tokens whose text encodes alone to exactly this id, proved by merging
        each: done on the driver once per vocabulary file, and sent to the tasks."""
        return array("I", sorted(i for b, i in self.id_of.items() if self.merge(b) == [i])).tobytes()

    def whole(self, proved: bytes | None = None) -> dict[bytes, int]:
        """Texts and ids of the proved tokens."""
        return {self.token_bytes[i]: i for i in array("I", proved or self.proved)}

    def parts(self, text: str) -> list[str]:
        """The text between special tokens."""
        return text.split(SPECIAL) if SPECIAL in self.special else [text]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


LONG_TEXT = 1 << 20
"""Characters beyond which the words of a text are not listed at once."""


def words_of(text: str):
    """The words of a text; long texts give them one by one, without a list of all."""
    if len(text) <= LONG_TEXT:
        return WORDS.findall(text)
    return (m.group() for m in WORDS.finditer(text))


class Remembered(dict):
    """What a worker has computed per word, in two generations of limited size.

    ``limit`` bounds the bytes of both together, counting what Python itself needs for an
    entry.  When the young one is full it becomes the old one; what is met again moves back,
    so frequent words stay while rare ones go.
    """

    ENTRY = 190
    """Bytes of an entry besides its text and value: slots of the table, two object heads."""

    def __init__(self, limit: int):
        self.limit, self.used, self.old = limit // 2, 0, {}

    def keep(self, word: str, value, size: int = 0) -> None:
        """Remember a value that takes ``size`` bytes of its own."""
        if self.used >= self.limit:
            self.old = dict(self)
            self.clear()
            self.used = 0
        self.used += self.ENTRY + len(word) + size
        self[word] = value

    def recall(self, word: str):
        """What the old generation holds of a word, moved to the young one."""
        found = self.old.get(word)
        if found is not None:
            self.keep(word, found, len(found) if isinstance(found, bytes) else 0)
        return found
