import hashlib
import random
import subprocess
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marginalia.llm import bpe_codec, packing, token_counts
from marginalia.llm.bpe_tables import vocabulary

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LETTERS = "abcdefghijklmnop ABCD 0123 \n\t\r\x1c\x85\xa0　éßñüΣ'sdmtl,.!?-<|>②Ⅷ½中文字한글́​😀🏽"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def texts(n, seed):
    rng = random.Random(seed)
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return out + [t + "<|endoftext|>" + t[:4] + "<|endoftext|>" for t in out[:50]] + ["a" * 4000, " " * 900, "ab" * 700 + "é" * 99]


def test_codec_equals_the_library(library):
    codec = bpe_codec.codec(BYTES)
    for text in texts(1200, 1):
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert token_counts.count_tokens(text, BYTES) == len(ids)
    assert 0 < codec.merged < codec.proposed  # both ways were taken


def test_whole_tokens_are_proved(library):
    v = vocabulary(BYTES)
    assert v.whole(v.proved) == v.whole()
    for raw in random.Random(2).sample(sorted(v.whole()), 300):
        assert v.merge(raw) == [v.id_of[raw]]


def test_long_words_merge_alike():
    v = vocabulary(BYTES)
    rng = random.Random(4)
    for _ in range(30):
        word = bytes(rng.choice(b"thean ing") for _ in range(rng.randint(2, 190)))
        ids = [v.byte_ids[b] for b in word]
        assert v.merge(word) == v._merge_long(ids)


def test_stores_that_overflow_stay_right(library, monkeypatch):
    codec = bpe_codec.Codec(BYTES)
    codec.words.limit = 4000
    monkeypatch.setattr(bpe_codec, "JUDGED", 50)
    for text in texts(80, 9):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(codec.words) + len(codec.words.old) < 60 and len(codec.pairs) < 2000


def test_long_texts_are_encoded_in_runs(library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe_codec, "LISTED", 7)
    monkeypatch.setattr(packing, "RUN", 90)
    codec, words = bpe_codec.Codec(BYTES), Tokenizer.from_file(WORDS)
    some = [a + " " + b + "\n" + a * 3 for a, b in zip(texts(150, 11), texts(150, 12))] + ["é" * 500, "", "x" * 300 + " y"]
    for text, (n, of_ids, of_text) in zip(some, codec.digests(some)):
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert n == len(ids) and codec.encode(text) == ids
        assert of_ids == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert of_text == hashlib.sha256(decoded.encode()).hexdigest()
        raw = packing.token_ids(text, WORDS)
        got = [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]
        assert got == words.encode(text, add_special_tokens=False).ids


def test_a_long_text_needs_little_memory():
    code = f"""
import resource, random, sys
from marginalia.llm import bpe_codec, packing
rng = random.Random(1)
some = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(200_000)]
text = " ".join(rng.choice(some) for _ in range(5_000_000))
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
codec, words = bpe_codec.codec({BYTES!r}), packing.words({WORDS!r})
before = peak()
codec_peak = list(codec.digests([text]))[0][0] and peak()
n = sum(len(p) for p in packing._pieces(words.runs(text), 4096))
print(len(text), codec_peak - before, peak() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 30e6 and float(out[1]) < 300 and float(out[2]) < 300


def test_word_vocabulary_equals_the_library():
    library, some = Tokenizer.from_file(WORDS), texts(800, 3)
    ends = [library.encode(t, add_special_tokens=False).ids for t in some]
    got = [packing.token_ids(t, WORDS) for t in some]
    assert [[int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)] for b in got] == ends


ROWS = [(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (None, "x <|endoftext|> y"), (4, "word " * 60_000)]


def test_tables(documents, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len((t or "").encode()), len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    counted = token_counts.token_counts(documents(ROWS), BYTES).collect()
    assert sorted([tuple(r) for r in counted], key=repr) == sorted([(i, b, n, n > 512) for i, b, n, _, _ in want], key=repr)
    tripped = bpe_codec.round_trips(documents(ROWS), BYTES).collect()
    assert sorted([tuple(r) for r in tripped], key=repr) == sorted([(i, n, a, d) for i, _, n, a, d in want], key=repr)
    encoded = bpe_codec.encode_documents(documents(ROWS[:4]), BYTES).collect()
    assert [r.ids for r in encoded if r.doc_id == 2] == [[]]
    for empty in (token_counts.token_counts, bpe_codec.round_trips):
        assert empty(documents([]), BYTES).count() == 0
