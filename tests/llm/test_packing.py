import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from marginalia.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_patterns_place_everything():
    rng = random.Random(1)
    for room, n in ((512, 3000), (64, 500), (16, 40), (8, 3)):
        demand = Counter(min(room, max(1, int(rng.expovariate(4 / room)))) for _ in range(n))
        found = packing.patterns_for(demand, room)
        placed = Counter()
        for times, pattern in found:
            assert times > 0 and sum(c * a for c, a in pattern.items()) <= room
            for c, a in pattern.items():
                placed[c] += times * a
        assert placed == demand
        least = -(-sum(c * a for c, a in demand.items()) // room)
        assert sum(t for t, _ in found) <= 1.05 * least + 2


def test_linear_program_reaches_a_known_optimum():
    # 100 pieces each of 6 and 4, 200 of 5: 200 sequences of 10 without any loss.
    found = packing.patterns_for({6: 100, 4: 100, 5: 200}, 10)
    assert sum(times for times, _ in found) == 200


def check(rows, got, sequence):
    want = {}
    for i, t in rows:
        ids = np.frombuffer(packing.token_ids(t or "", PATH), "<u4").tolist() + [packing.END_ID]
        want.setdefault(i, []).append(ids)
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == want.keys()
    for i, docs in want.items():
        pieces = Counter()
        for ids in docs:
            for s in range(0, len(ids), sequence):
                part = ids[s : s + sequence]
                pieces[(s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))] += 1
        assert Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[i]) == pieces
    for some in by_seq.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= sequence
    return sum(r.length for r in got) / (sequence * len(by_seq))


def test_documents_are_packed_whole(documents):
    rng = random.Random(5)
    rows = [(i, "some words of text here " * rng.randint(0, 60)) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (1002, "long one " * 30_000), (1003, "twice"), (1003, "twice")]
    rows += [(2000 + i, "the same text again") for i in range(200)]
    got = packing.pack(documents(rows), PATH, sequence=256).collect()
    assert check(rows, got, 256) > 0.93


def test_empty(documents):
    assert packing.pack(documents([]), PATH).count() == 0


def test_padding_of_the_test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = packing.pack(docs, PATH).collect()
    assert check([(r.doc_id, r.text) for r in docs.collect()], got, 4096) > 0.9
