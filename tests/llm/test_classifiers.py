import zlib

from marginalia.llm import language_id, toxicity


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language_id.identify(docs).collect()
    assert len(got) == len(true)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    kept = language_id.keep_identified(spark, docs, sf_dir)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * len(true)


def odd_documents(documents):
    words = {"xx": "the and of that with", "yy": "der und von mit ist"}
    rows = [(i, f"{words[lang]} " * (1 + i % 4), lang) for i in range(60) for lang in ("xx", "yy")]
    return documents(rows + [(None, "the and of", "xx"), (900, None, "xx"), (901, "", None), (902, "12 34 !!", "yy"),
                             (903, "der und von " * 60_000, None), (903, "der und", None)])


def test_language_of_odd_rows(documents):
    got = language_id.identify(odd_documents(documents)).collect()
    assert len(got) == 126
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.lang_pred for r in by[900] + by[901] + by[902]] == ["und"] * 3
    assert {r.lang_pred for r in by[903]} == {"yy"} and by[None][0].lang_pred == "xx" and by[None][0].held_out is False
    assert language_id.identify(documents([])).count() == 0
    assert [r.lang_pred for r in language_id.identify(documents([(1, "abc")])).collect()] == ["und"]


def test_gibberish_is_rejected(documents, spark):
    docs = odd_documents(documents).unionByName(documents([(999, "ЩЖЪ ЫЭЮ ЙЦУКЕН ФЫВА", None)]))
    kept = {r.doc_id for r in language_id.keep_identified(spark, docs, "").collect()}
    assert 999 not in kept and 900 not in kept and set(range(60)) <= kept and 903 in kept


def labels(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, score string")


def test_toxicity_finds_misspelt_words(documents, spark):
    # Ten roots in ordinary texts; the test sees endings that training did not.
    rows, marks = [], []
    for i in range(600):
        text = " ".join(f"w{(i * 7 + k * 13) % 97}a e{(i + k * k) % 53}n" for k in range(30))
        if i % 3 == 0:
            text += f" zorgl{'abcdefghijkl'[i % 12]}{'xyz'[i // 12 % 3]} " + text[:200]
        rows.append((i, text))
        marks.append((i, 1, int(i % 3 == 0)))
    docs = documents(rows)
    got = toxicity.score(docs, labels(spark, marks)).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    right = sum(r.predicted == int(r.doc_id % 3 == 0) for r in held)
    assert right >= 0.97 * len(held)
    model = toxicity.train([t for _, t in rows], [m[2] for m in marks])
    bad, good = model.scores(["plain words and zorglqq here", "plain words and nothing here"])
    assert bad > 0.3 > good


def test_toxicity_of_odd_rows(documents, spark):
    rows = [(None, "a zorg b"), (1, None), (2, ""), (3, "!!"), (4, "fine words here"), (5, "zorg " * 300_000), (5, "zorg"), (6, "zorg it"), (8, "calm")]
    marks = [(4, 1, 0), (5, 1, 1), (6, 0, 1), (8, None, 0), (8, 1, None), (None, 1, 1), (4, 1, 0)]
    got = toxicity.score(documents(rows), labels(spark, marks)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert [r.score for r in got if r.doc_id in (1, 2, 3)] == [0.0] * 3
    assert toxicity.score(documents([]), labels(spark, marks)).count() == 0
    assert {r.predicted for r in toxicity.score(documents(rows), labels(spark, [])).collect()} == {0}
    assert toxicity.score(documents(rows), labels(spark, [(4, 1, 1)])).count() == len(rows)
    assert toxicity.train(["!!", ""], [0, 1]).scores(["some words", ""])[0] < 0.1


def test_windows_run_over_the_parts_of_long_texts():
    weights = toxicity.train(["bad zorg", "fine day"] * 20, [1, 0] * 20).weights
    text = "fine day " * 130_000 + "zorg zorg zorg zorg " + "fine day " * 20
    whole, alone = toxicity.text_logits([text], weights)[0], toxicity.text_logits(["zorg zorg zorg zorg"], weights)[0]
    assert abs(whole - alone) < 1e-6


def test_unknown_languages_and_long_gibberish_are_rejected(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in docs.select("doc_id", "text", "lang").collect() if r.text and len(r.text) > 300]
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (300, 1000, 4000, 20_000, 100_000) for _ in range(20)]
    rate = lambda model, texts: sum(model.predict(t)[2] for t in texts) / len(texts)
    got = {}
    for out in ("en", "fr", "de"):
        model = language_id.fit(docs.filter(language_id.training_rows(docs) & (F.col("lang") != out)))
        known = [r.text for r in rows if r.lang != out and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
        got[out] = rate(model, [r.text for r in rows if r.lang == out]), rate(model, noise), rate(model, known)
    assert all(unknown >= 0.8 and gibberish >= 0.99 and clean <= 0.03 for unknown, gibberish, clean in got.values()), got


def test_parts_of_long_texts_lose_no_ngram(monkeypatch):
    text = "  Ab cdé 12 -- F ghi" * 40 + "ß!"
    whole = language_id.counts(text)
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(language_id, "_CHUNK", size)
        assert (language_id.counts(text) == whole).all()


def plain_language(text, model):
    """The prediction restated letter by letter."""
    import math

    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    stream = " "
    for i, c in enumerate(text.lower()):
        if c.isalpha():
            stream += c
        elif not i or text.lower()[i - 1].isalpha():
            stream += " "
    stream += " "
    tf, mask = {}, (1 << 32) - 1
    for n in (1, 2, 3):
        for i in range(len(stream) - n + 1):
            h = ord(stream[i]) * 0x9E3779B1 & mask
            for k in range(1, n):
                h = (h ^ (ord(stream[i + k]) + k)) * 0x85EBCA6B & mask
                h ^= h >> 13
            slot = (h * 0xC2B2AE35 & mask) >> 20
            tf[slot] = tf.get(slot, 0) + 1
    v = {s: (1 + math.log(n)) * model.idf[s] for s, n in tf.items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    near = [sum(x * c[s] for s, x in v.items()) / size for c in model.centroids]
    best = max(range(len(near)), key=lambda i: near[i])
    at = min(max(math.log2(len(v)) - 0.5, 0), language_id.BINS - 1)
    low = min(int(at), language_id.BINS - 2)
    floor = model.floors[best][low] + (at - low) * (model.floors[best][low + 1] - model.floors[best][low])
    return model.languages[best], min(1.0, max(0.0, near[best])), near[best] < floor


def test_predictions_equal_a_plain_restatement(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs.filter(language_id.training_rows(docs)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in language_id.identify(docs).collect():
        lang, score, rejected = plain_language(texts[r.doc_id], model)
        assert (r.lang_pred, r.rejected) == (lang, rejected) and abs(r.score - score) < 1e-6


def test_floors_follow_the_number_of_texts():
    own = {"a": [0.6] * 3, "b": [0.2] * 3}
    few = [language_id.shrunk(own, {"a": n, "b": 10_000})["a"][0] for n in (1, 10, 49, 50, 51, 1000, 100_000)]
    assert few == sorted(few) and few[0] < 0.22 and few[-1] > 0.59 and few[4] - few[2] < 0.01
    assert language_id.shrunk({"a": [0.6]}, {"a": 1})["a"][0] < 0.13
