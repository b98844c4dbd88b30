import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa

from marginalia.llm import disclosure as d

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and d._luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for letters, n in (("ab@.-@a1é ", 30), ("0129.. -+()4", 40), ("0123456789 -", 60), ("1.2+@a", 25)):
        for _ in range(4000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
            assert d.base_spans(text) == brute(text)
    assert d._luhn("4539578763621486") and not d._luhn("4539578763621487")


def test_long_texts_take_linear_time():
    for text in ("1" * 400_000, "a" * 400_000, "1." * 200_000, "+1 " * 100_000, "a@" * 200_000, "1 " * 200_000):
        assert d.base_spans(text + "!") == d.base_spans(text)


ROWS = [(i, f"filler{i} number {i * 31} Zebediah likes it, mail zed@corp.org daily, thing{i % 5} or other{i}") for i in range(12)]
ROWS += [(i, f"filler{i} plain likes it daily, mail other or thing{i % 5}") for i in range(100, 190)]
ROWS += [(300, "copy of Quibble text q@corp.org here")] + [(301 + k, "copy of Quibble text q@corp.org here") for k in range(6)]


def spans_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_terms_that_reveal_are_marked(documents):
    got = spans_of(d.personal_data(documents(ROWS)))
    assert len(got) == len(ROWS)
    for i, text in ROWS:
        base = d.span_text(brute(text))
        terms = [s for s in got[i].spans.split(",") if s.startswith("term:")]
        words = {text[int(s.split(":")[1]):int(s.split(":")[2])] for s in terms}
        assert got[i].spans.startswith(base) and got[i].n_term == len(terms)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        # Zebediah, "number" and "likes"... occur with the address only; copies prove nothing.
        assert {w.lower() for w in words} == {w for n, w in plainly_disclosing(ROWS) if w in text.lower().split()}
        assert ("Zebediah" in words) == (i < 12) and (i < 300 or not words)


def plainly_disclosing(rows):
    """(entity, term) -> (share, judged), restated word by word over whole texts."""
    groups = {"email": lambda v: v.split("@")[1], "ip": lambda v: ".".join(v.split(".")[:3]),
              "card": lambda v: re.sub("[^0-9]", "", v)[:6], "phone": lambda v: re.sub("[^0-9]", "", v)[:3]}
    n, words, held, lines_of = len(rows), {}, {}, {}
    for i, text in rows:
        found = brute(text)
        free = [m for m in re.finditer("[A-Za-z0-9_\x80-\U0010ffff]+", text) if not any(s < m.end() and m.start() < e for _, s, e in found)]
        words[i] = {"".join(chr(ord(c) + 32 * ("A" <= c <= "Z")) for c in m.group()) for m in free}
        for kind, s, e in found:
            start, end = text.rfind("\n", 0, s) + 1, (text + "\n").find("\n", e)
            line = " ".join(m.group() for m in free if start <= m.start() and m.end() <= end).lower()
            value = text[s:e].lower()
            for name in (f"{kind}:{value}", f"{kind} group:{groups[kind](value)}"):
                held.setdefault(name, set()).add(i)
                lines_of.setdefault((name, i), set()).add(line)
    everywhere = {}
    for i, text in rows:
        for w in set(re.findall("[a-z0-9_\x80-\U0010ffff]+", "".join(chr(ord(c) + 32 * ("A" <= c <= "Z")) for c in text))):
            everywhere[w] = everywhere.get(w, 0) + 1
    out = {}
    for name, docs in held.items():
        if len(docs) == n:
            continue
        information, p = math.log(n / len(docs)), len(docs) / n
        tried = sum(len(words[i]) for i in docs)
        for w in set().union(*(words[i] for i in docs)):
            with_both = [i for i in docs if w in words[i]]
            k = len({frozenset(lines_of[name, i]) for i in with_both})
            share = math.log(len(with_both) * n / (len(docs) * everywhere[w])) / information
            judged = share + math.log((k - 1 + p) / k) / information
            if judged >= d.GENERALISE and (k - 1) * information > math.log(tried):
                out[name, w] = share, judged
    return out


def noisy(n, seed):
    rng = random.Random(seed)
    some = [f"w{i}" for i in range(60)] + ["Éclair", "x_1"]
    people = [("Ann", "ann@a.org"), ("Bob", "bob@b.net"), ("Cy", "+49 (170) 555-1234"), ("Di", "10.1.2.3"), ("Ed", "10.1.2.77"), ("Flo", "flo@b.net")]
    rows = []
    for i in range(n):
        text = [rng.choice(some) for _ in range(rng.randint(3, 25))]
        if rng.random() < 0.25:
            who, value = rng.choice(people)
            for word in (who, value, rng.choice(["\n", "and", value])):
                text.insert(rng.randint(0, len(text)), word)
        rows.append((i, " ".join(text)))
    return rows + [(n + k, "list ann@a.org bob@b.net flo@b.net zoe@q.org yan@q.org end") for k in range(9)]


def test_against_brute_force_information(documents):
    """Share and judgement of every pair, on texts with clear and with accidental terms."""
    for rows in (ROWS, noisy(400, 1), noisy(900, 2)):
        docs = documents(rows)
        got = {(r.e, r.t): (r.share, r.judged) for r in d.disclosing(docs, "text", d.find(docs, "doc_id", "text")).collect()}
        want = plainly_disclosing(rows)
        assert want and any("group" in name for name, _ in want)
        term = lambda w: d._signed(d.hashed(*d.spans(w.encode())))[0]
        by = {}
        for (name, w), values in want.items():
            by.setdefault((values, term(w)), set()).add(d._digest(name))
        for (e, t), values in got.items():  # one entity stands for those with the same documents
            assert any(e in names and t == t2 and abs(v[0] - values[0]) < 1e-9 and abs(v[1] - values[1]) < 1e-9 for (v, t2), names in by.items())
        assert {t for _, t in got} == {term(w) for _, w in want}


def test_many_addresses_take_linear_time():
    import time

    text = " and ".join(f"person{i} p{i}@corp{i % 7}.org" for i in range(4000))
    start = time.perf_counter()
    found = d.entities(text, d.base_spans(text))
    assert len(found) == 4007 and len({x["c"] for x in found}) == 1 and time.perf_counter() - start < 0.5
    lines = text.replace(" and ", "\n")
    assert len({x["c"] for x in d.entities(lines, d.base_spans(lines))}) == 4007


def test_sanitising(documents, spark):
    docs = documents(ROWS + [(500, None), (None, "call +1 (555) 123-4567 now")])
    out = d.sanitise_documents(spark, docs, "")
    assert out.columns == docs.columns
    texts = {r.doc_id: r for r in out.collect()}
    assert "zed@corp.org" not in texts[0].text and "Zebediah" not in texts[0].text and "[EMAIL]" in texts[0].text
    assert texts[150].text == dict(ROWS)[150] and texts[500].text is None and texts[0].n_chars == len(texts[0].text)
    assert texts[None].text == "call [PHONE] now" and "Quibble" in texts[300].text
    assert d.sanitised("ab 12 Cd", [(0, 2, 0.9), (3, 5, 0.9), (6, 8, 0.99)]) == "[WORD] [NUMBER] "


def test_odd_rows(documents):
    rows = [(1, None), (2, ""), (None, "a@b.cc"), (3, "a@b.cc"), (3, "a@b.cc"), (4, "é 😀 1.2.3.4")]
    got = d.personal_data(documents(rows)).collect()
    assert len(got) == 6 and sorted(r.spans for r in got) == ["", ""] + ["email:0:6"] * 3 + ["ip:4:11"]
    assert d.personal_data(documents([])).count() == 0


def test_entities_met_twice_are_judged(documents):
    """Two different contexts are enough; one context, however often copied, is none."""
    rows = [(i, f"plain{i} words about thing{i % 7} and nothing else") for i in range(200)]
    rows += [(300, "ask Wilhelmina about it: wil@corp.org answers first300"), (301, "then Wilhelmina wrote from wil@corp.org second301")]
    rows += [(400 + k, "only Quibble here: q@corp.org rare400") for k in range(9)]
    got = spans_of(d.personal_data(documents(rows)))
    text = dict(rows)
    words = {i: {text[i][int(s.split(":")[1]):int(s.split(":")[2])] for s in r.spans.split(",") if s.startswith("term:")} for i, r in got.items()}
    assert words[300] == words[301] == {"Wilhelmina"}
    assert not any(w for i, w in words.items() if i not in (300, 301))


def test_terms_are_counted_and_marked_everywhere(documents, spark):
    """Far from the entity and in documents without it, a revealing term is marked too."""
    gap = " so it goes on" * 200
    rows = [(i, f"plain{i} words about thing{i % 7} and nothing else") for i in range(200)]
    rows += [(300 + k, f"é😀 Zebediah wrote a{k} from zed@corp.org today{gap} and Zebediah, again ZEBEDIAH b{k}") for k in range(5)]
    # Here term and entity are too far apart to nominate, but they meet in the document.
    rows += [(400 + k, f"Zebediah came c{k}{gap} see d{k} zed@corp.org there") for k in range(5)]
    rows += [(500, "nobody but Zebediah knows; zebediah@corp.org is no term")]
    docs = documents(rows)
    got, text = spans_of(d.personal_data(docs)), dict(rows)
    for i in [*range(300, 305), *range(400, 405), 500]:
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer("zebediah(?!@)", text[i], re.I)]
        assert set(want) <= set(got[i].spans.split(",")), i
    assert got[500].n_term == 1 and all(got[i].n_term == 0 for i in range(200))
    clean = {r.doc_id: r.text for r in d.sanitise(docs).collect()}
    assert not any("zebediah" in t.lower() for i, t in clean.items() if i >= 300)
    found = d.find(docs, "doc_id", "text")
    term = d._signed(d.hashed(*d.spans(b"zebediah")))[0]
    shares = {r.e: r.share for r in d.disclosing(docs, "text", found).collect() if r.t == term}
    assert abs(shares[d._digest("email:zed@corp.org")] - math.log(10 * 211 / (10 * 11)) / math.log(211 / 10)) < 1e-9


def test_sanitising_writes_no_row_without_personal_data(documents, monkeypatch):
    """Only entities of the rows that hold some are kept, not a table of all rows searched."""
    rows = [(i, f"plain{i} words about thing{i % 7} and nothing else") for i in range(200)]
    rows += [(300 + k, f"ask Wilhelmina first{k} at wil@corp.org") for k in range(3)]
    kept, stored = {}, d.stored

    def counted(df, name):
        out = stored(df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(d, "stored", counted)
    clean = {r.doc_id: r.text for r in d.sanitise(documents(rows)).collect()}
    assert len(clean) == 203 and all(clean[i] == t for i, t in rows if i < 300)
    assert not any("wil@corp.org" in t for t in clean.values())
    assert kept["disclosure-held"] == 6 and max(kept.values()) < 200


def test_a_bit_map_lets_few_other_words_through(spark):
    """However many terms it holds: all words of all texts are held against it."""
    rng = np.random.default_rng(5)
    others = rng.integers(0, 1 << 64, 200_000, np.uint64)
    for n in (0, 1, 3000, 60_000):
        terms = rng.integers(0, 1 << 64, n, np.uint64)
        wanted = d.mapped(d.bit_map(spark.createDataFrame(pa.table({"t": pa.array(terms.view(np.int64))}))))
        assert wanted(terms).all() and wanted(others).sum() < 200_000 / 200
