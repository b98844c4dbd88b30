"""Personal data, and the terms that give it away.

Base spans (email, ip, card, phone) are found by pattern.  Each distinct value is a
protected entity, and so is the group it belongs to (mail domain, network, card issuer,
dial prefix).  How strongly a term reveals an entity is its pointwise mutual information
with it over all documents, as a share of the entity's own information:
log(n_et N / (n_e n_t)) / log(N / n_e).  It is 1 for a term that occurs with the entity
only.  Terms at or above ``GENERALISE`` are replaced by their kind, those at or above
``REMOVE`` are removed, wherever they stand in any document.

All words of all documents that hold an entity are judged, by whole documents.  A pair's
share is uncertain where it was met in few different contexts (the words of the lines in
which the entity stands), so it is judged smoothed: one of its k contexts is no evidence,
and the entity's own rate p = n_e / N stands in as one context of prior, which takes
log(k / (k - 1 + p)) / log(1 / p) off the share.  A pair of one context keeps nothing, so
copies of one text prove nothing.  And because all words are tried, the k - 1 meetings must
be less likely than one accident among the ``w`` words tried with the entity:
(k - 1) log(1 / p) > log(w).

Words that always stand in the same documents are counted as one, and so are entities with
the same documents and contexts: a list of a thousand addresses, copied a hundred times, is
one entity with one word for the counts.  Passes over all texts count and mark only what
can still be a term; tasks get a bit map that tells which words these are, and what it lets
through in error falls out at the join.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.held import released
from marginalia.llm.words import batched_words, hashed, pieces, spans
from marginalia.operators.durable import stored
from marginalia.llm.one_row import row_key
from marginalia.operators.joins import lookup_join, skew_join

KINDS = ("email", "ip", "card", "phone")
GENERALISE, REMOVE = 0.8, 0.95
CONTEXTS = 1
"""Contexts of a pair that are no evidence: the one in which the term was met at all."""

TERM_BITS, LEAST_BITS, MOST_BITS = 256, 16, 28
"""Sizes of bit maps: so many bits for each term in them, within these powers of two (32 MB
at most; a fuller map lets more words through to the join, and loses none).  All words of
all texts are held against a map, so what it lets through in error must be few of them."""

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A leftmost address starts where its digits start, so later starts need no try.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile("[A-Za-z0-9_\x80-\U0010ffff]+")


def _emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            found.append((start, last))
        at = text.find("@", max(at + 1, last))
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of personal data by pattern, by kind and start."""
    found = [("email", *s) for s in _emails(text)]
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append(("phone", *m.span()))
    return found


def span_text(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def _signed(hashes: np.ndarray) -> list[int]:
    return hashes.view(np.int64).tolist()


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def group_of(kind: str, value: str) -> str:
    """The group a value belongs to: mail domain, /24 network, card issuer, dial prefix."""
    if kind == "email":
        return value.rsplit("@", 1)[1]
    if kind == "ip":
        return value.rsplit(".", 1)[0]
    digits = re.sub("[^0-9]", "", value)
    return digits[:6] if kind == "card" else digits[:3]


def entities(text: str, found: list[tuple[str, int, int]]) -> list[dict]:
    """Each entity of a text once: e, whether it is a group (g), and one digest (c) of the
    words of all the lines in which it stands, without the spans themselves."""
    met: dict[tuple[int, int], set[int]] = {}
    line_end, line, ordered = -1, 0, sorted(found, key=lambda f: f[1])
    for kind, start, end in ordered:
        if start >= line_end:  # each line is read once, however many spans it has
            at = text.rfind("\n", 0, start) + 1
            line_end = text.find("\n", end)
            line_end = len(text) if line_end < 0 else line_end
            words = []
            for _, s, e in ordered[bisect_left(ordered, at, key=lambda f: f[1]) :]:
                if s >= line_end:
                    break
                words += _WORD.findall(text, at, max(at, s))
                at = max(at, e)
            line = _digest(" ".join(words + _WORD.findall(text, at, max(at, line_end))).lower())
        value = text[start:end].lower()
        met.setdefault((_digest(f"{kind}:{value}"), 0), set()).add(line)
        met.setdefault((_digest(f"{kind} group:{group_of(kind, value)}"), 1), set()).add(line)
    return [{"e": e, "g": g, "c": _digest(" ".join(map(str, sorted(c))))} for (e, g), c in met.items()]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _doc, _text of every row; a null text is empty.

    ``_doc`` is a 128-bit digest of id and text: rows that agree in both are one document.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.select("_id", document_key(F.col("_id"), F.col("_text")).alias("_doc"), "_text")


def document_key(id_col: Column, text: Column) -> Column:
    """128 bits for an id (null or not) and a text."""
    return F.unhex(F.md5(F.concat(row_key(id_col, F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))))


def search(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _doc, counts per kind, base spans, entities and contexts of every row."""
    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    entity = pa.struct([("e", pa.int64()), ("g", pa.int32()), ("c", pa.int64())])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, held = [], [], []
            for text in batch.column(2):
                text = text.as_py()
                found = base_spans(text)
                counts.append(Counter(k for k, _, _ in found))
                base.append(span_text(found))
                held.append(entities(text, found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS),
                 pa.array(base, pa.string()), pa.array(held, pa.list_(entity))],
                ["_id", "_doc", *(f"n_{k}" for k in KINDS), "base", "held"],
            )

    return rows.mapInArrow(
        released(searched), f"_id {kind}, _doc binary, " + "".join(f"n_{k} bigint, " for k in KINDS)
        + "base string, held array<struct<e: bigint, g: int, c: bigint>>",
    )


def find(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``search``, searched once for all that read them."""
    return stored(search(docs, id_col, text_col), "disclosure-found")


def bit_map(terms: DataFrame) -> bytes:
    """A map with a bit set where the first bits of a hash ``t`` of the terms fall."""
    n = terms.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(TERM_BITS * n + 1))))
    place = F.shiftrightunsigned("t", 64 - bits)
    words = terms.groupBy(F.shiftright(place, 6).alias("i"), F.pmod(place, F.lit(64)).cast("int").alias("b")).count()
    words = words.groupBy("i").agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits")).toArrow()  # at most 2 ** (bits - 6) rows
    table = np.zeros(1 << (bits - 6), "<i8")
    table[words["i"].to_numpy()] = words["bits"].to_numpy()
    return table.tobytes()


def mapped(table: bytes) -> Callable[[np.ndarray], np.ndarray]:
    """For hashes whether their bit of the map is set."""
    packed = np.frombuffer(table, np.uint8)
    shift = np.uint64(64 - (len(packed).bit_length() + 2))

    def wanted(hashes: np.ndarray) -> np.ndarray:
        place = hashes >> shift
        return (packed[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

    return wanted


def frequencies(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """(t, n_t): rows whose text holds a term, for at least the terms given."""
    table = bit_map(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = mapped(table)
        for batch in batches:
            met = []
            for hashes in batched_words([t or "" for t in batch.column(0).to_pylist()]):
                some = hashes[wanted(hashes)]
                if len(some):
                    met.append(np.unique(some))
            if met:
                terms, n = np.unique(np.concatenate(met), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(terms), pa.int64()), pa.array(n, pa.int64())], ["t", "n"])

    return (
        docs.select(F.col(text_col).alias("_text")).mapInArrow(released(counted), "t bigint, n bigint")
        .groupBy("t").agg(F.sum("n").alias("n_t"))
    )


def words_of_documents(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(_doc, t) once for each of the chosen documents and each of its words outside base spans."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = [hashes for hashes, _, _ in free_words(batch.column(1)[i].as_py())]
                words = np.unique(np.concatenate([*found, np.empty(0, np.uint64)]))
                for start in range(0, len(words), 1 << 16):
                    some = words[start : start + (1 << 16)]
                    docs = pa.array([batch.column(0)[i].as_py()] * len(some), pa.binary())
                    yield pa.RecordBatch.from_arrays([docs, pa.array(some.view(np.int64))], ["_doc", "t"])

    some = lookup_join(rows.filter(F.col("_text").rlike("[0-9@]")).select("_doc", "_text"), chosen, ["_doc"], "left_semi")
    # Equal documents go before their words are listed: their texts are less than their words.
    return some.groupBy("_doc").agg(F.any_value("_text").alias("_text")).mapInArrow(released(listed), "_doc binary, t bigint")


def _alike(rows: DataFrame, key: list[str], *of: str) -> DataFrame:
    """The key of each row with ``alike``, equal for keys with the same set of ``of``, and
    the size of the set (``n``): sums of 64-bit hashes, two for each member."""
    one, two = F.xxhash64(*of).cast("decimal(38,0)"), F.xxhash64(F.lit(7), *of)
    grouped = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(one).alias("_s"), F.bit_xor(two).alias("_x"))
    return grouped.withColumn("alike", F.unhex(F.md5(F.concat_ws(":", "n", "_s", "_x").cast("binary")))).drop("_s", "_x")


def disclosing(docs: DataFrame, text_col: str, found: DataFrame, generalise: float = GENERALISE, id_col: str = "doc_id") -> DataFrame:
    """(e, g, t, share, judged): the terms that reveal an entity, and how much of it.

    Of entities with the same documents and contexts the smallest digest stands for all,
    and ``g`` is 0 if one of them is no group.

    ``share`` is the plain ratio of the counts; ``judged``, the share less what few
    contexts leave uncertain, must reach ``generalise``.  ``found`` is read once.
    """
    total = F.lit(float(max(docs.count(), 1)))
    rows = _rows(docs, id_col, text_col)
    held = stored(found.select("_doc", F.explode("held").alias("x")).select("_doc", "x.*").distinct(), "disclosure-held")
    information, prior = F.log(total / F.col("n_e")), F.col("n_e") / total

    def judged(n_et: Column, n_t: Column, k: Column) -> Column:
        return (F.log(n_et * total / (F.col("n_e") * n_t)) + F.log((k - CONTEXTS + prior) / k)) / information

    counts = held.groupBy("e", "g").agg(F.count("_doc").alias("n_e"), F.count_distinct("c").alias("k_e"))
    counts = counts.filter(information > 0).filter(judged(F.col("n_e"), F.col("n_e"), F.col("k_e")) >= generalise)
    alone = stored(_alike(held, ["e", "g"], "_doc", "c").drop("n").join(counts, ["e", "g"]), "disclosure-entities")
    kinds = stored(alone.groupBy("alike").agg(F.first("n_e").alias("n_e"), F.min("e").alias("e"), F.min("g").alias("g")), "disclosure-kinds")
    where = stored(skew_join(held, kinds.select("e", "alike"), ["e"]).select("_doc", "c", F.col("alike").alias("kind")), "disclosure-where")

    words = stored(words_of_documents(rows, where.select("_doc").distinct()), "disclosure-words")
    # A word in one of these documents only is met in one context; such words are not kept apart.
    sets = _alike(words, ["t"], "_doc").filter(F.col("n") > 1).select("t", F.col("alike").alias("set"))
    sets = stored(sets, "disclosure-sets")
    in_docs = stored(lookup_join(words, sets, ["t"], "inner").select("_doc", "set").distinct(), "disclosure-in")
    tried = words.groupBy("_doc").agg(F.count(F.lit(1)).alias("w")).join(where, "_doc").groupBy("kind").agg(F.sum("w").alias("w"))
    met = lookup_join(in_docs, where, ["_doc"], "inner").groupBy("kind", "set").agg(F.count("_doc").alias("n_et"), F.count_distinct("c").alias("k"))
    met = met.join(kinds.select(F.col("alike").alias("kind"), "n_e", "e", "g"), "kind").join(tried, "kind")
    met = met.filter((F.col("k") - CONTEXTS) * information > F.log(F.col("w")))
    # The greatest share a pair can have: the term in no other document.
    met = stored(met.filter(judged(F.col("n_et"), F.col("n_et"), F.col("k")) >= generalise), "disclosure-met")
    open_sets = sets.join(met.select("set").distinct(), "set", "left_semi")
    n_t = frequencies(docs, id_col, text_col, stored(open_sets.select("t"), "disclosure-open"))
    pairs = open_sets.join(n_t, "t").join(met, "set").withColumn("judged", judged(F.col("n_et"), F.col("n_t"), F.col("k")))
    pairs = pairs.filter(F.col("judged") >= generalise).withColumn(
        "share", F.log(F.col("n_et") * total / (F.col("n_e") * F.col("n_t"))) / information
    )
    return stored(pairs.select("e", "g", "t", "share", "judged"), "disclosure-terms")


def free_words(text: str, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, starts, ends) in code points of the words that are no part of a base span,
    of the wanted ones if told, for one stretch of the text after the other."""
    at, taken = 0, None
    for piece in pieces(text.encode("utf-8", "surrogatepass")):
        data, starts, ends = spans(piece)
        hashes = hashed(data, starts, ends)
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) + at
        at = int(before[-1])
        if wanted is not None and len(hashes):
            some = wanted(hashes)
            hashes, starts, ends = hashes[some], starts[some], ends[some]
        if not len(hashes):
            continue
        starts, ends = before[starts], before[ends]
        if taken is None:
            taken = sorted((s, e) for _, s, e in base_spans(text))
            begins, reach = np.array([s for s, _ in taken]), np.maximum.accumulate([0, *(e for _, e in taken)])
        # The greatest end of the base spans that begin before a word ends tells whether one reaches it.
        free = reach[np.searchsorted(begins, ends)] <= starts
        yield hashes[free], starts[free], ends[free]


def positions(text: str, wanted: Callable[[np.ndarray], np.ndarray]) -> list[tuple[int, int, int]]:
    """(term, start, end) in code points of the wanted words, none of them part of a base span."""
    return [m for h, s, e in free_words(text, wanted) for m in zip(_signed(h), s.tolist(), e.tolist())]


def term_spans(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """(_doc, terms): array of (s, f, share, g) per document with any; ``g`` is 1 for terms
    that reveal a group only.

    Every occurrence of a term counts, near its entity or not, with or without it.
    """
    best = stored(terms.groupBy("t").agg(F.max("judged").alias("share"), F.min("g").alias("g")), "disclosure-marked")
    table = bit_map(best)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = mapped(table)
        for batch in batches:
            met = [(i, *m) for i in range(batch.num_rows) for m in positions(batch.column(1)[i].as_py(), wanted)]
            if met:
                rows, *columns = (pa.array(c, pa.int64()) for c in zip(*met))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *columns], ["_doc", "t", "s", "f"])

    rows = _rows(docs, id_col, text_col).select("_doc", "_text")
    met = stored(rows.mapInArrow(released(marked), "_doc binary, t bigint, s bigint, f bigint"), "disclosure-spots")
    met = skew_join(met, best, ["t"]).groupBy("_doc", "s", "f").agg(F.max("share").alias("share"), F.min("g").alias("g"))
    return stored(
        met.groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct("s", "f", "share", "g"))).alias("terms")), "disclosure-spans"
    )


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term,
    n_group_term (terms that reveal a group only).

    A null text counts as empty and has no spans (``spans`` is empty, the digest that of
    the empty string).  Spans are ``kind:start:end`` in code points, end exclusive, by kind
    (base kinds, then ``term``) and start.  Ids may be null or repeated; rows that agree
    in id and text count as one document in the entities' statistics and get the same spans.
    Other columns are not read; an empty table gives no rows.
    """
    found = find(docs, id_col, text_col)
    marked = term_spans(docs, id_col, text_col, disclosing(docs, text_col, found, id_col=id_col))
    listed = F.concat_ws(",", F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["s"], x["f"])))
    marked = marked.select(
        "_doc", listed.alias("_terms"), F.size("terms").cast("bigint").alias("n_term"),
        F.size(F.filter("terms", lambda x: x["g"] == 1)).cast("bigint").alias("n_group_term"),
    )
    return lookup_join(found.drop("held"), marked, ["_doc"]).select(
        F.col("_id").alias(id_col), *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.col("_terms")).alias("spans"),
        *(F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("n_term", "n_group_term")),
    )


def _kind_of(term: str) -> str:
    if any(c.isdigit() for c in term):
        return "[NUMBER]"
    return "[NAME]" if term[:1].isupper() else "[WORD]"


def sanitised(text: str, terms: list[tuple[int, int, float]], remove: float = REMOVE) -> str:
    """The text with base spans and generalised terms replaced by their kinds."""
    marks = [(s, e, f"[{k.upper()}]") for k, s, e in base_spans(text)]
    marks += [(s, e, "" if share >= remove else _kind_of(text[s:e])) for s, e, share in terms]
    out, last = [], 0
    for s, e, label in sorted(marks, key=lambda m: (m[0], -m[1])):
        if s >= last:
            out += [text[last:s], label]
        last = max(last, e)
    return "".join([*out, text[last:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their texts sanitised; all other columns stay.  Null texts stay null."""
    found = search(docs, id_col, text_col)  # only its entities are read, and once
    marked = term_spans(docs, id_col, text_col, disclosing(docs, text_col, found, id_col=id_col))
    names, at = docs.columns, docs.columns.index(text_col)
    keyed = docs.select(F.struct(*names).alias("_row"), document_key(F.col(id_col), F.col(text_col)).alias("_doc"))
    joined = lookup_join(keyed, marked, ["_doc"]).select(*(F.col("_row")[n].alias(n) for n in names), F.col("terms").alias("_terms"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, terms in zip(batch.column(at), batch.column(len(names))):
                text, terms = text.as_py(), terms.as_py() or []
                texts.append(None if text is None else sanitised(text, [(x["s"], x["f"], x["share"]) for x in terms]))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(released(clean), docs.schema)


def sanitise_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without personal data; n_chars follows the new texts."""
    return sanitise(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def op8_disclosure(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document, with the terms that reveal it."""
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
