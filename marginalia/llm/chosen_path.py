"""N-gram Jaccard join by chosen paths.

Documents are sets of hashed five-word shingles; equal sets are one node.  In each of
several independent runs a set picks the shingles whose hash falls below 1 / (0.8 n), and
is sent to one bucket per pick; a bucket that is still large is split again by picks of
its own, and so on (the keys of all levels depend on the set and the bucket only, so they
are drawn in one pass over the texts).  Two sets of similarity 0.8 share at least one pick
per level on average, which gives the recall of one run; runs are repeated until the
target recall is reached at the deepest level.

Buckets are compared by brute force on short sketches; a bucket that is still large at the
deepest level is dealt out in tiles of two blocks.  Similar pairs only vote on which
sets may belong together: a bucket gives a spanning forest, never its pairs.  The
components of these votes are then verified on the full sets, every pair of a component
once, in tiles where a component is large.  Links are counted in the tile and classes are
the components of verified links, so the number of rows stays in proportion to the sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.components import components
from marginalia.llm.held import released
from marginalia.llm.one_row import chosen_rows, row_key
from marginalia.llm.streams import local_roots, over_groups
from marginalia.llm.words import batched_words, mix, shingles
from marginalia.operators.durable import stored
from marginalia.operators.joins import lookup_join

WIDTH = 5
SIMILARITY = 0.8
RECALL = 0.995
"""Share of the pairs at the threshold that the runs must find."""

DEPTH = 3
SMALL = 48
"""Buckets up to this size are compared, larger ones are split while there are levels."""

BINS = 64
SLACK = 0.2
"""Sketches whose estimated similarity is this far below the threshold still vote."""

TILE = 512
"""Members of a block; larger buckets and components are compared block by block."""

TILE_SHINGLES = 1 << 20
_CHUNK = 1 << 15


def vote_miss(similarity: float = SIMILARITY, slack: float = SLACK, bins: int = BINS) -> float:
    """The greatest chance that the sketches of a pair at the threshold do not vote.

    Each bin agrees with probability ``similarity``; a pair whose sets fill fewer bins has
    less variance, since a token that is not shared spoils one bin at most.
    """
    least = math.ceil((similarity - slack) * bins - 1e-9)
    return sum(math.comb(bins, i) * similarity**i * (1 - similarity) ** (bins - i) for i in range(least))


def runs_for(recall: float, similarity: float = SIMILARITY, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold is found with the given probability.

    The worst pair shares one pick per level on average (a set within a set); it meets at
    a level with probability q = 1 - exp(-q of the level below).  Its sketches must vote as
    well, and they are the same in all runs, so their misses come on top.
    """
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    meet = recall / (1 - vote_miss(similarity))
    if meet >= 1:
        raise ValueError("sketches alone miss more than the recall allows")
    return math.ceil(math.log(1 - meet) / math.log(1 - q))


def picks(tokens: np.ndarray, seeds: np.ndarray, bound: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, key) of the picks of each bucket seed among the tokens."""
    owners, keys = [], []
    odd, add = (seeds | np.uint64(1))[:, None], mix(seeds)[:, None]
    for at in range(0, len(tokens), _CHUNK):
        part = tokens[at : at + _CHUNK]
        row, column = np.nonzero(part[None, :] * odd + add < bound)
        owners.append(row)
        keys.append(mix(seeds[row] * np.uint64(0x9E3779B97F4A7C15) + part[column]))
    return np.concatenate(owners), np.concatenate(keys)


def paths(tokens: np.ndarray, runs: int, depth: int = DEPTH, similarity: float = SIMILARITY) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level (parent keys, keys) of the buckets a set is sent to."""
    bound = np.uint64(min((1 << 64) - 1, int((1 << 64) / (similarity * len(tokens)))))
    seeds = mix(np.arange(1, runs + 1, dtype=np.uint64))
    levels = []
    for _ in range(depth):
        owner, keys = picks(tokens, seeds, bound)
        levels.append((seeds[owner], keys))
        seeds = keys
    return levels


_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - int(math.log2(BINS)))


def sketch(tokens: np.ndarray) -> bytes:
    """A byte per bin of the hash range: the bin's smallest hash, 0 if the bin is empty."""
    at = np.searchsorted(tokens, _EDGES)
    first = tokens[np.minimum(at, len(tokens) - 1)]
    filled = (at < len(tokens)) & (first >> np.uint64(64 - int(math.log2(BINS))) == np.arange(BINS, dtype=np.uint64))
    return np.where(filled, first % np.uint64(255) + np.uint64(1), 0).astype(np.uint8).tobytes()


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat.view(np.int64)))


def _signatures(docs: DataFrame, runs: int) -> DataFrame:
    """_id, _text_key, set (null without words), n, sketch, and the keys of each level.

    Text keys are 128-bit digests: texts are joined by them."""
    kind = docs.schema["_id"].dataType.simpleString()
    names = ["_id", "_text_key", "set", "n", "sketch"] + [f"{x}{i}" for i in range(1, DEPTH + 1) for x in "pk"]
    schema = f"_id {kind}, _text_key string, set binary, n bigint, sketch binary" + "".join(
        f", p{i} array<bigint>, k{i} array<bigint>" for i in range(1, DEPTH + 1)
    )
    none = np.empty(0, np.uint64)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                sets, sizes, sketches = [], [], []
                levels: list[list[np.ndarray]] = [[] for _ in range(2 * DEPTH)]
                for words in batched_words([t or "" for t in batch.column(2).to_pylist()]):
                    tokens = shingles(words, WIDTH)
                    sizes.append(len(tokens))
                    sets.append(set_key(tokens) if len(tokens) else None)
                    sketches.append(sketch(tokens) if len(tokens) else None)
                    found = paths(tokens, runs) if len(tokens) else [(none, none)] * DEPTH
                    for i, (parent, key) in enumerate(found):
                        levels[2 * i].append(parent)
                        levels[2 * i + 1].append(key)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.array(sketches, pa.binary()), *map(_lists, levels)], names,
                )

    return docs.select("_id", "_text_key", "_text").mapInArrow(released(signed), schema)


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, size, set): the buckets that are compared, with their members."""
    found = None
    large = None
    for level in range(1, DEPTH + 1):
        entry = F.explode(F.arrays_zip(F.col(f"p{level}").alias("parent"), F.col(f"k{level}").alias("bucket")))
        rows = nodes.select("set", entry.alias("e")).select("set", F.col("e.parent").alias("parent"), F.col("e.bucket").alias("bucket"))
        if large is not None:
            rows = rows.join(large, rows.parent == large.bucket, "left_semi")
        rows = rows.drop("parent")
        if level > 1:
            rows = stored(rows, f"paths-{level}")
        sizes = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1), "path-sizes")
        large = sizes.filter(F.col("size") > SMALL).select("bucket")
        ready = sizes if level == DEPTH else sizes.filter(F.col("size") <= SMALL)
        members = rows.join(ready, "bucket")
        found = members if found is None else found.unionByName(members)
    return found


def _tiled(rows: DataFrame, group: str, parts) -> DataFrame:
    """Deal the rows of large groups to tiles of two blocks: adds tile and block.

    A row of block b goes to the tiles (b, 0), ..., (b, parts - 1); a group of one part
    has one tile.  ``block`` is -1 in a tile that compares a block with itself.
    """
    dealt = rows.withColumn("_parts", parts).withColumn("_b", F.pmod(F.xxhash64("set", F.lit(5)), F.col("_parts")).cast("int"))
    dealt = dealt.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_parts").cast("int") - 1)))
    tile = F.xxhash64(group, F.least("_b", "_j"), F.greatest("_b", "_j"))
    block = F.when(F.col("_b") == F.col("_j"), -1).otherwise(F.when(F.col("_b") < F.col("_j"), 0).otherwise(1))
    return dealt.withColumn("tile", tile).withColumn("block", block.cast("int")).drop("_parts", "_b", "_j")


def _pairs(bounds: np.ndarray, blocks: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows to compare in each group, some at a time."""
    ends = np.repeat(bounds[1:], np.diff(bounds)) if len(bounds) > 1 else bounds
    n = len(ends)
    reps = ends - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(reps)])
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(total, total[start] + most, side="right")) - 1)
        own = reps[start:stop]
        left = np.repeat(np.arange(start, stop), own)
        right = left + 1 + np.arange(len(left)) - np.repeat(total[start:stop] - total[start], own)
        different = (blocks[left] < 0) | (blocks[left] != blocks[right])
        yield left[different], right[different]
        start = stop


def _forest(table: pa.Table, bounds: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Edges to the first row of each component of sketches that look similar."""
    n = table.num_rows
    if bounds[-1] != n:
        bounds = np.concatenate([bounds, [n]])
    codes = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(n, BINS)
    lefts, rights = [], []
    for left, right in _pairs(bounds, table["block"].to_numpy()):
        a, b = codes[left], codes[right]
        filled = ((a | b) != 0).sum(axis=1)
        same = ((a == b) & (a != 0)).sum(axis=1)
        near = same >= least * filled
        lefts.append(left[near])
        rights.append(right[near])
    if not lefts:
        return
    roots = local_roots(n, np.concatenate(lefts), np.concatenate(rights))
    child = np.flatnonzero(roots != np.arange(n))
    if len(child):
        sets = table["set"].combine_chunks()
        yield pa.RecordBatch.from_arrays([sets.take(pa.array(child)), sets.take(pa.array(roots[child]))], ["a", "b"])


def intersections(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, by products of 0/1 blocks."""
    both = [*first, *second] if second is not first else first
    flat, code = np.unique(np.concatenate(both), return_inverse=True)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    often = np.bincount(code, minlength=len(flat)) > 1
    number = np.cumsum(often) - 1
    shared = often[code]
    code, owner = number[code[shared]], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    n, split = len(both), len(first)
    out = np.zeros((split, n if second is first else n - split), np.float32)
    step = max(1, (1 << 22) // n)
    for at in range(0, int(often.sum()), step):
        lo, hi = np.searchsorted(code, [at, at + step])
        block = np.zeros((n, step), np.float32)
        block[owner[lo:hi], code[lo:hi] - at] = 1
        out += block[:split] @ (block if second is first else block[split:]).T
    return out


def _verify(table: pa.Table, bounds: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    """Per set with links in a tile: the tile's first linked set and the linked documents."""
    if bounds[-1] != table.num_rows:
        bounds = np.concatenate([bounds, [table.num_rows]])
    raws, weights = table["tokens"].to_pylist(), table["copies"].to_numpy()
    blocks, sets = table["block"].to_numpy(), table["set"].combine_chunks()
    sizes = np.array([len(r) // 8 for r in raws], np.float64)
    rows_out, roots_out, links_out = [], [], []
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        rows = np.arange(start, end)
        if blocks[start] < 0:
            first = second = rows
        else:
            first, second = rows[blocks[rows] == 0], rows[blocks[rows] == 1]
        if not len(first) or not len(second) or end - start < 2:
            continue
        tokens = {r: np.frombuffer(raws[r], np.uint64) for r in rows.tolist()}
        a = [tokens[r] for r in first.tolist()]
        shared = intersections(a, a if first is second else [tokens[r] for r in second.tolist()])
        # Whole numbers to double precision: pairs exactly at the threshold are linked.
        linked = shared.astype(np.float64) * (1 + similarity) >= similarity * (sizes[first][:, None] + sizes[second][None, :]) - 1e-6
        if first is second:
            np.fill_diagonal(linked, False)
        left, right = np.nonzero(linked)
        left, right = first[left], second[right]
        links = np.bincount(left, weights[right], table.num_rows)
        if first is not second:
            links += np.bincount(right, weights[left], table.num_rows)
        met = np.flatnonzero(links)
        if len(met):
            rows_out.append(met)
            links_out.append(links[met])
            roots_out.append(local_roots(end - start, left - start, right - start)[met - start] + start)
    if rows_out:
        rows = np.concatenate(rows_out)
        yield pa.RecordBatch.from_arrays(
            [sets.take(pa.array(rows)), sets.take(pa.array(np.concatenate(roots_out))),
             pa.array(np.concatenate(links_out).astype(np.int64))], ["a", "b", "links"],
        )


def text_key(text: Column) -> Column:
    """128 bits of a text; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def classes_of_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per input row: _id, _text_key, set and root (null without words), class_id, n_links, n."""
    runs = runs_for(recall, similarity)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_text_key", text_key(F.col("_text")))
    signed = stored(_signatures(rows, runs), "path-signatures")
    levels = [f"{x}{i}" for i in range(1, DEPTH + 1) for x in "pk"]
    nodes = stored(
        signed.filter(F.col("set").isNotNull()).groupBy("set").agg(
            F.count(F.lit(1)).alias("copies"), F.min("_id").alias("least_id"), F.min("_text_key").alias("_text_key"),
            F.any_value(F.struct("n", "sketch", *levels)).alias("s"),
        ).select("set", "copies", "least_id", "_text_key", "s.*"), "path-nodes",
    )
    members = _buckets(nodes).join(nodes.select("set", "sketch"), "set")
    parts = F.when(F.col("size") <= 2 * TILE, F.lit(1)).otherwise(F.ceil(F.col("size") / F.lit(TILE))).cast("int")
    tiles = _tiled(members, "bucket", parts).select("tile", "block", "set", "sketch")
    least = similarity - SLACK
    votes = tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(
        over_groups(lambda t, b: _forest(t, b, least), "tile"), "a binary, b binary"
    )
    candidate = components(votes)

    # The full sets of the candidates, one text for each set.
    suspects = stored(
        candidate.withColumnRenamed("node", "set").join(nodes.select("set", "copies", "n", "_text_key"), "set"), "path-suspects"
    )
    sizes = stored(suspects.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total")), "path-roots")
    # Only texts of suspects are shuffled, and of equal ones only one per task.
    texts = lookup_join(rows.select("_text_key", "_text"), suspects.select("_text_key").distinct(), ["_text_key"], "left_semi")
    texts = texts.groupBy("_text_key").agg(F.any_value("_text").alias("_text"))
    wanted = texts.join(suspects.select("_text_key", "set", "root", "copies"), "_text_key").join(sizes, "root")

    def with_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                tokens = [shingles(w, WIDTH).tobytes() for w in batched_words(batch.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(tokens, pa.binary())], [*batch.schema.names[1:], "tokens"])

    filled = wanted.select("_text", "set", "root", "copies", "members", "total").mapInArrow(
        released(with_tokens), "set binary, root binary, copies bigint, members bigint, total bigint, tokens binary"
    )
    parts = F.greatest(F.ceil(F.col("members") / TILE), F.ceil(F.col("total") / TILE_SHINGLES))
    parts = F.when((F.col("members") <= 2 * TILE) & (F.col("total") <= 2 * TILE_SHINGLES), F.lit(1)).otherwise(parts).cast("int")
    compared = _tiled(filled, "root", parts).select("tile", "block", "set", "copies", "tokens")
    links = stored(
        compared.repartition("tile").sortWithinPartitions("tile").mapInArrow(
            over_groups(lambda t, b: _verify(t, b, similarity), "tile"), "a binary, b binary, links bigint"
        ), "path-links",
    )
    classes = components(links.select("a", "b")).withColumnRenamed("node", "set")
    degrees = links.groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    joined = stored(
        nodes.select("set", "copies", "least_id", "n").join(classes, "set", "left").join(degrees, "set", "left")
        .withColumn("root", F.coalesce("root", "set")), "path-classes",
    )
    named = joined.groupBy("root").agg(F.min("least_id").alias("class_id"))
    final = stored(
        joined.join(named, "root").select(
            "set", "root", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "n"
        ), "path-final",
    )
    return signed.select("_id", "_text_key", "set").join(final, "set", "left")


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per input row: id, class_id, n_links, n_shingles.

    Rows are linked when the Jaccard similarity of their sets of five-word shingles is at
    least ``similarity``; ``n_links`` counts the other rows that a row is linked to, rows
    of an equal set included, and ``class_id`` is the smallest id of all rows that links
    connect.  A text of fewer than five words is one shingle; null texts and texts without
    words have no links and are classes of their own.  Null ids get the class of their
    text, and a class without ids has a null class_id.  Repeated rows count as rows.
    Other columns are not read; an empty table gives no rows.
    """
    return classes_of_rows(docs, id_col, text_col, similarity, recall).select(
        F.col("_id").alias(id_col),
        F.when(F.col("set").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_shingles"),
    )


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate class and number of links of every document."""
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one_row_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, with its columns: the one with the smallest id.

    Exactly one row stays of a class, whether its ids are repeated or all null.  A text
    without words is a class with the rows that agree in id and text.
    """
    rows = classes_of_rows(docs).select("_id", "_text_key", "root")
    own = row_key(F.col("_id"), F.col("_text_key"))
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("_id"), F.col("_text_key").alias("_text_key")))
    group = F.coalesce(F.concat(F.lit("#"), F.hex("root")), own).alias("_class")
    best = rows.groupBy(group).agg(least.alias("x")).select("x.*")
    key = row_key(F.col("doc_id"), text_key(F.col("text")))
    return chosen_rows(docs, key, best.select(own.alias("_row_key")))
