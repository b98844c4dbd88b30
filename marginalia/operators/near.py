"""Near copies among the texts of a group, found and scored where they meet.

Texts cut into pieces are many times larger than the texts.  Only the texts are
dealt out; a task makes the pieces of some of them at a time, in arrays that end
with it, and writes nothing but the pairs that reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from marginalia.functions import text as tx

HELD_CHARS = 1 << 20
"""Characters of texts after which a task compares what it has read."""

PART_CHARS = 2 << 20
"""Known characters of one group that a task holds; a larger group is dealt out in parts."""

HITS = 1 << 20
"""Places in known texts that are looked at in one step."""

PAIRS = "fingerprint string, known_fingerprint string, score double, rounded double"
_PAIRS = pa.schema([
    ("fingerprint", pa.string()), ("known_fingerprint", pa.string()),
    ("score", pa.float64()), ("rounded", pa.float64()),
])
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_size(threshold: float) -> int:
    """Piece length for which every text has more pieces than tolerated edits."""
    slope = 2 * (1 - threshold) / threshold
    return max(1, int(1 / (2 * slope))) if slope > 0 else 64


def tolerated_edits(lengths: np.ndarray, threshold: float) -> np.ndarray:
    """Most unmatched characters, both texts together, at the threshold.

    A partner is at most (2-t)/t as long, so both have at most 2/t times the length.
    """
    return np.floor(lengths * (2 * (1 - threshold) / threshold) + 1e-6).astype(np.int64)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters in a row, and length and start of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), lengths, starts


def _hashes(codes: np.ndarray, at: np.ndarray, size: int, groups: np.ndarray) -> np.ndarray:
    """Of the ``size`` characters from each place on, within a group."""
    found = groups.astype(np.uint64) * _MIX
    for i in range(size):
        found = (found ^ codes[at + i].astype(np.uint64)) * _FACTOR
        found ^= found >> np.uint64(29)
    return found


def _ranges(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0, 1, ... up to each length, one after another, and whose number each is."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return np.arange(len(owner)) - np.repeat(first, lengths), owner


class _Index:
    """Every piece of some known texts, sorted."""

    def __init__(self, groups: list[int], texts: list[str], size: int):
        codes, self.lengths, starts = _codes(texts)
        self.groups = np.array(groups, np.int64)
        at, owner = _ranges(np.maximum(self.lengths - size + 1, 0))
        hashes = _hashes(codes, starts[owner] + at, size, self.groups[owner])
        order = np.argsort(hashes)
        self.hashes, self.at = hashes[order], at[order].astype(np.int32)
        self.owner = owner[order].astype(np.int32)


def _pairs(index: _Index, groups: np.ndarray, texts: list[str], threshold: float,
           size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts with the known ones that may reach the threshold; no such pair is left out.

    At the threshold a pair may leave only k characters unmatched.  Cut a text into
    pieces: k characters touch at most k of them, so out of any k+1 pieces one stands
    unchanged in the partner, moved by k at most.  The k+1 pieces that are rarest among
    the known texts are looked up; frequent pieces, shared by whole families of texts,
    are left out without losing a pair.
    """
    codes, lengths, starts = _codes(texts)
    allowed = tolerated_edits(lengths, threshold)
    piece, owner = _ranges(lengths // size)
    at = piece * size
    hashes = _hashes(codes, starts[owner] + at, size, groups[owner])
    low = np.searchsorted(index.hashes, hashes, "left")
    hits = np.searchsorted(index.hashes, hashes, "right") - low
    order = np.lexsort((at, hits, owner))  # the rarest of each text first
    rank = _ranges(lengths // size)[0]
    order = order[(rank <= allowed[owner]) & (hits[order] > 0)]
    owner, at, low, hits = owner[order], at[order], low[order], hits[order]

    def looked_up(a: int, b: int) -> np.ndarray:
        """Pairs, as one number each, of the pieces from a to b."""
        i, which = _ranges(hits[a:b])
        which += a
        place = low[which] + i
        mine, known = owner[which], index.owner[place].astype(np.int64)
        shorter = np.minimum(lengths[mine], index.lengths[known])
        both = lengths[mine] + index.lengths[known]
        near = (
            (np.abs(at[which] - index.at[place]) <= allowed[mine])
            & (2.0 * shorter >= threshold * both - 1e-9) & (groups[mine] == index.groups[known])
        )
        return np.unique(mine[near] * len(index.lengths) + known[near])

    total = np.concatenate([[0], np.cumsum(hits)])

    def steps(a: int, b: int, cuts: np.ndarray) -> Iterator[tuple[int, int]]:
        """From a to b in steps of about ``HITS`` that end at cuts, of one cut at least."""
        while a < b:
            last = np.searchsorted(total, total[a] + HITS, "right") - 1
            end = int(cuts[max(np.searchsorted(cuts, last, "right") - 1, np.searchsorted(cuts, a, "right"))])
            yield a, end
            a = end

    ends = np.append(np.flatnonzero(owner[1:] != owner[:-1]) + 1, len(owner))
    for a, b in steps(0, len(owner), ends):  # whole texts
        found = np.zeros(0, np.int64)
        for c, d in steps(a, b, np.arange(a + 1, b + 1)):  # pieces
            found = np.union1d(found, looked_up(c, d))
        yield found // len(index.lengths), found % len(index.lengths)


def near_copies(threshold: float, autojunk: bool = True, held_chars: int = HELD_CHARS):
    """A function for ``mapInArrow``: scored pairs of equal group, from sorted rows.

    Rows are (group columns, probe, fingerprint, anchor), sorted by them: the known
    texts of a group come before those that are looked up.  A text does not meet itself.
    """
    size = gram_size(threshold)

    def compared(index, known, probes) -> Iterator[pa.RecordBatch]:
        """``known`` and ``probes``: groups, fingerprints, texts."""
        groups, names, texts = np.array(probes[0], np.int64), probes[1], probes[2]
        for mine, others in _pairs(index, groups, texts, threshold, size):
            differ = [names[i] != known[1][j] or texts[i] != known[2][j] for i, j in zip(mine, others)]
            yield from scores(known, names, texts, mine[differ], others[differ])

    def scores(known, names, texts, mine, others) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((mine, others))  # the matcher prepares each known text once
        pairs = [(int(i), int(j)) for i, j in zip(mine[order], others[order])]
        found = tx.similarities(
            ((texts[i], known[2][j]) for i, j in pairs), threshold, autojunk)
        rows = [(names[i], known[1][j], *s) for (i, j), s in zip(pairs, found) if s[0] is not None]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), _PAIRS)], schema=_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, probes = ([], [], []), ([], [], [])
        index, group, last, chars = None, 0, None, 0

        def known_of(groups: set[int]) -> tuple[list, ...]:
            at = [i for i, g in enumerate(known[0]) if g in groups]
            return known if len(at) == len(known[0]) else tuple([c[i] for i in at] for c in known)

        for batch in batches:
            *keys, is_probe, names, texts = (c.to_pylist() for c in batch.columns)
            for key, probe, name, text in zip(zip(*keys), is_probe, names, texts):
                if key != last:
                    group, last = group + 1, key
                if chars > held_chars:
                    if probes[0]:
                        met = known_of(set(probes[0]))
                        index = index if index and met is known else _Index(met[0], met[2], size)
                        yield from compared(index, met, probes)
                        index = index if met is known else None
                    kept = known_of({group})  # whose probes may still come
                    if kept is not known:
                        known, index = kept, None
                    probes, chars = ([], [], []), 0
                if probe:
                    if not known[0] or known[0][-1] != group:
                        continue  # nothing known of this group
                    rows = probes
                elif known[0] and known[0][-1] == group and known[1][-1] == name:
                    continue  # the same once more
                else:
                    rows, index = known, None
                for column, value in zip(rows, (group, name, text)):
                    column.append(value)
                chars += len(text)
        if probes[0]:
            met = known_of(set(probes[0]))
            yield from compared(index if index and met is known else _Index(met[0], met[2], size), met, probes)

    return run
