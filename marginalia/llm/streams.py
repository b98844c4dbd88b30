"""Groups of sorted rows, read as a stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from marginalia.llm.held import released


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the bounds of the groups in them.

    The rows of a partition come sorted by an integer key.  Only the last group of a
    batch can go on in the next one; it is held back until it is complete.
    """
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        keys = table[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if len(cuts):
            last = int(cuts[-1])
            yield table.slice(0, last), np.concatenate([[0], cuts])
            held = table.slice(last)
        else:
            held = table
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def over_groups(function: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], key: str):
    """A function for ``mapInArrow`` that hands whole groups on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, key):
            yield from function(table, bounds)

    return released(run)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row of each row's connected component, for links between n rows."""
    roots = np.arange(n)
    while len(left):
        low = np.minimum(roots[left], roots[right])
        before = roots.copy()
        np.minimum.at(roots, left, low)
        np.minimum.at(roots, right, low)
        roots = roots[roots]
        if (before == roots).all():
            break
    return roots
