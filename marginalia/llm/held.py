"""What Python workers hold between tasks, and how it is given back.

Spark keeps Python workers for later tasks of any stage.  What a task leaves in them
(module-level caches, Arrow's pool, pages the C library keeps for reuse) would stay and add
up over the stages of a pipeline, so tasks that build such things end with ``released``.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_CACHES: list[Callable[[], None]] = []


def cleared_at_end(clear: Callable[[], None]) -> None:
    """Have a cache of this worker emptied when a task ends."""
    if clear not in _CACHES:
        _CACHES.append(clear)


def _give_back() -> None:
    for clear in _CACHES:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)  # only the GNU library has it
    except (AttributeError, OSError):
        pass


def released(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for ``mapInArrow`` whose worker gives memory back when its task ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _give_back()

    return run
