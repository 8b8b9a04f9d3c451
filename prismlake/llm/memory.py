"""Memory of Python workers, which Spark keeps for later stages."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


_settled = False


def give_back() -> None:
    """Return to the system what the allocators hold and nobody uses."""
    global _settled
    gc.collect()
    if not _settled:
        # Modules stay as long as the process does; to look through them after each task takes longer than many tasks.
        gc.freeze()
        _settled = True
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over a task's batches, then give_back(): else an idle worker would hold the most that any stage has needed."""

    @functools.wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy
