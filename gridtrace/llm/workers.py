"""Python workers are used again by later tasks: what a task held is given back when it ends."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()  # Arrow's pool is not of the C library
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map over batches that gives its memory back to the system at its end."""

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run
