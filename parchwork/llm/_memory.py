"""What a Python worker holds between tasks.

Workers outlive tasks and go from one operator to another, two or more on an executor. A task keeps
the caches of its own kind and lets go of all others; at its end freed memory goes back to the system.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Name → cache, filled by the modules that own them.
CACHES: dict[str, dict] = {}


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, which may use the cache named `keep` and leaves nothing else behind."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, cache in CACHES.items():
            if name != keep:
                cache.clear()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task
