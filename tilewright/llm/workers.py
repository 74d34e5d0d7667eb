"""Memory of Python workers."""

from __future__ import annotations

import ctypes


def trim() -> None:
    """Give memory that this worker has freed back to the machine.

    Workers are used again by later tasks and stages, and the allocators would keep for each of
    them the most that any batch has taken. Called after a batch; no result depends on it.
    """
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without that call
        pass
