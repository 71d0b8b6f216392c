"""Memory of Python workers."""

from __future__ import annotations

import ctypes
import os

import pyarrow as pa

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def release() -> None:
    """Gives the system what this process has freed. A worker that waits for its next task stands beside busy ones, and an executor's memory is that of all."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)
