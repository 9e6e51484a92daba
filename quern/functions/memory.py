"""Memory that a Python worker needed for a moment goes back to the system."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa


@lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not every C library has it
        return None


def release() -> None:
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)
