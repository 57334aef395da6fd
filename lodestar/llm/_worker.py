"""What a Python worker keeps between its tasks: one operator's cache at a time.

Workers outlive tasks and serve all operators of an application in turn, so a cache that stayed for
each of them would add up. Asking for one drops the one before.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_kept: list = [None, None]


def keep(key: Hashable, make: Callable[[], Any]) -> Any:
    """The object for ``key``, made if this worker doesn't have it."""
    if _kept[0] != key:
        release()
        _kept[:] = key, make()
    return _kept[1]


def release() -> None:
    """Drop what is kept and hand free memory back; operators without a cache call this before and after."""
    if _kept[0] is not None:
        _kept[:] = None, None
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed blocks otherwise
    if trim is not None:
        trim(0)
