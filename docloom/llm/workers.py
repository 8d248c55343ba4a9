"""The one large object that a Python worker keeps between tasks: a vocabulary's table or a set of models.

Workers outlive tasks and operators. Whoever needs much memory asks here first, so that an executor's workers never
hold what an earlier operator left.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_held: dict[Hashable, Any] = {}


def trim() -> None:
    """Hand memory that is free, but kept for later, back to the system: an idle worker then costs next to nothing."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def release() -> None:
    """Let go of what is held."""
    if _held:
        _held.clear()
        gc.collect()
        trim()


def hold(key: Hashable, make: Callable[[], Any]) -> Any:
    """The object for `key`, made once; another one that is held goes first."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]
