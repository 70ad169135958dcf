"""What a Python worker keeps from task to task: the tables of one operator at a time.

Spark sends a function made inside another one with copies of the module variables that it names, so a table kept in
such a variable is made again for every task.  What is to outlast a task stands here, behind functions of a module,
which are sent by name.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

MOST = 8
_kept: dict[tuple, object] = {}


def once(operator: str, key: object, make: Callable[[], object]) -> object:
    """What ``make`` returned for this operator and key in an earlier task, or returns now; other operators' go."""
    if (operator, key) not in _kept:
        if len(_kept) >= MOST or any(o != operator for o, _ in _kept):
            drop()
        _kept[operator, key] = make()
    return _kept[operator, key]


def drop() -> None:
    """For operators that keep nothing: another one's tables do not stand beside their work."""
    if _kept:
        _kept.clear()
        gc.collect()                             # tables may refer to each other
        give_back()


def give_back() -> None:
    """Memory that this worker has freed goes back to the system: an executor's workers and its heap share one limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)            # of the GNU C library
    if trim:
        trim(0)
