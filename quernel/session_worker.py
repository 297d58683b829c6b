"""What a Python worker keeps between tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable


def kept(name: str, make: Callable):
    """`make()`, run once a worker process: functions travel by value, so their own globals don't outlive a task."""
    store = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]
