"""What a Python worker keeps between its tasks: one thing at a time.

Workers outlive their tasks, so that a tokenizer's remembered words or an automaton serve the next task too. They also
outlive the operator: what it kept would fill an executor's memory while the stages of other operators run. So a worker
holds one thing, and forgets it when it is asked for another or starts on an operator that keeps nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_kept: dict[Hashable, Any] = {}


def keep(key: Hashable, build: Callable[[], Any]) -> Any:
    """The thing of that key: the one kept by this worker, or a new one in its place."""
    if key not in _kept:
        forget()
        _kept[key] = build()
    return _kept[key]


def forget() -> None:
    """Let go of what is kept, and of the memory that Arrow holds in reserve."""
    if _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
