"""What a Python process keeps from one task to the next.  Code travels with each task, so it can't be kept in a module's globals."""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any


def kept(name: str, make: Callable[[], Any], large: bool = False) -> Any:
    """The value under ``name``, made once in each process.  A ``large`` one stays until a stage of another kind runs (``forget_large``)."""
    store = sys.__dict__.setdefault("_memlake_kept", {})
    if name not in store:
        store[name] = make()
        if large:
            sys.__dict__.setdefault("_memlake_large", set()).add(name)
    return store[name]


def keep(name: str, value: Any) -> Any:
    sys.__dict__.setdefault("_memlake_kept", {})[name] = value
    return value


def forget_large() -> None:
    """Processes are used again by later stages: those that need memory of their own give back what earlier ones left."""
    for name in sys.__dict__.pop("_memlake_large", ()):
        sys.__dict__["_memlake_kept"].pop(name, None)
