"""Memory of Python workers, which live on for the tasks of later stages."""

from __future__ import annotations

import ctypes
import gc
import sys
import types

import pyarrow as pa


def kept_tables() -> dict:
    """What a worker keeps over tasks, by name. Functions arrive by value, so it stands in a module of its own."""
    return sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__.setdefault("tables", {})


def give_back(keep: str | None = None) -> None:
    """Return freed memory to the system at a task's end, so that idle workers hold little beside the next stage. What
    other operators have kept goes too: their stage is over, and its memory is this one's."""
    tables = kept_tables()
    if gone := [name for name in tables if name != keep]:
        for name in gone:
            del tables[name]
        gc.unfreeze()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it
