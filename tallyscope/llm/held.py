"""What a Python worker keeps between tasks: one model at a time.

Workers outlive their tasks and jobs, so whatever one job leaves there is memory that
the next can't use. Caches in models are bounded by entries of bounded length, that is, in bytes.
"""

from __future__ import annotations

import ctypes
import gc

_held: dict[object, object] = {}


def release() -> None:
    """Drop the worker's model and give its memory back."""
    if _held:
        _held.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not every C library has it
            pass


def held(name, make):
    """The worker's model called ``name``, made by ``make`` if another one, or none, is there."""
    if name not in _held:
        release()
        _held[name] = make()
    return _held[name]
