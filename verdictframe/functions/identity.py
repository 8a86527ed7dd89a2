"""What a function does, as a digest: for names and fingerprints that must change with it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable


def code_of(f: Callable) -> str:
    """A digest of a function's code and of the values it closes over; where it stands doesn't matter."""
    code = getattr(f, "__code__", None)
    if code is None:
        return type(f).__name__
    constants = [_bare(c) if hasattr(c, "co_code") else repr(c) for c in code.co_consts[1 if code.co_consts and isinstance(code.co_consts[0], str) else 0 :]]
    held = [code_of(c.cell_contents) if callable(c.cell_contents) else repr(c.cell_contents) for c in f.__closure__ or ()]
    return hashlib.sha256(repr((code.co_code, code.co_names, constants, held, f.__defaults__)).encode()).hexdigest()


def _bare(code) -> str:
    return hashlib.sha256(repr((code.co_code, code.co_names, [_bare(c) if hasattr(c, "co_code") else repr(c) for c in code.co_consts])).encode()).hexdigest()
