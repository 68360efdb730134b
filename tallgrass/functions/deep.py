"""Recursive readers of text on as much stack as the text's nesting needs."""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import TypeVar

R = TypeVar("R")

#: Frames that a character of text can open at most in the package's readers.
FRAMES = 64


def deeply(call: Callable[[], R], size: int) -> R:
    """``call()``; if the stack doesn't suffice, again with a larger one, up to what ``size`` characters can nest.

    Frames of Python functions are on the heap, so only memory limits them.
    """
    before = sys.getrecursionlimit()
    try:
        return call()
    except RecursionError:
        pass
    most = before + FRAMES * size
    limit = before
    try:
        while True:
            limit = min(8 * limit, most)
            sys.setrecursionlimit(limit)
            try:
                return call()
            except RecursionError:
                if limit >= most:
                    raise
    finally:
        sys.setrecursionlimit(before)
