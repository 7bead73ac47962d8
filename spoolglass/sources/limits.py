"""What providers that fetch and decode media have to keep to: bytes, deadlines, and no partial files.

These run inside a provider's call on an executor; clock and transport are
parameters, so that they are tested without a network.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterable, Iterator

from spoolglass.sources.files import ContractError

# Fixed values, in seconds.
SEEK_BUDGET_SECONDS, SEEK_SECONDS, LEAST_SEEK_SECONDS = 20.0, 4.0, 1.0


class LimitError(ContractError):
    pass


def checked(chunks: Iterable[bytes], declared: int | None, max_bytes: int, seconds: float, clock: Callable[[], float] = time.monotonic) -> Iterator[bytes]:
    """The chunks, while they are within the bytes and the time since the first was asked for."""
    if seconds <= 0 or max_bytes <= 0:
        raise LimitError("limits have to be positive")
    if declared is not None and declared > max_bytes:
        raise LimitError("more bytes are declared than the limit")
    end, left = clock() + seconds, max_bytes
    source = iter(chunks)
    while True:
        if clock() >= end:
            raise LimitError("the deadline has passed")
        chunk = next(source, b"")
        if not chunk:
            return
        left -= len(chunk)
        if left < 0:
            raise LimitError("more bytes came than the limit")
        yield chunk


def save(chunks: Iterable[bytes], path: str) -> int:
    """Write the chunks to a file that appears whole or not at all; the number of bytes."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    partial, size = f"{path}.partial", 0
    try:
        with open(partial, "wb") as f:
            for chunk in chunks:
                size += f.write(chunk)
        os.replace(partial, path)
    finally:
        if os.path.exists(partial):
            os.unlink(partial)
    return size


def within_budget(items: Iterable, call: Callable, budget: float = SEEK_BUDGET_SECONDS, each: float = SEEK_SECONDS, least: float = LEAST_SEEK_SECONDS, clock: Callable[[], float] = time.monotonic) -> list:
    """``call(item, timeout)`` of one item after the other until less than ``least`` seconds of the budget are left.

    A call gets ``each`` seconds or what is left; what gives None is left out.
    """
    end, out = clock() + budget, []
    for item in items:
        if (left := end - clock()) < least:
            break
        if (found := call(item, min(each, left))) is not None:
            out.append(found)
    return out
