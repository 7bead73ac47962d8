"""``difflib.SequenceMatcher(None, a, b).ratio()`` of many pairs at once, with the same results.

Only sizes of matching blocks are needed.  Where b has less than 200 elements,
all diagonal runs of equal elements are found at once, and the splits at the
longest run go on in step for all pairs: a few array operations a level instead
of a loop over every match of every part.  From 200 elements on difflib leaves
popular elements out, and few are left to loop over.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np

AUTOJUNK, LONGEST, CELLS, PLACE = 200, 4_096, 1 << 21, (1 << 20) - 1


def _codes(a: Sequence[str], b: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(a, str):
        return tuple(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b))
    of: dict[str, int] = {}
    return tuple(np.array([of.setdefault(w, len(of)) for w in x], np.uint32) for x in (a, b))


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in a, start in b and length of each run of equal elements that can't be made longer."""
    width = len(b) + 1
    cells = np.zeros((len(a) + 2, width), bool)  # a row before and after, a column after: no run goes on into the next row
    np.equal(a[:, None], b[None, :], out=cells[1:-1, :-1])
    flat = cells.ravel()
    hits = np.flatnonzero(flat)

    before, after = flat[hits - width - 1], flat[hits + width + 1]

    def by_diagonal(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.divmod(cell.astype(np.int32), np.int32(width))
        order = np.argsort((j - i + len(a) + 1) * (len(a) + 2) + i)
        return i[order], j[order]

    lone_i, lone_j = np.divmod(hits[~before & ~after].astype(np.int32), np.int32(width))
    i, j = by_diagonal(hits[~before & after])
    last, _ = by_diagonal(hits[before & ~after])
    return np.concatenate((lone_i, i)) - 1, np.concatenate((lone_j, j)), np.concatenate((np.ones_like(lone_i), last - i + 1))


def _in_step(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum of the sizes of the matching blocks of each pair."""
    matches, runs = np.zeros(len(pairs)), [_runs(a, b) for a, b in pairs]
    i, j, size = (np.concatenate(x) for x in zip(*runs, strict=True))
    pair = np.repeat(np.arange(len(pairs)), [len(x[0]) for x in runs])
    part = pair
    while len(i):
        # The longest run of each part, of those the first in a, then in b.
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        best = np.maximum.reduceat((size.astype(np.int64) << 40) | ((PLACE - i).astype(np.int64) << 20) | (PLACE - j), first)
        matches += np.bincount(pair[first], weights=best >> 40, minlength=len(pairs))
        g = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(i))))
        at_i, at_j, taken = (x.astype(np.int32)[g] for x in (PLACE - ((best >> 20) & PLACE), PLACE - (best & PLACE), best >> 40))
        # What is left of the runs before and after it.
        before = np.minimum(size, np.minimum(at_i - i, at_j - j))
        skip = np.maximum(0, np.maximum(at_i - i, at_j - j) + taken)
        left, right = np.flatnonzero(before > 0), np.flatnonzero(size > skip)
        part = np.concatenate((2 * g[left], 2 * g[right] + 1))
        order = np.argsort(part, kind="stable")
        part = part[order]
        i, j, size, pair = (np.concatenate(x)[order] for x in ((i[left], (i + skip)[right]), (j[left], (j + skip)[right]), (before[left], (size - skip)[right]), (pair[left], pair[right])))
    return matches


def _rare(a: Sequence[str], b: Sequence[str]) -> int:
    """The same of one pair where difflib leaves out b's popular elements."""
    most = len(b) // 100 + 1
    of: dict[str, list[int]] = {x: [] for x, n in Counter(b).items() if n <= most}
    for j, x in enumerate(b):
        if x in of:
            of[x].append(j)
    places = [i for i, x in enumerate(a) if x in of]
    matches, queue = 0, [(0, len(a), 0, len(b))]
    while queue:
        alo, ahi, blo, bhi = queue.pop()
        i, j, size, ends, last = alo, blo, 0, {}, -2
        for p in places[bisect_left(places, alo) : bisect_left(places, ahi)]:
            before, ends = ends if p == last + 1 else {}, {}
            last = p
            for q in of[a[p]]:
                if q >= bhi:
                    break
                if q >= blo:
                    k = ends[q] = before.get(q - 1, 0) + 1
                    if k > size:
                        i, j, size = p - k + 1, q - k + 1, k
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if size:
            matches += size
            if alo < i and blo < j:
                queue.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                queue.append((i + size, ahi, j + size, bhi))
    return matches


def ratios(pairs: Sequence[tuple[Sequence[str], Sequence[str]]]) -> np.ndarray:
    """The ratio of each pair of strings, or of lists of strings."""
    matches, waiting, cells = np.zeros(len(pairs)), [], 0

    def flush() -> None:
        if waiting:
            matches[waiting] = _in_step([_codes(*pairs[k]) for k in waiting])
            waiting.clear()

    for k, (a, b) in enumerate(pairs):
        if not a or not b:
            continue
        if len(b) >= AUTOJUNK:
            matches[k] = _rare(a, b)
        elif len(a) > LONGEST:
            matches[k] = sum(block.size for block in SequenceMatcher(None, a, b).get_matching_blocks())
        else:
            if cells > CELLS:
                flush()
                cells = 0
            waiting.append(k)
            cells += len(a) * len(b)
    flush()
    length = np.array([len(a) + len(b) for a, b in pairs], float)
    return np.where(length > 0, 2.0 * matches / np.maximum(length, 1), 1.0)
