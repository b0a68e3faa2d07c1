"""Local alignment of word sequences (Smith-Waterman, linear gaps), whole or within a band, a row of the table at a time."""

from __future__ import annotations

import numpy as np

#: Scores are multiples of this; what is left over counts the matched words, so equal scores go to more matches.
_UNIT = 1 << 20
MATCH, COST = 2, 1


def _ends(a: np.ndarray, b: np.ndarray, diagonal: int, band: int | None, cost: int) -> tuple[int, int, int]:
    """Best value, and where the best alignment ends in a and b."""
    n = len(b)
    ramp = np.arange(n + 1, dtype=np.int64) * (cost * _UNIT)
    row = np.zeros(n + 1, np.int64)
    best = at_a = at_b = 0
    for i, x in enumerate(a):
        new = np.zeros(n + 1, np.int64)
        same = np.where(b == x, MATCH * _UNIT + 1, -cost * _UNIT)
        np.maximum(row[:-1] + same, row[1:] - cost * _UNIT, out=new[1:])
        np.maximum(new, 0, out=new)
        if band is not None:
            new[: max(0, i + 1 + diagonal - band)] = 0
            new[max(0, i + 2 + diagonal + band) :] = 0
        new = np.maximum.accumulate(new + ramp) - ramp  # gaps in a; sinks by a gap a column, so restarts stay at 0
        np.maximum(new, 0, out=new)
        j = int(new.argmax())
        if new[j] > best:
            best, at_a, at_b = int(new[j]), i + 1, j
        row = new
    return best, at_a, at_b


def align(a: np.ndarray, b: np.ndarray, diagonal: int = 0, band: int | None = None, cost: int = COST) -> tuple[int, int, int, int, int, int]:
    """Score, matched words, and the aligned stretches [a0, a1) and [b0, b1) of the best local alignment.

    With a band, a's word i may only meet b's words within band of i + diagonal. A mismatched or skipped word costs so much.
    """
    best, a1, b1 = _ends(a, b, diagonal, band, cost)
    if not best:
        return 0, 0, 0, 0, 0, 0
    # The best alignment of what lies before the end, backwards, ends where the alignment begins.
    _, da, db = _ends(a[:a1][::-1], b[:b1][::-1], b1 - a1 - diagonal if band is not None else 0, band, cost)
    return best // _UNIT, best % _UNIT, a1 - da, a1, b1 - db, b1


def clusters(diagonal: np.ndarray, gap: int):
    """Index groups of hits whose diagonals lie within gap of their neighbour's."""
    order = np.argsort(diagonal, kind="stable")
    cut = np.flatnonzero(np.diff(diagonal[order]) > gap) + 1
    return np.split(order, cut)
