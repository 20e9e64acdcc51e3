"""Banded edit distance and alignment in numpy."""

from __future__ import annotations

import numpy as np


def codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("ascii", "replace"), np.uint8)


def edit_distance(a: str, b: str, limit: int | None = None) -> int:
    """Levenshtein distance; ``limit`` + 1 if it is above ``limit``.

    Rows of the table are vectors: what depends on the left neighbour is a running minimum of
    value - column, so no cell is visited in Python. The band is what the limit allows.
    """
    x, y = codes(a), codes(b)
    if len(x) > len(y):
        x, y = y, x
    limit = len(y) if limit is None else limit
    if len(y) - len(x) > limit:
        return limit + 1
    cols = np.arange(len(y) + 1)
    row = cols.copy()
    for i, c in enumerate(x):
        lo, hi = max(0, i + 1 - limit), min(len(y), i + 1 + limit)
        new = np.full(len(y) + 1, limit + 1)
        at = np.arange(max(lo, 1), hi + 1)
        best = np.minimum(row[at] + 1, row[at - 1] + (y[at - 1] != c))
        if lo == 0:
            new[0] = i + 1
            best = np.concatenate([[i + 1], best])
            at = np.concatenate([[0], at])
        new[at] = np.minimum.accumulate(best - at) + at
        row = np.minimum(new, limit + 1)
        if row.min() > limit:
            return limit + 1
    return int(min(row[len(y)], limit + 1))


def align(template: str, read: str, infix: bool = True) -> tuple[int, int, list[tuple[str, int, str]]]:
    """(begin, distance, operations) of ``read`` in ``template``, anywhere in it if ``infix``.

    Operations are (kind, template position, base): = match, X mismatch, I insertion before the position, D deletion.
    """
    t, r = codes(template), codes(read)
    n, m = len(t), len(r)
    table = np.empty((m + 1, n + 1), np.int32)
    cols = np.arange(n + 1)
    table[0] = 0 if infix else cols
    for i in range(1, m + 1):
        best = np.empty(n + 1, np.int32)
        best[0] = i
        best[1:] = np.minimum(table[i - 1, 1:] + 1, table[i - 1, :-1] + (t != r[i - 1]))
        table[i] = np.minimum.accumulate(best - cols) + cols
    j = int(table[m].argmin()) if infix else n
    distance, i, ops = int(table[m, j]), m, []
    while i > 0 or (not infix and j > 0):
        here = table[i, j]
        if i and j and here == table[i - 1, j - 1] + (t[j - 1] != r[i - 1]):
            ops.append(("=" if t[j - 1] == r[i - 1] else "X", j - 1, read[i - 1]))
            i, j = i - 1, j - 1
        elif j and here == table[i, j - 1] + 1:
            ops.append(("D", j - 1, template[j - 1]))
            j -= 1
        else:
            ops.append(("I", j, read[i - 1]))
            i -= 1
    return j, distance, ops[::-1]


def prefix_extension(a: str, b: str, max_errors: int) -> tuple[int, int, int]:
    """(bases of a, bases of b, errors): the farthest pair of prefixes that align with an error rate falling to the end, within ``max_errors``.

    Of the cells where either sequence ends, the one with the fewest errors; if none is within the bound, the
    longest diagonal reach (a branch).
    """
    x, y = codes(a), codes(b)
    row, best = np.arange(len(y) + 1), (0, 0, 0)
    cols, ends = np.arange(len(y) + 1), []
    for i, c in enumerate(x):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != c))
        row = np.minimum.accumulate(new - cols) + cols
        ok = np.flatnonzero(row <= max_errors)
        if len(ok):
            j = int(ok[(ok - 4 * row[ok]).argmax()])
            if i + 1 + j - 8 * row[j] > best[0] + best[1] - 8 * best[2]:
                best = (i + 1, j, int(row[j]))
        ends.append((int(row[-1]), i + 1, len(y)))
    ends += [(int(e), len(x), j) for j, e in enumerate(row)]
    e, i, j = min(ends, key=lambda z: (z[0] - 0.5 * (z[1] + z[2]) * 0.01, -z[1] - z[2])) if ends else (0, 0, 0)
    return (i, j, e) if ends and e <= max_errors and i + j > 0 else best
