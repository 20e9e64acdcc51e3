"""Extension of a seed to an overlap: furthest reaching points of each diagonal, error by error.

The points that e errors reach on a diagonal follow from those that e - 1 errors reach on it and its neighbours,
and matches carry on from there, compared a chunk at a time. So work grows with the square of the errors, not with
the product of the lengths, and memory with the errors alone. ``extend`` says what an extension is; ``extend_all`` gives the
same for many at once, one error of all in a step, with the diagonals of an extension as a row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

from ...functions.seq import binomial_bound

DOVETAIL, BRANCH = "dovetail", "branch"
CHUNK = 64
#: An error costs a branch as much as this many bases; bases by which the extension gives up behind its best point,
#: and by which a diagonal is left behind the foremost.
PENALTY, DROP, BAND = 8, 240, 64
#: Bytes that end a sequence of a batch (no text has them, and they differ), and what no point of a diagonal is.
_END_X, _END_Y, _NONE = np.array([254], np.uint8), np.array([255], np.uint8), -(1 << 28)
#: Bases and pairs of a batch, and steps after which rows are moved to their diagonals' begin.
LETTERS, PAIRS, STEPS = 1 << 22, 2048, 8


def _matches(x: np.ndarray, y: np.ndarray, i: int, j: int) -> int:
    """Length of the match that begins at x[i] and y[j]."""
    n, size = 0, CHUNK
    end = min(len(x) - i, len(y) - j)
    while n < end:
        m = min(size, end - n)
        differ = x[i + n : i + n + m] != y[j + n : j + n + m]
        if differ.any():
            return n + int(differ.argmax())
        n += m
        size *= 2
    return n


def extend(x: np.ndarray, y: np.ndarray, max_errors: int) -> tuple[str, int, int, int]:
    """(kind, bases of x, bases of y, errors) of the alignment of prefixes.

    A dovetail reaches the end of x or y with the fewest errors, at most ``max_errors``; otherwise a branch
    ends where its bases outweigh its errors the most. What has fallen DROP behind that is not carried on.
    """
    reach = {0: _matches(x, y, 0, 0)}
    best = (2 * reach[0], reach[0], reach[0], 0)
    for e in range(max_errors + 1):
        if e:
            new = {}
            for d in range(min(reach) - 1, max(reach) + 2):  # x ahead of y by d
                i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2) + 1, reach.get(d + 1, -2))
                i = min(i, len(x), len(y) + d)
                if i >= 0 and i - d >= 0:
                    new[d] = i + _matches(x, y, i, i - d)
            reach = new
        ends = [(i, i - d) for d, i in reach.items() if i == len(x) or i - d == len(y)]
        if ends:
            i, j = max(ends, key=sum)
            return DOVETAIL, i, j, e
        if reach:
            i, j = max(((i, i - d) for d, i in reach.items()), key=sum)
            best = max(best, (i + j - PENALTY * e, i, j, e))
            if i + j - PENALTY * e < best[0] - DROP:
                break
            reach = {d: k for d, k in reach.items() if 2 * k - d >= i + j - BAND}
    return BRANCH, best[1], best[2], best[3]


def _joined(texts: list[np.ndarray], end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, the 8 letters from each position on as a number, begin and length of each text)."""
    n = np.array([len(t) for t in texts], np.int32)
    text = np.concatenate([v for t in texts for v in (t, end)] + [end] * 15)
    words = np.empty(len(text) - 7, np.uint64)
    for at in range(8):
        some = words[at::8]
        some[:] = text[at : at + 8 * len(some)].view("<u8")
    return text, words, (np.cumsum(n + 1) - n - 1).astype(np.int32), n


def extend_all(xs: list[np.ndarray], ys: list[np.ndarray], max_errors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whether a dovetail, bases of x, bases of y, errors) as of ``extend``, for each x and y."""
    found = np.zeros((4, len(xs)), np.int64)
    if not len(xs):
        return found[0] > 0, *found[1:]
    x, xw, x0, xn = _joined(xs, _END_X)
    y, yw, y0, yn = _joined(ys, _END_Y)
    of, most, base = np.arange(len(xs)), np.asarray(max_errors), np.zeros(len(xs), np.int32)
    score, bi, bj, be = np.full(len(xs), _NONE), *np.zeros((3, len(xs)), np.int64)
    reach, e = np.zeros((len(xs), 1), np.int32), 0
    while len(of):
        d = base[:, None] + np.arange(reach.shape[1], dtype=np.int32)
        end = np.minimum(xn[:, None], yn[:, None] + d)
        np.minimum(reach, end, out=reach)
        on = reach >= np.maximum(d, 0)
        cell = np.flatnonzero(on)
        i = reach + x0[:, None]
        px = i.ravel()[cell]
        py = (i - (d + (x0 - y0)[:, None])).ravel()[cell]
        hit = np.flatnonzero(x[px] == y[py])
        px, py = px[hit], py[hit]
        differ = xw[px] ^ yw[py]
        low = (differ & (~differ + np.uint64(1))).astype(np.float64).view(np.int64)
        n = ((low >> 52) - 1023) >> 3
        for at in np.flatnonzero(differ == 0).tolist():
            n[at] = 8 + _matches(x, y, int(px[at]) + 8, int(py[at]) + 8)
        reach.ravel()[cell[hit]] += n.astype(np.int32)
        reach[~on] = _NONE
        sums = 2 * reach - d
        ends = reach == end
        done = ends.any(1)
        for r in np.flatnonzero(done).tolist():
            c = int(np.where(ends[r], sums[r], 2 * _NONE).argmax())
            found[:, of[r]] = 1, reach[r, c], sums[r, c] - reach[r, c], e
        row = np.arange(len(of))
        c = sums.argmax(1)
        top, i = sums[row, c].astype(np.int64), reach[row, c]
        now = top - PENALTY * e
        better = (now > score) | (now == score) & (i >= bi)
        score, bi, bj, be = np.where(better, now, score), np.where(better, i, bi), np.where(better, top - i, bj), np.where(better, e, be)
        lost = ~done & ((now < score - DROP) | (e >= most))
        found[1:, of[lost]] = bi[lost], bj[lost], be[lost]
        reach[sums < top[:, None] - BAND] = _NONE
        if done.any() or lost.any():
            use = ~(done | lost)
            reach, of, most, base, x0, xn, y0, yn, score, bi, bj, be = (v[use] for v in (reach, of, most, base, x0, xn, y0, yn, score, bi, bj, be))
            if not len(of):
                break
        e += 1
        if e % STEPS == 0:
            some = reach >= 0
            first, last = some.argmax(1), reach.shape[1] - 1 - some[:, ::-1].argmax(1)
            at = first[:, None] + np.arange((last - first).max() + 1)
            reach = np.where(at <= last[:, None], np.take_along_axis(reach, np.minimum(at, last[:, None]), 1), _NONE).astype(np.int32)
            base = base + first.astype(np.int32)
        wide = np.full((len(of), reach.shape[1] + 4), _NONE, np.int32)
        wide[:, 2:-2] = reach
        reach = np.maximum(np.maximum(wide[:, 1:-1], wide[:, :-2]) + 1, wide[:, 2:])
        base = base - 1
        reach = np.ascontiguousarray(reach)
    return found[0] > 0, *found[1:]


@functools.lru_cache(maxsize=1 << 16)
def error_bound(length: int, erate: float) -> int:
    return binomial_bound(length, erate)


def overlap(a: str, b: str, apos: int, bpos: int, k: int, erate: float) -> tuple[str, int, int, int, int, int]:
    """(kind, a_bgn, a_end, b_bgn, b_end, errors) of the alignment through a seed of ``k`` bases; a dovetail on both sides, or a branch."""
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    left, right = min(apos, bpos), min(len(x) - apos, len(y) - bpos) - k
    kind5, i5, j5, e5 = extend(x[:apos][::-1], y[:bpos][::-1], error_bound(max(left, 0), erate) + 1)
    kind3, i3, j3, e3 = extend(x[apos + k :], y[bpos + k :], error_bound(max(right, 0), erate) + 1)
    kind = DOVETAIL if kind5 == kind3 == DOVETAIL else BRANCH
    return kind, apos - i5, apos + k + i3, bpos - j5, bpos + k + j3, e5 + e3


def overlaps(a: list[np.ndarray], b: list[np.ndarray], seeds: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], left: np.ndarray, right: np.ndarray, k: int, erate: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, whether a dovetail, a_bgn, a_end, b_bgn, b_end, errors) as of ``overlap``, in batches of rows.

    a and b are the parts of the sequences that the extension can come to, ``seeds`` the seed's places in a, b and their parts,
    ``left`` and ``right`` the bases that an overlap has on either side of the seed.
    """
    apos, bpos, p, q = seeds
    size = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    order = np.argsort(size, kind="stable")  # those of like length together
    upto, at = np.cumsum(size[order]), 0
    while at < len(order):
        to = min(at + PAIRS, max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LETTERS, "right"))))
        rows, at = order[at:to], to
        xs = [a[r][: p[r]][::-1] for r in rows] + [a[r][p[r] + k :] for r in rows]
        ys = [b[r][: q[r]][::-1] for r in rows] + [b[r][q[r] + k :] for r in rows]
        most = [error_bound(max(n, 0), erate) + 1 for n in (*left[rows].tolist(), *right[rows].tolist())]
        (kind5, kind3), (i5, i3), (j5, j3), (e5, e3) = (v.reshape(2, -1) for v in extend_all(xs, ys, np.array(most)))
        yield rows, kind5 & kind3, apos[rows] - i5, apos[rows] + k + i3, bpos[rows] - j5, bpos[rows] + k + j3, e5 + e3
