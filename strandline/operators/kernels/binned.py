"""k-mers dealt into bins as stretches of bases, for k up to 31.

Neighbouring k-mers mostly have the same minimizer (the m-mer of least hash, of both strands), which names the bin, so a
stretch of them travels as its bases at two bits each, where the k-mers would take eight bytes and more. All
occurrences of a k-mer meet in one bin, which is read in passes over parts of its k-mers when it is large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .packed import _CODE, _words

#: Bases of a chunk that is dealt out at once, k-mers that a pass over a bin holds, and rows that a task gathers.
CHUNK, PASS, ROWS = 1 << 21, 1 << 21, 1 << 20
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0xC2B2AE3D27D4EB4F)
_HEAD = 8


def _mixed(x: np.ndarray, by: np.uint64) -> np.ndarray:
    return ((x.astype(np.uint64) + np.uint64(1)) * by) >> np.uint64(32)


def _bins(clean: np.ndarray, k: int, bins: int) -> np.ndarray:
    """The bin of the k-mer at each position, the same for its reverse complement."""
    m = max(min(k, 6), min(8, k - 8))
    least = _mixed(np.minimum(_words(clean, m, False), _words(3 - clean, m, True)), _M1).astype(np.uint32)
    size, left = 1, k - m + 1
    while size < left:
        step = min(size, left - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    return (_mixed(least, _M2) % np.uint64(bins)).astype(np.int32)


def pieces(rows: Iterator[tuple[int, bytes]], k: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """(key, length of the text, offset, part of it) in chunks; parts overlap by k - 1 bases."""
    chunk: list[tuple[int, int, int, bytes]] = []
    size = 0
    for key, t in rows:
        for at in range(0, max(0, len(t) - k + 1), CHUNK):
            chunk.append((key, len(t), at, t[at : at + CHUNK + k - 1]))
            size += len(chunk[-1][3]) + 1
            if size >= CHUNK:
                yield chunk
                chunk, size = [], 0
    if chunk:
        yield chunk


def _squeezed(x: np.ndarray) -> bytes:
    """Compressed, all first bytes before all second ones and so on, most of which are zero."""
    return pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _expanded(b: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(b, n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(-1)


def deal(chunk: list[tuple[int, int, int, bytes]], k: int, bins: int, positions: bool) -> Iterator[tuple[int, bytes]]:
    """(bin, stretches) of the k-mers without other letters of a chunk; with their positions and the lengths of their texts if ``positions``."""
    code = _CODE[np.frombuffer(b"N".join(t for *_, t in chunk), np.uint8)]  # a word across two texts has an N
    bad = np.concatenate([[0], np.cumsum(code > 3, dtype=np.int32)])
    at = np.flatnonzero(bad[k:] == bad[:-k])
    if not len(at):
        return
    clean = code & 3
    of = _bins(clean, k, bins)[at]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(of) != 0)]))
    start, length, of = at[first], np.diff(np.append(first, len(at))), of[first]
    order = np.argsort(of, kind="stable")
    start, length, of = start[order], length[order], of[order]
    begin = np.cumsum([0] + [len(t) + 1 for *_, t in chunk[:-1]])
    text = np.searchsorted(begin, start, "right") - 1
    key = np.array([x for x, *_ in chunk], np.int64)[text]
    pos = start - begin[text] + np.array([a for _, _, a, _ in chunk], np.int64)[text]
    whole = np.array([n for _, n, _, _ in chunk], np.int64)[text]
    cut = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0, [True]]))
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        span = length[lo:hi] + (k - 1)
        ends = np.cumsum(span)
        letters = clean[np.arange(ends[-1]) + np.repeat(start[lo:hi] - ends + span, span)]
        letters = np.concatenate([letters, np.zeros(-len(letters) % 4, np.uint8)]).reshape(-1, 4)
        bases = (letters[:, 0] | letters[:, 1] << 2 | letters[:, 2] << 4 | letters[:, 3] << 6).tobytes()
        own = key[lo:hi]
        parts = [_squeezed(np.diff(own, prepend=own[:1])), _squeezed(length[lo:hi].astype(np.int32)), *((_squeezed(x[lo:hi]) if positions else b"") for x in (pos, whole))]
        head = np.array([hi - lo, own[0], length[lo:hi].sum(), ends[-1], *(len(x) for x in parts)], np.int64).tobytes()
        yield int(of[lo]), b"".join([head, *parts, bases])


def sizes(blob: bytes) -> int:
    """k-mers of a blob."""
    return int(np.frombuffer(blob, np.int64, _HEAD)[2])


def opened(blob: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """(key, canonical k-mer, whether it is the forward one, position, length of the text) of the k-mers of ``deal``'s stretches."""
    runs, key0, total, letters, *parts = (int(x) for x in np.frombuffer(blob, np.int64, _HEAD))
    at, fields = 8 * _HEAD, []
    for size, kind in zip(parts, (np.int64, np.int32, np.int64, np.int64), strict=True):
        fields.append(_expanded(blob[at : at + size], runs, kind) if size else None)
        at += size
    length = fields[1].astype(np.int64)
    key = np.repeat(np.cumsum(fields[0]) + key0, length)
    packed = np.frombuffer(blob, np.uint8, offset=at)
    code = np.stack([packed & 3, packed >> 2 & 3, packed >> 4 & 3, packed >> 6], 1).reshape(-1)[:letters]
    offset = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    begin = np.cumsum(length + (k - 1)) - length - (k - 1)
    where = np.repeat(begin, length) + offset
    forward, backward = _words(code, k, False)[where], _words(3 - code, k, True)[where]
    return key, np.minimum(forward, backward), forward <= backward, *((None, None) if fields[2] is None else (np.repeat(fields[2], length) + offset, np.repeat(fields[3], length)))


def passes(blobs: list[bytes]) -> int:
    return -(-sum(map(sizes, blobs)) // PASS)


def read(blobs: list[bytes], k: int, part: int, parts: int) -> Iterator[tuple[np.ndarray, ...]]:
    """What ``opened`` gives, of the k-mers of one of ``parts`` passes."""
    for b in blobs:
        rows = opened(b, k)
        if parts > 1:
            use = np.flatnonzero(_mixed(rows[1], _M3) % np.uint64(parts) == part)
            rows = tuple(None if x is None else x[use] for x in rows)
        yield rows


def _firsts(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer, number, least key, greatest key), each k-mer once."""
    kmer, n, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(kmer)
    kmer, n, lo, hi = kmer[order], n[order], lo[order], hi[order]
    at = _firsts(kmer)
    if not len(at):
        return kmer, n, lo, hi
    return kmer[at], np.add.reduceat(n, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)


def counted(blobs: list[bytes], k: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer, number, least key, greatest key) of a pass over a bin, sorted by k-mer; memory goes with its distinct k-mers."""
    empty = np.zeros(0, np.int64)
    held, size, bound = [(empty, empty, empty, empty)], 0, 2 * PASS
    for key, kmer, *_ in read(blobs, k, part, parts):
        held.append((kmer, np.ones(len(kmer), np.int64), key, key))
        size += len(kmer)
        if size > bound:
            held = [merged(held)]
            size = len(held[0][0])
            bound = max(bound, 2 * size)
    return merged(held)


def occurrences(blobs: list[bytes], k: int, least: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, k-mer, forward, position, length of the text) sorted by k-mer, of those that occur ``least`` to ``most`` times; in passes."""
    parts = passes(blobs)
    for part in range(parts):
        held, size, bound, often = [], 0, 2 * PASS, np.zeros(0, np.int64)
        for rows in read(blobs, k, part, parts):
            if len(often):  # those that have passed the limit are held no longer
                use = ~np.isin(rows[1], often)
                rows = tuple(x[use] for x in rows)
            held.append(rows)
            size += len(rows[1])
            if size > bound:
                rows, over = _few(held, 0, most)
                held, size, often = [rows], len(rows[1]), np.union1d(often, over)
                bound = max(bound, 2 * size)
        yield _few(held, least, most)[0]


def _few(held: list[tuple[np.ndarray, ...]], least: int, most: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(rows[1])
    kmer = rows[1][order]
    at = _firsts(kmer)
    n = np.diff(np.append(at, len(order)))
    use = order[np.repeat((n >= least) & (n <= most), n)]
    return tuple(x[use] for x in rows), kmer[at[n > most]]


def seeds(key: np.ndarray, kmer: np.ndarray, forward: np.ndarray, pos: np.ndarray, whole: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, flipped, a's length, b's length, apos, bpos) of occurrences sorted by k-mer, a < b; b is turned if flipped."""
    for step in range(1, len(kmer)):  # as many steps as the most frequent k-mer has occurrences, less one
        x = np.flatnonzero(kmer[:-step] == kmer[step:])
        if not len(x):
            return
        y = x + step
        x, y = x[key[x] != key[y]], y[key[x] != key[y]]
        a, b = np.where(key[x] < key[y], x, y), np.where(key[x] < key[y], y, x)
        flipped = forward[a] != forward[b]
        yield key[a], key[b], flipped, whole[a], whole[b], pos[a], np.where(flipped, whole[b] - k - pos[b], pos[b])


def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n), each (a, b) once."""
    a, b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    at = _firsts(a, b)
    return a[at], b[at], np.add.reduceat(n, at) if len(at) else n


def clustered(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sums of seeds by (a, b, flipped): (..., lengths of a and b, seeds, sum, least and greatest of apos - bpos, greatest apos, first seed)."""
    a, b, flipped, alen, blen, n, s, lo, hi, last, seed = (np.concatenate(x) for x in zip(*parts, strict=True))
    small = len(a) and min(a.min(), b.min()) >= 0 and max(a.max(), b.max()) < 1 << 30
    order = np.argsort(a << 32 | b << 1 | flipped) if small else np.lexsort((flipped, b, a))
    a, b, flipped, alen, blen = (x[order] for x in (a, b, flipped, alen, blen))
    at = _firsts(a, b, flipped)
    if len(at):
        n, s, lo, hi = (f.reduceat(x[order], at) for f, x in ((np.add, n), (np.add, s), (np.minimum, lo), (np.maximum, hi)))
        last, seed = np.maximum.reduceat(last[order], at), np.minimum.reduceat(seed[order], at)
    return a[at], b[at], flipped[at], alen[at], blen[at], n, s, lo, hi, last, seed


def _narrowed(columns: list[np.ndarray]) -> bytes:
    """Columns of 64 bits, each in as few bytes as its values need, compressed together."""
    head, planes = [], []
    for c in columns:
        u = c.astype(np.int64).view(np.uint64)
        top = int(u.max(initial=0))
        size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
        head += [len(u), size]
        planes.append(u.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes())
    body = b"".join(planes)
    return np.array([len(columns), len(body), *head], np.int64).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _widened(blob: bytes) -> list[np.ndarray]:
    n, size = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    head = np.frombuffer(blob, np.int64, 2 * n, 16).reshape(-1, 2).tolist()
    body, at, out = np.frombuffer(pa.decompress(blob[16 + 16 * n :], size, "zstd", asbytes=True), np.uint8), 0, []
    for rows, wide in head:
        planes = body[at : at + rows * wide].reshape(wide, rows)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{wide}").reshape(-1).astype(np.uint64).view(np.int64))
        at += rows * wide
    return out


def shipped(rows: Iterator[tuple[np.ndarray, ...]], bins: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(bins, blobs) of rows of ``clustered``, by a and b. A row of one seed has its place alone, which says the rest."""

    def blobs(a, b, flipped, alen, blen, n, s, lo, hi, last, seed) -> tuple[np.ndarray, list[bytes]]:
        of = (_mixed(_mixed(a, _M1) ^ b.astype(np.uint64), _M2) % np.uint64(bins)).astype(np.uint16 if bins <= 1 << 16 else np.int64)
        order = np.argsort(of, kind="stable")
        of, a, b, flipped, alen, blen, n, s, lo, hi, last, seed = (x[order] for x in (of, a, b, flipped, alen, blen, n, s, lo, hi, last, seed))
        apos, bpos = seed >> 32, seed & 0xFFFFFFFF
        more = n > 1
        at = np.flatnonzero(np.concatenate([[len(of) > 0], of[1:] != of[:-1], [len(of) > 0]]))
        found = []
        for x, y in zip(at[:-1], at[1:], strict=True):
            m = x + np.flatnonzero(more[x:y])
            found.append(_narrowed([np.diff(a[x:y], prepend=0), b[x:y], flipped[x:y] * 2 + more[x:y], alen[x:y], blen[x:y], apos[x:y], bpos[x:y], n[m], s[m] - n[m] * lo[m], apos[m] - bpos[m] - lo[m], hi[m] - lo[m], last[m] - apos[m]]))
        return of[at[:-1]].astype(np.int32), found

    for r in rows:
        out = blobs(*r)
        del r
        yield out


def unshipped(blob: bytes) -> tuple[np.ndarray, ...]:
    """Rows for ``clustered`` of a blob of ``shipped``."""
    a, b, flags, alen, blen, apos, bpos, n_, s_, lo_, hi_, last_ = _widened(blob)
    d = apos - bpos
    n, s, lo, hi, last, m = np.ones(len(a), np.int64), d.copy(), d.copy(), d.copy(), apos.copy(), np.flatnonzero(flags & 1)
    lo[m] -= lo_
    n[m], s[m], hi[m], last[m] = n_, s_ + n_ * lo[m], lo[m] + hi_, apos[m] + last_
    return np.cumsum(a), b, flags > 1, alen, blen, n, s, lo, hi, last, apos << 32 | bpos


def seed_rows(rows: tuple[np.ndarray, ...], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows for ``clustered`` of the seeds of occurrences; a seed has apos in the high and bpos in the low half, so seeds sort by apos, then bpos."""
    for a, b, flipped, alen, blen, apos, bpos in seeds(*rows, k):
        d = apos - bpos
        yield a, b, flipped, alen, blen, np.ones(len(a), np.int64), d, d, d, apos, apos << 32 | bpos


def gathered(rows: Iterator[tuple[np.ndarray, ...]], merge) -> Iterator[tuple[np.ndarray, ...]]:
    """``rows`` merged: those of a task together, as long as the merged rows are few."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[0])
        del r
        if size > ROWS:
            held = [merge(held)]
            size = len(held[0][0])
            if size > ROWS // 2:
                size = 0
                yield held.pop()
    if held:
        held = [merge(held)]
        yield held.pop()
