"""k-mers as 64-bit integers, two bits a base (A, C, G, T in order, so integers sort as strings do), for k up to 31.

Words of k bases are made by doubling: from those of m bases at all positions come those of 2 m in one step,
so a batch of sequences takes about 2 log k vector operations, where strings take k steps a position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MAX_K = 31
#: Bases that are expanded at once.
BLOCK = 1 << 18
_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)

#: The four letters of a byte of ``folded`` texts, and the complement of a letter.
_FOUR = np.frombuffer(b"ACGT", np.uint8)[np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3].copy().view("<u4").reshape(-1)
COMPLEMENT = np.frombuffer(bytes(range(256)).translate(bytes.maketrans(b"ACGT", b"TGCA")), np.uint8)


def folded(text: bytes) -> tuple[int, bytes]:
    """(letters a byte, bytes): four bases to a byte and a last byte that says how many are lacking, or the text as it is if it has other letters."""
    code = _CODE[np.frombuffer(text, np.uint8)]
    if len(code) and code.max() > 3:
        return 1, text
    lacking = -len(code) % 4
    c = np.concatenate([code, np.zeros(lacking, np.uint8)]).reshape(-1, 4)
    return 4, (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes() + bytes([lacking])


def unfolded(part: bytes, letters: int) -> np.ndarray:
    """Letters of bytes of what ``folded`` gave, but its last."""
    x = np.frombuffer(part, np.uint8)
    return x if letters == 1 else _FOUR[x].view(np.uint8)


def text(blob: bytes, letters: int) -> bytes:
    """What ``folded`` gave this for."""
    return blob if letters == 1 else unfolded(blob[:-1], 4).tobytes()[: 4 * len(blob) - 4 - blob[-1]]


def _words(code: np.ndarray, k: int, reverse: bool) -> np.ndarray:
    """Words of k codes at each position, the first code highest, or lowest if ``reverse``."""
    have, size, power, of = None, 0, code.astype(np.int64), 1
    while True:
        if k & of:
            if have is None:
                have, size = power, of
            else:  # what is left of k's bits goes behind
                n = len(code) - size - of + 1
                ahead, behind = have[:n], power[size : size + n]
                have = ahead | behind << 2 * size if reverse else ahead << 2 * of | behind
                size += of
        if size == k:
            return have
        n = len(power) - of
        power = power[:n] | power[of:] << 2 * of if reverse else power[:n] << 2 * of | power[of:]
        of *= 2


def kmers(texts: list[bytes], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, position, canonical k-mer, whether it is the forward one) of all k-mers without other letters."""
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k is {k}, packed k-mers take 1 to {MAX_K}")
    piece: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - k + 1), BLOCK):
            piece.append((i, at, t[at : at + BLOCK + k - 1]))
            size += len(piece[-1][2])
            if size >= BLOCK:
                yield _expanded(piece, k)
                piece, size = [], 0
    if piece:
        yield _expanded(piece, k)


def _expanded(piece: list[tuple[int, int, bytes]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    code = _CODE[np.frombuffer(b"N".join(t for *_, t in piece), np.uint8)]  # a word across two sequences has an N
    bad = np.concatenate([[0], np.cumsum(code > 3)])
    at = np.flatnonzero(bad[k:] == bad[:-k])
    clean = code & 3
    forward, backward = _words(clean, k, False)[at], _words(3 - clean, k, True)[at]
    start = np.cumsum([0] + [len(t) + 1 for *_, t in piece[:-1]])
    of = np.searchsorted(start, at, "right") - 1
    text, offset = np.array([i for i, *_ in piece]), np.array([a for _, a, _ in piece])
    return text[of], at - start[of] + offset[of], np.minimum(forward, backward), forward <= backward
