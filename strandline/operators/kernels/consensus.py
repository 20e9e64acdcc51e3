"""Consensus of reads over a template: a graph of backbone columns and inserted bases, and its best path."""

from __future__ import annotations

import math
from collections import Counter

from .align import align

#: Counts saturate here.
MOST = 255


class Columns:
    """What reads say at each template position: bases and gaps at it, and inserted runs before it."""

    def __init__(self, template: str) -> None:
        self.template = template
        self.base = [Counter() for _ in template]
        self.insert = [Counter() for _ in range(len(template) + 1)]
        self.cover = [0] * len(template)

    def add(self, read: str, max_rate: float = 0.35, infix: bool = True) -> bool:
        """Aligns a read and counts it unless it differs too much; shared ends are not trusted for insertions."""
        if not read:
            return False
        begin, distance, ops = align(self.template, read, infix)
        if distance > max_rate * len(read):
            return False
        run: dict[int, str] = {}
        for kind, at, base in ops:
            if kind == "I":
                run[at] = run.get(at, "") + base
                continue
            self.cover[at] = min(MOST, self.cover[at] + 1)
            said = "-" if kind == "D" else base
            self.base[at][said] = min(MOST, self.base[at][said] + 1)
        for at, bases in run.items():
            if begin < at < len(self.template):
                self.insert[at][bases] = min(MOST, self.insert[at][bases] + 1)
        return True

    def call(self, min_coverage: int = 1, trim: bool = True) -> tuple[str, list[int]]:
        """(bases, quality): at each column the choice with the best count less half the coverage; lower case where coverage is low."""
        out, quality = [], []
        for at, own in enumerate(self.base):
            half = round(0.5 * self.cover[at])
            for bases, n in self.insert[at].most_common(1):
                if n - half > 0:
                    out += bases if self.cover[at] > min_coverage else bases.lower()
                    quality += [_qv(n, self.cover[at])] * len(bases)
            if not own:
                if not trim:
                    out.append(self.template[at].lower())
                    quality.append(0)
                continue
            base, n = max(own.items(), key=lambda x: (x[1], x[0] == self.template[at], x[0]))
            if base != "-":
                out.append(base if self.cover[at] > min_coverage else base.lower())
                quality.append(_qv(n, self.cover[at]))
        return "".join(out), quality


def _qv(n: int, cover: int) -> int:
    """-10 log10 of the share of other opinions, with one half of an opinion against."""
    return round(-10 * math.log10((cover - n + 0.5) / (cover + 1)))


def consensus(template: str, reads: list[str], rounds: int = 2, max_rate: float = 0.35, min_coverage: int = 0) -> tuple[str, list[int]]:
    """Consensus of ``reads``; each round takes the last one's result as the template."""
    quality: list[int] = []
    for _ in range(rounds):
        c = Columns(template)
        used = sum(c.add(r, max_rate) for r in reads)
        if not used:
            return template, [0] * len(template)
        template, quality = c.call(min_coverage, trim=False)
        template = template.upper() if min_coverage == 0 else template
    return template, quality


def stitch(placed: list[tuple[int, int, str]], min_overlap: int = 20, error: float = 0.1) -> str:
    """One template from reads (lo, hi, bases) in the order of lo: the next read is the one that reaches farthest among those
    that overlap the end; the joint is where its head aligns in the tail."""
    if not placed:
        return ""
    placed = sorted(placed)
    lo, end, out = placed[0]
    at = 1
    while at < len(placed):
        best = None
        while at < len(placed) and placed[at][0] < end - min_overlap:
            if placed[at][1] > end and (best is None or placed[at][1] > best[1]):
                best = placed[at]
            at += 1
        if best is None:
            if at >= len(placed):
                break
            best = placed[at]  # no overlap is left: what follows starts anew
            at += 1
        olap = max(min_overlap, end - best[0])
        head = best[2][: max(min_overlap, int(0.8 * olap))]
        tail = out[-int(1.2 * olap) - 1 :]
        begin, distance, _ = align(tail, head)
        if distance <= error * 1.25 * len(head) + 1:
            out = out[: len(out) - len(tail) + begin] + best[2]
        else:
            out += best[2][olap:]
        end = best[1]
    return out


def trim_circular(bases: str, min_overlap: int = 50, error: float = 0.05) -> tuple[int, int]:
    """(begin, end) of one turn of a circle whose end repeats its begin; the whole if it does not."""
    head = bases[:min_overlap]
    rest = bases[len(bases) // 2 :]
    if len(head) < min_overlap or len(rest) < min_overlap:
        return 0, len(bases)
    begin, distance, _ = align(rest, head)
    return (0, len(bases) // 2 + begin) if distance <= error * len(head) else (0, len(bases))
