"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Items and documents are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII
characters. A pattern is a window of ``window`` consecutive item words (a shorter item is one
window). Texts are scanned once; a match marks its document words, which map back to code point
offsets of the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow, spread, staged

#: Word bytes keep their value, A-Z is lower-cased, everything else is a space. Bytes from 0x80 on belong to words.
TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Pattern characters of one automaton (about 60 bytes of memory each); more patterns take further automata, one pass each.
MAX_PATTERN_CHARS = 4_000_000

HITS = "struct<n_words:bigint,n_hit:bigint,words:array<struct<lo:bigint,hi:bigint>>,spans:array<struct<lo:bigint,hi:bigint>>,items:array<string>>"
_AUTOMATA: dict[str, tuple] = {}


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def windows_of(words: list[bytes], window: int) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def _automaton(mark: str, patterns: list[tuple[bytes, str]]) -> tuple:
    """Built once in each Python worker."""
    if mark not in _AUTOMATA:
        items: dict[bytes, list[str]] = {}
        for w, item in patterns:
            items.setdefault(w, []).append(item)
        auto = ahocorasick.Automaton()
        for w, of in items.items():
            auto.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, of))
        if items:
            auto.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[mark] = (auto if items else None,)
    return _AUTOMATA[mark]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def scan(text: bytes | None, auto, before: dict | None = None) -> dict:
    """What ``auto`` finds in one text, added to what earlier automata found."""
    words = words_of(text)
    hit = [(x["lo"], x["hi"]) for x in before["words"]] if before else []
    items = set(before["items"]) if before else set()
    if words and auto is not None:
        line = b" %s " % b" ".join(words)
        found = list(auto.iter(line.decode("latin-1")))
        if found:
            gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            last = np.searchsorted(gaps, [e for e, _ in found])
            hit = _merge(hit + [(int(k) - n, int(k)) for k, (_, (n, _of)) in zip(last, found, strict=True)])
            for _, (_n, of) in found:
                items.update(of)
    return {"n_words": len(words), "n_hit": sum(hi - lo for lo, hi in hit), "words": [{"lo": lo, "hi": hi} for lo, hi in hit], "spans": [], "items": sorted(items)}


def offsets(text: bytes, hits: list[dict]) -> list[dict]:
    """Code point offsets in the original text of runs of words."""
    at = [m.span() for m in WORD.finditer(text.decode("utf-8", "replace"))]
    return [{"lo": at[h["lo"]][0], "hi": at[h["hi"] - 1][1]} for h in hits]


def find_hits(rows: DataFrame, benchmark: DataFrame, text_col: str, window: int = 13, item_col: str = "item_id", item_text_col: str = "text", max_pattern_chars: int = MAX_PATTERN_CHARS) -> DataFrame:
    """``rows`` with a struct column ``_hits``; no shuffle, and one automaton, so one scan, for a benchmark of ordinary size.

    The benchmark's windows are counted first: an automaton takes ``max_pattern_chars`` characters. A larger benchmark takes
    further automata, which are chained: each text passes through all of them, and the workers of one task hold one each, so
    memory grows with the benchmark (not with the documents). Null or empty texts
    have no words; null items have no windows; items that share a window are all reported.
    """
    wtype = "window binary, item string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, i) for i, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True) if i is not None for w in sorted(windows_of(words_of(t), window))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([i for _, i in rows], pa.string())], ["window", "item"])

    patterns = map_arrow(benchmark.select(F.col(item_col).cast("string"), F.col(item_text_col)), cut, wtype)
    patterns = staged(patterns.distinct(), "windows")
    chars = patterns.agg(F.sum(F.length("window") + 2)).first()[0] or 0
    shards = max(1, -(-chars // max_pattern_chars))
    out = rows.withColumn("_hits", F.lit(None).cast(HITS))
    schema = out.schema
    for k in range(shards):
        got = patterns.where(F.pmod(F.xxhash64("window"), F.lit(shards)) == k).collect()
        got = sorted((bytes(r[0]), r[1]) for r in got)
        mark = hashlib.sha256(repr(got).encode()).hexdigest()
        held = rows.sparkSession.sparkContext.broadcast(got)
        last = k == shards - 1

        def run(batches: Iterator[pa.RecordBatch], mark=mark, held=held, last=last) -> Iterator[pa.RecordBatch]:
            (auto,) = _automaton(mark, held.value) if mark not in _AUTOMATA else _AUTOMATA[mark]
            for b in batches:
                at = b.schema.get_field_index(text_col)
                texts, before = as_bytes(b.column(at)), b.column("_hits").to_pylist()
                found = [scan(t, auto, p) for t, p in zip(texts, before, strict=True)]
                if last:
                    for t, f in zip(texts, found, strict=True):
                        if f["words"]:
                            f["spans"] = offsets(t, f["words"])
                cols = [*b.columns]
                cols[b.schema.get_field_index("_hits")] = pa.array(found, b.column("_hits").type)
                yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

        out = map_arrow(out, run, schema)
    return out


def contaminated(hits, share: int | None = 20):
    """At least one word in ``share`` of the document's words is hit; without ``share`` any word."""
    some = hits["n_hit"] > 0
    return some if share is None else some & (hits["n_hit"] * share >= hits["n_words"])


def decontamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items, spans (code points of the original), contaminated."""
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")))
    h = F.col("_hits")
    found = find_hits(rows, benchmark, "_text", **options)
    return found.select("doc_id", h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"), h["items"].alias("items"), h["spans"].alias("spans"), contaminated(h).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", share: int | None = None, **options) -> DataFrame:
    """The rows of ``docs``, all columns as they were, in which no window of an item occurs.

    With ``share``, rows stay whose words are hit at a rate below one in ``share``. Null and empty texts have no
    words and stay; rows that repeat are decided alike; columns of any name come back unchanged.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    found = find_hits(rows, benchmark, "_text", **options)
    return found.where(~contaminated(F.col("_hits"), share)).select("_row.*")
