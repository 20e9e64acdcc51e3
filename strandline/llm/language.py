"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of up to three bytes. A symbol seen in a context costs by its count,
an unseen one escapes (method C: the number of distinct symbols counts as escapes) to the next shorter
context, whose distribution excludes what the longer one has seen; below order 0 all bytes are equal.
Statistics are frozen after training, so the code length of a byte is a function of its context and
is tabulated once; texts are then scored by table look-ups over whole batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow, spread

ORDER = 3
#: Expected number of training documents of a language (of longer texts a piece of TRAIN_CHARS is trained on), and contexts of
#: three symbols that the tables keep, the most frequent ones of all languages. A language has rows of 2 bytes a symbol for the
#: contexts that occur in it, and 4 bytes for each context that occurs in any: some 3 MB for prose of 40 symbols.
TRAIN_DOCS, TRAIN_CHARS, MAX_CONTEXTS = 500, 50_000, 60_000
SCALE, SEGMENT = 256, 1 << 20
LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Model:
    """Tables of frozen statistics: contexts of 2 and 3 symbols to rows, and bits of each symbol in each row."""

    languages: list[str]
    symbol: np.ndarray  # byte to class; 0 is the start and any byte not trained on
    three: np.ndarray  # three symbols to a context: one of the kept ones, or else of the last two symbols
    rows: list[np.ndarray]  # of each language, context to row; a context that does not occur in it has the row of a shorter one
    bits: list[np.ndarray]  # of each language, row * classes + class; in 1 / SCALE bits
    classes: int

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        pad, piece, of, size = b"\0" * ORDER, [], [], 0
        for i, t in enumerate(texts):
            for k in range(0, len(t), SEGMENT):
                piece.append((t[k - ORDER : k] if k else pad) + t[k : k + SEGMENT])
                of.append(i)
                size += len(piece[-1])
                if size >= SEGMENT:
                    self._add(out, piece, of)
                    piece, of, size = [], [], 0
        if piece:
            self._add(out, piece, of)
        return out

    def _add(self, out: np.ndarray, piece: list[bytes], of: list[int]) -> None:
        n = self.classes
        c = self.symbol[np.frombuffer(b"".join(piece), np.uint8)]
        ctx = self.three[(c[:-3] * n + c[1:-2]) * n + c[2:-1]]
        last = c[3:]
        start = np.cumsum([0, *map(len, piece)])
        # positions of a piece's own bytes; those between pieces belong to none
        edge = np.stack([start[:-1], start[1:] - ORDER], 1).ravel()[:-1]
        for k in range(len(self.languages)):
            cell = self.rows[k][ctx] * n
            cell += last
            sums = np.add.reduceat(self.bits[k][cell], edge, dtype=np.int64)[::2]
            np.add.at(out[:, k], of, sums / SCALE)


def gram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ORDER + 1 bytes, the text's start padded with zeros, and their counts."""
    b = np.frombuffer(b"\0" * ORDER + text, np.uint8).astype(np.int64)
    return np.unique(((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]), return_counts=True)


def _interpolate(counts: np.ndarray, parent: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Method C with exclusion: rows of counts over rows of the parents' probabilities."""
    total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    rest = np.where(counts > 0, 0.0, parent * weight).sum(1, keepdims=True)
    escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
    seen = counts / np.maximum(total + distinct, 1)
    return np.where(counts > 0, seen, escape * parent / np.maximum(rest, 1e-300))


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], max_contexts: int = MAX_CONTEXTS) -> Model:
    """The model of each language's counts of four-byte runs."""
    languages = sorted(counts)
    grams = np.unique(np.concatenate([g for g, _ in counts.values()])) if counts else np.empty(0, np.int64)
    symbol = np.zeros(256, np.int64)
    used = np.unique(grams & 255)
    used = used[used > 0]
    symbol[used] = np.arange(1, len(used) + 1)
    n = len(used) + 1
    weight = np.ones(n)
    weight[0] = 256 - len(used)
    parts = {k: (symbol[(g >> 24) & 255], symbol[(g >> 16) & 255], symbol[(g >> 8) & 255], symbol[g & 255], c) for k, (g, c) in counts.items()}
    freq = np.zeros(n**3, np.int64)
    for a, b, c, _, m in parts.values():
        np.add.at(freq, (a * n + b) * n + c, m)
    seen3 = np.flatnonzero(freq)
    seen3 = np.sort(seen3[np.argsort(-freq[seen3], kind="stable")][:max_contexts])
    row3 = np.full(n**3, -1, np.int64)
    row3[seen3] = np.arange(len(seen3))
    rows, tables = [], []
    for k in languages:
        a, b, c, d, m = parts[k]
        one = np.zeros((n, n))
        np.add.at(one, (c, d), m)
        some2, of2 = np.unique(b * n + c, return_inverse=True)
        two = np.zeros((len(some2), n))
        np.add.at(two, (of2, d), m)
        at = row3[(a * n + b) * n + c]
        some3, of3 = np.unique(at[at >= 0], return_inverse=True)
        three = np.zeros((len(some3), n))
        np.add.at(three, (of3, d[at >= 0]), m[at >= 0])
        flat = np.full((1, n), 1 / 256)
        zero = _interpolate(one.sum(0, keepdims=True), flat, weight)
        p1 = _interpolate(one, np.repeat(zero, n, 0), weight)
        p2 = _interpolate(two, p1[some2 % n], weight)
        # rows of the last symbol, then of the last two that occur, then of the last three; a context takes the longest it has
        of_two = np.arange(n * n) % n
        of_two[some2] = n + np.arange(len(some2))
        parent = of_two[seen3[some3] % (n * n)]
        p3 = _interpolate(three, np.concatenate([p1, p2])[parent], weight)
        of_ctx = np.concatenate([of_two[seen3 % (n * n)], of_two])
        of_ctx[some3] = n + len(some2) + np.arange(len(some3))
        p = np.concatenate([p1, p2, p3])
        rows.append(of_ctx.astype(np.int32))
        tables.append(np.minimum(np.rint(-np.log2(np.maximum(p, 1e-30)) * SCALE), 65535).astype(np.uint16).ravel())
    three = np.where(row3 >= 0, row3, len(seen3) + np.arange(n**3) % (n * n))
    return Model(languages, symbol, three.astype(np.int32), rows, tables, n)


def has_letter(text: bytes) -> bool:
    return bool(LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Model:
    """Learns from rows with a language, an expected ``train_docs`` of each, drawn by a hash of the key.

    Counting languages reads two columns; the sample's four-byte runs are counted on the executors, and the distinct ones of each
    language come to the driver, no more than ``train_docs`` pieces hold. Without labelled rows the model has no language.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    per = rows.groupBy("lang").count().orderBy("lang").collect()
    if not per:
        return build({})
    share = F.create_map(*[x for r in per for x in (F.lit(r["lang"]), F.lit(min(1.0, train_docs / r["count"])))])
    drawn = (F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))) < share[F.col("lang")]
    # of a long text a piece at a place that the key tells
    at = F.pmod(F.xxhash64("key", F.lit(5)), F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1))).cast("int") + 1
    sample = rows.where(drawn & F.col("text").isNotNull()).select("lang", F.substring("text", at, F.lit(TRAIN_CHARS)).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[bytes]] = {}
            for k, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                by.setdefault(k, []).append(t)
            for k, texts in by.items():
                got = [gram_counts(t) for t in texts]
                g = np.concatenate([x for x, _ in got])
                u, inv = np.unique(g, return_inverse=True)
                n = np.bincount(inv, np.concatenate([x for _, x in got]), len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(u), pa.string()), pa.array(u), pa.array(n)], ["lang", "gram", "n"])

    grams = map_arrow(sample, count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return build({k: (x["gram"].to_numpy(np.int64), x["n"].to_numpy(np.int64)) for k, x in grams.groupby("lang")})


PREDICTION = "struct<lang:string,score:double,bits_per_byte:double>"


def _predict(model: Model, texts: list[bytes | None]) -> list[dict]:
    ok = [bool(t) and has_letter(t) and len(model.languages) > 0 for t in texts]
    found = [{"lang": "und", "score": 0.0, "bits_per_byte": None}] * len(texts)
    some = [t for t, x in zip(texts, ok, strict=True) if x]
    if some:
        bits = model.lengths(some)
        best = bits.argmin(1)
        p = 1 / np.exp2(np.minimum(bits.min(1, keepdims=True) - bits, 0)).sum(1)
        it = iter(range(len(some)))
        for i, x in enumerate(ok):
            if x:
                k = next(it)
                found[i] = {"lang": model.languages[best[k]], "score": float(p[k]), "bits_per_byte": float(bits[k, best[k]] / len(some[k]))}
    return found


def with_prediction(rows: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``rows`` with a struct column ``_lang``: language, posterior under equal priors, bits a byte in that language."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
        for b in batches:
            found = _predict(held.value, as_bytes(b.column(b.schema.get_field_index(text_col))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, "_lang"])

    schema = rows.withColumn("_lang", F.lit(None).cast(PREDICTION)).schema
    return map_arrow(rows, run, schema)


def held_out(key: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether a document is in the fold that nothing is learned from; a null key is not."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, fold: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte) of every row, with a model of the labelled rows outside the fold.

    ``und`` with score 0 if the text is null or empty, has no letter, or nothing is labelled. Ties go to
    the first language by code point. Texts of any length are scored whole, in segments of a megabyte
    that keep their context.
    """
    out = held_out(F.col(id_col), folds, fold)
    model = train(docs.where(~out & F.col(id_col).isNotNull()), lang_col, text_col, id_col)
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("_text")))
    p = F.col("_lang")
    return with_prediction(rows, model, "_text").select("doc_id", "held_out", p["lang"].alias("lang_pred"), p["score"].alias("score"), p["bits_per_byte"].alias("bits_per_byte"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_bits: float = 8.0) -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose text is in one of the learned languages.

    Rejected: texts without letters or null, and those that no language's model codes in fewer than
    ``max_bits`` bits a byte, which is what bytes without any statistics take. If nothing is labelled,
    texts with letters stay.
    """
    model = train(docs.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull()), lang_col, text_col, id_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    if not model.languages:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    found = with_prediction(docs.select(row, F.col(text_col).alias("_text")), model, "_text")
    return found.where((F.col("_lang.lang") != "und") & (F.col("_lang.bits_per_byte") < max_bits)).select("_row.*")
