"""Toxicity by compression distance.

Two zstandard dictionaries of equal size are trained, one on toxic and one on ordinary text, and both are put
before the same ordinary history, which a third training makes. A window's distance is the number of bytes that it
takes less with the toxic dictionary than with the ordinary one; the history covers what both kinds of text have,
so most windows take as many with either.

Only some windows of a toxic document are toxic, so training goes in rounds over two halves of the documents: each
half is measured with the dictionaries of the other, and the next round trains on the share of windows that are
the most toxic of their class (of toxic documents: what is likely toxic; of ordinary ones: what is taken for
toxic most easily). Documents that no dictionary has seen calibrate the score: a logistic function of the shares
of windows at or above thresholds of the distance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow, spread

#: Expected number of labelled documents of a class to learn from, longest text among them (whole texts are scored).
TRAIN_DOCS, TRAIN_CHARS = 2500, 30_000
#: Bytes of a window, of a sample of the history and of the history; bytes and share of windows of each round's dictionaries.
WINDOW, SAMPLE, HISTORY = 32, 256, 1 << 18
ROUNDS = ((16384, 1.0), (8192, 0.3), (4096, 0.1), (2048, 0.04), (2048, 0.04), (2048, 0.04))
#: Segment and part of a segment that zstandard's trainer counts; shortest match and level of the compressors.
SEGMENT, PART, MATCH, LEVEL = 16, 6, 5, 9
STEPS = (2, 3, 4, 5, 6, 8)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass
class Model:
    """Dictionaries of equal size, their common history, and the calibration (empty without labels of both classes)."""

    ordinary: bytes
    toxic: bytes
    history: bytes
    weights: np.ndarray


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """Consecutive pieces of up to ``size`` bytes, cut behind a space where there is one in the latter half."""
    out, i, n = [], 0, len(text)
    while i < n:
        j = i + size
        if j < n:
            k = text.rfind(b" ", i + size // 2, j)
            j = k + 1 if k > 0 else j
        out.append(text[i:j])
        i = j
    return out


def compressor(content: bytes):
    """Compresses a window after ``content``; frames have no size, checksum or id, so lengths are those of the data."""
    d = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=len(content), min_match=MATCH, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    d.precompute_compress(compression_params=made)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=made).compress


class Distance:
    """Compressors of both dictionaries, made once in each worker and task."""

    def __init__(self, ordinary: bytes, toxic: bytes, history: bytes) -> None:
        self.ordinary, self.toxic = compressor(ordinary + history), compressor(toxic + history)

    def of(self, pieces: list[bytes]) -> np.ndarray:
        a, b = self.ordinary, self.toxic
        return np.array([len(a(x)) - len(b(x)) for x in pieces], np.int64)

    def features(self, text: bytes | None) -> np.ndarray:
        """Logarithms of the share of windows at each threshold, and of the mean of positive distances."""
        d = self.of(windows((text or b"").translate(LOWER)))
        n = max(1, len(d))
        shares = [*[(d >= s).sum() for s in STEPS], np.maximum(d, 0).sum()]
        return np.concatenate([[1.0], np.log1p(50 * np.array(shares, float) / n)])


def trained(samples: list[bytes], size: int, **options) -> bytes:
    """A zstandard dictionary of exactly ``size`` bytes, by default of short segments; too few samples are taken as they are."""
    some = [x for x in samples if len(x) >= 8]
    try:
        content = zstandard.train_dictionary(size, some, **(options or {"k": SEGMENT, "d": PART})).as_bytes()
    except zstandard.ZstdError:
        content = b"".join(some)[:size]
    return content.rjust(size, b"\0")


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], history: bytes) -> tuple[bytes, bytes]:
    """(ordinary, toxic) of the windows of each half of either class's documents."""
    classes = (ordinary, toxic)
    chosen = [list(halves) for halves in classes]
    made: list[list[bytes]] = []
    for k, (size, share) in enumerate(ROUNDS):
        if k:
            for half in (0, 1):
                distance = Distance(made[0][1 - half], made[1][1 - half], history)
                for c in (0, 1):
                    d = distance.of(classes[c][half])
                    mixed = np.random.default_rng(k).permutation(len(d))  # ties fall to no document in particular
                    best = mixed[np.argsort(-d[mixed], kind="stable")[: max(256, round(share * len(d)))]]
                    chosen[c][half] = [classes[c][half][i] for i in np.sort(best)]
        made = [[trained(x, size) for x in halves] for halves in chosen]
    last = ROUNDS[-1][0]
    return trained(chosen[0][0] + chosen[0][1], last), trained(chosen[1][0] + chosen[1][1], last)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge on all weights but the first."""
    w, eye = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    eye[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + eye, x.T @ (y - p) - eye @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None, train_docs: int = TRAIN_DOCS) -> Model:
    """Learns from labelled rows for which ``learn`` holds: an expected ``train_docs`` of each class, drawn by a hash.

    Two thirds of the sample make the dictionaries, one third the calibration, told apart by a hash of the id. Null
    labels are none; an id with both labels counts as both. Without a class every score is 0.
    """
    rows = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    rows = rows.where(learn) if learn is not None else rows
    per = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    u = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("y") == 1, F.lit(min(1.0, train_docs / max(1, per.get(1, 0))))).otherwise(F.lit(min(1.0, train_docs / max(1, per.get(0, 0)))))
    drawn = rows.where(u < share)
    texts = docs.where(F.length(text_col).between(1, TRAIN_CHARS)).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(drawn), F.col("_id") == F.col("id")).select(F.col("id").cast("string").alias("id"), "y", "text")
    sample = found.toPandas().sort_values(["id", "y", "text"])
    part = sample["id"].map(lambda i: zlib.crc32(f"part {i}".encode()) % 3)
    lower = sample["text"].map(lambda t: t.encode().translate(LOWER))

    def pieces(y: int, *parts: int, size: int = WINDOW) -> list[bytes]:
        return [w for t in lower[(sample["y"] == y) & part.isin(parts)] for w in windows(t, size)]

    # segments of the length that zstandard finds best; not of the calibration
    history = trained(pieces(0, 1, 2, size=SAMPLE), HISTORY, k=0, d=0)
    model = Model(*dictionaries([pieces(1, 1), pieces(1, 2)], [pieces(0, 1), pieces(0, 2)], history), history, np.zeros(0))
    y = sample["y"][part == 0].to_numpy(float)
    if len(set(y)) < 2:
        return model
    distance = Distance(model.ordinary, model.toxic, model.history)
    x = np.array([distance.features(t) for t in lower[part == 0]])
    model.weights = logistic(x, y)
    # a class drawn at another rate is brought back to its share by the intercept
    model.weights[0] += np.log(per[1] / per[0]) - np.log(y.mean() / (1 - y.mean()))
    return model


def with_score(rows: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``rows`` with ``score``."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        distance = Distance(m.ordinary, m.toxic, m.history)
        for b in batches:
            texts = as_bytes(b.column(b.schema.get_field_index(text_col)))
            z = [float(np.clip(distance.features(t) @ m.weights, -30, 30)) if len(m.weights) else -30.0 for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.array(z, float))), pa.float64())], names=[*b.schema.names, "score"])

    return map_arrow(rows, run, rows.withColumn("score", F.lit(0.0)).schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; nothing is learned from the fold.

    A null or empty text has no windows and gets the score of a text without distances. Rows that
    repeat are scored alike; ids may be of any type; labels of unknown ids are ignored, and without
    labels of both classes every score is 0. The drawn sample of labels is bounded by its expected
    2 * TRAIN_DOCS rows, which is what the join broadcasts; the driver holds their texts of
    TRAIN_CHARS characters at most.
    """
    of = lambda c: F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
    model = train(docs, labels, id_col, text_col, learn=~of(F.col("id")) & F.col("id").isNotNull())
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), of(F.col(id_col)).alias("held_out"), F.col(text_col).alias("_text")))
    return with_score(rows, model, "_text").select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
