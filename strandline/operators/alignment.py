"""From seed clusters to overlaps: hopeless clusters leave, seeds are extended, alignments accepted, merged and written as overlaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.seq import EVALUE_MAX, EVALUE_SCALE
from . import kmers as K
from . import overlaps as O
from .kernels import extend as X
from .kernels import packed as P

#: Bases that a lone seed may leave unmatched on a side, and distinct overlaps of a pair in one orientation.
HOPELESS, DISTINCT = 90, 3


def hopeful(clusters: DataFrame, k: int, limit: int = HOPELESS) -> DataFrame:
    """Drops clusters of a single seed (a_seed, b_seed; reads a_len, b_len) from which more than ``limit`` bases lead to an end on either side."""
    head = F.least("a_seed", "b_seed")
    tail = F.least(F.col("a_len") - F.col("a_seed"), F.col("b_len") - F.col("b_seed")) - k
    return clusters.where(~((F.col("seeds") == 1) & ((head > limit) | (tail > limit))))


def room(bases: Column, erate: float) -> Column:
    """Two more than the errors that an extension over so many bases may have, at least: Chernoff's bound of ``X.error_bound``."""
    n = F.greatest(bases, F.lit(0)) * F.lit(erate)
    return F.floor(n + 6 * F.sqrt(n)) + 20


def aligned(clusters: DataFrame, reads: DataFrame, k: int, erate: float) -> DataFrame:
    """(a_id, b_id, flipped, kind, a_bgn, a_end, b_bgn, b_end, errors, a_len, b_len): clusters extended from their seed.

    Reads are (read_id, seq), or ``K.folded`` ones if the clusters have lengths. b is in the orientation of a. A pair meets b first and takes the part of it that the extension can come to, at two bits a base, to a;
    so reads are dealt out once, and a part of one read for each pair.
    """
    K.bounded_batches(reads.sparkSession)
    if not {"a_len", "b_len"} <= set(clusters.columns):
        clusters = O.with_lengths(clusters, reads.select("read_id", F.length("seq").alias("len")))
    c, zero = F.col, F.lit(0).cast("bigint")
    left, right = F.least("a_seed", "b_seed"), F.least(c("a_len") - c("a_seed"), c("b_len") - c("b_seed")) - k
    head, tail = room(left, erate), room(right, erate)

    def part(x: str, y: str) -> tuple[Column, Column]:
        """Begin and end of what an extension of x along y can come to."""
        return F.greatest(zero, c(f"{x}_seed") - c(f"{y}_seed") - head), F.least(c(f"{x}_len"), c(f"{x}_seed") + c(f"{y}_len") - c(f"{y}_seed") + tail)

    def cut(bases: Column, letters: Column, lo: Column, hi: Column) -> Column:
        first = F.floor(lo / letters)
        return F.substring(bases, (first + 1).cast("int"), (F.ceil(hi / letters) - first).cast("int"))

    (a_lo, a_hi), (b_lo, b_hi) = part("a", "b"), part("b", "a")
    own = F.when(c("flipped"), c("b_len") - b_hi).otherwise(b_lo), F.when(c("flipped"), c("b_len") - b_lo).otherwise(b_hi)
    keys = ["a_id", "b_id", "flipped", "a_seed", "b_seed", "a_len", "b_len"]
    pairs = clusters.select(*(c(x) if x == "flipped" else c(x).cast("bigint").alias(x) for x in keys))
    r = reads if "bases" in reads.columns else K.folded(reads)
    pairs = pairs.join(r.select(c("read_id").alias("b_id"), c("letters").alias("b_letters"), c("bases").alias("b_bases")), "b_id")
    pairs = pairs.select(*keys, "b_letters", cut(c("b_bases"), c("b_letters"), *own).alias("b_part"))
    pairs = pairs.join(r.select(c("read_id").alias("a_id"), c("letters").alias("a_letters"), c("bases").alias("a_bases")), "a_id")
    rows = pairs.select(*keys, a_lo.alias("a_lo"), a_hi.alias("a_hi"), "a_letters", cut(c("a_bases"), c("a_letters"), a_lo, a_hi).alias("a_part"), b_lo.alias("b_lo"), b_hi.alias("b_hi"), "b_letters", "b_part", left.alias("left"), right.alias("right"))

    def opened(parts: list[bytes], letters: list[int], lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
        return [P.unfolded(t, n)[x % n : x % n + y - x] for t, n, x, y in zip(parts, letters, lo.tolist(), hi.tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            v = {x: t.column(x).to_numpy(zero_copy_only=False) for x in (*keys, "a_lo", "a_hi", "b_lo", "b_hi", "left", "right")}
            turn = v["flipped"].astype(bool)
            a = opened(t.column("a_part").to_pylist(), t.column("a_letters").to_pylist(), v["a_lo"], v["a_hi"])
            lo, hi = np.where(turn, v["b_len"] - v["b_hi"], v["b_lo"]), np.where(turn, v["b_len"] - v["b_lo"], v["b_hi"])
            b = opened(t.column("b_part").to_pylist(), t.column("b_letters").to_pylist(), lo, hi)
            b = [P.COMPLEMENT[x[::-1]] if f else x for x, f in zip(b, turn.tolist(), strict=True)]
            seeds = v["a_seed"], v["b_seed"], v["a_seed"] - v["a_lo"], v["b_seed"] - v["b_lo"]
            for at, whole, *found in X.overlaps(a, b, seeds, v["left"], v["right"], k, erate):
                columns = [v["a_id"][at], v["b_id"][at], turn[at], np.where(whole, X.DOVETAIL, X.BRANCH), *found, v["a_len"][at], v["b_len"][at]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a_id", "b_id", "flipped", "kind", "a_bgn", "a_end", "b_bgn", "b_end", "errors", "a_len", "b_len"])

    return rows.mapInArrow(run, "a_id bigint, b_id bigint, flipped boolean, kind string, a_bgn bigint, a_end bigint, b_bgn bigint, b_end bigint, errors bigint, a_len bigint, b_len bigint")


def accepted(alignments: DataFrame, min_length: int, erate: float, partial: bool = False) -> DataFrame:
    """Alignments long enough on both reads whose ``quality``, errors over the shorter part, is ``erate`` at most; branches only if ``partial``."""
    on_a, on_b = F.col("a_end") - F.col("a_bgn"), F.col("b_end") - F.col("b_bgn")
    good = alignments.withColumn("quality", F.col("errors") / F.least(on_a, on_b)).where((on_a >= min_length) & (on_b >= min_length) & (F.col("quality") <= erate))
    return good if partial else good.where(F.col("kind") == X.DOVETAIL)


def distinct(alignments: DataFrame, most: int = DISTINCT) -> DataFrame:
    """Of alignments of a pair and orientation that intersect on a, the one of the best quality; the best ``most`` of what is left."""
    key = ["a_id", "b_id", "flipped"]
    rank = ("quality", F.desc(F.col("a_end") - F.col("a_bgn")), "a_bgn", "b_bgn", "a_end", "b_end")
    by = W.partitionBy(*key).orderBy("a_bgn", "a_end", "b_bgn", "b_end")
    far = F.max("a_end").over(by.rowsBetween(W.unboundedPreceding, -1))
    runs = alignments.withColumn("_new", F.when(far.isNull() | (F.col("a_bgn") >= far), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    one = runs.withColumn("_rank", F.row_number().over(W.partitionBy(*key, "_run").orderBy(*rank))).where("_rank = 1")
    few = one.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(*rank))).where(F.col("_rank") <= most)
    return few.drop("_new", "_run", "_rank")


def emitted(alignments: DataFrame) -> DataFrame:
    """Overlaps with hangs, evalue and span, and what they are for: those that reach ends on both sides for the graph, all for trimming and duplicates."""
    o = alignments.select(
        "a_id", "b_id", "flipped",
        F.col("a_bgn").alias("ahg5"), (F.col("a_len") - F.col("a_end")).alias("ahg3"), F.col("b_bgn").alias("bhg5"), (F.col("b_len") - F.col("b_end")).alias("bhg3"),
        F.least(F.lit(EVALUE_MAX), F.floor(F.col("quality") * EVALUE_SCALE + 0.5)).cast("bigint").alias("evalue"),
        F.greatest(F.col("a_end") - F.col("a_bgn"), F.col("b_end") - F.col("b_bgn")).alias("span"), "a_len", "b_len",
    )
    return o.withColumn("for_utg", G.reaches_ends()).withColumn("for_obt", F.lit(True)).withColumn("for_dup", F.lit(True))
