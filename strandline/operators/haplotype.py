"""Assigning reads to haplotypes by the k-mers that only one haplotype has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..components import staged
from . import kmers as K
from .kernels import binned as B


def _coded(parents: DataFrame) -> DataFrame:
    return parents.where("hap is not null").select(F.xxhash64("hap").alias("code"), "seq")


def _names(parents: DataFrame) -> DataFrame:
    return F.broadcast(parents.where("hap is not null").select("hap").distinct().withColumn("code", F.xxhash64("hap")))  # as many rows as haplotypes


def _specific(blobs: list[bytes], k: int, part: int, parts: int, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    kmer, n, code, other = B.counted(blobs, k, part, parts)
    use = (code == other) & (n >= min_count)
    return code[use], kmer[use]


def specific_kmers(parents: DataFrame, k: int, min_count: int = 1) -> DataFrame:
    """(hap, kmer) of k-mers (integers) that exactly one haplotype of ``parents`` (hap, read_id, seq) has ``min_count`` times or more.

    One aggregation replaces a difference for each haplotype: a k-mer stays if the hash of its only haplotype is
    its least and its greatest, and then its number is that of the haplotype.
    """

    def kernel(sides: list[list[bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
        parts = B.passes(sides[0])
        for part in range(parts):
            yield _specific(sides[0], k, part, parts, min_count)

    one = K.by_bin(K.dealt(_coded(parents), k, "code", K.n_bins(parents.sparkSession)), kernel, "code bigint, kmer bigint")
    return one.join(_names(parents), "code").select("hap", "kmer")


def assign(reads: DataFrame, parents: DataFrame, k: int, min_ratio: float = 1.0, min_length: int = 0, min_count: int = 1) -> DataFrame:
    """(read_id, hap, score): matches over the haplotype's number of k-mers that only it has in ``parents``; ``ambiguous`` unless the
    best is unrivalled or over ``min_ratio`` times the second. Reads shorter than ``min_length`` go.

    The k-mers of parents and reads meet in bins; what leaves a bin are sums of a read and haplotype.
    """

    def kernel(sides: list[list[bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
        parts = B.passes(sides[0] + sides[1])
        for part in range(parts):
            code, kmer = _specific(sides[0], k, part, parts, min_count)
            if not len(kmer):
                continue
            codes, n = np.unique(code, return_counts=True)
            yield np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), codes, n
            for key, mer, *_ in B.read(sides[1], k, part, parts):
                at = np.minimum(np.searchsorted(kmer, mer), len(kmer) - 1)
                hit = kmer[at] == mer
                a, b, n = B.added([(key[hit], code[at[hit]], np.ones(hit.sum(), np.int64))])
                yield np.ones(len(n), np.int64), a, b, n

    def merge(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        one = []
        for read in (0, 1):
            own = [(a[kind == read], b[kind == read], n[kind == read]) for kind, a, b, n in rows]
            a, b, n = B.added(own)
            one.append((np.full(len(n), read), a, b, n))
        return tuple(np.concatenate(x) for x in zip(*one, strict=True))

    bins = K.n_bins(reads.sparkSession)
    long = reads.where((F.col("len") >= min_length) & F.col("read_id").isNotNull())
    both = K.dealt(_coded(parents), k, "code", bins).withColumn("side", F.lit(0)).unionByName(K.dealt(long, k, "read_id", bins).withColumn("side", F.lit(1)))
    sums = staged(K.by_bin(both, kernel, "kind bigint, read_id bigint, code bigint, n bigint", merge, sides=2))
    sizes = sums.where("kind = 0").groupBy("code").agg(F.sum("n").alias("n_kmers")).join(_names(parents), "code")
    hits = sums.where("kind = 1").groupBy("read_id", "code").agg(F.sum("n").alias("matches"))
    scored = hits.join(F.broadcast(sizes), "code").withColumn("score", F.col("matches") / F.col("n_kmers"))
    by = W.partitionBy("read_id").orderBy(F.desc("score"), "hap")
    top = scored.withColumn("rank", F.row_number().over(by)).where("rank <= 2").groupBy("read_id").agg(F.max(F.when(F.col("rank") == 1, F.col("hap"))).alias("best"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("s2"))
    out = reads.where(F.col("len") >= min_length).select("read_id").join(top, "read_id", "left")
    sure = (F.col("s2") == 0) | (F.col("s1") / F.col("s2") > min_ratio)
    return out.select("read_id", F.when(F.col("s1").isNotNull() & sure, F.col("best")).otherwise("ambiguous").alias("hap"), F.coalesce("s1", F.lit(0.0)).alias("score"))
