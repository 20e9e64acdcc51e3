"""Overlap tables: seeding, clustering, filters, twins, ranking, statistics and classification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.seq import decode_evalue, seed_minimum
from . import intervals as I
from . import kmers as K
from .kernels import binned as B


def seed_pairs(reads: DataFrame, k: int, min_count: int = 2, max_count: int = 100) -> DataFrame:
    """(a_id, b_id, flipped, apos, bpos): seeds that reads a < b share.

    k-mers above ``max_count`` (repeats) and below ``min_count`` (unique) leave before the self-join, so a
    bucket of the join has at most ``max_count`` rows: the join grows with reads, not with their square.
    """
    e = K.expand_packed(reads, k) if k <= K.P.MAX_K else K.expand(reads, k, oriented=True)
    use = e.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(min_count, max_count)).select("kmer")
    e = e.join(use, "kmer", "left_semi")
    a = e.select("kmer", F.col("read_id").alias("a_id"), F.col("pos").alias("apos"), F.col("forward").alias("af"))
    b = e.select("kmer", F.col("read_id").alias("b_id"), F.col("pos").alias("bpos"), F.col("forward").alias("bf"))
    return a.join(b, "kmer").where("a_id < b_id").select("a_id", "b_id", (F.col("af") != F.col("bf")).alias("flipped"), "apos", "bpos")


def seed_clusters(pairs: DataFrame, lengths: DataFrame, k: int, min_seeds: int = 1) -> DataFrame:
    """Seeds of a pair and orientation as one row: seeds, mean diagonal (b turned if flipped), extent on a, and the first seed."""
    j = pairs.join(lengths.select(F.col("read_id").alias("b_id"), F.col("len").alias("b_len")), "b_id")
    turned = F.when(F.col("flipped"), F.col("b_len") - k - F.col("bpos")).otherwise(F.col("bpos"))
    j = j.withColumn("bpos", turned)
    return j.groupBy("a_id", "b_id", "flipped").agg(F.count(F.lit(1)).alias("seeds"), F.floor(F.avg(F.col("apos") - F.col("bpos"))).alias("diagonal"), F.min(F.col("apos") - F.col("bpos")).alias("diag_bgn"), F.max(F.col("apos") - F.col("bpos")).alias("diag_end"), F.min("apos").alias("a_first"), F.max("apos").alias("a_last"), F.min(F.struct("apos", "bpos")).alias("seed")).where(F.col("seeds") >= min_seeds).select("a_id", "b_id", "flipped", "seeds", "diagonal", "diag_bgn", "diag_end", "a_first", "a_last", F.col("seed.apos").alias("a_seed"), F.col("seed.bpos").alias("b_seed"))


def clusters(reads: DataFrame, k: int, min_count: int = 2, max_count: int = 100, min_seeds: int = 1) -> DataFrame:
    """``seed_clusters`` of ``seed_pairs`` with the lengths of both (a_len, b_len), for reads (read_id bigint, seq), or ``K.folded`` ones, and k up to 31.

    k-mers meet in bins as stretches of bases; seeds leave a task as sums by pair and orientation, which meet in bins of pairs.
    """
    names = ("a_id", "b_id", "flipped", "a_len", "b_len", "n", "s", "lo", "hi", "last", "seed")
    schema = ", ".join(f"{x} {'boolean' if x == 'flipped' else 'bigint'}" for x in names)

    def kernel(sides: list[list[bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
        for rows in B.occurrences(sides[0], k, min_count, max_count):
            yield from B.seed_rows(rows, k)

    stretches = K.dealt(reads.where("read_id is not null"), k, "read_id", K.n_bins(reads.sparkSession), positions=True)
    bins = min(8192, 8 * int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = K.by_bin(stretches, kernel, "bin int, stretches binary", B.clustered, leave=lambda rows: B.shipped(rows, bins))

    def whole(sides: list[list[bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
        rows = B.clustered([B.unshipped(x) for x in sides[0]])
        use = np.flatnonzero(rows[5] >= min_seeds)
        yield tuple(x[use] for x in rows)

    c, first = F.col, F.shiftright("seed", 32)
    one = K.by_bin(sums, whole, schema)
    return one.select("a_id", "b_id", "flipped", c("n").alias("seeds"), F.floor(c("s") / c("n")).alias("diagonal"), c("lo").alias("diag_bgn"), c("hi").alias("diag_end"), first.alias("a_first"), c("last").alias("a_last"), first.alias("a_seed"), c("seed").bitwiseAND((1 << 32) - 1).alias("b_seed"), "a_len", "b_len")


def enough_seeds(clusters: DataFrame, k: int, erate: float, least: int) -> DataFrame:
    """Drops clusters with fewer seeds than an overlap of their extent is expected to have."""
    return clusters.where(F.col("seeds") >= seed_minimum(k, erate, F.col("a_last") - F.col("a_first") + k, least))


def from_diagonals(clusters: DataFrame, lengths: DataFrame, evalue: int = 0) -> DataFrame:
    """Overlaps (a_id, b_id, flipped, hangs, evalue, span) that clusters imply: ends are where the shorter side of the diagonal ends."""
    la = lengths.select(F.col("read_id").alias("a_id"), F.col("len").alias("a_len"))
    lb = lengths.select(F.col("read_id").alias("b_id"), F.col("len").alias("b_len"))
    j = clusters if {"a_len", "b_len"} <= set(clusters.columns) else clusters.join(la, "a_id").join(lb, "b_id")
    d, tail = F.col("diagonal"), F.col("diagonal") + F.col("b_len") - F.col("a_len")
    zero = F.lit(0).cast("bigint")
    o = j.select("a_id", "b_id", "flipped", F.greatest(d, zero).alias("ahg5"), F.greatest(-tail, zero).alias("ahg3"), F.greatest(-d, zero).alias("bhg5"), F.greatest(tail, zero).alias("bhg3"), F.lit(evalue).cast("bigint").alias("evalue"), "a_len", "b_len", "seeds")
    return o.where((F.col("ahg5") + F.col("ahg3") < F.col("a_len")) & (F.col("bhg5") + F.col("bhg3") < F.col("b_len")))


def snap_hangs(pairs: DataFrame, slop: int = 15) -> DataFrame:
    """Overlaps (a_bgn, a_end, b_bgn, b_end) within clear ranges (a_clr_bgn, ...), of which ends of b that miss its clear range by less
    than ``slop`` are moved there, as far as a's clear range allows, together with a's."""
    c = F.col
    hang5, hang3 = c("b_bgn") - c("b_clr_bgn"), c("b_clr_end") - c("b_end")
    by5 = F.when(hang5 < slop, F.least(hang5, c("a_bgn") - c("a_clr_bgn"))).otherwise(0)
    by3 = F.when(hang3 < slop, F.least(hang3, c("a_clr_end") - c("a_end"))).otherwise(0)
    return pairs.withColumns({"a_bgn": c("a_bgn") - by5, "b_bgn": c("b_bgn") - by5, "a_end": c("a_end") + by3, "b_end": c("b_end") + by3})


def limit_per_read(clusters: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` overlaps on each side of a read, in the order of mean diagonal."""
    for side in ("a_id", "b_id"):
        w = W.partitionBy(side, F.col("diagonal") >= 0).orderBy("diagonal", "a_id", "b_id", "flipped")
        clusters = clusters.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= limit).drop("_rank")
    return clusters


def with_lengths(overlaps: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds a_len and b_len from (read_id, len)."""
    return overlaps.join(lengths.select(F.col("read_id").alias("a_id"), F.col("len").alias("a_len")), "a_id").join(lengths.select(F.col("read_id").alias("b_id"), F.col("len").alias("b_len")), "b_id")


def store(overlaps: DataFrame, max_evalue: int) -> DataFrame:
    """Overlaps and their twins with use flags; those above ``max_evalue`` lose all flags and go."""
    good = F.col("evalue") <= max_evalue
    both = overlaps.unionByName(G.twins(overlaps))
    return both.withColumn("for_utg", good & G.reaches_ends()).withColumn("for_obt", good).where("for_utg or for_obt")


def dump_filters(a_len: Column, b_len: Column, no5p=False, no3p=False, no_container=False, no_contained=False, no_redundant=False, erate=(0.0, 1.0), length=(0, None), query=(0, None)) -> Column:
    """Whether an overlap is reported. ``no_container`` tests a_hang <= 0 <= b_hang, as the reference behaviour has it."""
    keep = F.lit(True)
    a, b, n = G.a_hang(), G.b_hang(), G.aligned(a_len, b_len)
    for on, test in ((no5p, (a < 0) & (b < 0)), (no3p, (a > 0) & (b > 0)), (no_container, (a <= 0) & (b >= 0)), (no_contained, (a >= 0) & (b <= 0)), (no_redundant, F.col("a_id") >= F.col("b_id"))):
        keep = keep & ~test if on else keep
    e = decode_evalue(F.col("evalue"))
    keep = keep & e.between(*erate) & (n >= length[0]) & (F.col("a_id") >= query[0])
    keep = keep & (n <= length[1]) if length[1] is not None else keep
    return keep & (F.col("a_id") <= query[1]) if query[1] is not None else keep


def dedupe_pairs(overlaps: DataFrame) -> DataFrame:
    """One overlap of each (a, b): the most accurate, then the longest, then the one that is not flipped."""
    w = W.partitionBy("a_id", "b_id").orderBy("evalue", F.desc("span"), F.col("flipped").asc(), "ahg5", "ahg3", "bhg5", "bhg3")
    return overlaps.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_per_read(overlaps: DataFrame, n: int, length: Column) -> DataFrame:
    """The ``n`` longest overlaps of each read, more accurate ones first among equals (a group limit runs before the shuffle)."""
    w = W.partitionBy("a_id").orderBy(F.desc("_length"), "evalue", "b_id", "flipped")
    return overlaps.withColumn("_length", length).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank", "_length")


def symmetrise(overlaps: DataFrame) -> DataFrame:
    """Both twins of every overlap, with the lesser evalue of the two where both exist.

    Twins meet in one aggregation by their common key instead of a self-join.
    """
    o = overlaps.select("a_id", "b_id", "flipped", "ahg5", "ahg3", "bhg5", "bhg3", "evalue", "span")
    both = o.withColumn("made", F.lit(1)).unionByName(G.twins(o).withColumn("made", F.lit(2)))
    shape = F.struct("made", "ahg5", "ahg3", "bhg5", "bhg3", "span")
    s = both.groupBy("a_id", "b_id", "flipped").agg(F.min("evalue").alias("evalue"), F.min(shape).alias("s"))
    return s.select("a_id", "b_id", "flipped", "s.ahg5", "s.ahg3", "s.bhg5", "s.bhg3", "evalue", "s.span", (F.col("s.made") == 2).alias("created"))


def override_evalues(overlaps: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Recomputed evalues (a_id, b_id, flipped, evalue) take the place of stored ones."""
    new = recomputed.withColumnRenamed("evalue", "_new")
    return overlaps.join(new, ["a_id", "b_id", "flipped"], "left").withColumn("evalue", F.coalesce("_new", "evalue")).drop("_new")


def score_samples(overlaps: DataFrame, score: Column, points: int = 16) -> DataFrame:
    """(a_id, rank, score): ``points`` samples of each read's descending scores; steps of n / points within [1, 10], the last score repeated at the end."""
    s = overlaps.select("a_id", score.alias("score"), F.row_number().over(W.partitionBy("a_id").orderBy(F.desc(score))).alias("r"), F.count(F.lit(1)).over(W.partitionBy("a_id")).alias("n"))
    step = F.least(F.lit(10.0), F.greatest(F.lit(1.0), F.col("n") / points))
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    want = s.groupBy("a_id", "n").agg(F.lit(1).alias("_one")).select("a_id", "n", i.alias("i"))
    at = F.when((F.col("i") < points - 1) & (F.col("i") * step < F.col("n")), F.floor(F.col("i") * step + 0.5)).otherwise(F.col("n") - 1)
    # rounding up may pass the end
    want = want.select("a_id", "i", F.least(at, F.col("n") - 1).alias("rank"))
    return want.join(s.select("a_id", (F.col("r") - 1).alias("rank"), "score"), ["a_id", "rank"]).select("a_id", "i", "rank", "score")


def score_estimate(samples: DataFrame, coverage: int) -> DataFrame:
    """(a_id, estimate): the score at rank ``coverage`` by linear interpolation of the samples; 0 beyond the last."""
    by = W.partitionBy("a_id").orderBy("i")
    s = samples.select("a_id", "i", "rank", "score", F.lag("rank").over(by).alias("r0"), F.lag("score").over(by).alias("s0"))
    y = F.col("s0") + (F.col("score") - F.col("s0")) / (F.col("rank") - F.col("r0")) * (coverage - F.col("r0"))
    hit = (F.col("r0") < coverage) & (F.col("rank") >= coverage)
    return s.groupBy("a_id").agg(F.coalesce(F.max(F.when(hit, F.floor(y))), F.lit(0)).cast("int").alias("estimate"))


def erate_length_histogram(overlaps: DataFrame, length: Column, evalue_bin: int, length_bin: int) -> DataFrame:
    return overlaps.groupBy(F.floor(F.col("evalue") / evalue_bin).alias("erate_bin"), F.floor(length / length_bin).alias("length_bin")).agg(F.count(F.lit(1)).alias("n"))


def per_read(overlaps: DataFrame) -> DataFrame:
    return overlaps.groupBy("a_id").agg(F.count(F.lit(1)).alias("n"))


def classify_reads(overlaps: DataFrame, lengths: DataFrame, expected_mean: float) -> DataFrame:
    """(read_id, category) by what overlaps cover of a read and how deeply.

    The depth profile of a read comes from a sweep; its first and last runs of one class decide.
    """
    o = with_lengths(overlaps, lengths)
    whole = ~G.partial()
    flags = o.groupBy(F.col("a_id").alias("read_id")).agg(F.max(G.at_a5() & whole).alias("c5"), F.max(G.at_a3() & whole).alias("c3"), F.max(G.a_contained()).alias("cont"), F.max(G.partial()).alias("part"))
    iv = o.select(F.col("a_id").alias("key"), G.a_bgn().alias("lo"), G.a_end(F.col("a_len")).alias("hi"))
    islands = I.merge(iv).groupBy("key").agg(F.count(F.lit(1)).alias("islands"))
    d = F.col("depth")
    kind = F.when(d < expected_mean / 3, "l").when(d < 5 * expected_mean / 3, "u").otherwise("r")
    by = W.partitionBy("key").orderBy("lo")
    seg = I.depth(iv).withColumn("kind", kind)
    seg = seg.withColumn("change", F.when(F.lag("kind").over(by).isNull() | (F.lag("kind").over(by) != F.col("kind")), 1).otherwise(0))
    runs = seg.groupBy("key").agg(F.sum("change").alias("runs"), F.min(F.struct("lo", "kind")).alias("head"), F.max(F.struct("lo", "kind")).alias("tail"))
    j = lengths.where("len > 0").select("read_id").join(flags, "read_id", "left").join(islands.withColumnRenamed("key", "read_id"), "read_id", "left").join(runs.withColumnRenamed("key", "read_id"), "read_id", "left")
    t5, t3, loose = F.col("head.kind"), F.col("tail.kind"), ~F.col("cont") & ~F.col("part")
    same = F.when(t5 == "l", "low-cov").when(t5 == "u", "unique").otherwise(F.when(F.col("cont"), "contained-repeat").otherwise("dovetail-repeat"))
    good = F.when(F.col("runs") == 1, same).when(t5 != t3, "uniq-repeat").when(t5 == "r", "uniq-anchor").otherwise("span-repeat")
    cat = F.when(F.col("islands").isNull(), "no-overlaps").when(F.col("islands") > 1, "middle-missing").when(loose & ~F.col("c5") & ~F.col("c3"), "middle-only").when(loose & ~F.col("c5"), "no-5-prime").when(loose & ~F.col("c3"), "no-3-prime").otherwise(good)
    return j.select("read_id", cat.alias("category"))


def clip_to_clear(overlaps: DataFrame, ranges: DataFrame) -> DataFrame:
    """Overlaps in the coordinates of clear ranges (read_id, bgn, end): clipped in proportion on both reads, gone if nothing is left.

    Needs a_len and b_len; the result has them as clear lengths.
    """
    ra = ranges.select(F.col("read_id").alias("a_id"), F.col("bgn").alias("a0"), F.col("end").alias("a1"))
    rb = ranges.select(F.col("read_id").alias("b_id"), F.col("bgn").alias("b0"), F.col("end").alias("b1"))
    j = overlaps.join(ra, "a_id").join(rb, "b_id")
    c, f = F.col, F.col("flipped")
    # in the orientation of a: b's clear range turned if flipped
    j = j.withColumn("q0", F.when(f, c("b_len") - c("b1")).otherwise(c("b0"))).withColumn("q1", F.when(f, c("b_len") - c("b0")).otherwise(c("b1")))
    j = j.withColumn("as", c("ahg5")).withColumn("ae", c("a_len") - c("ahg3")).withColumn("bs", c("bhg5")).withColumn("be", c("b_len") - c("bhg3"))
    alen, blen = c("ae") - c("as"), c("be") - c("bs")
    lost5 = F.greatest(F.greatest(c("a0") - c("as"), F.lit(0)) / alen, F.greatest(c("q0") - c("bs"), F.lit(0)) / blen)
    lost3 = F.greatest(F.greatest(c("ae") - c("a1"), F.lit(0)) / alen, F.greatest(c("be") - c("q1"), F.lit(0)) / blen)
    j = j.withColumn("f5", lost5).withColumn("f3", lost3).where("f5 + f3 < 1")
    cut = lambda f, n: F.floor(f * n + 0.5)
    j = j.select("*", (c("as") + cut(c("f5"), alen)).alias("as2"), (c("ae") - cut(c("f3"), alen)).alias("ae2"), (c("bs") + cut(c("f5"), blen)).alias("bs2"), (c("be") - cut(c("f3"), blen)).alias("be2"))
    hang = lambda x: F.greatest(x, F.lit(0)).cast("bigint")
    out = j.select("a_id", "b_id", "flipped", hang(c("as2") - c("a0")).alias("ahg5"), hang(c("a1") - c("ae2")).alias("ahg3"), hang(c("bs2") - c("q0")).alias("bhg5"), hang(c("q1") - c("be2")).alias("bhg3"), "evalue", (c("a1") - c("a0")).alias("a_len"), (c("b1") - c("b0")).alias("b_len"))
    return out.where((c("ahg5") + c("ahg3") < c("a_len")) & (c("bhg5") + c("bhg3") < c("b_len")))
