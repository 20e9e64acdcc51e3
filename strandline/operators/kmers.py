"""k-mer tables: (kmer, count) of canonical k-mers, all occurrences of one counted in one place.

Up to k = 31 k-mers travel as stretches of bases in bins and are counted there as integers; longer ones as strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.seq import canonical, reverse_complement
from .kernels import binned as B
from .kernels import packed as P

#: Bases of a piece: substring() counts from the start of its string, so pieces keep expansion linear.
PIECE = 256


def expand(reads: DataFrame, k: int, oriented: bool = False) -> DataFrame:
    """(read_id, pos, kmer): the k-mers of ``reads`` (read_id, seq) without N; canonical ones, with ``forward`` if ``oriented``."""
    r = reads.where(F.length("seq") >= k)
    at = F.sequence(F.lit(0), F.floor((F.length("seq") - k) / PIECE).cast("int"))
    pieces = r.select("read_id", "seq", F.explode(at).alias("p")).select("read_id", (F.col("p") * PIECE).alias("off"), F.expr(f"substring(seq, p * {PIECE} + 1, {PIECE + k - 1})").alias("piece"))
    mers = pieces.select("read_id", "off", "piece", F.explode(F.sequence(F.lit(0), F.length("piece") - k)).alias("i"))
    mers = mers.select("read_id", (F.col("off") + F.col("i")).cast("bigint").alias("pos"), F.expr(f"substring(piece, i + 1, {k})").alias("fwd")).where(~F.col("fwd").contains("N"))
    kmer = canonical(F.col("fwd")).alias("kmer")
    return mers.select("read_id", "pos", kmer, (F.col("fwd") == canonical(F.col("fwd"))).alias("forward")) if oriented else mers.select("read_id", "pos", kmer)


def texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def expand_packed(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, pos, kmer, forward) as of ``expand``, the k-mer as an integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, pos, kmer, forward in P.kmers(texts(b.column(1)), k):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(pos), pa.array(kmer), pa.array(forward)], names=["read_id", "pos", "kmer", "forward"])

    kind = reads.schema["read_id"].dataType.simpleString()
    return reads.select("read_id", "seq").mapInArrow(run, f"read_id {kind}, pos bigint, kmer bigint, forward boolean")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch hands to a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def folded(reads: DataFrame) -> DataFrame:
    """(read_id, letters, bases) of reads (read_id, seq): ``letters`` bases a byte."""
    bounded_batches(reads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.column(1).null_count:
                b = b.filter(b.column(1).is_valid())
            found = [P.folded(t) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["read_id", "letters", "bases"])

    r = reads.where("read_id is not null").select(F.col("read_id").cast("bigint").alias("read_id"), "seq")
    return r.mapInArrow(run, "read_id bigint, letters int, bases binary")


def dealt(reads: DataFrame, k: int, key: str | Column, bins: int, positions: bool = False) -> DataFrame:
    """(bin, stretches): the k-mers of ``reads`` (``key`` bigint, seq), or of ``folded`` ones, in bins."""
    bounded_batches(reads.sparkSession)
    columns = ["letters", "bases"] if "bases" in reads.columns else ["seq"]

    def opened(b: pa.RecordBatch) -> list[bytes]:
        if len(columns) == 1:
            return texts(b.column(1))
        return [P.text(t, n) for n, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((x, t) for b in batches for x, t in zip(b.column(0).to_pylist(), opened(b), strict=True))
        for chunk in B.pieces(rows, k):
            found = list(B.deal(chunk, k, bins, positions))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["bin", "stretches"])

    return reads.select(F.col(key) if isinstance(key, str) else key, *columns).mapInArrow(run, "bin int, stretches binary")


def n_bins(spark: SparkSession) -> int:
    return min(8192, max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def by_bin(stretches: DataFrame, kernel: Callable[[list[list[bytes]]], Iterator[tuple[np.ndarray, ...]]], schema: str, merge=None, sides: int = 1, leave=None) -> DataFrame:
    """``kernel`` over the stretches of each bin, a list for each ``side``; ``merge`` joins the rows of a task, ``leave`` makes what it gives of them."""
    names = [x.split()[0] for x in schema.split(", ")]
    s = stretches if sides > 1 else stretches.withColumn("side", F.lit(0))
    parts = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = s.select("bin", "side", "stretches").repartition(parts, "bin").sortWithinPartitions("bin")

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[bytes]]]:
        last, held = None, [[] for _ in range(sides)]
        for b in batches:
            for bin_, side, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if bin_ != last and last is not None:
                    yield held
                    held = [[] for _ in range(sides)]
                last = bin_
                held[side].append(blob)
        if last is not None:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for held in bins(batches) for r in kernel(held))
        rows = B.gathered(rows, merge) if merge else rows
        for r in leave(rows) if leave else rows:
            for at in range(0, len(r[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in r], names=names)

    return s.mapInArrow(run, schema)


def unpacked(kmer: Column, k: int) -> Column:
    """An integer k-mer as a string: its digits to base 4."""
    return F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def count_packed(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, count) of integer k-mers."""

    def kernel(sides: list[list[bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
        parts = B.passes(sides[0])
        for part in range(parts):
            yield B.counted(sides[0], k, part, parts)[:2]

    return by_bin(dealt(reads, k, F.lit(0).cast("bigint"), n_bins(reads.sparkSession)), kernel, "kmer bigint, count bigint")


def count(reads: DataFrame, k: int) -> DataFrame:
    if k <= P.MAX_K:
        return count_packed(reads, k).select(unpacked(F.col("kmer"), k).alias("kmer"), "count")
    return expand(reads, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("count"))


def union_sum(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("kmer").agg(F.sum("count").alias("count"))


def greater_than(kmers: DataFrame, n: int) -> DataFrame:
    return kmers.where(F.col("count") > n)


def difference(kmers: DataFrame, *others: DataFrame) -> DataFrame:
    """k-mers that no other table has; each step is an anti-join on the k-mer."""
    for o in others:
        kmers = kmers.join(o.select("kmer"), "kmer", "left_anti")
    return kmers


def histogram(kmers: DataFrame) -> DataFrame:
    """(freq, n_distinct, frac_distinct, frac_total), fractions cumulative. The windows run over one row per frequency."""
    h = kmers.groupBy(F.col("count").alias("freq")).agg(F.count(F.lit(1)).alias("n_distinct"))
    upto, all_ = W.orderBy("freq"), W.partitionBy()
    n, m = F.col("n_distinct"), F.col("freq") * F.col("n_distinct")
    return h.select("freq", "n_distinct", (F.sum(n).over(upto) / F.sum(n).over(all_)).alias("frac_distinct"), (F.sum(m).over(upto) / F.sum(m).over(all_)).alias("frac_total"))


def statistics(kmers: DataFrame) -> DataFrame:
    return kmers.agg(F.count_if(F.col("count") == 1).alias("n_unique"), F.count(F.lit(1)).alias("n_distinct"), F.sum("count").alias("n_present"))


def at_least(kmers: DataFrame, threshold: int | None = None, distinct: float | None = None, word_frequency: float | None = None) -> DataFrame:
    """Frequent k-mers: all the given conditions hold. ``distinct`` takes those from the count on at which that share of distinct k-mers is reached."""
    if threshold is not None:
        kmers_ = kmers.where(F.col("count") >= threshold)
    else:
        kmers_ = kmers
    if distinct is not None:
        cut = histogram(kmers).where(F.col("frac_distinct") >= distinct).agg(F.min("freq").alias("_cut"))
        kmers_ = kmers_.crossJoin(F.broadcast(cut)).where(F.col("count") >= F.col("_cut")).drop("_cut")  # one row
    if word_frequency is not None:
        total = kmers.agg(F.sum("count").alias("_total"))
        kmers_ = kmers_.crossJoin(F.broadcast(total)).where(F.col("count") / F.col("_total") >= word_frequency).drop("_total")  # one row
    return kmers_


def mhap_threshold(coverage: Column) -> Column:
    """k-mers of corrected reads are too frequent for sketches from five times the expected coverage on."""
    return F.floor(5.0 * coverage).cast("bigint")


def ignore_list(frequent: DataFrame, total: Column | int) -> DataFrame:
    """(kmer, frac, count, total) of both orientations of each k-mer."""
    both = F.array_distinct(F.array("kmer", reverse_complement(F.col("kmer"))))
    t = F.lit(total) if isinstance(total, int) else total
    return frequent.select(F.explode(both).alias("kmer"), F.round(F.col("count") / t, 10).alias("frac"), "count", t.cast("bigint").alias("total"))


def trough(kmers: DataFrame) -> DataFrame:
    """One row: the least frequency from which counts of distinct k-mers stop falling, plus one."""
    h = histogram(kmers).select("freq", "n_distinct", F.lead("n_distinct").over(W.orderBy("freq")).alias("next"))
    return h.where((F.col("next") >= F.col("n_distinct")) | F.col("next").isNull()).agg((F.min("freq") + 1).alias("min_freq"))


def histogram_plot(rows: list[tuple[int, int]], stars: int = 70) -> list[str]:
    """Text plot of (freq, n) rows with bins that widen as frequencies grow."""
    bins: dict[tuple[int, int], int] = {}
    lo, step = 2, 1
    for freq, n in sorted(r for r in rows if r[0] >= 2):
        while freq >= lo + step:
            lo, step = lo + step, max(1, int((lo + step) * 0.1) if lo + step > 30 else 1)
        bins[lo, lo + step - 1] = bins.get((lo, lo + step - 1), 0) + n
    top = max(bins.values(), default=1)
    return [f"{a:>9}-{b:<9} {n:>12} {'*' * round(stars * n / top)}" for (a, b), n in bins.items()]


def profile(a: DataFrame, b: DataFrame, kmers: DataFrame, cutoff: int = 1333) -> DataFrame:
    """(shared, unique, repeat): k-mers that two aligned sequences (read_id, seq expanded) have at the same position."""
    j = a.select("read_id", "pos", "kmer").join(b.select("read_id", "pos", "kmer"), ["read_id", "pos", "kmer"]).join(kmers, "kmer")
    return j.groupBy("read_id").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("count") < cutoff).alias("uniq"), F.count_if(F.col("count") >= cutoff).alias("rep"))


def trivial_runs(k_max: int = 5):
    """Regular expression of repeats of a unit of 2 to ``k_max`` bases, three times or more."""
    return "|".join(rf"([ACGT]{{{k}}})\{k - 1}{{2,}}" for k in range(2, k_max + 1))


def trivial_bases(seq: Column, k_max: int = 5) -> Column:
    """Bases in repeats of short units, where alignment differences are not counted."""
    return F.length(seq) - F.length(F.regexp_replace(seq, trivial_runs(k_max), ""))
