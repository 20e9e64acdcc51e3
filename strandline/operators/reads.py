"""Read tables: loading rules, versions, clear ranges, down-sampling and length statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.seq import clear_range, homopolymer_compress, normalise_bases, trim_n, valid_bases


def checked(raw: DataFrame, min_length: int = 1000, max_length: int = (1 << 30) - 1) -> DataFrame:
    """``raw`` (name, seq) with ``seq`` normalised and ``status``: INVALID, SHORT, LONG or LOADED."""
    seq = normalise_bases(trim_n(F.col("seq")))
    out = raw.withColumn("ok", valid_bases(F.col("seq"))).withColumn("seq", seq)
    n = F.length("seq")
    return out.withColumn("status", F.when(~F.col("ok"), "INVALID").when(n < min_length, "SHORT").when(n > max_length, "LONG").otherwise("LOADED")).drop("ok")


def load_stats(checked_reads: DataFrame) -> DataFrame:
    return checked_reads.groupBy("status").agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("seq")).alias("bases"))


def numbered(loaded: DataFrame, order: str = "name") -> DataFrame:
    """``read_id`` from 1 in the order of names, without a single-task sort: counts of ranges are added to ranks within them."""
    ranged = loaded.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    rank = ranged.withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy(order)))
    sizes = rank.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rank.join(F.broadcast(before), "_part").withColumn("read_id", F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before")  # one row per partition


def effective_length(trimmed: bool) -> Column:
    """Length of a read version: the clear range if trimmed, 0 if invalid, ignored or not yet trimmed."""
    if trimmed:
        return F.when(F.col("trimmed") & F.col("valid") & ~F.col("ignore_t"), F.col("clr_end") - F.col("clr_bgn")).otherwise(0)
    return F.when(F.col("valid") & ~F.col("ignore_u"), F.col("length")).otherwise(0)


def view(reads: DataFrame, trimmed: bool = False, compressed: bool = False) -> DataFrame:
    """(read_id, seq, len) of what a stage sees; reads of length 0 are excluded."""
    seq = homopolymer_compress(F.col("seq")) if compressed else F.col("seq")
    seq = clear_range(seq, F.col("clr_bgn"), F.col("clr_end")) if trimmed else seq
    return reads.select("read_id", seq.alias("seq")).withColumn("len", F.length("seq").cast("bigint")).where("len > 0")


def load_corrected(reads: DataFrame, corrected: DataFrame) -> DataFrame:
    """Upserts corrected bases (read_id, seq)."""
    new = corrected.select("read_id", F.col("seq").alias("_seq"))
    return reads.join(new, "read_id", "left").withColumn("corrected", F.col("_seq").isNotNull()).withColumn("seq", F.coalesce("_seq", "seq")).drop("_seq")


def load_trimmed(reads: DataFrame, ranges: DataFrame) -> DataFrame:
    """Sets clear ranges (read_id, bgn, end, deleted); bogus or deleted ones mark the read ignored."""
    j = reads.join(ranges, "read_id", "left")
    bogus = F.col("deleted") | (F.col("bgn") >= F.col("end")) | (F.col("end") > F.col("len"))
    none = F.col("bgn").isNull()
    return j.select(*reads.columns, F.when(none | bogus, 0).otherwise(F.col("bgn")).cast("bigint").alias("clr_bgn"), F.when(none, F.col("len")).when(bogus, 0).otherwise(F.col("end")).cast("bigint").alias("clr_end"), (F.coalesce(bogus, F.lit(False)) & ~none).alias("ignored"))


def downsample(reads: DataFrame, target: float, score: Column) -> DataFrame:
    """``reads`` with ``kept``: best scores first, while what is before is below ``target`` bases; the read that crosses it stays.

    Scores are ranked in ranges: a range's total is known before any rank within it, so no task sorts all reads.
    """
    scored = reads.withColumn("_score", score)
    ranged = scored.repartitionByRange(F.desc("_score"), F.asc("read_id")).withColumn("_part", F.spark_partition_id())
    totals = ranged.groupBy("_part").agg(F.sum("len").alias("_sum"))
    before = totals.select("_part", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    by = W.partitionBy("_part").orderBy(F.desc("_score"), "read_id")
    here = F.coalesce(F.sum("len").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = ranged.withColumn("_here", here).join(F.broadcast(before), "_part")  # one row per partition
    return out.withColumn("kept", F.col("_before") + F.col("_here") < target).drop("_part", "_here", "_before", "_score")


def stats(reads: DataFrame, by: str) -> DataFrame:
    return reads.groupBy(by).agg(F.count(F.lit(1)).alias("reads"), F.sum("len").alias("bases"), F.min("len").alias("shortest"), F.max("len").alias("longest"))


def length_histogram(reads: DataFrame, width: int) -> DataFrame:
    return reads.groupBy((F.floor(F.col("len") / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("reads"), F.sum("len").alias("bases"))


def by_length(reads: DataFrame, length: str = "len") -> DataFrame:
    """(len, n, reads_before, bases_before) in descending order of length: running totals over distinct lengths, not over reads."""
    per = reads.groupBy(F.col(length).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    w = W.orderBy(F.desc("len")).rowsBetween(W.unboundedPreceding, -1)
    return per.select("len", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("reads_before"), F.coalesce(F.sum(F.col("n") * F.col("len")).over(w), F.lit(0)).alias("bases_before"))


def n_table(reads: DataFrame, size: Column | int | None = None, step: int = 10, length: str = "len") -> DataFrame:
    """(ng, len, reads): the first length at which the running total in descending order exceeds ng % of ``size`` (all bases if none)."""
    per = by_length(reads, length)
    total = F.sum(F.col("n") * F.col("len")).over(W.partitionBy()) if size is None else F.lit(size)
    per = per.withColumn("goal", total).withColumn("ng", F.explode(F.sequence(F.lit(step), F.lit(100), F.lit(step))))
    aim = F.col("goal") * F.col("ng") / 100
    # within one length the total grows by len at each read
    more = F.floor((aim - F.col("bases_before")) / F.col("len")) + 1
    hit = per.where((F.col("bases_before") <= aim) & (F.col("bases_before") + F.col("n") * F.col("len") > aim))
    return hit.select("ng", "len", (F.col("reads_before") + more).cast("bigint").alias("reads"))


def length_stats(reads: DataFrame) -> DataFrame:
    """One row: reads, bases, median (upper middle), integral mean, N50 by ascending totals, shortest, longest."""
    per = reads.groupBy("len").agg(F.count(F.lit(1)).alias("n"))
    up, all_ = W.orderBy("len"), W.partitionBy()
    per = per.select("len", "n", F.sum("n").over(up).alias("c"), F.sum(F.col("n") * F.col("len")).over(up).alias("b"), F.sum("n").over(all_).alias("cn"), F.sum(F.col("n") * F.col("len")).over(all_).alias("bn"))
    half = F.floor(F.col("cn") / 2)
    return per.agg(F.max("cn").alias("reads"), F.max("bn").alias("bases"), F.min(F.when(F.col("c") > half, F.col("len"))).alias("median"), F.max(F.floor(F.col("bn") / F.col("cn"))).alias("mean"), F.min(F.when(F.col("b") * 2 >= F.col("bn"), F.col("len"))).alias("n50"), F.min("len").alias("shortest"), F.max("len").alias("longest"))


def coverage(reads: DataFrame, genome_size: float) -> DataFrame:
    return reads.agg((F.sum("len") / F.lit(float(genome_size))).alias("coverage"))
