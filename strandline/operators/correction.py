"""Read correction: which overlaps are evidence, which reads are corrected, and how well that went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import intervals as I


def scored(overlaps: DataFrame, evalue=(0, 65535), length=(0, 1 << 30)) -> DataFrame:
    """Overlaps with a_len and ``score`` (of a), ``usable`` if evalue and aligned length are within range."""
    n = G.a_aligned(F.col("a_len"))
    return overlaps.withColumn("score", G.overlap_score(n, F.col("a_len"))).withColumn("usable", F.col("evalue").between(*evalue) & n.between(*length))


def global_threshold(scored_overlaps: DataFrame, coverage: int) -> DataFrame:
    """(a_id, threshold): the score behind ``coverage`` better ones, 0 if there are not so many."""
    w = W.partitionBy("a_id").orderBy(F.desc("score"), "b_id", "flipped")
    ranked = scored_overlaps.where("usable").select("a_id", "score", F.row_number().over(w).alias("r")).where(F.col("r") <= coverage + 1)
    hit = ranked.where(F.col("r") == coverage + 1).select("a_id", F.col("score").alias("threshold"))
    return scored_overlaps.select("a_id").distinct().join(hit, "a_id", "left").select("a_id", F.coalesce("threshold", F.lit(0)).alias("threshold"))


def threshold_stats(scored_overlaps: DataFrame, thresholds: DataFrame, evalue, length) -> DataFrame:
    """One row of counts of what the global filter does to overlaps."""
    n, e = G.a_aligned(F.col("a_len")), F.col("evalue")
    below = F.col("usable") & (F.col("score") < F.col("threshold"))
    j = scored_overlaps.join(thresholds, "a_id")
    return j.agg(F.count(F.lit(1)).alias("total"), F.count_if(e < evalue[0]).alias("low_erate"), F.count_if(e > evalue[1]).alias("high_erate"), F.count_if(n < length[0]).alias("too_short"), F.count_if(n > length[1]).alias("too_long"), F.count_if(below).alias("below_cutoff"), F.count_if(F.col("usable") & ~below).alias("retained"))


def reads_by_filtered(scored_overlaps: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row: reads whose filtered share of usable overlaps is at most 0, 50, 80, 95 and 100 %."""
    j = scored_overlaps.where("usable").join(thresholds, "a_id").groupBy("a_id").agg((F.count_if(F.col("score") < F.col("threshold")) / F.count(F.lit(1))).alias("f"))
    return j.agg(*[F.count_if(F.col("f") <= p / 100).alias(f"reads{p:03d}") for p in (0, 50, 80, 95, 100)])


def evidence(scored_overlaps: DataFrame, thresholds: DataFrame, max_evalue: int, min_length: int) -> DataFrame:
    """Overlaps that support correction of a: accurate and long enough, scoring at least b's threshold, the first of each (a, b)."""
    t = thresholds.select(F.col("a_id").alias("b_id"), "threshold")
    good = scored_overlaps.where((F.col("evalue") <= max_evalue) & (G.a_aligned(F.col("a_len")) >= min_length))
    good = good.join(t, "b_id").where(F.col("score") >= F.col("threshold"))
    w = W.partitionBy("a_id", "b_id").orderBy("flipped", "ahg5", "ahg3", "bhg5", "bhg3", "evalue")
    return good.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "threshold")


def drop_excess_coverage(layout: DataFrame, length: DataFrame, max_coverage: float, key: str = "tig_id") -> DataFrame:
    """``layout`` (key, read_id, lo, hi) with ``kept``: reads that extend the layout, then the longest contained ones up to ``max_coverage`` times its length."""
    by = W.partitionBy(key).orderBy("lo", F.desc("hi"), "read_id")
    far = F.max("hi").over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = layout.withColumn("backbone", far.isNull() | (F.col("hi") > far)).withColumn("n", F.col("hi") - F.col("lo"))
    rank = W.partitionBy(key).orderBy(F.desc("backbone"), F.desc("n"), "read_id").rowsBetween(W.unboundedPreceding, -1)
    run = marked.withColumn("before", F.coalesce(F.sum("n").over(rank), F.lit(0)))
    return run.join(length, key).withColumn("kept", F.col("backbone") | (F.col("before") < max_coverage * F.col("length"))).select(*layout.columns, "backbone", "kept")


def corrected_length(evidence_: DataFrame, min_coverage: int) -> DataFrame:
    """(key, corrected): the longest stretch of evidence intervals (key, lo, hi) at depth ``min_coverage`` or more."""
    deep = I.depth(evidence_).where(F.col("depth") >= min_coverage)
    return I.merge(deep.select("key", "lo", "hi")).groupBy("key").agg(F.max(F.col("hi") - F.col("lo")).alias("corrected"))


def select_reads(lengths: DataFrame, target: float) -> DataFrame:
    """(read_id, corrected, selected): the longest reads while what is before them is below ``target`` bases.

    Totals run over distinct lengths first, so one task ranks lengths, not reads.
    """
    per = lengths.groupBy("corrected").agg(F.count(F.lit(1)).alias("n"))
    w = W.orderBy(F.desc("corrected")).rowsBetween(W.unboundedPreceding, -1)
    before = per.select("corrected", F.coalesce(F.sum(F.col("n") * F.col("corrected")).over(w), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("corrected").orderBy("read_id")) - 1
    j = lengths.withColumn("rank", rank).join(before, "corrected")
    return j.select("read_id", "corrected", (F.col("before") + F.col("rank") * F.col("corrected") < target).alias("selected"))


def rescued(selected: DataFrame, evidence_: DataFrame, min_length: int) -> DataFrame:
    """Reads neither selected nor evidence of a selected one, but long enough."""
    used = evidence_.join(selected.where("selected").select(F.col("read_id").alias("a_id")), "a_id", "left_semi").select(F.col("b_id").alias("read_id"))
    return selected.where(~F.col("selected") & (F.col("corrected") > min_length)).join(used, "read_id", "left_anti")


def error_estimate(overlaps: DataFrame, deviations: float = 6.0) -> DataFrame:
    """One row: median + deviations * 1.4826 * MAD of the error of each b's longest overlap; 0.01 if that is 0. Exact order statistics over distinct evalues."""
    best = overlaps.groupBy("b_id").agg(F.max(F.struct("span", (-F.col("evalue")).alias("neg"))).alias("m")).select((-F.col("m.neg")).alias("v"))
    median = _upper_median(best).alias("median")
    dev = best.crossJoin(F.broadcast(median)).select(F.abs(F.col("v") - F.col("median")).alias("v"), "median")  # one row
    mad = _upper_median(dev.select("v")).withColumnRenamed("median", "mad")
    limit = (F.col("median") + deviations * 1.4826 * F.col("mad")) / 100_000
    return median.crossJoin(F.broadcast(mad)).select("median", "mad", F.when(limit == 0, 0.01).otherwise(limit).alias("error"))


def _upper_median(values: DataFrame) -> DataFrame:
    """(median) of ``v``, the upper of the middle two, from counts of distinct values."""
    per = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    per = per.select("v", F.sum("n").over(W.orderBy("v")).alias("c"), F.sum("n").over(W.partitionBy()).alias("t"))
    return per.where(F.col("c") > F.floor(F.col("t") / 2)).agg(F.min("v").alias("median"))
