"""Trimming: covered parts, subreads, bad regions and clear ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import intervals as I


def accept_in_order(pdf: pd.DataFrame, min_overlap: int) -> pd.DataFrame:
    """The overlaps of one read that start or end away from all accepted before; order is what the rule depends on.

    An end close to the read's own end is never too close to another.
    """
    slack, n = min_overlap // 50, int(pdf["a_len"].iloc[0])
    begins: set[int] = set()
    ends: set[int] = set()
    keep = []
    for lo, hi in zip(pdf["lo"], pdf["hi"], strict=True):
        near = lo > 15 and any(b in begins for b in range(lo - slack, lo + slack + 1)) or hi < n - 15 and any(e in ends for e in range(hi - slack, hi + slack + 1))
        keep.append(not near)
        if not near:
            begins.add(lo)
            ends.add(hi)
    return pdf[keep]


def largest_covered(overlaps: DataFrame, max_evalue: int, min_overlap: int, min_coverage: int = 1) -> DataFrame:
    """(read_id, bgn, end): the longest part of each read covered ``min_coverage`` deep and joined by ``min_overlap``.

    Accepted overlaps (in the order b_id, flipped, begin, end) are shrunk by 5 % or 250 bases at ends that do
    not reach the read's. The order-dependent step alone runs per read outside generated code.
    """
    iv = overlaps.where(F.col("evalue") <= max_evalue).select("a_id", "b_id", "flipped", F.col("ahg5").cast("int").alias("lo"), (F.col("a_len") - F.col("ahg3")).cast("int").alias("hi"), F.col("a_len").cast("int").alias("a_len")).where(F.col("hi") - F.col("lo") >= min_overlap)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["b_id", "flipped", "lo", "hi"])
        return accept_in_order(pdf, min_overlap)[["a_id", "lo", "hi", "a_len"]]

    kept = iv.groupBy("a_id").applyInPandas(run, "a_id bigint, lo int, hi int, a_len int")
    shrink = F.least(F.floor((F.col("hi") - F.col("lo")) * 0.05), F.lit(250)).cast("bigint")
    cut = kept.select(F.col("a_id").alias("key"), F.when(F.col("lo") == 0, F.lit(0)).otherwise(F.col("lo") + shrink).cast("bigint").alias("lo"), F.when(F.col("hi") == F.col("a_len"), F.col("hi")).otherwise(F.col("hi") - shrink).cast("bigint").alias("hi")).where("lo < hi")
    joined = I.merge(cut, min_overlap).select("key", "lo", "hi")
    if min_coverage > 1:
        deep = I.merge(I.depth(cut).where(F.col("depth") >= min_coverage).select("key", "lo", "hi")).select("key", "lo", "hi")
        joined = I.intersect(joined, deep)
    return I.largest(joined).select(F.col("key").alias("read_id"), F.col("lo").alias("bgn"), F.col("hi").alias("end"))


def trim_status(reads: DataFrame, ranges: DataFrame, min_length: int) -> DataFrame:
    """(read_id, bgn, end, status): NOV no overlap, DEL too short, NOC unchanged, MOD trimmed."""
    j = reads.join(ranges, "read_id", "left")
    st = F.when(F.col("bgn").isNull(), "NOV").when(F.col("end") - F.col("bgn") < min_length, "DEL").when((F.col("bgn") == 0) & (F.col("end") == F.col("len")), "NOC").otherwise("MOD")
    return j.select("read_id", F.coalesce("bgn", F.lit(0)).alias("bgn"), F.coalesce("end", F.lit(0)).alias("end"), st.alias("status"))


def enforce_max_clear(ranges: DataFrame, maximal: DataFrame) -> DataFrame:
    """Ranges within (read_id, max_bgn, max_end); ``ok`` is false if nothing is left."""
    j = ranges.join(maximal, "read_id")
    lo, hi = F.greatest("bgn", "max_bgn"), F.least("end", "max_end")
    return j.select("read_id", F.when(lo < hi, lo).otherwise(0).alias("bgn"), F.when(lo < hi, hi).otherwise(0).alias("end"), (lo < hi).alias("ok"))


def subread_evidence(overlaps: DataFrame, on_a: int = 250, on_b: int = 250) -> DataFrame:
    """(read_id, lo, hi, b_id) of junctions: two overlaps of opposite orientation with one b that hardly meet on a but do on b."""
    c = F.col
    o = overlaps.select("a_id", "b_id", "flipped", c("ahg5").alias("alo"), (c("a_len") - c("ahg3")).alias("ahi"), F.when(c("flipped"), c("bhg3")).otherwise(c("bhg5")).alias("blo"), F.when(c("flipped"), c("b_len") - c("bhg5")).otherwise(c("b_len") - c("bhg3")).alias("bhi"))
    x = o.where("not flipped").select("a_id", "b_id", *[c(k).alias(f"x{k}") for k in ("alo", "ahi", "blo", "bhi")])
    y = o.where("flipped").select("a_id", "b_id", *[c(k).alias(f"y{k}") for k in ("alo", "ahi", "blo", "bhi")])
    j = x.join(y, ["a_id", "b_id"])
    meet = lambda p: F.greatest(F.least(c(f"x{p}hi"), c(f"y{p}hi")) - F.greatest(c(f"x{p}lo"), c(f"y{p}lo")), F.lit(0))
    j = j.withColumn("on_a", meet("a")).withColumn("on_b", meet("b")).where((c("on_a") <= on_a) & (c("on_b") >= on_b))
    first = c("xalo") <= c("yalo")
    lo = F.when(first, c("xahi")).otherwise(c("yahi"))
    hi = F.when(first, c("yalo")).otherwise(c("xalo"))
    return j.select(c("a_id").alias("read_id"), F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi"), "b_id")


def detect_subreads(overlaps: DataFrame, max_gap: int = 500, min_count: int = 3, max_spanning: int = 9, on_a: int = 250, on_b: int = 250) -> DataFrame:
    """(read_id, lo, hi, n, n_span): junctions of several pairs that few overlaps span."""
    e = subread_evidence(overlaps, on_a, on_b).where((F.col("hi") > F.col("lo")) & (F.col("hi") - F.col("lo") <= max_gap))
    m = I.merge(e.select(F.col("read_id").alias("key"), "lo", "hi")).where(F.col("n") >= min_count)
    cover = overlaps.select(F.col("a_id").alias("key"), F.col("ahg5").alias("lo"), (F.col("a_len") - F.col("ahg3")).alias("hi"))
    s = I.spanning(m.select("key", "lo", "hi"), cover, 100)
    return m.join(s, ["key", "lo", "hi"]).where(F.col("n_span") <= max_spanning).select(F.col("key").alias("read_id"), "lo", "hi", "n", "n_span")


def trim_bad(ranges: DataFrame, bad: DataFrame, min_length: int) -> DataFrame:
    """(read_id, bgn, end, deleted): the largest part of each clear range without bad regions (read_id, lo, hi)."""
    within = bad.join(ranges, "read_id").select(F.col("read_id").alias("key"), F.greatest("lo", "bgn").alias("lo"), F.least("hi", "end").alias("hi")).where("lo < hi")
    bounds = ranges.select(F.col("read_id").alias("key"), "bgn", "end")
    left = I.largest(I.invert(I.merge(within), bounds)).withColumnRenamed("key", "read_id")
    j = ranges.select("read_id").join(left, "read_id", "left")
    ok = F.coalesce(F.col("hi") - F.col("lo") >= min_length, F.lit(False))
    return j.select("read_id", F.when(ok, F.col("lo")).otherwise(0).alias("bgn"), F.when(ok, F.col("hi")).otherwise(0).alias("end"), (~ok).alias("deleted"))


def best_edge_trim(overlaps: DataFrame, ranges: DataFrame) -> DataFrame:
    """(read_id, bgn, end): the outermost begin and end of overlaps inside the range that maximise the overlap at each end."""
    iv = overlaps.select(F.col("a_id").alias("read_id"), F.col("ahg5").alias("lo"), (F.col("a_len") - F.col("ahg3")).alias("hi")).join(ranges, "read_id")
    lo, hi = F.greatest("lo", "bgn"), F.least("hi", "end")
    iv = iv.withColumn("lo", lo).withColumn("hi", hi).where("lo < hi")
    best5 = F.max(F.struct((F.col("hi") - F.col("lo")).alias("n"), (-F.col("lo")).alias("neg")))
    best3 = F.max(F.struct((F.col("hi") - F.col("lo")).alias("n"), F.col("hi").alias("pos")))
    half = F.floor((F.col("bgn") + F.col("end")) / 2)
    at5, at3 = iv.where(F.col("lo") < half).groupBy("read_id").agg(best5.alias("b")), iv.where(F.col("hi") > half).groupBy("read_id").agg(best3.alias("e"))
    return at5.join(at3, "read_id").select("read_id", (-F.col("b.neg")).alias("bgn"), F.col("e.pos").alias("end"))


def merge_ranges(batches: DataFrame) -> DataFrame:
    """(read_id, bgn, end) of clear ranges (batch, read_id, bgn, end) that batches of reads have written; of a read in several, the last batch's."""
    last = batches.groupBy("read_id").agg(F.max(F.struct("batch", "bgn", "end")).alias("r"))
    return last.select("read_id", "r.bgn", "r.end")
