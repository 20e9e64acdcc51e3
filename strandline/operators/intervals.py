"""Interval algebra on rows (key, lo, hi), half-open, by window functions over each key.

A key's intervals meet in one task, sorted and spilled by Spark, never gathered into an array; a hot key
(one long tig) can be cut beforehand with ``binned``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge(iv: DataFrame, min_overlap: int = 0, key: str = "key") -> DataFrame:
    """Unions of intervals that overlap by ``min_overlap`` or more: (key, lo, hi, n)."""
    by = W.partitionBy(key).orderBy("lo", "hi")
    far = F.max("hi").over(by.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(far.isNull() | (F.col("lo") > far - min_overlap), 1).otherwise(0)
    runs = iv.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n")).drop("_run")


def depth(iv: DataFrame, key: str = "key") -> DataFrame:
    """Segments of constant depth, 1 or more: (key, lo, hi, depth). Events are summed before the window sorts them."""
    events = iv.select(key, F.explode(F.array(F.struct(F.col("lo").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    sums = events.groupBy(key, F.col("e.pos").alias("lo")).agg(F.sum("e.d").alias("d"))
    by = W.partitionBy(key).orderBy("lo")
    seg = sums.select(key, "lo", F.lead("lo").over(by).alias("hi"), F.sum("d").over(by).alias("depth"))
    return seg.where("depth > 0 and hi is not null")


def invert(merged: DataFrame, bounds: DataFrame, key: str = "key") -> DataFrame:
    """What merged intervals leave of each key's bounds (key, bgn, end): (key, lo, hi)."""
    ends = bounds.select(key, F.explode(F.array(F.struct(F.col("bgn").alias("lo"), F.col("bgn").alias("hi")), F.struct(F.col("end").alias("lo"), F.col("end").alias("hi")))).alias("e")).select(key, "e.*")
    by = W.partitionBy(key).orderBy("lo", "hi")
    all_ = merged.select(key, "lo", "hi").unionByName(ends)
    return all_.select(key, F.max("hi").over(by.rowsBetween(W.unboundedPreceding, -1)).alias("lo"), F.col("lo").alias("hi")).where("lo < hi")


def intersect(a: DataFrame, b: DataFrame, key: str = "key", bin_size: int = 1024) -> DataFrame:
    """Pairwise intersections of two interval sets: an equi-join on key and bin, each pair in its first common bin."""
    def binned(x: DataFrame, lo: str, hi: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col("lo") / bin_size), F.floor((F.col("hi") - 1) / bin_size))
        return x.where("lo < hi").select(key, F.col("lo").alias(lo), F.col("hi").alias(hi), F.explode(bins).alias("_bin"))
    j = binned(a, "alo", "ahi").join(binned(b, "blo", "bhi"), [key, "_bin"])
    lo, hi = F.greatest("alo", "blo"), F.least("ahi", "bhi")
    return j.where((lo < hi) & (F.col("_bin") == F.floor(lo / bin_size))).select(key, lo.alias("lo"), hi.alias("hi"))


def spanning(marks: DataFrame, reads: DataFrame, anchor: int, key: str = "key", bin_size: int = 4096) -> DataFrame:
    """(key, lo, hi, n_span): marks and how many reads cover them with ``anchor`` bases to spare on both sides.

    A mark lies in the bin of its begin, a read in all that it covers, so no task has a whole key's marks and reads.
    """
    at = F.floor(F.col("lo") / bin_size)
    covered = F.sequence(F.floor(F.col("lo") / bin_size), F.floor(F.col("hi") / bin_size))
    r = reads.where("lo <= hi").select(F.col(key).alias("_k"), F.col("lo").alias("rlo"), F.col("hi").alias("rhi"), F.explode(covered).alias("_b"))
    m = marks.withColumn("_bin", at)
    j = m.join(r, (F.col(key) == F.col("_k")) & (F.col("_bin") == F.col("_b")) & (F.col("rlo") + anchor <= F.col("lo")) & (F.col("hi") + anchor <= F.col("rhi")), "left")
    return j.groupBy(key, "lo", "hi").agg(F.count("rlo").alias("n_span"))


def thin_overlaps(placed: DataFrame, key: str = "key") -> DataFrame:
    """(key, lo, hi, thickness): consecutive intervals by begin, and how far all before reach into each."""
    by = W.partitionBy(key).orderBy("lo", "hi")
    far = F.max("hi").over(by.rowsBetween(W.unboundedPreceding, -1))
    return placed.select(key, "lo", "hi", (far - F.col("lo")).alias("thickness")).where("thickness is not null")


def split_discontinuous(placed: DataFrame, min_overlap: int, key: str = "tig_id") -> DataFrame:
    """``placed`` with ``part`` from 0: a new part where a begin lies beyond the farthest end less the overlap."""
    by = W.partitionBy(key).orderBy("lo", "hi", "read_id")
    far = F.max("hi").over(by.rowsBetween(W.unboundedPreceding, -1))
    return placed.withColumn("part", F.sum(F.when(F.col("lo") > far - min_overlap, 1).otherwise(0)).over(by.rowsBetween(W.unboundedPreceding, 0)))


def coverage(segments: DataFrame, inclusive: bool = False, key: str = "key") -> DataFrame:
    """Mean, largest and standard deviation of depth over covered bases; ``inclusive`` weighs a segment by hi - lo + 1."""
    w = F.col("hi") - F.col("lo") + (1 if inclusive else 0)
    s = segments.groupBy(key).agg(F.sum(w).alias("n"), F.sum(w * F.col("depth")).alias("s"), F.sum(w * F.col("depth") * F.col("depth")).alias("q"), F.max("depth").alias("max_depth"))
    mean = F.col("s") / F.col("n")
    return s.select(key, F.col("n").alias("covered"), mean.alias("avg_depth"), "max_depth", F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("stddev_depth"))


def depth_histogram(segments: DataFrame) -> DataFrame:
    return segments.groupBy("depth").agg(F.sum(F.col("hi") - F.col("lo")).alias("bases"))


def largest(iv: DataFrame, key: str = "key") -> DataFrame:
    """The longest interval of each key, the first of equals."""
    return iv.groupBy(key).agg(F.min(F.struct((F.col("lo") - F.col("hi")).alias("neg"), "lo", "hi")).alias("m")).select(key, "m.lo", "m.hi")
