"""Sketches of k-mer sets: MinHash signatures with tf-idf weighting, minimizers, and the joins on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hashes, least matches, threshold and ordered sketch size by sensitivity; high up to 30x, normal below 60x.
SENSITIVITY = {"low": (256, 3, 0.80, 1000), "normal": (512, 3, 0.78, 1000), "high": (768, 2, 0.73, 1536)}


def sensitivity(coverage: float) -> str:
    return "high" if coverage <= 30 else "normal" if coverage < 60 else "low"


def minhash(kmers: DataFrame, slots: int) -> DataFrame:
    """(read_id, slot, h) of expanded k-mers: the least md5 in each slot.

    The slots of a read come from one aggregation of distinct k-mers: minima combine before the shuffle.
    """
    aggs = [F.min(F.md5(F.concat("kmer", F.lit(str(s))))).alias(f"h{s}") for s in range(slots)]
    wide = kmers.groupBy("read_id").agg(*aggs)
    return wide.select("read_id", F.posexplode(F.array(*[f"h{s}" for s in range(slots)])).alias("slot", "h"))


def minhash_pairs(signatures: DataFrame, min_matches: int, max_bucket: int | None = None) -> DataFrame:
    """(a_id, b_id, matches) of reads that agree in ``min_matches`` slots or more; buckets above ``max_bucket`` reads (repeats) are left out."""
    s = signatures
    if max_bucket is not None:
        s = s.join(s.groupBy("slot", "h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= max_bucket).drop("_n"), ["slot", "h"], "left_semi")
    a, b = s.withColumnRenamed("read_id", "a_id"), s.withColumnRenamed("read_id", "b_id")
    j = a.join(b, ["slot", "h"]).where("a_id < b_id")
    return j.groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("matches")).where(F.col("matches") >= min_matches)


def minimizers(kmers: DataFrame, window: int) -> DataFrame:
    """(read_id, pos, kmer): the least md5 of every ``window`` consecutive k-mers, the first of equals."""
    by = W.partitionBy("read_id").orderBy("pos").rowsBetween(0, window - 1)
    least = kmers.select("read_id", F.min(F.struct(F.md5("kmer").alias("h"), "pos", "kmer")).over(by).alias("m"), F.count(F.lit(1)).over(by).alias("n"))
    return least.where(F.col("n") == window).select("read_id", "m.pos", "m.kmer").distinct()


def minimizer_pairs(marks: DataFrame, band: int, min_seeds: int) -> DataFrame:
    """(a_id, b_id, band, seeds) of reads whose shared minimizers lie on one band of diagonals."""
    a = marks.select(F.col("read_id").alias("a_id"), F.col("pos").alias("apos"), "kmer")
    b = marks.select(F.col("read_id").alias("b_id"), F.col("pos").alias("bpos"), "kmer")
    j = a.join(b, "kmer").where("a_id < b_id")
    return j.groupBy("a_id", "b_id", F.floor((F.col("apos") - F.col("bpos")) / band).alias("band")).agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= min_seeds)


def idf_weights(kmers: DataFrame, reads: int, scale: float = 10.0) -> DataFrame:
    """(kmer, weight): rarer k-mers weigh more, from 1 up to ``scale``."""
    per = kmers.select("read_id", "kmer").distinct().groupBy("kmer").agg(F.count(F.lit(1)).alias("df"))
    return per.select("kmer", (1 + (scale - 1) * F.log(F.lit(reads) / F.col("df")) / F.log(F.lit(float(max(reads, 2))))).alias("weight"))
