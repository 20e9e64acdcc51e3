"""Tigs: placement of reads, depth and error profiles, repeats, classification and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.seq import decode_evalue
from . import intervals as I


#: Bases of a bin in joins of stretches of a tig.
BIN = 4096


def project(overlaps: DataFrame, placed: DataFrame) -> DataFrame:
    """Where each overlap puts its read a, by the placement (tig_id, read_id, lo, hi, reverse) of b.

    Four cases of orientation; overlaps whose hangs leave nothing of the placed read are dropped.
    """
    p = placed.select("tig_id", F.col("read_id").alias("b_id"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.col("reverse").alias("brev"))
    j = overlaps.join(p, "b_id")
    a, b = G.a_hang(), G.b_hang()
    j = j.where(F.col("bhi") - F.col("blo") + F.least(a, F.lit(0)) - F.greatest(b, F.lit(0)) > 0)
    fwd = F.col("flipped") == F.col("brev")  # a lies forward on the tig
    lo = F.when(fwd, F.col("blo") - a).otherwise(F.col("blo") + b)
    hi = F.when(fwd, F.col("bhi") - b).otherwise(F.col("bhi") + a)
    vlo = F.when(fwd, F.col("blo") - F.least(a, F.lit(0))).otherwise(F.col("blo") + F.greatest(b, F.lit(0)))
    vhi = F.when(fwd, F.col("bhi") - F.greatest(b, F.lit(0))).otherwise(F.col("bhi") + F.least(a, F.lit(0)))
    errors = G.overlap_length(F.col("a_len"), F.col("b_len")) * decode_evalue(F.col("evalue"))
    cbgn, cend = F.greatest(a, F.lit(0)), F.col("a_len") + F.least(b, F.lit(0))
    return j.select(F.col("a_id").alias("read_id"), "tig_id", (~fwd).alias("reverse"), lo.alias("lo"), hi.alias("hi"), vlo.alias("vlo"), vhi.alias("vhi"), cbgn.alias("cbgn"), cend.alias("cend"), errors.alias("errors"), "a_len")


def cluster(projected: DataFrame, slop: float = 0.075) -> DataFrame:
    """One placement for each (read, tig, orientation) and cluster of begins and of ends within ``slop`` of the read's length."""
    key = ["read_id", "tig_id", "reverse"]
    d = F.greatest(F.lit(5), F.floor(F.col("a_len") * slop))
    out = projected
    for c in ("lo", "hi"):
        w = W.partitionBy(*key).orderBy(c)
        new = F.coalesce((F.col(c) - d) > (F.lag(c).over(w) + d), F.lit(True)).cast("int")
        out = out.withColumn("_new", new).withColumn(f"_{c}", F.sum("_new").over(w.rangeBetween(W.unboundedPreceding, 0))).drop("_new")
    g = out.groupBy(*key, "_lo", "_hi")
    placed = g.agg(F.floor(F.avg("lo") + 0.5).alias("lo"), F.floor(F.avg("hi") + 0.5).alias("hi"), F.min("vlo").alias("vlo"), F.max("vhi").alias("vhi"), F.min("cbgn").alias("cbgn"), F.max("cend").alias("cend"), F.sum("errors").alias("errors"), F.sum(F.col("cend") - F.col("cbgn")).alias("aligned"), F.max("a_len").alias("a_len"), F.count(F.lit(1)).alias("n"))
    return placed.withColumn("f_coverage", (F.col("cend") - F.col("cbgn")) / F.col("a_len")).drop("_lo", "_hi")


def place_contained(clusters: DataFrame, min_coverage: float = 0.99, max_erate: float = 0.05, placed: DataFrame | None = None) -> DataFrame:
    """The placement with the lowest error of each read that is covered well enough; with ``placed``, one in a tig of a single read
    only if the read has none in another."""
    e = F.col("errors") / F.col("aligned")
    good = clusters.withColumn("erate", e).where((F.col("f_coverage") >= min_coverage) & (e <= max_erate))
    if placed is not None:
        sizes = placed.groupBy("tig_id").agg((F.count(F.lit(1)) == 1).alias("_alone"))
        good = good.join(sizes, "tig_id").withColumn("_all", F.min("_alone").over(W.partitionBy("read_id"))).where(~F.col("_alone") | F.col("_all")).drop("_alone", "_all")
    w = W.partitionBy("read_id").orderBy("erate", F.desc("aligned"), "tig_id", "lo", "reverse")
    return good.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def without_singletons(placed: DataFrame) -> DataFrame:
    """Placements in tigs of two reads or more; the reads of other tigs are unplaced."""
    few = placed.groupBy("tig_id").agg(F.count(F.lit(1)).alias("n")).where("n < 2").select("tig_id")
    return placed.join(few, "tig_id", "left_anti")


def promoted(placed: DataFrame, lengths: DataFrame) -> DataFrame:
    """(tig_id, read_id, lo, hi, reverse) of reads (read_id, len) that are in no tig: each becomes one of its own, named by the read."""
    z = F.lit(0).cast("bigint")
    return lengths.where("len > 0").join(placed.select("read_id").distinct(), "read_id", "left_anti").select(F.col("read_id").alias("tig_id"), "read_id", z.alias("lo"), F.col("len").cast("bigint").alias("hi"), F.lit(False).alias("reverse"))


def thickest(placed: DataFrame, regions: DataFrame, after: bool, bin_size: int = 256) -> DataFrame:
    """(tig_id, read_id, other_id, thickness) of reads that begin (``after``: end) inside a region (tig_id, rlo, rhi): the read placed before
    (after) them that overlaps them the most, if that overlap ends (begins) inside the region too.

    ``placed`` has the reads that count as neighbours, in the order of begin, end and id. The thickest overlap with a read before is the one
    that reaches farthest (with a read after: that begins first), so a running best replaces the pairs: over a bin's reads, then over bins.
    """
    p = placed.select("tig_id", "read_id", "lo", "hi").where("lo is not null and hi is not null and read_id is not null").distinct().withColumn("bin", F.floor(F.col("lo") / bin_size))
    # the sign makes the better one the greater: the farthest end or the first begin, of equals the least id
    reach = -F.col("lo") if after else F.col("hi")
    p = p.withColumn("me", F.struct(reach.alias("reach"), (-F.col("read_id")).alias("neg")))
    along = F.desc if after else F.asc  # a frame that only grows takes one pass
    near = F.max("me").over(W.partitionBy("tig_id", "bin").orderBy(along("lo"), along("hi"), along("read_id")).rowsBetween(W.unboundedPreceding, -1))
    bins = p.groupBy("tig_id", "bin").agg(F.max("me").alias("most"))
    far = bins.select("tig_id", "bin", F.max("most").over(W.partitionBy("tig_id").orderBy(along("bin")).rowsBetween(W.unboundedPreceding, -1)).alias("far"))
    edge = F.col("hi") if after else F.col("lo")
    p = p.withColumn("near", near).join(far, ["tig_id", "bin"]).withColumn("best", F.greatest("near", "far")).where("best is not null")
    size = F.col("hi") + F.col("best.reach") if after else F.col("best.reach") - F.col("lo")
    at = F.explode(F.sequence(F.floor(F.col("rlo") / BIN), F.floor(F.col("rhi") / BIN)))
    r = regions.select("tig_id", "rlo", "rhi", at.alias("at"))
    inside = p.withColumn("thickness", size).where("thickness > 0").withColumn("at", F.floor(edge / BIN)).join(r, ["tig_id", "at"]).where(edge.between(F.col("rlo"), F.col("rhi")))
    best = inside.groupBy("tig_id", "read_id", "rlo", "rhi").agg(F.max(F.struct("thickness", "best.neg", (-F.col("best.reach") if after else F.col("best.reach")).alias("reach"))).alias("b"))
    return best.where(F.col("b.reach").between(F.col("rlo"), F.col("rhi"))).select("tig_id", "read_id", (-F.col("b.neg")).alias("other_id"), F.col("b.thickness").alias("thickness"))


def in_tig(overlaps: DataFrame, placed: DataFrame) -> DataFrame:
    """(tig_id, lo, hi, evalue) of overlaps whose reads lie in one tig and intersect there."""
    p = placed.select("tig_id", "read_id", "lo", "hi")
    a = p.select(F.col("tig_id"), F.col("read_id").alias("a_id"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    b = p.select(F.col("tig_id").alias("btig"), F.col("read_id").alias("b_id"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    j = overlaps.where("a_id < b_id").join(a, "a_id").join(b, "b_id").where("tig_id = btig")
    return j.select("tig_id", F.greatest("alo", "blo").alias("lo"), F.least("ahi", "bhi").alias("hi"), "evalue").where("lo < hi")


def error_profile(spans: DataFrame) -> DataFrame:
    """(tig_id, lo, hi, n, mean, stddev) of evalues of the overlaps (tig_id, lo, hi, evalue) open over each stretch.

    A sweep: sums of count, error and squared error open and close with the overlaps; sums are integers, so nothing drifts.
    """
    e = F.col("evalue")
    ev = spans.select("tig_id", F.explode(F.array(F.struct(F.col("lo").alias("pos"), F.lit(1).alias("n"), e.alias("s"), (e * e).alias("q")), F.struct(F.col("hi").alias("pos"), F.lit(-1).alias("n"), (-e).alias("s"), (-e * e).alias("q")))).alias("v"))
    sums = ev.groupBy("tig_id", F.col("v.pos").alias("lo")).agg(F.sum("v.n").alias("n"), F.sum("v.s").alias("s"), F.sum("v.q").alias("q"))
    w = W.partitionBy("tig_id").orderBy("lo")
    run = sums.select("tig_id", "lo", F.lead("lo").over(w).alias("hi"), F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("s"), F.sum("q").over(w).alias("q")).where("n > 0 and hi is not null")
    mean = F.col("s") / F.col("n")
    var = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))).otherwise(0.0)
    return run.select("tig_id", "lo", "hi", "n", mean.alias("mean"), F.sqrt(var).alias("stddev"))


def consistency(spans: DataFrame, profile: DataFrame, deviations: float = 6.0) -> DataFrame:
    """(tig_id, lo, hi, evalue, share): part of each stretch's bases where its error is within the profile's bound."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / BIN), F.floor((F.col(hi) - 1) / BIN))).alias("_bin")
    p = profile.where("lo < hi").select("tig_id", F.col("lo").alias("plo"), F.col("hi").alias("phi"), (F.col("mean") + deviations * F.col("stddev")).alias("bound"), bins("lo", "hi"))
    j = spans.select("*", bins("lo", "hi")).join(p, ["tig_id", "_bin"]).where((F.col("plo") < F.col("hi")) & (F.col("lo") < F.col("phi")))
    j = j.where(F.col("_bin") == F.floor(F.greatest("lo", "plo") / BIN))  # each pair in its first common bin
    n = F.least("hi", "phi") - F.greatest("lo", "plo")
    return j.groupBy("tig_id", "lo", "hi", "evalue").agg((F.sum(F.when(F.col("evalue") <= F.col("bound"), n).otherwise(0)) / F.sum(n)).alias("share"))


def classify_unassembled(placed: DataFrame, few_reads: int = 2, short: int = 0, span: float = 1.0, low_share: float = 0.5, low_depth: int = 3) -> DataFrame:
    """(tig_id, rule): S single read, 1 few reads, 2 short, 3 one read spans it, 4 low coverage, else contig."""
    t = placed.groupBy("tig_id").agg(F.count(F.lit(1)).alias("n"), (F.max("hi") - F.min("lo")).alias("len"), F.max(F.col("hi") - F.col("lo")).alias("longest"))
    seg = I.depth(placed.select(F.col("tig_id").alias("key"), "lo", "hi"))
    w = F.col("hi") - F.col("lo")
    low = seg.groupBy(F.col("key").alias("tig_id")).agg((F.sum(F.when(F.col("depth") < low_depth, w).otherwise(0)) / F.sum(w)).alias("low"))
    j = t.join(low, "tig_id")
    rule = F.when(F.col("n") == 1, "S").when(F.col("n") < few_reads, "1").when(F.col("len") < short, "2").when(F.col("longest") > F.col("len") * span, "3").when(F.col("low") >= low_share, "4").otherwise("contig")
    return j.select("tig_id", rule.alias("rule"))


def tig_sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("tig_id").agg(F.count(F.lit(1)).alias("reads"), (F.max("hi") - F.min("lo")).alias("len"))


def satisfied(overlaps: DataFrame, placed: DataFrame) -> DataFrame:
    """(kind, where, n): overlaps by kind, and whether their reads lie in one tig, intersect there and agree in orientation."""
    a = placed.select(F.col("read_id").alias("a_id"), F.col("tig_id").alias("at"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.col("reverse").alias("ar"))
    b = placed.select(F.col("read_id").alias("b_id"), F.col("tig_id").alias("bt"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.col("reverse").alias("br"))
    kind = F.when(G.hang_dovetail(), "dovetail").otherwise("contained")
    j = overlaps.select("a_id", "b_id", "flipped", kind.alias("kind")).join(a, "a_id", "left").join(b, "b_id", "left")
    meet = (F.col("alo") < F.col("bhi")) & (F.col("blo") < F.col("ahi"))
    where = F.when(F.col("at").isNull() | F.col("bt").isNull(), "unplaced").when(F.col("at") != F.col("bt"), "different-tig").when(~meet, "apart").when((F.col("ar") != F.col("br")) == F.col("flipped"), "satisfied").otherwise("misoriented")
    return j.groupBy("kind", where.alias("where")).agg(F.count(F.lit(1)).alias("n"))


def repeats(marks: DataFrame, placed: DataFrame, min_overlap: int = 50, anchor: int = 500) -> DataFrame:
    """(tig_id, lo, hi): repeat marks merged, without those a read spans with anchors on both sides, extended by the anchor and merged where they touch."""
    m = I.merge(marks.select(F.col("tig_id").alias("key"), "lo", "hi"), min_overlap).withColumnRenamed("key", "tig_id")
    alone = I.spanning(m.select("tig_id", "lo", "hi"), placed, anchor, "tig_id").where("n_span = 0")
    wide = alone.select(F.col("tig_id").alias("key"), (F.col("lo") - anchor).alias("lo"), (F.col("hi") + anchor).alias("hi"))
    return I.merge(wide).select(F.col("key").alias("tig_id"), "lo", "hi")


def mask(bases, lo, hi):
    """Bases with [lo, hi) overwritten."""
    return F.overlay(bases, F.repeat(F.lit("_"), hi - lo), lo + 1, hi - lo)


def tig_filter(placed: DataFrame, reads=(0, None), length=(0, None)) -> DataFrame:
    s = tig_sizes(placed)
    keep = (F.col("reads") >= reads[0]) & (F.col("len") >= length[0])
    keep = keep & (F.col("reads") <= reads[1]) if reads[1] is not None else keep
    keep = keep & (F.col("len") <= length[1]) if length[1] is not None else keep
    return s.where(keep)


def split_blocks(placed: DataFrame, breaks: DataFrame) -> DataFrame:
    """``placed`` with ``block``: the last block (between break points (tig_id, pos)) that holds a read's begin and end; reads across a break go to none."""
    w = W.partitionBy("tig_id").orderBy("pos")
    b = breaks.select("tig_id", "pos").distinct()
    lo = b.select("tig_id", F.lag("pos").over(w).alias("from"), F.col("pos").alias("to"))
    last = b.groupBy("tig_id").agg(F.max("pos").alias("from")).withColumn("to", F.lit(None).cast("bigint"))
    blocks = lo.unionByName(last).withColumn("block", F.row_number().over(W.partitionBy("tig_id").orderBy(F.col("from").asc_nulls_first())))
    inside = (F.col("from").isNull() | (F.col("lo") >= F.col("from"))) & (F.col("to").isNull() | (F.col("hi") <= F.col("to")))
    j = placed.join(blocks, "tig_id").where(inside)
    return placed.join(j.groupBy("tig_id", "read_id").agg(F.max("block").alias("block")), ["tig_id", "read_id"], "left")


def assembly_graph(clusters: DataFrame, placed: DataFrame, min_coverage: float = 0.01, max_erate: float = 1.0) -> DataFrame:
    """(tig_id, target, reads, thickest): placements of a tig's reads in other tigs, as edges with the longest covered part."""
    home = placed.select("read_id", F.col("tig_id").alias("home"))
    away = clusters.join(home, "read_id").where((F.col("tig_id") != F.col("home")) & (F.col("f_coverage") >= min_coverage) & (F.col("errors") <= F.col("aligned") * max_erate))
    return away.groupBy(F.col("home").alias("tig_id"), F.col("tig_id").alias("target")).agg(F.count_distinct("read_id").alias("reads"), F.max(F.col("cend") - F.col("cbgn")).alias("thickest"))


def orphan_decisions(clusters: DataFrame, placed: DataFrame, min_coverage: float = 0.99) -> DataFrame:
    """(tig_id, n_orphan, n_bubble, decision) of tigs by where their reads could lie instead.

    A target at least as long that takes all reads makes an orphan of the tig, one that takes both terminal
    reads a bubble. One orphan target: merge into it; several: each read goes where its error is least
    (distribute); none but a bubble target: bubble; else keep.
    """
    w = W.partitionBy("tig_id")
    ends = placed.withColumn("first", F.row_number().over(w.orderBy("lo", "hi", "read_id")) == 1).withColumn("last", F.row_number().over(w.orderBy(F.desc("hi"), F.desc("lo"), F.desc("read_id"))) == 1)
    home = ends.select("read_id", F.col("tig_id").alias("home"), (F.col("first") | F.col("last")).alias("terminal"))
    size = placed.groupBy("tig_id").agg(F.count(F.lit(1)).alias("n"), (F.max("hi") - F.min("lo")).alias("len"))
    own = size.join(home.where("terminal").groupBy(F.col("home").alias("tig_id")).agg(F.count(F.lit(1)).alias("n_terminal")), "tig_id").select(F.col("tig_id").alias("home"), "n", "n_terminal", F.col("len").alias("home_len"))
    away = clusters.where(F.col("f_coverage") >= min_coverage).select("read_id", "tig_id").distinct().join(home, "read_id").where("tig_id <> home")
    per = away.groupBy("home", "tig_id").agg(F.count(F.lit(1)).alias("placed"), F.count_if("terminal").alias("placed_terminal")).join(own, "home").join(size.select("tig_id", "len"), "tig_id").where("len >= home_len and n > 1")
    orphan = F.col("placed") == F.col("n")
    out = per.groupBy("home").agg(F.count_if(orphan).alias("n_orphan"), F.count_if(~orphan & (F.col("placed_terminal") == F.col("n_terminal"))).alias("n_bubble"))
    j = size.select("tig_id").join(out, F.col("tig_id") == F.col("home"), "left").select("tig_id", F.coalesce("n_orphan", F.lit(0)).alias("n_orphan"), F.coalesce("n_bubble", F.lit(0)).alias("n_bubble"))
    return j.withColumn("decision", F.when(F.col("n_orphan") == 1, "merge").when(F.col("n_orphan") > 1, "distribute").when(F.col("n_bubble") > 0, "bubble").otherwise("keep"))
