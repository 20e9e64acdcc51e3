"""Best-overlap graph: containment, best edges, read flags, chunks and components.

Overlaps here are symmetric (both twins) and carry a_len and b_len.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..components import connected, ranked, staged
from ..functions import geometry as G
from ..functions.seq import decode_evalue
from . import intervals as I


def without(overlaps: DataFrame, flagged: DataFrame, side: str) -> DataFrame:
    """Overlaps whose read on ``side`` is not among ``flagged`` (read_id)."""
    return overlaps.join(flagged.select(F.col("read_id").alias(side)).distinct(), side, "left_anti")


def good_quality(max_erate: float, min_share: float = 0.0) -> Column:
    n = G.overlap_length(F.col("a_len"), F.col("b_len"))
    ok = decode_evalue(F.col("evalue")) <= max_erate
    return ok & (n >= F.col("a_len") * min_share) & (n >= F.col("b_len") * min_share) if min_share > 0 else ok


def contained(overlaps: DataFrame) -> DataFrame:
    """Reads inside another; of exact copies the smaller id."""
    exact_larger = (G.a_hang() == 0) & (G.b_hang() == 0) & (F.col("a_id") > F.col("b_id"))
    return overlaps.where(G.hang_a_contained() & ~exact_larger).select(F.col("a_id").alias("read_id")).distinct()


def best_edges(overlaps: DataFrame, excluded: DataFrame) -> DataFrame:
    """The longest dovetail out of each end of each read that is not ``excluded``, more accurate ones first, then smaller ids.

    One aggregation over (read, end): the maximum of a struct, combined before the shuffle.
    """
    o = without(without(overlaps.where(G.hang_dovetail()), excluded, "a_id"), excluded, "b_id")
    end3 = G.hang_a3()
    b3 = F.when(end3, F.col("flipped")).otherwise(~F.col("flipped"))
    best = F.max(F.struct(G.edge_score(F.col("a_len")).alias("score"), (-F.col("b_id")).alias("neg"), (~b3).alias("_first"), b3.alias("b3p"), G.a_hang().alias("a_hang"), G.b_hang().alias("b_hang"), "evalue"))
    return o.groupBy(F.col("a_id").alias("read_id"), end3.alias("end3p")).agg(best.alias("e")).select("read_id", "end3p", (-F.col("e.neg")).alias("b_id"), "e.b3p", "e.a_hang", "e.b_hang", "e.evalue", "e.score")


def initial_edges(overlaps: DataFrame, erate_graph: float, erate_max: float, min_share: float = 0.8) -> tuple[DataFrame, DataFrame, float]:
    """(contained, best edges, error limit): at ``erate_graph`` if ``min_share`` of the reads that are not contained get an edge, else at ``erate_max``.

    Reads are those that have overlaps at all; three counts go to the driver.
    """
    reads = overlaps.select(F.col("a_id").alias("read_id")).distinct()
    for limit in (erate_graph, erate_max):
        good = overlaps.where(good_quality(limit))
        inside = staged(contained(good))
        best = staged(best_edges(good, inside))
        possible, found = reads.join(inside, "read_id", "left_anti").count(), best.select("read_id").distinct().count()
        if found >= min_share * possible:
            break
    return inside, best, limit


def best_overlap_graph(overlaps: DataFrame, lengths: DataFrame, erate_graph: float, erate_max: float, deviations: float = 6.0, min_overlap: int = 500, gaps: str = "chimer", lopsided_percent: float = 25.0) -> tuple[DataFrame, DataFrame, float]:
    """(contained, best edges, error limit) after all filters, in order: initial edges, error threshold, coverage gaps, lopsided reads, spurs.

    The threshold is that of the best edges' errors, never above the limit they were found at; reads with gaps in their good
    overlaps and lopsided reads take no part in edges, and edges are routed around spurs, whose own edges to others go.
    """
    inside, best, limit = initial_edges(overlaps, erate_graph, erate_max)
    row = error_threshold(best, limit, deviations).first()
    if row is not None and row["tight"] is not None:
        limit = min(limit, max(row["tight"], 1e-5))
    good = staged(overlaps.where(good_quality(limit)))
    inside = staged(contained(good))
    bad = staged(coverage_gaps(good, inside, min_overlap, gaps).select("read_id"))
    off = staged(inside.unionByName(bad).distinct())
    uneven = lopsided(staged(best_edges(good, off)), lengths, lopsided_percent).select("read_id").distinct()
    off = staged(off.unionByName(uneven).distinct())
    best, spurs = remove_spurs(good, off)
    return inside, repair_spurs(best, spurs), limit


def repair_spurs(best: DataFrame, spurs: DataFrame) -> DataFrame:
    """Best edges without those that lead from a spur to a read that is none and whose own edge there does not point back."""
    marked = spurs.select("read_id").distinct().withColumn("_spur", F.lit(True))
    j = best.join(marked, "read_id", "left").withColumnRenamed("_spur", "_from")
    j = j.join(marked.select(F.col("read_id").alias("b_id"), F.col("_spur").alias("_to")), "b_id", "left")
    back = best.select(F.col("read_id").alias("b_id"), F.col("end3p").alias("b3p"), F.col("b_id").alias("read_id"), F.col("b3p").alias("end3p"), F.lit(True).alias("_back"))
    j = j.join(back, ["read_id", "end3p", "b_id", "b3p"], "left")
    return j.where(F.col("_from").isNull() | F.col("_to").isNotNull() | F.col("_back").isNotNull()).select(*best.columns)


def chunk_order(lengths: DataFrame) -> DataFrame:
    """(read_id, path_len, rank): the order in which reads start tigs, longest path first, then smaller ids."""
    return ranked(lengths, F.desc("path_len"), F.col("read_id").asc())


def spur_report(placed: DataFrame, best: DataFrame, near: int = 5, min_reads: int = 15) -> DataFrame:
    """(tig_id, end3p, into_tig, into_read): tigs whose best edge out of an end enters another within ``near`` reads of an end that leads nowhere.

    The entered tig has more than ``min_reads`` reads, and is entered from outside towards its near end.
    """
    w = W.partitionBy("tig_id")
    at = placed.select("tig_id", "read_id", "reverse", F.row_number().over(w.orderBy("lo", "hi", "read_id")).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    edges = best.select("read_id", "end3p", "b_id", "b3p")
    ends = at.where("i = 1 or i = n").select("tig_id", "read_id", "n", F.explode(F.when(F.col("n") == 1, F.array(F.lit(False), F.lit(True))).when(F.col("i") == 1, F.array(F.lit(False))).otherwise(F.array(F.lit(True)))).alias("tig3p"), "reverse")
    out = ends.select("tig_id", "tig3p", "read_id", (F.col("tig3p") != F.col("reverse")).alias("end3p")).join(edges, ["read_id", "end3p"], "left")
    into = at.select(F.col("read_id").alias("b_id"), F.col("tig_id").alias("into_tig"), "i", "n", F.col("reverse").alias("rev"))
    hit = out.where("b_id is not null").select("tig_id", "tig3p", "b_id", "b3p").join(into, "b_id")
    # the end that is near, and that the entered read's side looks at
    first, last = (F.col("n") > min_reads) & (F.col("i") <= near), (F.col("n") > min_reads) & (F.col("i") + near > F.col("n"))
    hit = hit.where((F.col("b3p") != F.col("rev")) & (first | last)).withColumn("near3p", ~first)
    open_ = out.select(F.col("tig_id").alias("into_tig"), F.col("tig3p").alias("near3p"), F.col("b_id").alias("leads"))
    return hit.join(open_, ["into_tig", "near3p"]).where("leads is null").select("tig_id", F.col("tig3p").alias("end3p"), "into_tig", F.col("b_id").alias("into_read"))


def mutual(best: DataFrame) -> DataFrame:
    """Best edges that point back at each other, each once (read_id < b_id or, on itself, 5' first)."""
    back = best.select(F.col("read_id").alias("b_id"), F.col("end3p").alias("b3p"), F.col("b_id").alias("read_id"), F.col("b3p").alias("end3p"))
    return best.join(back, ["read_id", "end3p", "b_id", "b3p"]).where("read_id < b_id")


def mutual_components(best: DataFrame) -> DataFrame:
    """(read_id, component): chains of mutual best edges; a read without any is its own."""
    c = connected(mutual(best).select(F.col("read_id").alias("a"), F.col("b_id").alias("b")))
    reads = best.select("read_id").distinct()
    return reads.join(c.withColumnRenamed("node", "read_id"), "read_id", "left").select("read_id", F.coalesce("component", "read_id").alias("component"))


def coverage_gaps(overlaps: DataFrame, inside: DataFrame, min_overlap: int, mode: str = "deadend") -> DataFrame:
    """Reads whose good overlaps leave a gap. chimer: more than one covered part; uncovered: or an end bare;
    deadend: or an end that no read reaches which is not contained (``inside``)."""
    o = overlaps.join(inside.select(F.col("read_id").alias("b_id"), F.lit(True).alias("b_in")), "b_id", "left").withColumn("b_in", F.coalesce("b_in", F.lit(False)))
    lo = F.greatest(G.a_hang(), F.lit(0))
    hi = F.col("a_len") + F.least(G.b_hang(), F.lit(0))
    iv = o.select(F.col("a_id").alias("key"), lo.alias("lo"), hi.alias("hi"), "a_len", "b_in")
    m = I.merge(iv, min_overlap).groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ends = iv.groupBy("key").agg(F.max((F.col("lo") == 0) & ~F.col("b_in")).alias("d5"), F.max((F.col("hi") == F.col("a_len")) & ~F.col("b_in")).alias("d3"), F.max("a_len").alias("len"))
    j = m.join(ends, "key")
    bad = {"none": F.lit(False), "chimer": F.col("parts") > 1, "uncovered": (F.col("parts") > 1) | (F.col("lo") != 0) | (F.col("hi") != F.col("len")), "deadend": (F.col("parts") > 1) | ~F.col("d5") | ~F.col("d3")}[mode]
    return j.where(bad).select(F.col("key").alias("read_id"))


def lopsided(best: DataFrame, lengths: DataFrame, percent: float = 25.0) -> DataFrame:
    """(read_id, end3p): ends whose best overlap is under ``percent`` % of the one out of the end it enters.

    A read both of whose edges are mutual is not tested.
    """
    la = lengths.select("read_id", F.col("len").alias("a_len"))
    lb = lengths.select(F.col("read_id").alias("b_id"), F.col("len").alias("b_len"))
    n = best.join(la, "read_id").join(lb, "b_id")
    # hangs as signed columns
    a, b = F.col("a_hang"), F.col("b_hang")
    on_a = F.when(a < 0, F.col("a_len") + b).otherwise(F.col("a_len") - a)
    on_b = F.when(a < 0, F.col("b_len") + a).otherwise(F.col("b_len") - b)
    n = n.select("read_id", "end3p", "b_id", "b3p", F.greatest(on_a, on_b).alias("n"))
    back = n.select(F.col("read_id").alias("b_id"), F.col("end3p").alias("b3p"), F.col("b_id").alias("back_id"), F.col("b3p").alias("back3p"), F.col("n").alias("back_n"))
    j = n.join(back, ["b_id", "b3p"], "left").withColumn("points_back", F.coalesce((F.col("back_id") == F.col("read_id")) & (F.col("back3p") == F.col("end3p")), F.lit(False)))
    both = j.groupBy("read_id").agg(F.count_if("points_back").alias("k"))
    score = F.when(F.coalesce("back_n", F.lit(0)) == 0, 100.0).otherwise(100.0 * F.col("n") / F.col("back_n"))
    return j.join(both, "read_id").where((F.col("k") < 2) & (score < percent)).select("read_id", "end3p")


def error_threshold(best: DataFrame, limit: float, deviations: float = 6.0) -> DataFrame:
    """One row of order statistics of best-edge errors and the tight and loose thresholds they give (integers in 1e-5, doubles)."""
    per = best.groupBy(F.col("evalue").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    mid = _median(per).withColumnRenamed("m", "median")
    dev = per.crossJoin(F.broadcast(mid)).groupBy(F.abs(F.col("v") - F.col("median")).alias("v")).agg(F.sum("n").alias("n"))  # one row
    mad = _median(dev).withColumnRenamed("m", "mad")
    s = per.agg(F.sum("n").alias("edges"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.sum(F.col("v") * F.col("v") * F.col("n")).alias("q"), F.sum(F.col("v") * F.col("n")).alias("t"))
    s = s.withColumn("stddev", F.sqrt((F.col("q") - F.col("t") * F.col("t") / F.col("edges")) / (F.col("edges") - 1)))
    j = s.crossJoin(F.broadcast(mid)).crossJoin(F.broadcast(mad))  # one row each
    tight = F.least(F.lit(limit), (F.col("median") + deviations * 1.4826 * F.col("mad")) / 100_000)
    loose = F.least(F.lit(limit), (F.col("mean") + deviations * F.col("stddev")) / 100_000)
    return j.select("edges", "mean", "stddev", "median", "mad", tight.alias("tight"), loose.alias("loose"))


def _median(per: DataFrame) -> DataFrame:
    run = per.select("v", F.sum("n").over(W.orderBy("v")).alias("c"), F.sum("n").over(W.partitionBy()).alias("t"))
    return run.where(F.col("c") > F.floor(F.col("t") / 2)).agg(F.min("v").alias("m"))


def read_ends(best: DataFrame) -> DataFrame:
    """(node, next) over 2 * read_id + end3p: leaving an end along its best edge one comes out of the other end of the read entered."""
    return best.select((F.col("read_id") * 2 + F.col("end3p").cast("int")).alias("node"), (F.col("b_id") * 2 + (~F.col("b3p")).cast("int")).alias("next"))


def chunk_lengths(best: DataFrame) -> DataFrame:
    """(read_id, path_len): ends met when walking out of both ends; an end on or before a cycle counts the cycle once.

    Pointer doubling: after k rounds a pointer is 2 ** k steps away, with the distance, the least end passed
    and whether the path has ended. What never ends leads to a cycle.
    """
    edges = read_ends(best)
    ends = best.select(F.explode(F.array(F.col("read_id") * 2, F.col("read_id") * 2 + 1)).alias("node")).union(edges.select("next")).distinct()
    p = staged(ends.join(edges, "node", "left").select("node", F.col("next").alias("ptr"), F.lit(1).cast("bigint").alias("dist"), F.col("node").alias("least")))
    n = p.count()
    for _ in range(max(1, n.bit_length())):
        q = p.select(F.col("node").alias("ptr"), F.col("ptr").alias("p2"), F.col("dist").alias("d2"), F.col("least").alias("l2"))
        j = p.join(q, "ptr", "left")
        p = staged(j.select("node", F.col("p2").alias("ptr"), (F.col("dist") + F.coalesce("d2", F.lit(0))).alias("dist"), F.least("least", "l2").alias("least")))
    ended = p.where("ptr is null").select("node", F.col("dist").alias("len"))
    endless = p.where("ptr is not null")
    # where endless walks are after more steps than there are ends lies on a cycle
    on = endless.select(F.col("ptr").alias("node")).distinct()
    loop = staged(endless.join(on, "node").select("node", "least"))
    size = loop.groupBy("least").agg(F.count(F.lit(1)).alias("cycle"))
    cyclic = staged(loop.join(size, "least").select("node", F.col("cycle").alias("len")))
    # tails: the same doubling, stopping at cycle ends, whose cycle they add
    out = ended.unionByName(cyclic)
    tail = endless.join(on, "node", "left_anti").select("node")
    if not tail.isEmpty():
        stop = cyclic.select("node", F.col("len").alias("stop"))
        t = staged(tail.join(edges, "node").join(stop.withColumnRenamed("node", "next"), "next", "left").select("node", F.col("next").alias("ptr"), F.lit(1).cast("bigint").alias("dist"), "stop"))
        for _ in range(max(1, n.bit_length())):
            q = t.select(F.col("node").alias("ptr"), F.col("ptr").alias("p2"), F.col("dist").alias("d2"), F.col("stop").alias("s2"))
            j = t.join(q, "ptr", "left")
            go = F.col("stop").isNull()
            t = staged(j.select("node", F.when(go, F.col("p2")).otherwise(F.col("ptr")).alias("ptr"), F.when(go, F.col("dist") + F.col("d2")).otherwise(F.col("dist")).alias("dist"), F.coalesce("stop", "s2").alias("stop")))
        out = out.unionByName(t.select("node", (F.col("dist") + F.col("stop")).alias("len")))
    per = out.groupBy(F.shiftright("node", 1).alias("read_id")).agg(F.sum("len").alias("path_len"))
    return best.select("read_id").distinct().join(per, "read_id")


def spur_marks(best: DataFrame, reads: DataFrame, depth: int = 3) -> DataFrame:
    """(read_id, dist5, dist3, spur, path5, path3) of ``reads``: steps to a dead end along best edges, null from ``depth`` on."""
    nxt = staged(read_ends(best))
    ends = reads.select("read_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("e")).select((F.col("read_id") * 2 + F.col("e")).alias("node"))
    at = ends.select("node", F.col("node").alias("here"), F.lit(None).cast("int").alias("dist"))
    for k in range(depth):
        j = at.join(nxt.withColumnRenamed("node", "here"), "here", "left")
        dead = F.col("dist").isNull() & F.col("next").isNull()
        at = j.select("node", F.col("next").alias("here"), F.when(dead, F.lit(k)).otherwise(F.col("dist")).alias("dist"))
    side = F.col("node") % 2
    per = at.groupBy(F.shiftright("node", 1).alias("read_id")).agg(F.max(F.when(side == 0, F.col("dist"))).alias("dist5"), F.max(F.when(side == 1, F.col("dist"))).alias("dist3"))
    zero = lambda c: F.coalesce(F.col(c) == 0, F.lit(False))
    return per.select("read_id", "dist5", "dist3", (zero("dist5") | zero("dist3")).alias("spur"), F.col("dist5").isNotNull().alias("path5"), F.col("dist3").isNotNull().alias("path3"))


def remove_spurs(overlaps: DataFrame, excluded: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(best edges, spur reads) after re-routing around spur paths, at most 2 * depth rounds, until no edge changes.

    In a round, an end that a way out leads through loses its spur-path mark; then edges are chosen anew
    among those whose exit is not a spur path, keeping the old edge where there is none. All reads are
    decided on the marks before the round, not one after the other.
    """
    best = staged(best_edges(overlaps, excluded))
    reads = overlaps.select(F.col("a_id").alias("read_id")).distinct().join(excluded.select("read_id").distinct(), "read_id", "left_anti")
    m = spur_marks(best, reads, depth)
    paths = staged(m.where("path5").select("read_id", F.lit(False).alias("end3p")).unionByName(m.where("path3").select("read_id", F.lit(True).alias("end3p"))))
    for _ in range(2 * depth):
        # reads that get out of an end: what the edge of the other end enters is no spur path
        free = reads.select("read_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("end3p")).join(paths, ["read_id", "end3p"], "left_anti")
        clear = free.select("read_id", (~F.col("end3p")).alias("end3p")).join(best, ["read_id", "end3p"]).select(F.col("b_id").alias("read_id"), F.col("b3p").alias("end3p")).distinct()
        paths = staged(paths.join(clear, ["read_id", "end3p"], "left_anti"))
        b3 = F.when(G.hang_a3(), F.col("flipped")).otherwise(~F.col("flipped"))
        exits = overlaps.where(G.hang_dovetail()).withColumn("_exit", ~b3)
        exits = exits.join(paths.select(F.col("read_id").alias("b_id"), F.col("end3p").alias("_exit")), ["b_id", "_exit"], "left_anti").drop("_exit")
        new = best_edges(exits, excluded)
        old = best.join(new.select("read_id", "end3p"), ["read_id", "end3p"], "left_anti")
        now = staged(new.unionByName(old))
        key = ["read_id", "end3p", "b_id", "b3p"]
        same = now.join(best.select(key), key, "left_anti").isEmpty()
        best = now
        if same:
            break
    return best, paths.select("read_id").distinct()


def circular_candidates(placed: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(tig_id, first, last, circular): whether a tig's last read by end overlaps its first by begin."""
    w = W.partitionBy("tig_id")
    ends = placed.withColumn("f", F.row_number().over(w.orderBy("lo", "hi", "read_id"))).withColumn("l", F.row_number().over(w.orderBy(F.desc("hi"), F.desc("lo"), F.desc("read_id"))))
    pair = ends.groupBy("tig_id").agg(F.max(F.when(F.col("f") == 1, F.col("read_id"))).alias("first"), F.max(F.when(F.col("l") == 1, F.col("read_id"))).alias("last"), F.count(F.lit(1)).alias("n"))
    o = overlaps.select(F.col("a_id").alias("last"), F.col("b_id").alias("first")).distinct().withColumn("found", F.lit(True))
    return pair.join(o, ["last", "first"], "left").select("tig_id", "first", "last", (F.coalesce("found", F.lit(False)) & (F.col("n") > 1)).alias("circular"))
