"""From reads to contigs: modes, presets, stages with resume, and the layout of mutual best edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..components import staged
from ..functions import geometry as G
from ..functions.seq import reverse_complement
from ..operators import alignment as A
from ..operators import correction as C
from ..operators import errors as E
from ..operators import graph as H
from ..operators import layouts as L
from ..operators import overlaps as O
from ..operators import reads as R
from ..operators import trimming as T


@dataclass(frozen=True)
class Settings:
    """Error rates by stage, and what the stages need. Fixed values of the sequencing technologies are in PRESETS."""

    cor_ovl_error: float
    obt_ovl_error: float
    utg_ovl_error: float
    cor_error: float
    obt_error: float
    utg_error: float
    cns_error: float
    oea_error: float
    haplo_confirm: int = 5
    max_input_coverage: float = 200
    compress: bool = False
    mask_trivial: bool = False
    deviations: float = 6
    min_read_length: int = 1000
    min_overlap: int = 500
    k: int = 22
    max_kmer_count: int = 200
    min_seeds: int = 5
    out_coverage: float = 40
    min_coverage: float = 10


#: Fixed values.
PRESETS = {
    "nanopore": Settings(0.320, 0.120, 0.120, 0.300, 0.120, 0.120, 0.200, 0.120),
    "pacbio": Settings(0.240, 0.045, 0.045, 0.250, 0.045, 0.045, 0.075, 0.045),
    "hifi": Settings(0.000, 0.025, 0.010, 0.000, 0.025, 0.0003, 0.050, 0.003, max_input_coverage=50, compress=True, mask_trivial=True, deviations=4),
}
MODES = {"run": ("correct", "trim", "assemble"), "correct": ("correct",), "trim": ("trim",), "trim-assemble": ("trim", "assemble"), "assemble": ("assemble",), "haplotype": ("haplotype",)}


def preset(technologies: set[str], **changes) -> Settings:
    """Settings for a set of technologies; the noisier one decides, and HiFi reads cannot be mixed with others."""
    kinds = {t.lower() for t in technologies}
    if not kinds or kinds - PRESETS.keys():
        raise ValueError(f"unknown sequencing technology: {sorted(kinds - PRESETS.keys()) or 'none given'}")
    if "hifi" in kinds and len(kinds) > 1:
        raise ValueError("hifi reads cannot be combined with another read type")
    name = next(t for t in ("nanopore", "pacbio", "hifi") if t in kinds)
    return replace(PRESETS[name], **changes)


class Stages:
    """Runs named stages once: a stage whose Parquet output is complete is read instead of run, so a lost driver resumes."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def __call__(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.path}/{name}"
        jvm = self.spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def find_overlaps(reads: DataFrame, s: Settings) -> DataFrame:
    """Symmetric overlaps (with lengths): pairs that share k-mers, aligned from a seed; k-mers too frequent or unique take no part."""
    clusters = O.seed_clusters(O.seed_pairs(reads, s.k, 2, s.max_kmer_count), reads, s.k, s.min_seeds)
    clusters = A.hopeful(O.with_lengths(O.enough_seeds(clusters, s.k, s.utg_ovl_error, s.min_seeds), reads), s.k)
    erate = max(s.utg_ovl_error, 1e-5)
    found = A.distinct(A.accepted(A.aligned(clusters, reads, s.k, erate), s.min_overlap, erate, partial=True))
    return O.with_lengths(O.symmetrise(O.dedupe_pairs(A.emitted(found))).drop("created"), reads)


def chains(best: DataFrame) -> DataFrame:
    """(tig_id, read_id, pos, reverse): reads of each chain of mutual best edges with their begin.

    A node is a read and the direction it is walked in. Pointers to the node before double in each round and
    carry the offset; a chain is met once in either direction, and the one whose first node is less is kept.
    Circles are cut at their least node.
    """
    m = H.mutual(best)
    back = m.select(F.col("b_id").alias("read_id"), F.col("b3p").alias("end3p"), F.col("read_id").alias("b_id"), F.col("end3p").alias("b3p"), F.when(F.col("end3p") == F.col("b3p"), F.col("b_hang")).otherwise(-F.col("a_hang")).alias("a_hang"), F.when(F.col("end3p") == F.col("b3p"), F.col("a_hang")).otherwise(-F.col("b_hang")).alias("b_hang"))
    both = m.select("read_id", "end3p", "b_id", "b3p", "a_hang", "b_hang").unionByName(back)
    node = F.col("read_id") * 2 + (~F.col("end3p")).cast("int")  # out at the 3' end: walked forward
    step = F.when(F.col("end3p"), F.col("a_hang")).otherwise(-F.col("b_hang"))
    edges = staged(both.select((F.col("b_id") * 2 + F.col("b3p").cast("int")).alias("node"), node.alias("prev"), step.alias("step")))
    nodes = best.select(F.explode(F.array(F.col("read_id") * 2, F.col("read_id") * 2 + 1)).alias("node")).distinct()

    def doubled(links: DataFrame) -> DataFrame:
        p = staged(nodes.join(links, "node", "left").select("node", F.col("prev").alias("ptr"), F.coalesce("step", F.lit(0)).cast("bigint").alias("off"), F.coalesce("prev", "node").alias("root"), F.least("node", F.coalesce("prev", "node")).alias("least")))
        for _ in range(max(1, p.count().bit_length())):
            q = p.select(F.col("node").alias("ptr"), F.col("ptr").alias("p2"), F.col("off").alias("o2"), F.col("root").alias("r2"), F.col("least").alias("l2"))
            j = p.join(q, "ptr", "left")
            p = staged(j.select("node", F.col("p2").alias("ptr"), (F.col("off") + F.coalesce("o2", F.lit(0))).alias("off"), F.coalesce("r2", "root").alias("root"), F.least("least", "l2").alias("least")))
        return p

    p = doubled(edges)
    circles = p.where("ptr is not null and node = least").select("node")
    if not circles.isEmpty():
        p = doubled(edges.join(circles, "node", "left_anti"))
    read = F.shiftright("node", 1)
    first = p.groupBy("root").agg(F.min(read).alias("tig_id"), F.min(F.struct(F.col("root"))).alias("_"))
    # the two walks of a chain have the same least read
    least = first.groupBy("tig_id").agg(F.min("root").alias("root"))
    return p.join(least, "root").select("tig_id", read.alias("read_id"), F.col("off").alias("pos"), (F.col("node") % 2 == 1).alias("reverse"))


def layout(reads: DataFrame, overlaps: DataFrame, s: Settings) -> DataFrame:
    """(tig_id, read_id, lo, hi, reverse): chains of best edges, other reads where their overlaps put them, and what is left each by itself."""
    lens = reads.select("read_id", "len")
    inside, best, limit = H.best_overlap_graph(overlaps, lens, max(s.utg_error, 1e-5), max(s.utg_ovl_error, 1e-5), s.deviations, s.min_overlap)
    good = staged(overlaps.where(H.good_quality(limit)))
    placed = chains(staged(best))
    placed = staged(placed.join(lens, "read_id").select("tig_id", "read_id", F.col("pos").alias("lo"), (F.col("pos") + F.col("len")).alias("hi"), "reverse"))
    placed = L.without_singletons(placed)
    rest = lens.join(placed.select("read_id"), "read_id", "left_anti").select(F.col("read_id").alias("a_id"))
    more = L.place_contained(L.cluster(L.project(good.join(rest, "a_id", "left_semi"), placed)), 0.99, 1.0, placed)
    placed = staged(placed.unionByName(more.select("tig_id", "read_id", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"), "reverse")))
    # a read by itself draws in those that only it contains
    alone = staged(L.promoted(placed, lens.join(inside, "read_id", "left_anti")))
    rest = lens.join(placed.unionByName(alone).select("read_id"), "read_id", "left_anti").select(F.col("read_id").alias("a_id"))
    more = L.place_contained(L.cluster(L.project(good.join(rest, "a_id", "left_semi"), alone)), 0.99, 1.0)
    placed = staged(placed.unionByName(alone).unionByName(more.select("tig_id", "read_id", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"), "reverse")))
    return placed.unionByName(L.promoted(placed, lens))


def contigs(reads: DataFrame, placed: DataFrame, s: Settings) -> DataFrame:
    """(tig_id, reads, bases, quality): consensus of each tig, excess coverage dropped first."""
    j = placed.join(reads.select("read_id", "seq"), "read_id")
    seq = F.when(F.col("reverse"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    j = j.withColumn("seq", seq)
    size = L.tig_sizes(placed)
    kept = C.drop_excess_coverage(j, size.select("tig_id", F.col("len").alias("length")), s.out_coverage).where("kept")
    return E.tig_consensus(kept).join(size.select("tig_id", "reads"), "tig_id").select("tig_id", "reads", "bases", "quality")


def trimmed(reads: DataFrame, overlaps: DataFrame, s: Settings) -> DataFrame:
    """Reads cut to their largest covered part and without subread junctions; short ones go."""
    ranges = T.trim_status(reads, T.largest_covered(overlaps, int(s.obt_error * 100_000), s.min_overlap), s.min_read_length)
    ranges = ranges.where(F.col("status").isin("NOC", "MOD")).select("read_id", "bgn", "end")
    bad = T.detect_subreads(overlaps).select("read_id", "lo", "hi")
    clear = T.trim_bad(ranges, bad, s.min_read_length).where("not deleted").select("read_id", F.col("bgn").alias("clr_bgn"), F.col("end").alias("clr_end"))
    return R.view(reads.join(clear, "read_id"), trimmed=True)


def corrected(reads: DataFrame, overlaps: DataFrame, s: Settings, genome_size: float) -> DataFrame:
    """Reads as the consensus of their evidence, the longest up to the wanted coverage, and those that were no evidence."""
    scored = C.scored(overlaps.drop("b_len").join(reads.select(F.col("read_id").alias("b_id"), F.col("len").alias("b_len")), "b_id"))
    limits = staged(C.global_threshold(scored, int(s.out_coverage)))
    ev = staged(C.evidence(scored, limits, int(max(s.cor_error, 1e-5) * 100_000), s.min_overlap))
    long = C.corrected_length(ev.select(F.col("a_id").alias("key"), G.a_bgn().alias("lo"), G.a_end(F.col("a_len")).alias("hi")), 1).withColumnRenamed("key", "read_id")
    picked = staged(C.select_reads(long, genome_size * s.out_coverage))
    rescue = C.rescued(picked, ev, s.min_read_length).select("read_id")
    want = picked.where("selected").select("read_id").unionByName(rescue)
    b = reads.select(F.col("read_id").alias("b_id"), F.col("seq").alias("bseq"))
    others = ev.join(want.select(F.col("read_id").alias("a_id")), "a_id", "left_semi").join(b, "b_id")
    turned = F.when(F.col("flipped"), reverse_complement(F.col("bseq"))).otherwise(F.col("bseq"))
    part = F.expr("substring(turned, cast(bhg5 as int) + 1, cast(b_len - bhg5 - bhg3 as int))")
    lists = others.withColumn("turned", turned).select("a_id", part.alias("part")).groupBy(F.col("a_id").alias("read_id")).agg(F.collect_list("part").alias("others"))
    done = E.template_consensus(reads.join(lists, "read_id").select("read_id", F.col("seq").alias("template"), "others"), min_coverage=0)
    return done.where(F.col("seq").isNotNull()).withColumn("len", F.length("seq").cast("bigint")).where(F.col("len") >= s.min_read_length)


def run(spark: SparkSession, reads: DataFrame, path: str, genome_size: float, mode: str = "run", technologies: set[str] | None = None, stop_after: str | None = None, **changes) -> DataFrame:
    """Runs the stages of ``mode`` on reads (read_id, seq, len), each kept below ``path``; gives the last one's table."""
    if mode not in MODES or mode == "haplotype":
        raise ValueError(f"mode {mode!r}: use haplotype.assign for haplotypes, or one of {sorted(set(MODES) - {'haplotype'})}")
    s, stage = preset(technologies or {"pacbio"}, **changes), Stages(spark, path)
    now = stage("reads", lambda: reads.where(F.col("len") >= s.min_read_length))
    have = R.coverage(now, genome_size).first()[0] or 0.0
    if have < s.min_coverage:
        raise ValueError(f"read coverage ({have:.2f}) lower than allowed ({s.min_coverage})")
    if have > s.max_input_coverage:
        now = stage("sampled", lambda: R.downsample(now, genome_size * s.max_input_coverage, F.col("len")).where("kept").drop("kept"))
    for name in MODES[mode]:
        before = now
        olaps = stage(f"{name}.overlaps", lambda b=before: find_overlaps(b, s))
        if stop_after == f"{name}.overlaps":
            return olaps
        if name == "correct":
            now = stage("corrected", lambda b=before, o=olaps: corrected(b, o, s, genome_size))
        elif name == "trim":
            now = stage("trimmed", lambda b=before, o=olaps: trimmed(b, o, s))
        else:
            placed = stage("layout", lambda b=before, o=olaps: layout(b, o, s))
            if stop_after == "layout":
                return placed
            now = stage("contigs", lambda b=before, p=placed: contigs(b, p, s))
        if stop_after == name:
            break
    return now
