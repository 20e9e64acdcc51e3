"""Overlap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import alignment as A
from ..operators import overlaps as O
from ..operators.kmers import folded
from ..tables import READ_LEN, load, overlaps, reads, sql
from . import register
from .intervals import depths, merged
from .kmers import mers

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)


def read_len():
    """Length of every read of the overlap table."""
    return F.lit(READ_LEN).cast("bigint")


OVL = sql("ovl")


def lengths(spark, d):
    o = overlaps(spark, d)
    return o.select(F.col("a_id").alias("read_id")).union(o.select("b_id")).distinct().withColumn("len", read_len())


def full(spark, d):
    return overlaps(spark, d).withColumn("a_len", read_len()).withColumn("b_len", read_len())


def turned(spark, d):
    """Reads of which every third is reverse-complemented, so that flipped overlaps exist."""
    from ..functions.seq import reverse_complement

    return reads(spark, d).withColumn("seq", F.when(F.col("read_id") % 3 == 0, reverse_complement(F.col("seq"))).otherwise(F.col("seq")))


K = 21
_TURNED = sql("reads") + ", tr AS (SELECT read_id, len, CASE WHEN read_id % 3 = 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq FROM reads)"
_SEEDS = _TURNED + f""", km AS (SELECT read_id, i - 1 AS pos, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS kmer, f <= reverse(translate(f, 'ACGT', 'TGCA')) AS fw FROM (SELECT read_id, i, substring(seq, i, {K}) AS f FROM (SELECT read_id, seq, unnest(range(1, len - {K - 2})) AS i FROM tr WHERE len >= {K}))),
ok AS (SELECT kmer FROM km GROUP BY kmer HAVING count(*) BETWEEN 2 AND 20), k2 AS (SELECT km.* FROM km SEMI JOIN ok USING (kmer)),
sp AS (SELECT a.read_id AS a_id, b.read_id AS b_id, a.fw <> b.fw AS flipped, a.pos AS apos, CASE WHEN a.fw <> b.fw THEN bl.len - {K} - b.pos ELSE b.pos END AS bpos FROM k2 a JOIN k2 b ON a.kmer = b.kmer AND a.read_id < b.read_id JOIN reads bl ON bl.read_id = b.read_id),
cl AS (SELECT a_id, b_id, flipped, count(*) AS seeds, floor(avg(apos - bpos))::BIGINT AS diagonal, min(apos - bpos) AS diag_bgn, max(apos - bpos) AS diag_end, min(apos) AS a_first, max(apos) AS a_last FROM sp GROUP BY 1, 2, 3)"""


def clusters(spark, d, least=1):
    r = turned(spark, d)
    return O.clusters(r, K, 2, 20, least)


@query(_SEEDS + " SELECT * FROM cl")
def seed_cluster(spark, d):
    return clusters(spark, d).drop("a_seed", "b_seed", "a_len", "b_len")


@query(_SEEDS + f" SELECT a_id, b_id, flipped, seeds FROM cl WHERE seeds >= greatest(5, floor(exp(-{K} * 0.02) * (a_last - a_first + {K} - {K} + 1)))")
def min_kmers_filter(spark, d):
    return O.enough_seeds(clusters(spark, d), K, 0.02, 5).select("a_id", "b_id", "flipped", "seeds")


_FROM = _SEEDS + """, dg AS (SELECT a_id, b_id, flipped, seeds, diagonal AS dd, diagonal + b.len - a.len AS tail, a.len AS a_len, b.len AS b_len FROM cl JOIN reads a ON a.read_id = a_id JOIN reads b ON b.read_id = b_id WHERE seeds >= 20),
so AS (SELECT a_id, b_id, flipped, seeds, greatest(dd, 0) AS ahg5, greatest(-tail, 0) AS ahg3, greatest(-dd, 0) AS bhg5, greatest(tail, 0) AS bhg3, a_len, b_len FROM dg),
so2 AS (SELECT * FROM so WHERE ahg5 + ahg3 < a_len AND bhg5 + bhg3 < b_len)"""


@query(_FROM + """ SELECT a_id, b_id, flipped, seeds, ahg5 - bhg5 AS a_hang, bhg3 - ahg3 AS b_hang, CASE WHEN ahg5 = 0 AND ahg3 = 0 THEN 'contained' WHEN bhg5 = 0 AND bhg3 = 0 THEN 'container' ELSE 'dovetail' END AS kind FROM so2
UNION ALL SELECT b_id, a_id, flipped, seeds, CASE WHEN flipped THEN bhg3 - ahg3 ELSE bhg5 - ahg5 END, CASE WHEN flipped THEN ahg5 - bhg5 ELSE ahg3 - bhg3 END, CASE WHEN bhg5 = 0 AND bhg3 = 0 THEN 'contained' WHEN ahg5 = 0 AND ahg3 = 0 THEN 'container' ELSE 'dovetail' END FROM so2""")
def overlap_containment(spark, d):
    """Which reads overlap which, and which are contained: k-mers, seeds, clusters, hangs, twins and labels in one plan."""
    r = turned(spark, d)
    o = O.from_diagonals(clusters(spark, d, 20), r)
    both = o.unionByName(G.twins(o))
    kind = F.when(G.a_contained(), "contained").when(G.a_container(), "container").otherwise("dovetail")
    return both.select("a_id", "b_id", "flipped", "seeds", G.a_hang().alias("a_hang"), G.b_hang().alias("b_hang"), kind.alias("kind"))


@query(OVL + f""" SELECT a_id, b_id, flipped, ah AS a_hang, bh AS b_hang, CASE WHEN flipped THEN {READ_LEN} - bhg5 ELSE bhg5 END AS b_bgn, CASE WHEN flipped THEN bhg3 ELSE {READ_LEN} - bhg3 END AS b_end, al AS a_aligned, bl AS b_aligned,
(ahg5 = 0 OR bhg5 = 0) AND (ahg3 = 0 OR bhg3 = 0) AS reaches, ah * bh > 0 AS dovetail, ahg5 = 0 AND ahg3 = 0 AS contained, bhg5 = 0 AND bhg3 = 0 AS container, (ahg5 > 0 AND bhg5 > 0) OR (ahg3 > 0 AND bhg3 > 0) AS partial,
greatest(CASE WHEN ah < 0 THEN {READ_LEN} + least(bh, 0) ELSE {READ_LEN} - ah + least(bh, 0) END, CASE WHEN ah < 0 THEN CASE WHEN bh < 0 THEN {READ_LEN} + ah ELSE {READ_LEN} + ah - bh END ELSE CASE WHEN bh < 0 THEN {READ_LEN} ELSE {READ_LEN} - bh END END) AS length FROM ovl""")
def overlap_geometry(spark, d):
    return overlaps(spark, d).select("a_id", "b_id", "flipped", G.a_hang().alias("a_hang"), G.b_hang().alias("b_hang"), G.b_bgn(read_len()).alias("b_bgn"), G.b_end(read_len()).alias("b_end"), G.a_aligned(read_len()).alias("a_aligned"), G.b_aligned(read_len()).alias("b_aligned"), G.reaches_ends().alias("reaches"), G.hang_dovetail().alias("dovetail"), G.a_contained().alias("contained"), G.a_container().alias("container"), G.partial().alias("partial"), G.overlap_length(read_len(), read_len()).alias("length"))


TWIN = "SELECT b_id AS a_id, a_id AS b_id, flipped, CASE WHEN flipped THEN bhg3 ELSE bhg5 END AS ahg5, CASE WHEN flipped THEN bhg5 ELSE bhg3 END AS ahg3, CASE WHEN flipped THEN ahg3 ELSE ahg5 END AS bhg5, CASE WHEN flipped THEN ahg5 ELSE ahg3 END AS bhg3, evalue, span FROM ovl"
COLS = "a_id, b_id, flipped, ahg5, ahg3, bhg5, bhg3, evalue, span"


@query(OVL + f" {TWIN}")
def swap_ids(spark, d):
    return G.twins(overlaps(spark, d))


@query(OVL + f", both_ AS (SELECT {COLS} FROM ovl UNION ALL {TWIN}) SELECT *, (ahg5 = 0 OR bhg5 = 0) AND (ahg3 = 0 OR bhg3 = 0) AS for_utg, true AS for_obt FROM both_ WHERE evalue <= 2000")
def store_filter(spark, d):
    return O.store(overlaps(spark, d), 2000)


@query(OVL + f" SELECT {COLS} FROM ovl WHERE NOT (ah < 0 AND bh < 0) AND NOT (ah >= 0 AND bh <= 0) AND a_id < b_id AND evalue / 100000 BETWEEN 0.001 AND 0.02 AND (al + bl) // 2 BETWEEN 5000 AND 9500 AND a_id BETWEEN 10 AND 400")
def overlap_dump_filters(spark, d):
    keep = O.dump_filters(read_len(), read_len(), no5p=True, no_contained=True, no_redundant=True, erate=(0.001, 0.02), length=(5000, 9500), query=(10, 400))
    return overlaps(spark, d).where(keep)


SCORE = "floor(16384.0 * (1 - evalue / 100000) * al / 10000)::BIGINT"


@query(OVL + f" SELECT a_id, b_id, flipped, {SCORE} AS score FROM ovl")
def overlap_score(spark, d):
    return overlaps(spark, d).select("a_id", "b_id", "flipped", G.overlap_score(G.a_aligned(read_len()), read_len()).cast("bigint").alias("score"))


@query(OVL + f" SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY a_id, b_id ORDER BY evalue, span DESC, flipped, ahg5, ahg3, bhg5, bhg3) AS rn FROM ovl) WHERE rn = 1")
def dedupe_pairs(spark, d):
    return O.dedupe_pairs(overlaps(spark, d))


@query(OVL + f" SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY al DESC, evalue, b_id, flipped) AS rn FROM ovl) WHERE rn <= 10")
def topk_overlaps(spark, d):
    return O.top_per_read(overlaps(spark, d), 10, G.a_aligned(read_len()))


@query(OVL + f""", u AS (SELECT {COLS}, 1 AS made FROM ovl UNION ALL SELECT *, 2 FROM ({TWIN})), r AS (SELECT *, min(evalue) OVER (PARTITION BY a_id, b_id, flipped) AS ev, row_number() OVER (PARTITION BY a_id, b_id, flipped ORDER BY made, ahg5, ahg3, bhg5, bhg3, span) AS rn FROM u)
SELECT a_id, b_id, flipped, ahg5, ahg3, bhg5, bhg3, ev AS evalue, span, made = 2 AS created FROM r WHERE rn = 1""")
def symmetrize(spark, d):
    return O.symmetrise(overlaps(spark, d))


@query(OVL + " SELECT a_id, b_id, flipped, CASE WHEN a_id % 3 = 0 THEN evalue // 2 ELSE evalue END AS evalue FROM ovl")
def load_erates(spark, d):
    o = overlaps(spark, d)
    new = o.where("a_id % 3 = 0").select("a_id", "b_id", "flipped", F.expr("evalue div 2").alias("evalue"))
    return O.override_evalues(o, new).select("a_id", "b_id", "flipped", "evalue")


@query(OVL + " SELECT evalue // 100 AS erate_bin, (al + bl) // 2 // 500 AS length_bin, count(*) AS n FROM ovl GROUP BY 1, 2")
def erate_length_histogram(spark, d):
    return O.erate_length_histogram(overlaps(spark, d), G.aligned(read_len(), read_len()), 100, 500)


@query(OVL + " SELECT a_id, count(*) AS n FROM ovl GROUP BY a_id")
def overlaps_per_read(spark, d):
    return O.per_read(overlaps(spark, d))


_CLASS = OVL + f""", ids AS (SELECT a_id AS read_id FROM ovl UNION SELECT b_id FROM ovl), oiv AS (SELECT a_id AS key, ahg5 AS lo, {READ_LEN} - ahg3 AS hi FROM ovl), {merged('0', 'oiv')}, {depths('oiv')},
fl AS (SELECT a_id AS read_id, bool_or(bhg5 > 0 AND ahg3 > 0 AND NOT pt) AS c5, bool_or(ahg5 > 0 AND bhg3 > 0 AND NOT pt) AS c3, bool_or(ahg5 = 0 AND ahg3 = 0) AS cont, bool_or(pt) AS part FROM (SELECT *, (ahg5 > 0 AND bhg5 > 0) OR (ahg3 > 0 AND bhg3 > 0) AS pt FROM ovl) GROUP BY 1),
isl AS (SELECT key AS read_id, count(*) AS islands FROM mg GROUP BY 1),
kd AS (SELECT key, lo, CASE WHEN depth < 40 / 3 THEN 'l' WHEN depth < 200 / 3 THEN 'u' ELSE 'r' END AS kind FROM dp),
rn AS (SELECT key AS read_id, count(*) FILTER (WHERE prev IS NULL OR prev <> kind) AS runs, arg_min(kind, lo) AS t5, arg_max(kind, lo) AS t3 FROM (SELECT *, lag(kind) OVER (PARTITION BY key ORDER BY lo) AS prev FROM kd) GROUP BY 1)
SELECT read_id, CASE WHEN islands IS NULL THEN 'no-overlaps' WHEN islands > 1 THEN 'middle-missing' WHEN NOT cont AND NOT part AND NOT c5 AND NOT c3 THEN 'middle-only' WHEN NOT cont AND NOT part AND NOT c5 THEN 'no-5-prime' WHEN NOT cont AND NOT part AND NOT c3 THEN 'no-3-prime'
WHEN runs = 1 THEN CASE t5 WHEN 'l' THEN 'low-cov' WHEN 'u' THEN 'unique' ELSE CASE WHEN cont THEN 'contained-repeat' ELSE 'dovetail-repeat' END END WHEN t5 <> t3 THEN 'uniq-repeat' WHEN t5 = 'r' THEN 'uniq-anchor' ELSE 'span-repeat' END AS category
FROM ids LEFT JOIN fl USING (read_id) LEFT JOIN isl USING (read_id) LEFT JOIN rn USING (read_id)"""


@query(_CLASS)
def read_overlap_classify(spark, d):
    return O.classify_reads(overlaps(spark, d), lengths(spark, d), 40)


_CLIP = OVL + f""", cr AS (SELECT DISTINCT a_id AS read_id, a_id * 13 % 900 AS c0, {READ_LEN} - a_id * 7 % 1100 AS c1 FROM ovl),
j AS (SELECT o.*, a.c0 AS a0, a.c1 AS a1, CASE WHEN flipped THEN {READ_LEN} - b.c1 ELSE b.c0 END AS q0, CASE WHEN flipped THEN {READ_LEN} - b.c0 ELSE b.c1 END AS q1, b.c1 - b.c0 AS blen FROM ovl o JOIN cr a ON a.read_id = a_id JOIN cr b ON b.read_id = b_id),
f AS (SELECT *, greatest(greatest(a0 - ahg5, 0) / al, greatest(q0 - bhg5, 0) / bl) AS f5, greatest(greatest({READ_LEN} - ahg3 - a1, 0) / al, greatest({READ_LEN} - bhg3 - q1, 0) / bl) AS f3 FROM j),
g AS (SELECT *, ahg5 + floor(f5 * al + 0.5)::BIGINT AS as2, {READ_LEN} - ahg3 - floor(f3 * al + 0.5)::BIGINT AS ae2, bhg5 + floor(f5 * bl + 0.5)::BIGINT AS bs2, {READ_LEN} - bhg3 - floor(f3 * bl + 0.5)::BIGINT AS be2 FROM f WHERE f5 + f3 < 1),
h AS (SELECT a_id, b_id, flipped, greatest(as2 - a0, 0) AS ahg5, greatest(a1 - ae2, 0) AS ahg3, greatest(bs2 - q0, 0) AS bhg5, greatest(q1 - be2, 0) AS bhg3, evalue, a1 - a0 AS a_len, blen AS b_len FROM g)
SELECT * FROM h WHERE ahg5 + ahg3 < a_len AND bhg5 + bhg3 < b_len"""


@query(_CLIP)
def clip_to_clear(spark, d):
    r = overlaps(spark, d).select(F.col("a_id").alias("read_id"), (F.col("a_id") * 13 % 900).alias("bgn"), (READ_LEN - F.col("a_id") * 7 % 1100).alias("end")).distinct()
    return O.clip_to_clear(full(spark, d), r)


@query(_SEEDS + f", cs AS (SELECT cl.a_id, cl.b_id, cl.flipped, cl.seeds, sd.apos, sd.bpos FROM cl JOIN (SELECT a_id, b_id, flipped, min((apos, bpos))[1] AS apos, min((apos, bpos))[2] AS bpos FROM sp GROUP BY 1, 2, 3) sd USING (a_id, b_id, flipped)) SELECT a_id, b_id, flipped, seeds FROM cs JOIN reads a ON a.read_id = a_id JOIN reads b ON b.read_id = b_id WHERE NOT (seeds = 1 AND (least(apos, bpos) > 90 OR least(a.len - apos, b.len - bpos) - {K} > 90))")
def hopeless_check(spark, d):
    return A.hopeful(clusters(spark, d), K).select("a_id", "b_id", "flipped", "seeds")


@query(_SEEDS + ", w AS (SELECT *, row_number() OVER (PARTITION BY a_id, diagonal >= 0 ORDER BY diagonal, a_id, b_id, flipped) AS ra FROM cl), v AS (SELECT *, row_number() OVER (PARTITION BY b_id, diagonal >= 0 ORDER BY diagonal, a_id, b_id, flipped) AS rb FROM w WHERE ra <= 5) SELECT a_id, b_id, flipped, diagonal FROM v WHERE rb <= 5")
def limit_per_read(spark, d):
    return O.limit_per_read(clusters(spark, d), 5).select("a_id", "b_id", "flipped", "diagonal")


@query()
def aligned_overlaps(spark, d):
    """Seeds of pairs with 20 or more extended to overlaps, accepted at 10 % errors."""
    r = folded(turned(spark, d)).repartition("read_id")  # an exchange that seeds and both joins read
    found = A.accepted(A.aligned(O.clusters(r, K, 2, 20, 20), r, K, 0.1), 50, 0.1, partial=True)
    return A.emitted(A.distinct(found))


_AL = """al AS (SELECT l_suppkey AS a_id, l_partkey % 20 AS b_id, l_linenumber % 2 = 1 AS flipped, CASE WHEN l_orderkey % 3 = 0 THEN 'branch' ELSE 'dovetail' END AS kind, l_orderkey * 17 % 8000 AS a_bgn, l_orderkey * 17 % 8000 + 100 + l_quantity::BIGINT * 20 AS a_end,
l_orderkey * 29 % 8000 AS b_bgn, l_orderkey * 29 % 8000 + 100 + l_quantity::BIGINT * 21 AS b_end, l_quantity::BIGINT * l_linenumber % 40 AS errors, 10000 AS a_len, 10000 AS b_len FROM lineitem)"""


def alignments(spark, d):
    """Alignments made of line items."""
    c = F.col
    q, a, b = c("l_quantity").cast("bigint"), c("l_orderkey") * 17 % 8000, c("l_orderkey") * 29 % 8000
    n = F.lit(10_000).cast("bigint")
    return load(spark, d, "lineitem").select(c("l_suppkey").alias("a_id"), (c("l_partkey") % 20).alias("b_id"), (c("l_linenumber") % 2 == 1).alias("flipped"), F.when(c("l_orderkey") % 3 == 0, "branch").otherwise("dovetail").alias("kind"), a.alias("a_bgn"), (a + 100 + q * 20).alias("a_end"), b.alias("b_bgn"), (b + 100 + q * 21).alias("b_end"), (q * c("l_linenumber") % 40).alias("errors"), n.alias("a_len"), n.alias("b_len"))


_ACC = "WITH " + _AL + ", ac AS (SELECT *, errors / least(a_end - a_bgn, b_end - b_bgn) AS quality FROM al WHERE a_end - a_bgn >= 400 AND b_end - b_bgn >= 400 AND errors / least(a_end - a_bgn, b_end - b_bgn) <= 0.03)"


@query(_ACC + " SELECT a_id, b_id, flipped, a_bgn, b_bgn, errors, round(quality, 9) AS quality FROM ac WHERE kind = 'dovetail'")
def accept_overlap(spark, d):
    return A.accepted(alignments(spark, d), 400, 0.03).select("a_id", "b_id", "flipped", "a_bgn", "b_bgn", "errors", F.round("quality", 9).alias("quality"))


_DIS = _ACC + """, r0 AS (SELECT *, CASE WHEN a_bgn < max(a_end) OVER (PARTITION BY a_id, b_id, flipped ORDER BY a_bgn, a_end, b_bgn, b_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM ac),
r1 AS (SELECT *, sum(nw) OVER (PARTITION BY a_id, b_id, flipped ORDER BY a_bgn, a_end, b_bgn, b_end ROWS UNBOUNDED PRECEDING) AS run FROM r0),
r2 AS (SELECT * FROM r1 QUALIFY row_number() OVER (PARTITION BY a_id, b_id, flipped, run ORDER BY quality, a_end - a_bgn DESC, a_bgn, b_bgn, a_end, b_end) = 1),
r3 AS (SELECT * FROM r2 QUALIFY row_number() OVER (PARTITION BY a_id, b_id, flipped ORDER BY quality, a_end - a_bgn DESC, a_bgn, b_bgn, a_end, b_end) <= 3)"""


@query(_DIS + " SELECT a_id, b_id, flipped, a_bgn, a_end, b_bgn, b_end, errors FROM r3")
def distinct_overlaps(spark, d):
    return A.distinct(A.accepted(alignments(spark, d), 400, 0.03, partial=True)).select("a_id", "b_id", "flipped", "a_bgn", "a_end", "b_bgn", "b_end", "errors")


@query(_DIS + " SELECT a_id, b_id, flipped, a_bgn AS ahg5, a_len - a_end AS ahg3, b_bgn AS bhg5, b_len - b_end AS bhg3, least(65535, floor(quality * 100000 + 0.5))::BIGINT AS evalue, greatest(a_end - a_bgn, b_end - b_bgn) AS span, (a_bgn = 0 OR b_bgn = 0) AND (a_end = a_len OR b_end = b_len) AS for_utg, true AS for_obt, true AS for_dup FROM r3")
def emit_overlaps(spark, d):
    return A.emitted(A.distinct(A.accepted(alignments(spark, d), 400, 0.03, partial=True))).drop("a_len", "b_len")


_SNAP = "WITH " + _AL + ", cl AS (SELECT *, greatest(0, a_bgn - l) AS a0, a_end + r AS a1, greatest(0, b_bgn - l2) AS b0, b_end + r2 AS b1 FROM (SELECT *, a_bgn % 23 AS l, a_end % 19 AS r, b_bgn % 29 AS l2, b_end % 31 AS r2 FROM al)), sn AS (SELECT *, CASE WHEN b_bgn - b0 < 15 THEN least(b_bgn - b0, a_bgn - a0) ELSE 0 END AS d5, CASE WHEN b1 - b_end < 15 THEN least(b1 - b_end, a1 - a_end) ELSE 0 END AS d3 FROM cl)"


@query(_SNAP + " SELECT a_id, b_id, flipped, a_bgn - d5 AS a_bgn, b_bgn - d5 AS b_bgn, a_end + d3 AS a_end, b_end + d3 AS b_end FROM sn")
def snap_small_hangs(spark, d):
    c, z = F.col, F.lit(0).cast("bigint")
    o = alignments(spark, d).withColumns({"a_clr_bgn": F.greatest(z, c("a_bgn") - c("a_bgn") % 23), "a_clr_end": c("a_end") + c("a_end") % 19, "b_clr_bgn": F.greatest(z, c("b_bgn") - c("b_bgn") % 29), "b_clr_end": c("b_end") + c("b_end") % 31})
    return O.snap_hangs(o).select("a_id", "b_id", "flipped", "a_bgn", "b_bgn", "a_end", "b_end")
