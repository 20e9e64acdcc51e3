"""Tig and placement queries. Placed reads are those of the overlap table, each on one of 20 tigs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layouts as L
from ..operators import reads as R
from ..tables import READ_LEN, layout, load, sql
from . import register
from .intervals import merged
from .overlaps import full

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)

_PL = sql("ovl") + f", pl AS (SELECT a_id % 20 AS tig_id, a_id AS read_id, a_id * 977 % 40000 AS lo, a_id * 977 % 40000 + {READ_LEN} AS hi, a_id % 3 = 0 AS reverse FROM (SELECT DISTINCT a_id FROM ovl))"


def placed(spark, d):
    r = full(spark, d).select("a_id").distinct()
    lo = F.col("a_id") * 977 % 40000
    return r.select((F.col("a_id") % 20).alias("tig_id"), F.col("a_id").alias("read_id"), lo.alias("lo"), (lo + READ_LEN).alias("hi"), (F.col("a_id") % 3 == 0).alias("reverse"))


_PRJ = _PL + f""", pj AS (SELECT a_id AS read_id, tig_id, flipped <> reverse AS reverse,
CASE WHEN flipped = reverse THEN lo - ah ELSE lo + bh END AS lo, CASE WHEN flipped = reverse THEN hi - bh ELSE hi + ah END AS hi,
CASE WHEN flipped = reverse THEN lo - least(ah, 0) ELSE lo + greatest(bh, 0) END AS vlo, CASE WHEN flipped = reverse THEN hi - greatest(bh, 0) ELSE hi + least(ah, 0) END AS vhi,
greatest(ah, 0) AS cbgn, {READ_LEN} + least(bh, 0) AS cend FROM ovl JOIN pl ON pl.read_id = b_id WHERE hi - lo + least(ah, 0) - greatest(bh, 0) > 0)"""


@query(_PRJ + " SELECT * FROM pj")
def place_read_projection(spark, d):
    return L.project(full(spark, d), placed(spark, d)).drop("errors", "a_len")


_CLU = _PRJ + """, c1 AS (SELECT *, sum(CASE WHEN prev IS NULL OR lo - 750 > prev + 750 THEN 1 ELSE 0 END) OVER (PARTITION BY read_id, tig_id, reverse ORDER BY lo) AS kl FROM (SELECT *, lag(lo) OVER (PARTITION BY read_id, tig_id, reverse ORDER BY lo) AS prev FROM pj)),
c2 AS (SELECT *, sum(CASE WHEN prevh IS NULL OR hi - 750 > prevh + 750 THEN 1 ELSE 0 END) OVER (PARTITION BY read_id, tig_id, reverse ORDER BY hi) AS kh FROM (SELECT *, lag(hi) OVER (PARTITION BY read_id, tig_id, reverse ORDER BY hi) AS prevh FROM c1)),
pc AS (SELECT read_id, tig_id, reverse, floor(avg(lo) + 0.5)::BIGINT AS lo, floor(avg(hi) + 0.5)::BIGINT AS hi, min(vlo) AS vlo, max(vhi) AS vhi, min(cbgn) AS cbgn, max(cend) AS cend, count(*) AS n FROM c2 GROUP BY read_id, tig_id, reverse, kl, kh)"""


@query(_CLU + " SELECT * FROM pc")
def place_read_clusters(spark, d):
    return L.cluster(L.project(full(spark, d), placed(spark, d))).select("read_id", "tig_id", "reverse", "lo", "hi", "vlo", "vhi", "cbgn", "cend", "n")


_LEN = f"greatest(CASE WHEN ah < 0 THEN {READ_LEN} + least(bh, 0) ELSE {READ_LEN} - ah + least(bh, 0) END, CASE WHEN ah < 0 THEN CASE WHEN bh < 0 THEN {READ_LEN} + ah ELSE {READ_LEN} + ah - bh END ELSE CASE WHEN bh < 0 THEN {READ_LEN} ELSE {READ_LEN} - bh END END)"
_PLC = _CLU.replace("greatest(ah, 0) AS cbgn", f"{_LEN} * (evalue / 100000) AS errors, greatest(ah, 0) AS cbgn").replace("count(*) AS n FROM c2", "count(*) AS n, sum(errors) / sum(cend - cbgn) AS erate, sum(cend - cbgn) AS aligned FROM c2")


@query(_PLC + f""", sg AS (SELECT tig_id, count(*) = 1 AS alone FROM pl GROUP BY 1), gd AS (SELECT pc.*, alone, bool_and(alone) OVER (PARTITION BY read_id) AS al FROM pc JOIN sg USING (tig_id) WHERE (cend - cbgn) / {READ_LEN} >= 0.9 AND erate <= 0.02)
SELECT read_id, tig_id, reverse, lo, hi, round(erate, 9) AS erate FROM gd WHERE NOT alone OR al QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY erate, aligned DESC, tig_id, lo, reverse) = 1""")
def place_contains(spark, d):
    p = placed(spark, d)
    return L.place_contained(L.cluster(L.project(full(spark, d), p)), 0.9, 0.02, p).select("read_id", "tig_id", "reverse", "lo", "hi", F.round("erate", 9).alias("erate"))


_TIG = _PL + ", sp AS (SELECT a.tig_id, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi, evalue FROM ovl JOIN pl a ON a.read_id = a_id JOIN pl b ON b.read_id = b_id WHERE a_id < b_id AND a.tig_id = b.tig_id AND greatest(a.lo, b.lo) < least(a.hi, b.hi))"
_PROF = _TIG + """, ev AS (SELECT tig_id, pos, sum(n) AS n, sum(n * evalue) AS s, sum(n * evalue * evalue) AS q FROM (SELECT tig_id, lo AS pos, 1 AS n, evalue FROM sp UNION ALL SELECT tig_id, hi, -1, evalue FROM sp) GROUP BY 1, 2),
rp AS (SELECT tig_id, pos AS lo, lead(pos) OVER w AS hi, (sum(n) OVER w)::BIGINT AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM ev WINDOW w AS (PARTITION BY tig_id ORDER BY pos)),
pf AS (SELECT tig_id, lo, hi, n, s / n AS mean, CASE WHEN n > 1 THEN sqrt(greatest(0, (q - s / n * s) / (n - 1))) ELSE 0 END AS stddev FROM rp WHERE n > 0 AND hi IS NOT NULL)"""


@query(_PROF + " SELECT tig_id, lo, hi, n, round(mean, 6) AS mean, round(stddev, 4) AS stddev FROM pf")
def tig_error_profile(spark, d):
    p = L.error_profile(L.in_tig(full(spark, d), placed(spark, d)))
    return p.select("tig_id", "lo", "hi", "n", F.round("mean", 6).alias("mean"), F.round("stddev", 4).alias("stddev"))


@query(_PROF + ", dsp AS (SELECT DISTINCT * FROM sp) SELECT sp.tig_id, sp.lo, sp.hi, evalue, round(sum(CASE WHEN evalue <= mean + 0.5 * stddev THEN least(sp.hi, pf.hi) - greatest(sp.lo, pf.lo) ELSE 0 END) / sum(least(sp.hi, pf.hi) - greatest(sp.lo, pf.lo)), 6) AS share FROM dsp sp JOIN pf ON pf.tig_id = sp.tig_id AND pf.lo < sp.hi AND sp.lo < pf.hi GROUP BY ALL")
def overlap_consistent_with_tig(spark, d):
    s = L.in_tig(full(spark, d), placed(spark, d))
    return L.consistency(s.distinct(), L.error_profile(s), 0.5).withColumn("share", F.round("share", 6))


_CLS = sql("lay") + """, ev AS (SELECT tig_id, pos, sum(n) AS n FROM (SELECT tig_id, lo AS pos, 1 AS n FROM lay UNION ALL SELECT tig_id, hi, -1 FROM lay) GROUP BY 1, 2),
dp AS (SELECT tig_id, pos AS lo, lead(pos) OVER w AS hi, sum(n) OVER w AS depth FROM ev WINDOW w AS (PARTITION BY tig_id ORDER BY pos)),
lw AS (SELECT tig_id, coalesce(sum(hi - lo) FILTER (WHERE depth < 3), 0) / sum(hi - lo) AS low FROM dp WHERE depth > 0 AND hi IS NOT NULL GROUP BY 1),
ts AS (SELECT tig_id, count(*) AS reads, max(hi) - min(lo) AS len, max(hi - lo) AS longest FROM lay GROUP BY 1)"""


@query(_CLS + " SELECT tig_id, CASE WHEN reads = 1 THEN 'S' WHEN reads < 100 THEN '1' WHEN len < 29900 THEN '2' WHEN longest > len * 0.5 THEN '3' WHEN low >= 0.05 THEN '4' ELSE 'contig' END AS rule FROM ts JOIN lw USING (tig_id)")
def classify_unassembled(spark, d):
    return L.classify_unassembled(layout(spark, d), 100, 29900, 0.5, 0.05, 3)


@query(_CLS + " SELECT tig_id, reads, len FROM ts")
def tig_sizes(spark, d):
    return L.tig_sizes(layout(spark, d))


@query(_CLS + " SELECT tig_id, reads, len FROM ts WHERE reads BETWEEN 200 AND 380 AND len >= 30000")
def tig_filter(spark, d):
    return L.tig_filter(layout(spark, d), (200, 380), (30000, None))


@query(_CLS + ", c AS (SELECT len, row_number() OVER w AS k, sum(len) OVER w AS upto FROM ts WINDOW w AS (ORDER BY len DESC, tig_id ROWS UNBOUNDED PRECEDING)) SELECT ng, max(len) AS len, min(k)::BIGINT AS reads FROM c, (SELECT unnest(range(10, 101, 10))::INT AS ng) WHERE upto > 1000000 * ng / 100 GROUP BY ng")
def tig_n50_table(spark, d):
    return R.n_table(L.tig_sizes(layout(spark, d)).drop("reads"), 1_000_000)


@query(_PL + """, st AS (SELECT CASE WHEN ah * bh > 0 THEN 'dovetail' ELSE 'contained' END AS kind, CASE WHEN a.tig_id <> b.tig_id THEN 'different-tig' WHEN NOT (a.lo < b.hi AND b.lo < a.hi) THEN 'apart' WHEN (a.reverse <> b.reverse) = flipped THEN 'satisfied' ELSE 'misoriented' END AS w FROM ovl JOIN pl a ON a.read_id = a_id JOIN pl b ON b.read_id = b_id)
SELECT kind, w AS "where", count(*) AS n FROM st GROUP BY 1, 2""")
def satisfied_overlaps(spark, d):
    return L.satisfied(full(spark, d), placed(spark, d))


_REP = sql("lay") + ", mk AS (SELECT tig_id AS key, lo + 30 AS lo, lo + 200 AS hi FROM lay WHERE read_id % 150 = 0), " + merged("50", "mk") + """, al AS (SELECT m.key, m.lo - 40 AS lo, m.hi + 40 AS hi FROM mg m WHERE NOT EXISTS (SELECT 1 FROM lay r WHERE r.tig_id = m.key AND r.lo + 40 <= m.lo AND m.hi + 40 <= r.hi)), """ + merged("0", "al", "mx") + " SELECT key AS tig_id, lo, hi FROM mx"


@query(_REP)
def mark_repeats(spark, d):
    r = layout(spark, d)
    marks = r.where("read_id % 150 = 0").select("tig_id", (F.col("lo") + 30).alias("lo"), (F.col("lo") + 200).alias("hi"))
    return L.repeats(marks, r, 50, 40)


@query(sql("lay") + """, bk AS (SELECT DISTINCT tig_id, lo AS pos FROM lay WHERE read_id % 300 = 0), bl AS (SELECT tig_id, lag(pos) OVER (PARTITION BY tig_id ORDER BY pos) AS f, pos AS t FROM bk UNION ALL SELECT tig_id, max(pos), NULL FROM bk GROUP BY 1),
bn AS (SELECT *, row_number() OVER (PARTITION BY tig_id ORDER BY f NULLS FIRST) AS block FROM bl), hit AS (SELECT l.tig_id, l.read_id, max(block) AS block FROM lay l JOIN bn ON bn.tig_id = l.tig_id AND (f IS NULL OR l.lo >= f) AND (t IS NULL OR l.hi <= t) GROUP BY 1, 2)
SELECT l.tig_id, l.read_id, block FROM lay l LEFT JOIN hit USING (tig_id, read_id)""")
def split_at_breaks(spark, d):
    r = layout(spark, d)
    return L.split_blocks(r, r.where("read_id % 300 = 0").select("tig_id", F.col("lo").alias("pos"))).select("tig_id", "read_id", F.col("block").cast("bigint").alias("block"))


@query("SELECT item_id, text[:10] || repeat('_', 20) || text[31:] AS masked FROM benchmark WHERE length(text) >= 30")
def mask_consensus(spark, d):
    from ..tables import load

    return load(spark, d, "benchmark").where(F.length("text") >= 30).select("item_id", L.mask(F.col("text"), F.lit(10), F.lit(30)).alias("masked"))


def clusters(spark, d):
    return L.cluster(L.project(full(spark, d), placed(spark, d)))


@query(_CLU + f" SELECT pl.tig_id, pc.tig_id AS target, count(DISTINCT read_id) AS reads, max(cend - cbgn) AS thickest FROM pc JOIN pl USING (read_id) WHERE pc.tig_id <> pl.tig_id AND (cend - cbgn) / {READ_LEN} >= 0.7 GROUP BY 1, 2")
def assembly_graph(spark, d):
    return L.assembly_graph(clusters(spark, d), placed(spark, d), 0.7)


_ORPHAN = _CLU + f""", tm AS (SELECT *, row_number() OVER (PARTITION BY tig_id ORDER BY lo, hi, read_id) = 1 OR row_number() OVER (PARTITION BY tig_id ORDER BY hi DESC, lo DESC, read_id DESC) = 1 AS t FROM pl),
sz AS (SELECT tig_id, count(*) AS n, count(*) FILTER (WHERE t) AS nt, max(hi) - min(lo) AS len FROM tm GROUP BY 1),
aw AS (SELECT DISTINCT pc.read_id, pc.tig_id, tm.tig_id AS home, t FROM pc JOIN tm USING (read_id) WHERE pc.tig_id <> tm.tig_id AND (cend - cbgn) / {READ_LEN} >= 0.9),
pr AS (SELECT home, aw.tig_id, count(*) AS p, count(*) FILTER (WHERE t) AS pt FROM aw GROUP BY 1, 2), oc AS (SELECT home, p = h.n AS orphan, p <> h.n AND pt = h.nt AS bubble FROM pr JOIN sz h ON h.tig_id = home JOIN sz g ON g.tig_id = pr.tig_id WHERE g.len >= h.len AND h.n > 1),
dc AS (SELECT home, count(*) FILTER (WHERE orphan) AS no, count(*) FILTER (WHERE bubble) AS nb FROM oc GROUP BY 1)
SELECT tig_id, coalesce(no, 0) AS n_orphan, coalesce(nb, 0) AS n_bubble, CASE WHEN no = 1 THEN 'merge' WHEN no > 1 THEN 'distribute' WHEN nb > 0 THEN 'bubble' ELSE 'keep' END AS decision FROM sz LEFT JOIN dc ON home = tig_id"""


@query(_ORPHAN)
def orphan_decisions(spark, d):
    return L.orphan_decisions(clusters(spark, d), placed(spark, d), 0.9)


_FEW = "WITH fw AS (SELECT o_custkey * 10 + o_orderkey % 10 AS tig_id, o_orderkey AS read_id, o_orderkey % 700 AS lo, o_orderkey % 700 + 300 AS hi FROM orders), sz AS (SELECT tig_id, count(*) AS n FROM fw GROUP BY 1)"


def small_tigs(spark, d):
    """Tigs of one read and of few."""
    o = load(spark, d, "orders")
    lo = F.col("o_orderkey") % 700
    return o.select((F.col("o_custkey") * 10 + F.col("o_orderkey") % 10).alias("tig_id"), F.col("o_orderkey").alias("read_id"), lo.alias("lo"), (lo + 300).alias("hi"), F.lit(False).alias("reverse"))


@query(_FEW + " SELECT tig_id, read_id, lo FROM fw JOIN sz USING (tig_id) WHERE n > 1")
def break_singletons(spark, d):
    return L.without_singletons(small_tigs(spark, d)).select("tig_id", "read_id", "lo")


@query(_FEW + " SELECT read_id AS tig_id, read_id, 0::BIGINT AS lo, 300::BIGINT AS hi, false AS reverse FROM fw JOIN sz USING (tig_id) WHERE n = 1")
def promote_to_singleton(spark, d):
    p = small_tigs(spark, d)
    return L.promoted(L.without_singletons(p), p.select("read_id", (F.col("hi") - F.col("lo")).alias("len")))


_THICK = sql("lay") + """, rg AS (SELECT DISTINCT tig_id, lo // 5000 * 5000 AS rlo, lo // 5000 * 5000 + 2500 AS rhi FROM lay),
pv AS (SELECT a.tig_id, a.read_id, b.read_id AS other_id, b.hi - a.lo AS th, b.hi AS reach, rlo, rhi FROM lay a JOIN rg ON rg.tig_id = a.tig_id AND a.lo BETWEEN rlo AND rhi JOIN lay b ON b.tig_id = a.tig_id AND (b.lo, b.hi, b.read_id) < (a.lo, a.hi, a.read_id) AND b.hi > a.lo),
nt AS (SELECT a.tig_id, a.read_id, b.read_id AS other_id, a.hi - b.lo AS th, b.lo AS reach, rlo, rhi FROM lay a JOIN rg ON rg.tig_id = a.tig_id AND a.hi BETWEEN rlo AND rhi JOIN lay b ON b.tig_id = a.tig_id AND (b.lo, b.hi, b.read_id) > (a.lo, a.hi, a.read_id) AND b.lo < a.hi)"""
_BEST = "SELECT tig_id, read_id, other_id, th AS thickness FROM (SELECT * FROM {} QUALIFY row_number() OVER (PARTITION BY tig_id, read_id, rlo, rhi ORDER BY th DESC, other_id) = 1) WHERE reach BETWEEN rlo AND rhi"


def regions(spark, d):
    at = F.floor(F.col("lo") / 5000) * 5000
    return layout(spark, d).select("tig_id", at.alias("rlo"), (at + 2500).alias("rhi")).distinct()


@query(f"{_THICK} {_BEST.format('pv')}")
def thickest_previous(spark, d):
    return L.thickest(layout(spark, d), regions(spark, d), after=False)


@query(f"{_THICK} {_BEST.format('nt')}")
def thickest_next(spark, d):
    return L.thickest(layout(spark, d), regions(spark, d), after=True)
