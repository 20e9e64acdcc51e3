"""Graph queries, on all overlaps that reach the ends of their reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import graph as H
from ..operators import overlaps as O
from ..tables import READ_LEN, layout, overlaps, sql
from . import register
from .intervals import merged
from .overlaps import TWIN, read_len

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)

_USE = "(ahg5 = 0 OR bhg5 = 0) AND (ahg3 = 0 OR bhg3 = 0)"
GV = sql("ovl").replace("ovl AS (SELECT a_id", "ovl0 AS (SELECT a_id") + f""", ovl AS (SELECT * FROM ovl0 WHERE {_USE}),
u AS (SELECT a_id, b_id, flipped, ahg5, ahg3, bhg5, bhg3, evalue, span, 1 AS made FROM ovl UNION ALL SELECT *, 2 FROM ({TWIN})),
gv AS (SELECT *, ahg5 - bhg5 AS ah, bhg3 - ahg3 AS bh FROM (SELECT a_id, b_id, flipped, ahg5, ahg3, bhg5, bhg3, ev AS evalue FROM (SELECT *, min(evalue) OVER (PARTITION BY a_id, b_id, flipped) AS ev, row_number() OVER (PARTITION BY a_id, b_id, flipped ORDER BY made, ahg5, ahg3, bhg5, bhg3, span) AS rn FROM u) WHERE rn = 1)),
ct AS (SELECT DISTINCT a_id AS read_id FROM gv WHERE ah <= 0 AND bh >= 0 AND NOT (ah = 0 AND bh = 0 AND a_id > b_id)),
be AS (SELECT a_id AS read_id, ah > 0 AS end3p, b_id, (ah > 0) = flipped AS b3p, ah AS a_hang, bh AS b_hang, evalue, score FROM (SELECT *, (CASE WHEN ah > 0 THEN {READ_LEN} - ah ELSE {READ_LEN} + bh END) * 65536 + 65535 - evalue AS score FROM gv WHERE ah * bh > 0 AND a_id NOT IN (FROM ct) AND b_id NOT IN (FROM ct))
  QUALIFY row_number() OVER (PARTITION BY a_id, ah > 0 ORDER BY score DESC, b_id, (ah > 0) = flipped) = 1)"""


def graph(spark, d):
    o = overlaps(spark, d)
    return O.symmetrise(o.where(G.reaches_ends())).drop("created").withColumn("a_len", read_len()).withColumn("b_len", read_len())


def best(spark, d):
    g = graph(spark, d)
    return H.best_edges(g, H.contained(g))


def lens(spark, d):
    return graph(spark, d).select(F.col("a_id").alias("read_id")).distinct().withColumn("len", read_len())


@query(GV + " SELECT read_id FROM ct")
def find_contains(spark, d):
    return H.contained(graph(spark, d))


@query(GV + " SELECT * FROM be")
def best_edges(spark, d):
    return best(spark, d)


@query(GV + " SELECT count(*) AS n FROM gv WHERE evalue <= 1500 AND greatest(CASE WHEN ah < 0 THEN 10000 + least(bh, 0) ELSE 10000 - ah + least(bh, 0) END, CASE WHEN ah < 0 THEN 10000 + ah - greatest(bh, 0) ELSE 10000 - greatest(bh, 0) END) >= 7000")
def overlap_bad_quality(spark, d):
    return graph(spark, d).where(H.good_quality(0.015, 0.7)).agg(F.count(F.lit(1)).alias("n"))


_ERR = """, v AS (SELECT evalue AS v FROM be), m AS (SELECT list_sort(list(v))[count(*) // 2 + 1] AS median, count(*) AS edges, avg(v) AS mean, stddev_samp(v) AS stddev FROM v), e AS (SELECT list_sort(list(abs(v - median)))[count(*) // 2 + 1] AS mad FROM v, m)
SELECT edges, round(mean, 6) AS mean, round(stddev, 6) AS stddev, median, mad, round(least(0.02, (median + 6 * 1.4826 * mad) / 100000), 9) AS tight, round(least(0.02, (mean + 6 * stddev) / 100000), 9) AS loose FROM m, e"""


@query(GV + _ERR)
def error_rate_threshold(spark, d):
    t = H.error_threshold(best(spark, d), 0.02)
    return t.select("edges", *[F.round(c, 6).alias(c) for c in ("mean", "stddev")], "median", "mad", *[F.round(c, 9).alias(c) for c in ("tight", "loose")])


_GAP = GV + f""", giv AS (SELECT a_id AS key, greatest(ah, 0) AS lo, {READ_LEN} + least(bh, 0) AS hi, b_id IN (FROM ct) AS b_in FROM gv WHERE evalue <= 150), {merged('500', 'giv')},
gp AS (SELECT key, count(*) AS parts, min(lo) AS lo, max(hi) AS hi FROM mg GROUP BY key), ge AS (SELECT key, bool_or(lo = 0 AND NOT b_in) AS d5, bool_or(hi = {READ_LEN} AND NOT b_in) AS d3 FROM giv GROUP BY key)"""


def accurate(spark, d):
    """Overlaps of good quality, which is what gaps are sought in."""
    return graph(spark, d).where("evalue <= 150")


@query(_GAP + " SELECT key AS read_id FROM gp JOIN ge USING (key) WHERE parts > 1 OR NOT d5 OR NOT d3")
def coverage_gap_deadend(spark, d):
    return H.coverage_gaps(accurate(spark, d), H.contained(graph(spark, d)), 500, "deadend")


@query(_GAP + f" SELECT key AS read_id FROM gp WHERE parts > 1 OR lo <> 0 OR hi <> {READ_LEN}")
def coverage_gap_uncovered(spark, d):
    return H.coverage_gaps(accurate(spark, d), H.contained(graph(spark, d)), 500, "uncovered")


@query(GV + f""", n AS (SELECT *, greatest(CASE WHEN a_hang < 0 THEN {READ_LEN} + b_hang ELSE {READ_LEN} - a_hang END, CASE WHEN a_hang < 0 THEN {READ_LEN} + a_hang ELSE {READ_LEN} - b_hang END) AS n FROM be),
j AS (SELECT n.read_id, n.end3p, n.n, k.n AS back_n, coalesce(k.b_id = n.read_id AND k.b3p = n.end3p, false) AS pb FROM n LEFT JOIN n k ON k.read_id = n.b_id AND k.end3p = n.b3p)
SELECT read_id, end3p FROM (SELECT *, count(*) FILTER (WHERE pb) OVER (PARTITION BY read_id) AS k FROM j) WHERE k < 2 AND CASE WHEN coalesce(back_n, 0) = 0 THEN 100 ELSE 100.0 * n / back_n END < 99.5""")
def lopsided(spark, d):
    return H.lopsided(best(spark, d), lens(spark, d), 99.5)


@query(GV + " SELECT a.* FROM be a JOIN be b ON a.b_id = b.read_id AND a.b3p = b.end3p AND b.b_id = a.read_id AND b.b3p = a.end3p WHERE a.read_id < a.b_id")
def mutual_edges(spark, d):
    return H.mutual(best(spark, d))


_MUT = "mu AS (SELECT a.read_id AS x, a.b_id AS y FROM be a JOIN be b ON a.b_id = b.read_id AND a.b3p = b.end3p AND b.b_id = a.read_id AND b.b3p = a.end3p)"


@query(GV.replace("WITH ", "WITH RECURSIVE ", 1) + f", {_MUT}, re AS (SELECT DISTINCT read_id AS node, read_id AS r FROM be UNION SELECT re.node, mu.y FROM re JOIN mu ON mu.x = re.r) SELECT node AS read_id, min(r) AS component FROM re GROUP BY node")
def mutual_components(spark, d):
    return H.mutual_components(best(spark, d))


@query(GV.replace("WITH ", "WITH RECURSIVE ", 1) + """, nx AS (SELECT read_id * 2 + end3p::INT AS node, b_id * 2 + (NOT b3p)::INT AS nxt FROM be), st AS (SELECT read_id * 2 AS node FROM (SELECT DISTINCT read_id FROM be) UNION SELECT read_id * 2 + 1 FROM be),
wk AS (SELECT node, node AS here FROM st UNION SELECT wk.node, nx.nxt FROM wk JOIN nx ON nx.node = wk.here)
SELECT node // 2 AS read_id, count(*) AS path_len FROM wk GROUP BY node // 2""")
def chunk_lengths(spark, d):
    return H.chunk_lengths(best(spark, d))


@query(GV + """, nx AS (SELECT read_id * 2 + end3p::INT AS node, b_id * 2 + (NOT b3p)::INT AS nxt FROM be), en AS (SELECT read_id, e, read_id * 2 + e AS node FROM (SELECT DISTINCT a_id AS read_id FROM gv), (SELECT unnest([0, 1]) AS e) WHERE read_id NOT IN (FROM ct)),
w AS (SELECT en.*, a.nxt AS n1, b.nxt AS n2, c.nxt AS n3 FROM en LEFT JOIN nx a ON a.node = en.node LEFT JOIN nx b ON b.node = a.nxt LEFT JOIN nx c ON c.node = b.nxt),
ds AS (SELECT read_id, e, CASE WHEN n1 IS NULL THEN 0 WHEN n2 IS NULL THEN 1 WHEN n3 IS NULL THEN 2 END AS dist FROM w)
SELECT read_id, max(dist) FILTER (WHERE e = 0) AS dist5, max(dist) FILTER (WHERE e = 1) AS dist3, bool_or(coalesce(dist = 0, false)) AS spur, bool_or(e = 0 AND dist IS NOT NULL) AS path5, bool_or(e = 1 AND dist IS NOT NULL) AS path3 FROM ds GROUP BY read_id""")
def spur_marks(spark, d):
    g = graph(spark, d)
    inside = H.contained(g)
    reads = g.select(F.col("a_id").alias("read_id")).distinct().join(inside, "read_id", "left_anti")
    return H.spur_marks(H.best_edges(g, inside), reads)


@query()
def remove_spurs(spark, d):
    g = accurate(spark, d)
    best_, spurs = H.remove_spurs(g, H.contained(g))
    return best_.join(spurs.withColumn("spur", F.lit(True)), "read_id", "left").select("read_id", "end3p", "b_id", "b3p", F.coalesce("spur", F.lit(False)).alias("spur"))


@query(sql("lay", "ovl") + """, e AS (SELECT tig_id, count(*) AS n, arg_min(read_id, (lo, hi, read_id)) AS first, arg_max(read_id, (hi, lo, read_id)) AS last FROM lay GROUP BY tig_id)
SELECT tig_id, first, last, n > 1 AND EXISTS (FROM ovl WHERE a_id = last AND b_id = first) AS circular FROM e""")
def circular_candidates(spark, d):
    return H.circular_candidates(layout(spark, d), overlaps(spark, d))


def _edges(name: str, most: int) -> str:
    """Contained reads and best edges of the overlaps of an evalue of at most ``most``."""
    return f"""g{name} AS (SELECT * FROM gv WHERE evalue <= {most}), c{name} AS (SELECT DISTINCT a_id AS read_id FROM g{name} WHERE ah <= 0 AND bh >= 0 AND NOT (ah = 0 AND bh = 0 AND a_id > b_id)),
b{name} AS (SELECT a_id AS read_id, ah > 0 AS end3p, b_id, (ah > 0) = flipped AS b3p, ah AS a_hang, bh AS b_hang, evalue, score FROM (SELECT *, (CASE WHEN ah > 0 THEN {READ_LEN} - ah ELSE {READ_LEN} + bh END) * 65536 + 65535 - evalue AS score FROM g{name} WHERE ah * bh > 0 AND a_id NOT IN (FROM c{name}) AND b_id NOT IN (FROM c{name}))
  QUALIFY row_number() OVER (PARTITION BY a_id, ah > 0 ORDER BY score DESC, b_id, (ah > 0) = flipped) = 1), s{name} AS (SELECT (SELECT count(DISTINCT read_id) FROM b{name}) / (SELECT count(DISTINCT a_id) FROM gv WHERE a_id NOT IN (FROM c{name})) AS share)"""


_INIT = GV + ", " + _edges("1", 25) + ", " + _edges("2", 2000)


@query(_INIT + " SELECT *, 0.00025::DOUBLE AS erate FROM b1 WHERE (FROM s1) >= 0.9 UNION ALL SELECT *, 0.02 FROM b2 WHERE (FROM s1) < 0.9")
def find_initial_edges(spark, d):
    """The graph's limit is too tight here, so the larger one holds."""
    _, best_, limit = H.initial_edges(graph(spark, d), 0.00025, 0.02, 0.9)
    return best_.withColumn("erate", F.lit(limit))


@query(GV.replace("WITH ", "WITH RECURSIVE ", 1) + """, nx AS (SELECT read_id * 2 + end3p::INT AS node, b_id * 2 + (NOT b3p)::INT AS nxt FROM be), st AS (SELECT read_id * 2 AS node FROM (SELECT DISTINCT read_id FROM be) UNION SELECT read_id * 2 + 1 FROM be),
wk AS (SELECT node, node AS here FROM st UNION SELECT wk.node, nx.nxt FROM wk JOIN nx ON nx.node = wk.here), pl AS (SELECT node // 2 AS read_id, count(*) AS path_len FROM wk GROUP BY node // 2)
SELECT read_id, path_len, row_number() OVER (ORDER BY path_len DESC, read_id) - 1 AS rank FROM pl""")
def chunk_order(spark, d):
    return H.chunk_order(H.chunk_lengths(best(spark, d)))


_SPUR = """, nx AS (SELECT read_id * 2 + end3p::INT AS node FROM be), sr AS (SELECT DISTINCT a_id AS read_id FROM gv WHERE a_id NOT IN (FROM ct) AND (a_id * 2 NOT IN (FROM nx) OR a_id * 2 + 1 NOT IN (FROM nx)))"""


@query(GV + _SPUR + " SELECT read_id, end3p, b_id, b3p FROM be WHERE read_id NOT IN (FROM sr) OR b_id IN (FROM sr) OR EXISTS (FROM be k WHERE k.read_id = be.b_id AND k.end3p = be.b3p AND k.b_id = be.read_id AND k.b3p = be.end3p)")
def repair_spurs(spark, d):
    g = graph(spark, d)
    inside = H.contained(g)
    edges = H.best_edges(g, inside)
    reads = g.select(F.col("a_id").alias("read_id")).distinct().join(inside, "read_id", "left_anti")
    return H.repair_spurs(edges, H.spur_marks(edges, reads).where("spur")).select("read_id", "end3p", "b_id", "b3p")


@query(GV + f""", pl AS (SELECT a_id % 20 AS tig_id, a_id AS read_id, a_id * 977 % 40000 AS lo, a_id * 977 % 40000 + {READ_LEN} AS hi, a_id % 3 = 0 AS reverse FROM (SELECT DISTINCT a_id FROM ovl0)),
pi AS (SELECT *, row_number() OVER (PARTITION BY tig_id ORDER BY lo, hi, read_id) AS i, count(*) OVER (PARTITION BY tig_id) AS n FROM pl),
en AS (SELECT tig_id, read_id, reverse, false AS t3 FROM pi WHERE i = 1 UNION ALL SELECT tig_id, read_id, reverse, true FROM pi WHERE i = n),
ou AS (SELECT en.tig_id, t3, be.b_id, be.b3p FROM en LEFT JOIN be ON be.read_id = en.read_id AND be.end3p = (t3 <> reverse)),
hi AS (SELECT ou.tig_id, ou.t3, p.tig_id AS into_tig, ou.b_id AS into_read, NOT (n > 4 AND i <= 8) AS n3 FROM ou JOIN pi p ON p.read_id = ou.b_id WHERE ou.b3p <> p.reverse AND n > 4 AND (i <= 8 OR i + 8 > n))
SELECT hi.tig_id, hi.t3 AS end3p, into_tig, into_read FROM hi JOIN ou o ON o.tig_id = into_tig AND o.t3 = n3 WHERE o.b_id IS NULL""")
def detect_spurs(spark, d):
    from .layouts import placed

    return H.spur_report(placed(spark, d), best(spark, d), 8, 4)
