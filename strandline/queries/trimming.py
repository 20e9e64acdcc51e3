"""Trimming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trimming as T
from ..tables import READ_LEN, load, overlaps, sql
from . import register
from .intervals import merged
from .overlaps import read_len, full

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)
OVL = sql("ovl")
_RG = f"rg AS (SELECT a_id AS read_id, a_id * 13 % 900 AS bgn, {READ_LEN} - a_id * 7 % 1100 AS \"end\" FROM (SELECT DISTINCT a_id FROM ovl))"


def ranges(spark, d):
    r = overlaps(spark, d).select(F.col("a_id").alias("read_id")).distinct()
    return r.select("read_id", (F.col("read_id") * 13 % 900).alias("bgn"), (READ_LEN - F.col("read_id") * 7 % 1100).alias("end"))


@query()
def largest_covered(spark, d):
    return T.largest_covered(full(spark, d), 2000, 500, 2)


@query(OVL + f", {_RG} SELECT read_id, bgn, \"end\", CASE WHEN \"end\" - bgn < 8300 THEN 'DEL' WHEN bgn = 0 AND \"end\" = {READ_LEN} THEN 'NOC' ELSE 'MOD' END AS status FROM rg")
def trim_status(spark, d):
    g = ranges(spark, d)
    return T.trim_status(g.select("read_id").withColumn("len", read_len()), g, 8300)


@query(OVL + f", {_RG}, mx AS (SELECT read_id, 400 AS m0, 9400 - read_id * 31 % 9000 AS m1 FROM rg) SELECT read_id, CASE WHEN greatest(bgn, m0) < least(\"end\", m1) THEN greatest(bgn, m0) ELSE 0 END AS bgn, CASE WHEN greatest(bgn, m0) < least(\"end\", m1) THEN least(\"end\", m1) ELSE 0 END AS \"end\", greatest(bgn, m0) < least(\"end\", m1) AS ok FROM rg JOIN mx USING (read_id)")
def enforce_max_clear(spark, d):
    g = ranges(spark, d)
    return T.enforce_max_clear(g, g.select("read_id", F.lit(400).cast("bigint").alias("max_bgn"), (9400 - F.col("read_id") * 31 % 9000).alias("max_end")))


_SUB = OVL + f""", p AS (SELECT a_id, b_id, flipped, ahg5 AS alo, {READ_LEN} - ahg3 AS ahi, CASE WHEN flipped THEN bhg3 ELSE bhg5 END AS blo, {READ_LEN} - CASE WHEN flipped THEN bhg5 ELSE bhg3 END AS bhi FROM ovl),
j AS (SELECT x.a_id AS read_id, x.b_id, CASE WHEN x.alo <= y.alo THEN x.ahi ELSE y.ahi END AS e1, CASE WHEN x.alo <= y.alo THEN y.alo ELSE x.alo END AS e2, greatest(0, least(x.ahi, y.ahi) - greatest(x.alo, y.alo)) AS on_a, greatest(0, least(x.bhi, y.bhi) - greatest(x.blo, y.blo)) AS on_b FROM p x JOIN p y ON x.a_id = y.a_id AND x.b_id = y.b_id AND NOT x.flipped AND y.flipped)"""


@query(_SUB + " SELECT read_id, least(e1, e2) AS lo, greatest(e1, e2) AS hi, b_id FROM j WHERE on_a <= 6500 AND on_b >= 250")
def subread_evidence(spark, d):
    """With a tolerance on a that the generated overlaps reach."""
    return T.subread_evidence(full(spark, d), 6500, 250)


@query(_SUB + f""", e AS (SELECT read_id AS key, least(e1, e2) AS lo, greatest(e1, e2) AS hi FROM j WHERE on_a <= 6500 AND on_b >= 250 AND e1 <> e2 AND abs(e1 - e2) <= 6500), {merged('0', 'e')}, m AS (SELECT key, lo, hi, n FROM mg WHERE n >= 2)
SELECT m.key AS read_id, m.lo, m.hi, m.n, count(c.alo) AS n_span FROM m LEFT JOIN p c ON c.a_id = m.key AND c.alo + 100 <= m.lo AND m.hi + 100 <= c.ahi GROUP BY 1, 2, 3, 4 HAVING count(c.alo) <= 40""")
def detect_subreads(spark, d):
    return T.detect_subreads(full(spark, d), 6500, 2, 40, on_a=6500, on_b=250)


@query(OVL + f", {_RG}, bd AS (SELECT read_id AS key, greatest(lo, bgn) AS lo, least(hi, \"end\") AS hi FROM (SELECT a_id AS read_id, a_id * 41 % 9000 + b_id AS lo, a_id * 41 % 9000 + b_id + 150 AS hi FROM ovl WHERE b_id % 90 = 0) JOIN rg USING (read_id) WHERE greatest(lo, bgn) < least(hi, \"end\")), {merged('0', 'bd')}, " + """
iv AS (SELECT key, lo, hi FROM mg UNION ALL SELECT read_id, bgn, bgn FROM rg UNION ALL SELECT read_id, "end", "end" FROM rg), gp AS (SELECT key, max(hi) OVER (PARTITION BY key ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, lo AS hi FROM iv),
lg AS (SELECT key, lo, hi FROM gp WHERE lo < hi QUALIFY row_number() OVER (PARTITION BY key ORDER BY hi - lo DESC, lo) = 1)
SELECT read_id, CASE WHEN hi - lo >= 6000 THEN lo ELSE 0 END AS bgn, CASE WHEN hi - lo >= 6000 THEN hi ELSE 0 END AS "end", coalesce(hi - lo < 6000, true) AS deleted FROM rg LEFT JOIN lg ON key = read_id""")
def trim_bad_interval(spark, d):
    lo = F.col("a_id") * 41 % 9000 + F.col("b_id")
    bad = overlaps(spark, d).where("b_id % 90 = 0").select(F.col("a_id").alias("read_id"), lo.alias("lo"), (lo + 150).alias("hi"))
    return T.trim_bad(ranges(spark, d), bad, 6000)


@query(OVL + f""", {_RG}, c AS (SELECT read_id, greatest(ahg5, bgn) AS lo, least({READ_LEN} - ahg3, "end") AS hi, (bgn + "end") // 2 AS half FROM ovl JOIN rg ON read_id = a_id WHERE greatest(ahg5, bgn) < least({READ_LEN} - ahg3, "end")),
f AS (SELECT read_id, lo AS bgn FROM c WHERE lo < half QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY hi - lo DESC, lo) = 1), t AS (SELECT read_id, hi AS "end" FROM c WHERE hi > half QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY hi - lo DESC, hi DESC) = 1) SELECT * FROM f JOIN t USING (read_id)""")
def best_edge_trim(spark, d):
    return T.best_edge_trim(full(spark, d), ranges(spark, d))


@query("SELECT l_orderkey AS read_id, max((l_linenumber, l_partkey % 500, l_partkey % 500 + 4000 + l_suppkey % 100))[2] AS bgn, max((l_linenumber, l_partkey % 500, l_partkey % 500 + 4000 + l_suppkey % 100))[3] AS \"end\" FROM lineitem GROUP BY 1")
def merge_ranges(spark, d):
    bgn = F.col("l_partkey") % 500
    l = load(spark, d, "lineitem").select(F.col("l_linenumber").alias("batch"), F.col("l_orderkey").alias("read_id"), bgn.alias("bgn"), (bgn + 4000 + F.col("l_suppkey") % 100).alias("end"))
    return T.merge_ranges(l)
