"""Interval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..tables import intervals, layout, sql
from . import register

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)


def merged(slack: str, src: str = "iv", name: str = "mg") -> str:
    return f"""{name}1 AS (SELECT *, max(hi) OVER (PARTITION BY key ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {src}),
{name}2 AS (SELECT *, sum(CASE WHEN far IS NULL OR lo > far - {slack} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM {name}1),
{name} AS (SELECT key, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM {name}2 GROUP BY key, run)"""


def depths(src: str = "iv", name: str = "dp") -> str:
    return f"""{name}e AS (SELECT key, pos, sum(d) AS d FROM (SELECT key, lo AS pos, 1 AS d FROM {src} UNION ALL SELECT key, hi, -1 FROM {src}) GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT key, pos AS lo, lead(pos) OVER w AS hi, (sum(d) OVER w)::BIGINT AS depth FROM {name}e WINDOW w AS (PARTITION BY key ORDER BY pos)) WHERE depth > 0 AND hi IS NOT NULL)"""


@query(sql("iv") + ", " + merged("0") + " SELECT * FROM mg")
def interval_merge(spark, d):
    return I.merge(intervals(spark, d))


@query(sql("iv") + ", " + merged("5") + " SELECT * FROM mg")
def interval_merge_min_overlap(spark, d):
    return I.merge(intervals(spark, d), 5)


@query(sql("iv") + ", " + depths() + " SELECT * FROM dp")
def interval_depth(spark, d):
    return I.depth(intervals(spark, d))


@query(sql("iv") + ", " + merged("0") + """, e AS (SELECT key, lo, hi FROM mg UNION ALL SELECT DISTINCT key, 0, 0 FROM iv UNION ALL SELECT DISTINCT key, 21000, 21000 FROM iv)
SELECT key, far AS lo, lo AS hi FROM (SELECT key, lo, max(hi) OVER (PARTITION BY key ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM e) WHERE far < lo""")
def interval_invert(spark, d):
    iv = intervals(spark, d)
    return I.invert(I.merge(iv), iv.select("key").distinct().select("key", F.lit(0).cast("bigint").alias("bgn"), F.lit(21000).cast("bigint").alias("end")))


@query(sql("iv") + """, a AS (SELECT DISTINCT key, lo, hi FROM iv WHERE lo % 2 = 0), b AS (SELECT DISTINCT key, lo, hi FROM iv WHERE lo % 2 = 1)
SELECT a.key, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM a JOIN b ON a.key = b.key AND a.lo < b.hi AND b.lo < a.hi""")
def interval_intersect(spark, d):
    iv = intervals(spark, d).distinct()
    return I.intersect(iv.where("lo % 2 = 0"), iv.where("lo % 2 = 1"))


@query(sql("iv") + ", " + depths() + " SELECT key, sum(hi - lo)::BIGINT AS covered, round(sum((hi - lo) * depth) / sum(hi - lo), 9) AS avg_depth, max(depth) AS max_depth, round(sqrt(greatest(0, sum((hi - lo) * depth * depth) / sum(hi - lo) - (sum((hi - lo) * depth) / sum(hi - lo)) ** 2)), 6) AS stddev_depth FROM dp GROUP BY key")
def tig_coverage(spark, d):
    return I.coverage(I.depth(intervals(spark, d))).withColumn("avg_depth", F.round("avg_depth", 9)).withColumn("stddev_depth", F.round("stddev_depth", 6))


@query(sql("iv") + ", " + depths() + " SELECT depth, sum(hi - lo)::BIGINT AS bases FROM dp GROUP BY depth")
def tig_depth_histogram(spark, d):
    return I.depth_histogram(I.depth(intervals(spark, d)))


@query(sql("lay") + " SELECT tig_id, lo, hi, far - lo AS thickness FROM (SELECT tig_id, lo, hi, max(hi) OVER (PARTITION BY tig_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM lay) WHERE far IS NOT NULL")
def thin_overlap(spark, d):
    return I.thin_overlaps(layout(spark, d), "tig_id")


@query(sql("lay") + ", m AS (SELECT DISTINCT tig_id, lo + 20 AS lo, lo + 40 AS hi FROM lay WHERE read_id % 50 = 0) SELECT m.tig_id, m.lo, m.hi, count(r.lo) AS n_span FROM m LEFT JOIN lay r ON m.tig_id = r.tig_id AND r.lo + 10 <= m.lo AND m.hi + 10 <= r.hi GROUP BY 1, 2, 3")
def spanning_reads(spark, d):
    r = layout(spark, d)
    marks = r.where("read_id % 50 = 0").select("tig_id", (F.col("lo") + 20).alias("lo"), (F.col("lo") + 40).alias("hi")).distinct()
    return I.spanning(marks, r, 10, "tig_id")


@query(sql("lay") + " SELECT tig_id, read_id, lo, hi, reverse, (sum(CASE WHEN lo > far - 100 THEN 1 ELSE 0 END) OVER (PARTITION BY tig_id ORDER BY lo, hi, read_id ROWS UNBOUNDED PRECEDING))::BIGINT AS part FROM (SELECT *, max(hi) OVER (PARTITION BY tig_id ORDER BY lo, hi, read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM lay)")
def split_discontinuous(spark, d):
    return I.split_discontinuous(layout(spark, d), 100)


@query(sql("iv") + ", " + merged("0") + " SELECT key, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY hi - lo DESC, lo) AS rn FROM mg) WHERE rn = 1")
def largest_interval(spark, d):
    return I.largest(I.merge(intervals(spark, d)))
