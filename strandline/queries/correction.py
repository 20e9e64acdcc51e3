"""Correction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import correction as C
from ..operators import overlaps as O
from ..tables import READ_LEN, layout, overlaps, sql
from . import register
from .intervals import depths, merged
from .overlaps import read_len, OVL, SCORE, full

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)

EV, LN = (100, 2500), (4000, 9800)
_SC = OVL + f", sc AS (SELECT *, {SCORE} AS score, evalue BETWEEN 100 AND 2500 AND al BETWEEN 4000 AND 9800 AS usable FROM ovl), th AS (SELECT a_id, coalesce(max(score) FILTER (WHERE r = 31 AND usable), 0) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY a_id, usable ORDER BY score DESC, b_id, flipped) AS r FROM sc) GROUP BY a_id)"


def scored(spark, d):
    return C.scored(full(spark, d), EV, LN)


@query(_SC + " SELECT a_id, threshold FROM th")
def global_score_threshold(spark, d):
    return C.global_threshold(scored(spark, d), 30).withColumn("threshold", F.col("threshold").cast("bigint"))


@query(_SC + " SELECT count(*) AS total, count(*) FILTER (WHERE evalue < 100) AS low_erate, count(*) FILTER (WHERE evalue > 2500) AS high_erate, count(*) FILTER (WHERE al < 4000) AS too_short, count(*) FILTER (WHERE al > 9800) AS too_long, count(*) FILTER (WHERE usable AND score < threshold) AS below_cutoff, count(*) FILTER (WHERE usable AND score >= threshold) AS retained FROM sc JOIN th USING (a_id)")
def global_score_stats(spark, d):
    s = scored(spark, d)
    return C.threshold_stats(s, C.global_threshold(s, 30), EV, LN)


@query(_SC + ", f AS (SELECT a_id, count(*) FILTER (WHERE score < threshold) / count(*) AS f FROM sc JOIN th USING (a_id) WHERE usable GROUP BY a_id) SELECT count(*) FILTER (WHERE f <= 0) AS reads000, count(*) FILTER (WHERE f <= 0.5) AS reads050, count(*) FILTER (WHERE f <= 0.8) AS reads080, count(*) FILTER (WHERE f <= 0.95) AS reads095, count(*) FILTER (WHERE f <= 1) AS reads100 FROM f")
def filter_stats(spark, d):
    s = scored(spark, d)
    return C.reads_by_filtered(s, C.global_threshold(s, 30))


_SAMP = OVL + f""", sc AS (SELECT a_id, {SCORE} AS score FROM ovl), rk AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC) - 1 AS rank, count(*) OVER (PARTITION BY a_id) AS n FROM sc),
w AS (SELECT a_id, n, least(10.0, greatest(1.0, n / 16)) AS step, i FROM (SELECT a_id, count(*) AS n FROM sc GROUP BY a_id), (SELECT unnest(range(16))::INT AS i)),
p AS (SELECT a_id, i, least(CASE WHEN i < 15 AND i * step < n THEN floor(i * step + 0.5)::BIGINT ELSE n - 1 END, n - 1) AS rank FROM w), sa AS (SELECT p.a_id, i, p.rank, score FROM p JOIN rk ON rk.a_id = p.a_id AND rk.rank = p.rank)"""


def samples(spark, d):
    return O.score_samples(overlaps(spark, d), G.overlap_score(G.a_aligned(read_len()), read_len()).cast("bigint"))


@query(_SAMP + " SELECT * FROM sa")
def score_samples(spark, d):
    return samples(spark, d)


@query(_SAMP + ", l AS (SELECT *, lag(rank) OVER w AS r0, lag(score) OVER w AS s0 FROM sa WINDOW w AS (PARTITION BY a_id ORDER BY i)) SELECT a_id, coalesce(max(floor(s0 + (score - s0) / (rank - r0) * (25 - r0))) FILTER (WHERE r0 < 25 AND rank >= 25), 0)::INT AS estimate FROM l GROUP BY a_id")
def score_estimate(spark, d):
    return O.score_estimate(samples(spark, d), 25)


_EV = _SC + ", evd AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY sc.a_id, sc.b_id ORDER BY flipped, ahg5, ahg3, bhg5, bhg3, evalue) AS rn FROM sc JOIN th ON th.a_id = sc.b_id WHERE evalue <= 2000 AND al >= 5000 AND score >= threshold) WHERE rn = 1)"


def evidence(spark, d):
    s = scored(spark, d)
    return C.evidence(s, C.global_threshold(s, 30), 2000, 5000)


@query(_EV + " SELECT a_id, b_id, flipped, score FROM evd")
def correction_evidence(spark, d):
    return evidence(spark, d).select("a_id", "b_id", "flipped", F.col("score").cast("bigint").alias("score"))


@query(sql("lay") + """, m AS (SELECT *, coalesce(hi > max(hi) OVER (PARTITION BY tig_id ORDER BY lo, hi DESC, read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS backbone FROM lay),
r AS (SELECT *, coalesce(sum(hi - lo) OVER (PARTITION BY tig_id ORDER BY backbone DESC, hi - lo DESC, read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
SELECT tig_id, read_id, lo, hi, backbone, backbone OR before < 2.5 * 31000 AS kept FROM r""")
def excess_coverage(spark, d):
    lay = layout(spark, d).drop("reverse")
    return C.drop_excess_coverage(lay, lay.select("tig_id").distinct().withColumn("length", F.lit(31000)), 2.5)


_CL = _EV + f", eiv AS (SELECT a_id AS key, ahg5 AS lo, {READ_LEN} - ahg3 AS hi FROM evd), {depths('eiv')}, deep AS (SELECT key, lo, hi FROM dp WHERE depth >= 4), {merged('0', 'deep')}, cl AS (SELECT key AS read_id, max(hi - lo) AS corrected FROM mg GROUP BY key)"


def corrected(spark, d):
    e = evidence(spark, d).select(F.col("a_id").alias("key"), G.a_bgn().alias("lo"), G.a_end(read_len()).alias("hi"))
    return C.corrected_length(e, 4).withColumnRenamed("key", "read_id")


@query(_CL + " SELECT * FROM cl")
def corrected_length(spark, d):
    return corrected(spark, d)


_SEL = _CL + ", se AS (SELECT read_id, corrected, coalesce(sum(corrected) OVER (ORDER BY corrected DESC, read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 1500000 AS selected FROM cl)"


@query(_SEL + " SELECT * FROM se")
def select_reads_to_correct(spark, d):
    return C.select_reads(corrected(spark, d), 1_500_000)


@query(_SEL.replace("1500000", "60000") + " SELECT * FROM se WHERE NOT selected AND corrected > 1000 AND read_id NOT IN (SELECT b_id FROM evd WHERE a_id IN (SELECT read_id FROM se WHERE selected))")
def rescued_reads(spark, d):
    return C.rescued(C.select_reads(corrected(spark, d), 60_000), evidence(spark, d), 1000)


@query(OVL + ", b AS (SELECT evalue AS v FROM (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY span DESC, evalue) AS rn FROM ovl) WHERE rn = 1), m AS (SELECT list_sort(list(v))[count(*) // 2 + 1] AS median FROM b), e AS (SELECT list_sort(list(abs(v - median)))[count(*) // 2 + 1] AS mad, any_value(median) AS median FROM b, m) SELECT median, mad, round(CASE WHEN median + 6 * 1.4826 * mad = 0 THEN 0.01 ELSE (median + 6 * 1.4826 * mad) / 100000 END, 12) AS error FROM e")
def error_estimate(spark, d):
    return C.error_estimate(overlaps(spark, d)).withColumn("error", F.round("error", 12))
