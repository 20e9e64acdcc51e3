"""Alignment, vote and consensus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.seq import mapq, seed_minimum
from ..operators import errors as E
from ..operators import kmers as K
from ..tables import load, overlaps, references, sql
from . import register

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)


@query(sql("refs") + " SELECT a.read_id AS a_id, b.read_id AS b_id, levenshtein(a.seq, b.seq)::INT AS distance FROM refs a JOIN refs b ON b.read_id = a.read_id + 1")
def banded_edit_distance(spark, d):
    r = references(spark, d)
    b = r.select(F.col("read_id").alias("b_id"), F.col("seq").alias("bseq"))
    j = r.select(F.col("read_id").alias("a_id"), F.col("seq").alias("aseq")).join(b, F.col("b_id") == F.col("a_id") + 1)
    return j.select("a_id", "b_id", E.distance("aseq", "bseq").alias("distance"))


_KINDS = "['deletes', 'a_subst', 'c_subst', 'g_subst', 't_subst', 'confirmed', 'no_insert']"
_VT = f"vt AS (SELECT l_orderkey % 300 AS read_id, l_partkey % 50 AS pos, {_KINDS}[CASE WHEN l_suppkey % 3 = 0 THEN (l_partkey % 5) + 1 ELSE l_suppkey % 7 + 1 END] AS vote FROM lineitem), tl AS (SELECT read_id, pos, " + ", ".join(f"count(*) FILTER (WHERE vote = '{v}') AS {v}" for v in E.VOTES) + " FROM vt GROUP BY 1, 2)"


def cast(spark, d):
    l = load(spark, d, "lineitem")
    kinds = F.array(*[F.lit(v) for v in E.VOTES])
    i = F.when(F.col("l_suppkey") % 3 == 0, F.col("l_partkey") % 5 + 1).otherwise(F.col("l_suppkey") % 7 + 1).cast("int")
    return l.select((F.col("l_orderkey") % 300).alias("read_id"), (F.col("l_partkey") % 50).alias("pos"), F.element_at(kinds, i).alias("vote")).groupBy("read_id", "pos", "vote").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + _VT + " SELECT * FROM tl")
def vote_tally(spark, d):
    return E.tally(cast(spark, d))


_TOP = "greatest(deletes, a_subst, c_subst, g_subst, t_subst)"
_WIN = "CASE " + " ".join(f"WHEN {v} = top THEN '{v}'" for v in E.VOTES[:5]) + " END"


@query("WITH " + _VT + f""", w AS (SELECT *, {_TOP} AS top, deletes + a_subst + c_subst + g_subst + t_subst + confirmed AS total, (deletes >= 4)::INT + (a_subst >= 4)::INT + (c_subst >= 4)::INT + (g_subst >= 4)::INT + (t_subst >= 4)::INT AS al FROM tl), x AS (SELECT *, {_WIN} AS win FROM w)
SELECT read_id, pos, CASE WHEN win <> substring('acgt', (pos % 4 + 1)::INT, 1) || '_subst' AND total > 1 AND 2 * top > total AND al < 2 AND NOT (confirmed = 1 AND top <= 6) THEN win END AS change FROM x""")
def check_del_subst(spark, d):
    t = E.tally(cast(spark, d))
    base = F.element_at(F.array(*[F.lit(x) for x in "ACGT"]), (F.col("pos") % 4 + 1).cast("int"))
    return t.select("read_id", "pos", E.check_del_subst(base, 2, 4).alias("change"))


@query("SELECT o_custkey % 9 AS n, CASE WHEN o_custkey % 9 <= 1 THEN 60 ELSE floor(-10 * log10(1 - 1 / (o_custkey % 9))) END::INT AS mapq, count(*) AS orders FROM orders GROUP BY 1")
def mapping_quality(spark, d):
    n = F.col("o_custkey") % 9
    return load(spark, d, "orders").groupBy(n.alias("n")).agg(F.first(mapq(n)).alias("mapq"), F.count(F.lit(1)).alias("orders"))


@query(sql("ovl") + " SELECT a_id, b_id, flipped, greatest(10, floor(exp(-22 * 0.05) * (span - 21)))::INT AS least FROM ovl")
def seeds_expected(spark, d):
    return overlaps(spark, d).select("a_id", "b_id", "flipped", seed_minimum(22, 0.05, F.col("span"), 10).alias("least"))


@query()
def trivial_dna(spark, d):
    r = references(spark, d)
    return r.select("read_id", "len", K.trivial_bases(F.col("seq")).cast("bigint").alias("trivial"))


def noisy(spark, d, copies=12):
    """Copies of the references, each with one base changed, one left out and one put in."""
    r = references(spark, d).where("len >= 60")
    i = F.explode(F.sequence(F.lit(1), F.lit(copies)))
    r = r.select("read_id", "seq", "len", i.alias("c"))
    at = lambda k: (F.col("c") * k * 7 + F.col("read_id") * 3) % (F.col("len") - 20) + 10
    x = F.concat(F.expr("substring(seq, 1, 0)"), F.col("seq"))
    sub = F.overlay(x, F.translate(F.substring(x, at(1) + 1, F.lit(1)), "ACGT", "CGTA"), at(1) + 1, F.lit(1))
    gone = F.overlay(sub, F.lit(""), at(3) + 1, F.lit(1))
    return r.select("read_id", "seq", "c", gone.alias("other"))


@query()
def find_errors(spark, d):
    return E.tally(E.votes(noisy(spark, d, 4)))


@query()
def template_consensus(spark, d):
    """Twelve copies with errors at different places, the first of which is the template."""
    n = noisy(spark, d)
    first = n.where("c = 1").select("read_id", F.col("other").alias("template"))
    others = n.groupBy("read_id").agg(F.collect_list("other").alias("others"))
    return E.template_consensus(first.join(others, "read_id"), min_coverage=0)


_IN = "WITH " + _VT + """, ic AS (SELECT l_orderkey % 300 AS read_id, l_partkey % 50 AS pos, ['A', 'AC', 'G', 'A'][l_linenumber % 4 + 1] AS ins, count(*) AS n FROM lineitem GROUP BY ALL), cf AS (SELECT read_id, pos, no_insert, no_insert % 3 AS conf FROM tl),
pi AS (SELECT read_id, pos, sum(n) AS total, count(*) FILTER (WHERE n >= 3) AS al, min((-n, ins)) AS top FROM ic GROUP BY 1, 2),
pj AS (SELECT pi.*, -top[1] AS most, coalesce(no_insert, 0) AS no_insert, coalesce(conf, 0) AS conf FROM pi LEFT JOIN cf USING (read_id, pos))"""


@query(_IN + " SELECT read_id, pos, top[2] AS ins FROM pj WHERE conf < 2 AND total > 1 AND 2 * most > total + no_insert AND al + (no_insert >= 3)::INT < 2 AND NOT (conf = 1 AND most <= 6)")
def check_insert(spark, d):
    l = load(spark, d, "lineitem")
    ins = F.element_at(F.array(*[F.lit(x) for x in ("A", "AC", "G", "A")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    counts = l.groupBy((F.col("l_orderkey") % 300).alias("read_id"), (F.col("l_partkey") % 50).alias("pos"), ins.alias("ins")).agg(F.count(F.lit(1)).alias("n"))
    return E.check_insert(counts, E.tally(cast(spark, d)).withColumn("conf_no_insert", F.col("no_insert") % 3), expected=2, confirm=3)


@query("WITH " + _VT + ", ht AS (SELECT read_id, pos FROM tl WHERE deletes >= 2 AND a_subst + c_subst + g_subst + t_subst + confirmed >= 2) SELECT DISTINCT tl.read_id, tl.pos FROM tl JOIN ht ON ht.read_id = tl.read_id AND tl.pos BETWEEN ht.pos - 1 AND ht.pos + 1")
def freeze_deletes(spark, d):
    return E.frozen_deletes(E.tally(cast(spark, d)), 2)
