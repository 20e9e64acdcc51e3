"""k-mer, haplotype and sketch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import haplotype as H
from ..operators import kmers as K
from ..operators import sketch as S
from ..tables import reads, references, sql
from . import register

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)


def mers(table: str, k: int, name: str = "km") -> str:
    return f"{name} AS (SELECT read_id, i - 1 AS pos, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT read_id, i, substring(seq, i, {k}) AS f FROM (SELECT read_id, seq, unnest(range(1, len - {k - 2})) AS i FROM {table} WHERE len >= {k})))"


REF = sql("refs") + ", " + mers("refs", 8) + ", kc AS (SELECT kmer, count(*) AS count FROM km GROUP BY kmer)"


def ref_counts(spark, d, k=8):
    return K.count(references(spark, d), k)


@query(sql("reads") + ", " + mers("reads", 21) + " SELECT kmer, count(*) AS count FROM km GROUP BY kmer ORDER BY count DESC, kmer LIMIT 100")
def kmer_count_topk(spark, d):
    return K.count_packed(reads(spark, d), 21).orderBy(F.desc("count"), "kmer").limit(100).select(K.unpacked(F.col("kmer"), 21).alias("kmer"), "count")


_HIST = "SELECT freq, n_distinct, round(sum(n_distinct) OVER w / sum(n_distinct) OVER (), 9) AS frac_distinct, round(sum(freq * n_distinct) OVER w / sum(freq * n_distinct) OVER (), 9) AS frac_total FROM (SELECT count AS freq, count(*) AS n_distinct FROM kc GROUP BY 1) WINDOW w AS (ORDER BY freq)"


@query(sql("reads") + ", " + mers("reads", 16) + ", kc AS (SELECT kmer, count(*) AS count FROM km GROUP BY kmer) " + _HIST)
def kmer_histogram(spark, d):
    return K.histogram(K.count_packed(reads(spark, d), 16)).select("freq", "n_distinct", F.round("frac_distinct", 9).alias("frac_distinct"), F.round("frac_total", 9).alias("frac_total"))


@query(REF + " SELECT kmer, count * 2 AS count FROM kc")
def kmer_union_sum(spark, d):
    k = ref_counts(spark, d)
    return K.union_sum(k, k)


@query(REF + " SELECT kmer, count FROM kc WHERE count > 1")
def kmer_greater_than(spark, d):
    return K.greater_than(ref_counts(spark, d), 1)


@query(REF + " SELECT count(*) FILTER (WHERE count = 1) AS n_unique, count(*) AS n_distinct, sum(count)::BIGINT AS n_present FROM kc")
def kmer_statistics(spark, d):
    return K.statistics(ref_counts(spark, d))


@query(REF + f", h AS ({_HIST}) SELECT kmer, count FROM kc WHERE count >= (SELECT min(freq) FROM h WHERE frac_distinct >= 0.9)")
def kmer_at_least_distinct(spark, d):
    return K.at_least(ref_counts(spark, d), distinct=0.9)


@query(REF + " SELECT kmer, count FROM kc WHERE count >= 3 AND count / (SELECT sum(count) FROM kc) >= 0.0005")
def kmer_word_frequency(spark, d):
    return K.at_least(ref_counts(spark, d), threshold=3, word_frequency=0.0005)


@query(REF + ", f AS (SELECT kmer, count FROM kc WHERE count >= 4) SELECT DISTINCT k AS kmer, round(count / 10000, 10) AS frac, count, 10000::BIGINT AS total FROM (SELECT unnest([kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))]) AS k, count FROM f)")
def kmer_ignore_list(spark, d):
    return K.ignore_list(K.at_least(ref_counts(spark, d), threshold=4), 10_000)


@query(sql("reads", "refs") + ", " + mers("refs", 12) + ", " + mers("reads", 12, "rm") + " SELECT kmer, count(*) AS count FROM km WHERE kmer NOT IN (SELECT kmer FROM rm) GROUP BY kmer")
def kmer_difference(spark, d):
    left = K.difference(K.count_packed(references(spark, d), 12), K.count_packed(reads(spark, d), 12))
    return left.select(K.unpacked(F.col("kmer"), 12).alias("kmer"), "count")


@query(REF + ", h AS (SELECT freq, n, lead(n) OVER (ORDER BY freq) AS nx FROM (SELECT count AS freq, count(*) AS n FROM kc GROUP BY 1)) SELECT min(freq) + 1 AS min_freq FROM h WHERE nx >= n OR nx IS NULL")
def kmer_noise_trough(spark, d):
    return K.trough(ref_counts(spark, d))


@query(sql("refs") + ", " + mers("refs", 8) + ", sh AS (SELECT read_id, seq[2:] AS seq, len - 1 AS len FROM refs WHERE len > 1), " + mers("sh", 8, "sm") + ", kc AS (SELECT kmer, count(*) AS count FROM km GROUP BY kmer) SELECT a.read_id, count(*) AS shared, count(*) FILTER (WHERE count < 3) AS uniq, count(*) FILTER (WHERE count >= 3) AS rep FROM km a JOIN sm b ON a.read_id = b.read_id AND a.pos = b.pos AND a.kmer = b.kmer JOIN kc ON kc.kmer = a.kmer GROUP BY a.read_id")
def kmer_profile(spark, d):
    r = references(spark, d)
    shifted = r.where("len > 1").select("read_id", F.expr("substring(seq, 2)").alias("seq"))
    return K.profile(K.expand(r, 8), K.expand(shifted, 8), K.count(r, 8), cutoff=3)


_HAP = sql("reads") + ", " + mers("reads", 16) + ", hk AS (SELECT kmer, min(lang) AS hap FROM km JOIN reads USING (read_id) GROUP BY kmer HAVING count(DISTINCT lang) = 1)"


def parents(spark, d):
    return reads(spark, d).select(F.col("lang").alias("hap"), "read_id", "seq")


@query(_HAP + " SELECT hap, count(*) AS n_kmers FROM hk GROUP BY hap")
def haplotype_kmers(spark, d):
    return H.specific_kmers(parents(spark, d), 16).groupBy("hap").agg(F.count(F.lit(1)).alias("n_kmers"))


@query(_HAP + """, sz AS (SELECT hap, count(*) AS n FROM hk GROUP BY hap), hit AS (SELECT read_id, hap, count(*) AS m FROM km JOIN hk USING (kmer) GROUP BY 1, 2),
s AS (SELECT read_id, hap, m / n AS score, row_number() OVER (PARTITION BY read_id ORDER BY m / n DESC, hap) AS rk FROM hit JOIN sz USING (hap)),
t AS (SELECT read_id, max(hap) FILTER (WHERE rk = 1) AS best, max(score) FILTER (WHERE rk = 1) AS s1, coalesce(max(score) FILTER (WHERE rk = 2), 0) AS s2 FROM s GROUP BY read_id)
SELECT read_id, CASE WHEN s1 IS NOT NULL AND (s2 = 0 OR s1 / s2 > 1.5) THEN best ELSE 'ambiguous' END AS hap, round(coalesce(s1, 0), 12) AS score FROM reads LEFT JOIN t USING (read_id) WHERE len >= 100""")
def haplotype_assign(spark, d):
    return H.assign(reads(spark, d), parents(spark, d), 16, min_ratio=1.5, min_length=100).withColumn("score", F.round("score", 12))


_MIN = "mh AS (SELECT DISTINCT read_id, s AS slot, min(md5(kmer || s)) OVER (PARTITION BY read_id, s) AS h FROM km, (SELECT unnest(range(4))::INT AS s))"


@query(sql("refs") + ", " + mers("refs", 8) + ", " + _MIN + " SELECT read_id, slot, h FROM mh")
def minhash_signatures(spark, d):
    return S.minhash(K.expand(references(spark, d), 8), 4)


@query(sql("refs") + ", " + mers("refs", 8) + ", " + _MIN + " SELECT a.read_id AS a_id, b.read_id AS b_id, count(*) AS matches FROM mh a JOIN mh b ON a.slot = b.slot AND a.h = b.h AND a.read_id < b.read_id GROUP BY 1, 2 HAVING count(*) >= 1")
def minhash_pairs(spark, d):
    return S.minhash_pairs(S.minhash(K.expand(references(spark, d), 8), 4), 1)


@query(sql("refs") + ", " + mers("refs", 8) + ", m AS (SELECT *, md5(kmer) AS h FROM km), w AS (SELECT a.read_id, a.pos AS win, min((b.h, b.pos)) AS m FROM m a JOIN m b ON a.read_id = b.read_id AND b.pos BETWEEN a.pos AND a.pos + 4 GROUP BY 1, 2 HAVING count(*) = 5) SELECT DISTINCT w.read_id, m[2] AS pos, km.kmer FROM w JOIN km ON km.read_id = w.read_id AND km.pos = m[2]")
def minimizers(spark, d):
    return S.minimizers(K.expand(references(spark, d), 8), 5)


@query(sql("reads") + " SELECT library, floor(5.0 * sum(len) / 10000)::BIGINT AS threshold FROM reads GROUP BY library")
def mhap_threshold(spark, d):
    """Per library, for a genome of 10,000 bases."""
    return reads(spark, d).groupBy("library").agg(K.mhap_threshold(F.sum("len") / 10_000).alias("threshold"))
