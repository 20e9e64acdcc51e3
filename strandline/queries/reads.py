"""Read-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.seq import homopolymer_compress, reverse_complement
from ..operators import reads as R
from ..tables import reads, sql
from . import register

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)


@query(sql("reads") + " SELECT library, count(*) AS reads, sum(len)::BIGINT AS bases, min(len) AS shortest, max(len) AS longest FROM reads GROUP BY library")
def read_stats(spark, d):
    return R.stats(reads(spark, d), "library")


@query(sql("reads") + " SELECT len // 500 * 500 AS bin, count(*) AS reads, sum(len)::BIGINT AS bases FROM reads GROUP BY 1")
def read_length_histogram(spark, d):
    return R.length_histogram(reads(spark, d), 500)


@query(sql("reads") + """, c AS (SELECT len, row_number() OVER w AS k, sum(len) OVER w AS upto, sum(len) OVER () AS total FROM reads WHERE len > 0 WINDOW w AS (ORDER BY len DESC, read_id ROWS UNBOUNDED PRECEDING))
SELECT ng, max(len) AS len, min(k)::BIGINT AS reads FROM c, (SELECT unnest(range(10, 101, 10))::INT AS ng) WHERE upto > total * ng / 100 GROUP BY ng""")
def read_n50_table(spark, d):
    return R.n_table(reads(spark, d).where("len > 0"))


@query(sql("reads") + """, s AS (SELECT list_sort(list(len)) AS l, count(*) AS n, sum(len) AS b FROM reads),
c AS (SELECT len, sum(len) OVER (ORDER BY len, read_id ROWS UNBOUNDED PRECEDING) AS upto, sum(len) OVER () AS total FROM reads)
SELECT n AS reads, b::BIGINT AS bases, l[n // 2 + 1] AS median, (b // n)::BIGINT AS mean, (SELECT min(len) FROM c WHERE upto * 2 >= total) AS n50, l[1] AS shortest, l[-1] AS longest FROM s""")
def length_stats(spark, d):
    return R.length_stats(reads(spark, d))


@query(sql("reads") + """, s AS (SELECT read_id, len, coalesce(sum(len) OVER (ORDER BY len DESC, read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 500000 AS kept FROM reads) SELECT read_id, len, kept FROM s""")
def downsample_by_length(spark, d):
    return R.downsample(reads(spark, d), 500_000, F.col("len")).select("read_id", "len", "kept")


@query(sql("reads") + r" SELECT read_id, length(h)::BIGINT AS compressed, md5(h) AS digest FROM (SELECT read_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g') AS h FROM reads)")
def homopolymer_compressed(spark, d):
    h = homopolymer_compress(F.col("seq"))
    return reads(spark, d).select("read_id", F.length(h).cast("bigint").alias("compressed"), F.md5(h).alias("digest"))


@query(sql("reads") + " SELECT read_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest FROM reads")
def reverse_complemented(spark, d):
    return reads(spark, d).select("read_id", F.md5(reverse_complement(F.col("seq"))).alias("digest"))


_RANGES = "SELECT read_id, read_id * 7 % 300 AS bgn, len - read_id * 11 % 200 AS \"end\", read_id % 17 = 0 AS deleted FROM reads WHERE read_id % 5 <> 0"


@query(sql("reads") + f""", g AS ({_RANGES}), t AS (SELECT r.read_id, r.seq, r.len, g.bgn IS NULL AS missing, g.deleted OR g.bgn >= g."end" OR g."end" > r.len AS bogus, g.bgn, g."end" FROM reads r LEFT JOIN g USING (read_id))
SELECT read_id, CASE WHEN missing OR bogus THEN 0 ELSE bgn END::BIGINT AS clr_bgn, CASE WHEN missing THEN len WHEN bogus THEN 0 ELSE "end" END::BIGINT AS clr_end, coalesce(bogus, false) AS ignored FROM t""")
def load_trimmed_reads(spark, d):
    r = reads(spark, d)
    g = r.where(F.col("read_id") % 5 != 0).select("read_id", (F.col("read_id") * 7 % 300).alias("bgn"), (F.col("len") - F.col("read_id") * 11 % 200).alias("end"), (F.col("read_id") % 17 == 0).alias("deleted"))
    return R.load_trimmed(r, g).select("read_id", "clr_bgn", "clr_end", "ignored")


@query(sql("reads") + " SELECT read_id, length(substring(seq, (len // 10 + 1)::BIGINT, (len - len // 10 - len // 10)::BIGINT))::BIGINT AS len, md5(substring(seq, (len // 10 + 1)::BIGINT, (len - len // 10 - len // 10)::BIGINT)) AS digest FROM reads WHERE len > 0")
def clear_range_view(spark, d):
    r = reads(spark, d).withColumn("clr_bgn", F.floor(F.col("len") / 10)).withColumn("clr_end", F.col("len") - F.floor(F.col("len") / 10))
    return R.view(r, trimmed=True).select("read_id", "len", F.md5("seq").alias("digest"))


@query(sql("reads") + " SELECT CASE WHEN NOT regexp_matches(raw, '^[ACGTNacgtn]*$') THEN 'INVALID' WHEN length(s) < 1000 THEN 'SHORT' WHEN length(s) > 5000 THEN 'LONG' ELSE 'LOADED' END AS status, count(*) AS reads, sum(length(s))::BIGINT AS bases FROM (SELECT raw, translate(upper(regexp_replace(raw, '^[Nn]+|[Nn]+$', '', 'g')), 'U', 'T') AS s FROM (SELECT 'NN' || seq || CASE WHEN read_id % 13 = 0 THEN 'X' ELSE 'n' END AS raw FROM reads)) GROUP BY 1")
def load_reads_stats(spark, d):
    raw = reads(spark, d).select(F.col("read_id").alias("name"), F.concat(F.lit("NN"), F.col("seq"), F.when(F.col("read_id") % 13 == 0, "X").otherwise("n")).alias("seq"))
    return R.load_stats(R.checked(raw, 1000, 5000))


@query(sql("reads") + " SELECT read_id AS name, row_number() OVER (ORDER BY read_id) AS read_id FROM reads")
def sequential_ids(spark, d):
    return R.numbered(reads(spark, d).select(F.col("read_id").alias("name"))).select("name", "read_id")


@query(sql("reads") + " SELECT read_id, read_id % 3 = 0 AND read_id % 4 <> 3 AS corrected, md5(CASE WHEN read_id % 3 = 0 AND read_id % 4 <> 3 THEN reverse(seq) ELSE seq END) AS digest FROM reads")
def load_corrected_reads(spark, d):
    r = reads(spark, d)
    new = r.where((F.col("read_id") % 3 == 0) & (F.col("read_id") % 4 != 3)).select("read_id", F.reverse("seq").alias("seq"))
    return R.load_corrected(r, new).select("read_id", "corrected", F.md5("seq").alias("digest"))


@query(sql("reads") + " SELECT round(sum(len) / 1e6, 9) AS coverage FROM reads")
def read_coverage(spark, d):
    return R.coverage(reads(spark, d), 1e6).select(F.round("coverage", 9).alias("coverage"))
