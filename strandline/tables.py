"""Sequence tables derived from the star-schema and text tables, for the engine's queries.

Reads are documents projected to four letters; overlaps and intervals come from line items by integer
arithmetic. ``CTE`` has the same definitions for another SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Length of every read of the overlap table, its least number of reads, and rows of the line items for each further one.
READ_LEN, MIN_READS, ROWS_PER_READ = 10_000, 500, 120
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals out a scan of fewer splits than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bases(text) -> F.Column:
    return F.upper(F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, BASES))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, library, lang, seq, len)."""
    d = spread(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    r = d.select(F.col("doc_id").alias("read_id"), F.col("source").alias("library"), "lang", bases(F.col("text")).alias("seq"))
    return r.withColumn("len", F.length("seq").cast("bigint"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq, len) of the benchmark's texts."""
    r = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("read_id"), bases(F.col("text")).alias("seq"))
    return r.withColumn("len", F.length("seq").cast("bigint"))


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a_id, b_id, flipped, ahg5, ahg3, bhg5, bhg3, evalue, span): one for each pair and orientation.

    Reads grow with the line items; most overlaps are dovetails, few are containments, some are partial.
    """
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    n = max(MIN_READS, l.count() // ROWS_PER_READ)  # of the files' footers
    m = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 1000
    kind, x = F.when(m < 420, 0).when(m < 840, 1).when(m < 842, 2).when(m < 844, 3).otherwise(4), 1 + (F.col("l_orderkey") * 7 + F.col("l_partkey") * 13) % 6000
    y = 1 + (F.col("l_partkey") * 5 + F.col("l_suppkey") * 11) % 2500
    zero = F.lit(0).cast("bigint")
    o = l.select(
        (F.col("l_orderkey") % n + 1).alias("a_id"),
        (F.col("l_partkey") % n + 1).alias("b_id"),
        (F.col("l_suppkey") % 2 == 1).alias("flipped"),
        F.when(kind == 0, x).when(kind.isin(3, 4), y).otherwise(zero).alias("ahg5"),
        F.when(kind == 1, x).when(kind == 3, y * 3 % 2000).otherwise(zero).alias("ahg3"),
        F.when(kind == 1, x).when(kind == 2, y).when(kind == 4, x % 500 + 1).otherwise(zero).alias("bhg5"),
        F.when(kind == 0, x).when(kind == 2, y * 3 % 2000).otherwise(zero).alias("bhg3"),
        (F.col("l_quantity").cast("bigint") * 60 + F.col("l_linenumber") * 7).alias("evalue"),
    ).where("a_id <> b_id")
    first = W.partitionBy("a_id", "b_id", "flipped").orderBy("evalue", "ahg5", "ahg3", "bhg5", "bhg3")
    o = o.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    return o.withColumn("span", READ_LEN - F.greatest(F.col("ahg5") + F.col("ahg3"), F.col("bhg5") + F.col("bhg3")))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, lo, hi)."""
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    lo = (F.col("l_orderkey") * 17 + F.col("l_partkey") * 3) % 20000
    return l.select(F.col("l_suppkey").alias("key"), lo.alias("lo"), (lo + 1 + F.col("l_quantity").cast("bigint") % 7 * (1 + F.col("l_linenumber"))).alias("hi"))


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tig_id, read_id, lo, hi, reverse): reads of 10 to 60 lengths placed on tigs."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lo = (F.col("o_orderkey") * 31 + F.col("o_custkey") * 7) % 30000
    return o.select((F.col("o_custkey") % 40 + 1).alias("tig_id"), F.col("o_orderkey").alias("read_id"), lo.alias("lo"), (lo + 100 + F.col("o_orderkey") % 500).alias("hi"), (F.col("o_orderkey") % 3 == 0).alias("reverse"))


_SEQ = f"upper(translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}'))"
CTE = {
    "reads": f"reads AS (SELECT *, length(seq)::BIGINT AS len FROM (SELECT doc_id AS read_id, source AS library, lang, {_SEQ} AS seq FROM documents))",
    "refs": f"refs AS (SELECT *, length(seq)::BIGINT AS len FROM (SELECT item_id AS read_id, {_SEQ} AS seq FROM benchmark))",
    "ovl": f"""nr AS (SELECT greatest({MIN_READS}, count(*) // {ROWS_PER_READ}) AS n FROM lineitem), lm AS (SELECT *, (l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7 + l_linenumber) % 1000 AS m FROM lineitem),
      l0 AS (SELECT l_orderkey % n + 1 AS a_id, l_partkey % n + 1 AS b_id, l_suppkey % 2 = 1 AS flipped, CASE WHEN m < 420 THEN 0 WHEN m < 840 THEN 1 WHEN m < 842 THEN 2 WHEN m < 844 THEN 3 ELSE 4 END AS kind,
        1 + (l_orderkey * 7 + l_partkey * 13) % 6000 AS x, 1 + (l_partkey * 5 + l_suppkey * 11) % 2500 AS y, l_quantity::BIGINT * 60 + l_linenumber * 7 AS evalue FROM lm, nr),
      l1 AS (SELECT a_id, b_id, flipped, CASE WHEN kind = 0 THEN x WHEN kind IN (3, 4) THEN y ELSE 0 END AS ahg5, CASE WHEN kind = 1 THEN x WHEN kind = 3 THEN y * 3 % 2000 ELSE 0 END AS ahg3,
        CASE WHEN kind = 1 THEN x WHEN kind = 2 THEN y WHEN kind = 4 THEN x % 500 + 1 ELSE 0 END AS bhg5, CASE WHEN kind = 0 THEN x WHEN kind = 2 THEN y * 3 % 2000 ELSE 0 END AS bhg3, evalue FROM l0 WHERE a_id <> b_id),
      ovl AS (SELECT a_id, b_id, flipped, ahg5, ahg3, bhg5, bhg3, evalue, {READ_LEN} - greatest(ahg5 + ahg3, bhg5 + bhg3) AS span, ahg5 - bhg5 AS ah, bhg3 - ahg3 AS bh, {READ_LEN} - ahg5 - ahg3 AS al, {READ_LEN} - bhg5 - bhg3 AS bl
        FROM (SELECT *, row_number() OVER (PARTITION BY a_id, b_id, flipped ORDER BY evalue, ahg5, ahg3, bhg5, bhg3) AS rn FROM l1) WHERE rn = 1)""",
    "iv": "iv AS (SELECT l_suppkey AS key, (l_orderkey * 17 + l_partkey * 3) % 20000 AS lo, (l_orderkey * 17 + l_partkey * 3) % 20000 + 1 + l_quantity::BIGINT % 7 * (1 + l_linenumber) AS hi FROM lineitem)",
    "lay": "lay AS (SELECT o_custkey % 40 + 1 AS tig_id, o_orderkey AS read_id, (o_orderkey * 31 + o_custkey * 7) % 30000 AS lo, (o_orderkey * 31 + o_custkey * 7) % 30000 + 100 + o_orderkey % 500 AS hi, o_orderkey % 3 = 0 AS reverse FROM orders)",
}


def sql(*tables: str) -> str:
    """The start of a query that has these tables."""
    return "WITH " + ",\n".join(CTE[t] for t in tables)
