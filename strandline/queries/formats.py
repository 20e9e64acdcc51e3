"""Format queries: written and parsed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import text as X
from ..tables import READ_LEN, layout, load, overlaps, references, sql
from . import register
from .overlaps import read_len, full, lengths

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)
OVL = sql("ovl")


@query(OVL + f" SELECT a_id, b_id, flipped, ahg5, ahg3, bhg5, bhg3, evalue, (ahg5 = 0 OR bhg5 = 0) AND (ahg3 = 0 OR bhg3 = 0) AS for_utg FROM ovl WHERE al >= 5000 AND bl >= 5000 AND evalue <= 2500")
def paf_roundtrip(spark, d):
    o = X.parse_paf(X.paf(full(spark, d)), 5000, 0.025)
    return o.select("a_id", "b_id", "flipped", "ahg5", "ahg3", "bhg5", "bhg3", "evalue", "for_utg")


@query(OVL + " SELECT a_id, b_id, flipped, ahg5, ahg3, bhg5, bhg3, evalue FROM ovl WHERE al >= 6000 OR bl >= 6000")
def mhap_convert(spark, d):
    c = F.col
    o = full(spark, d)
    lo, hi = F.when(c("flipped"), c("bhg3")).otherwise(c("bhg5")), F.when(c("flipped"), c("b_len") - c("bhg5")).otherwise(c("b_len") - c("bhg3"))
    line = F.concat_ws(" ", *[x.cast("string") for x in [c("a_id"), c("b_id"), c("evalue") / 100000, F.lit(10), F.lit(0), c("ahg5"), c("a_len") - c("ahg3"), c("a_len"), F.when(c("flipped"), 1).otherwise(0), lo, hi, c("b_len")]])
    return X.parse_mhap(o.select(line.alias("value")), 6000).select("a_id", "b_id", "flipped", "ahg5", "ahg3", "bhg5", "bhg3", "evalue")


_U = OVL + " SELECT a_id, b_id, flipped, ahg5, ahg3, bhg5, bhg3, evalue, span FROM ovl"


@query(_U)
def overlap_unaligned_roundtrip(spark, d):
    return X.parse_overlap_text(X.overlap_text(full(spark, d), "unaligned"), "unaligned")


@query(_U)
def overlap_coords_roundtrip(spark, d):
    return X.parse_overlap_text(X.overlap_text(full(spark, d), "coords"), "coords", lengths(spark, d))


@query(OVL + " SELECT a_id, b_id, flipped, greatest(ah, 0) AS ahg5, greatest(-bh, 0) AS ahg3, greatest(-ah, 0) AS bhg5, greatest(bh, 0) AS bhg3, evalue, span FROM ovl")
def overlap_hangs_roundtrip(spark, d):
    return X.parse_overlap_text(X.overlap_text(full(spark, d), "hangs"), "hangs")


@query("SELECT o_orderkey AS id, (o_custkey + 10)::BIGINT AS query_len, (o_custkey + o_orderkey % 7)::BIGINT AS ref_len, (o_custkey + 10 + o_orderkey % 7)::BIGINT AS align_len FROM orders")
def gfa_links(spark, d):
    o = load(spark, d, "orders")
    cigar = F.concat(F.col("o_custkey"), F.lit("M10I"), F.col("o_orderkey") % 7, F.lit("D"))
    line = F.concat_ws("\t", F.lit("L"), F.concat(F.lit("tig"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")), F.lit("+"), F.lit("tig2"), F.lit("-"), cigar)
    _, links = X.parse_gfa(o.select(line.alias("value")))
    return links.select(X.tig_number(F.col("a")).alias("id"), "query_len", "ref_len", "align_len")


@query("SELECT 'tig' || l_orderkey AS seq_name, l_partkey AS bgn, l_partkey + 5 AS \"end\", 's' || l_suppkey AS name, l_linenumber::DOUBLE AS score, l_linenumber % 2 = 0 AS reverse FROM lineitem")
def bed_roundtrip(spark, d):
    l = load(spark, d, "lineitem")
    rows = l.select(F.concat(F.lit("tig"), "l_orderkey").alias("seq_name"), F.col("l_partkey").alias("bgn"), (F.col("l_partkey") + 5).alias("end"), F.concat(F.lit("s"), "l_suppkey").alias("name"), F.col("l_linenumber").cast("double").alias("score"), (F.col("l_linenumber") % 2 == 0).alias("reverse"))
    return X.parse_bed(X.bed(rows))


@query(sql("lay") + " SELECT * FROM lay")
def layout_roundtrip(spark, d):
    return X.parse_read_to_tig(X.read_to_tig(layout(spark, d)))


@query(sql("refs") + " SELECT read_id::VARCHAR AS name, seq FROM refs")
def fasta_roundtrip(spark, d):
    return X.fasta_records(X.fasta(references(spark, d), width=60)).select("name", "seq")


@query(sql("refs") + " SELECT read_id::VARCHAR AS name, seq, length(seq)::BIGINT AS qualities FROM refs WHERE len > 0")
def fastq_roundtrip(spark, d):
    r = X.fastq_records(X.fastq(references(spark, d).where("len > 0"))).select("name", "seq", F.length("qual").cast("bigint").alias("qualities"))
    return r


_MIX = lambda k, m: f"((id * 31 + {k} * 7919 + 104729) % 2147483647 * 48271 % 2147483647 * 69621 % 2147483647) % {m}"


@query(f"WITH i AS (SELECT unnest(range((SELECT count(*) FROM orders))) AS id), r AS (SELECT {_MIX(1, 1000)} + 1 AS a_id, {_MIX(2, 1000)} + 1 AS b_id, {_MIX(3, 2)} = 1 AS flipped, {_MIX(4, READ_LEN // 2)} AS ahg5, 0::BIGINT AS ahg3, 0::BIGINT AS bhg5, {_MIX(5, READ_LEN // 2)} AS bhg3, {_MIX(6, 1000)} AS evalue FROM i) SELECT *, {READ_LEN} - greatest(ahg5, bhg3) AS span FROM r WHERE a_id <> b_id")
def random_overlaps(spark, d):
    n = load(spark, d, "orders").count()
    return X.random_overlaps(spark, n, 1000, READ_LEN)
