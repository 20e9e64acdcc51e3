"""Assembly queries: reads cut from the benchmark's sequences and put together again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.seq import reverse_complement
from ..plans import assembly as A
from ..tables import references
from . import register

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)
SETTINGS = A.preset({"pacbio"}, k=25, min_seeds=1, min_overlap=30, min_read_length=40, max_kmer_count=1000)


def tiles(spark, d):
    """Reads of 80 bases every 20, every third turned."""
    r = references(spark, d).where("len >= 100")
    i = F.explode(F.sequence(F.lit(0), F.floor((F.col("len") - 80) / 20).cast("int")))
    t = r.select("read_id", "seq", i.alias("i")).select((F.col("read_id") * 1000 + F.col("i")).alias("read_id"), F.expr("substring(seq, i * 20 + 1, 80)").alias("seq"))
    return t.withColumn("seq", F.when(F.col("read_id") % 3 == 0, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))).withColumn("len", F.length("seq").cast("bigint"))


@query()
def assembly_layout(spark, d):
    r = tiles(spark, d)
    return A.layout(r, A.find_overlaps(r, SETTINGS), SETTINGS)


@query()
def assembly_contigs(spark, d):
    r = tiles(spark, d)
    return A.contigs(r, A.layout(r, A.find_overlaps(r, SETTINGS), SETTINGS), SETTINGS)
