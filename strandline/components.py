"""Staging and connected components for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def staged(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder named in spark.checkpoint.dir and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:  # a bare local session
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/strandline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``rank`` from 0 in an order without ties: range partitions are sorted by themselves and offset by the rows
    of those before, so no task sees more than one of them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    own = staged(own.withColumn("_part", F.shiftright("_at", 33)).withColumn("_i", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at"))
    rows = own.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    return own.join(rows.select("_part", before.alias("_before")), "_part").withColumn("rank", F.col("_before") + F.col("_i")).drop("_part", "_i", "_before")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of an edge list (a, b) of longs: labels fall to the least in reach, then to their label's label.

    Jumping halves what is left of a path in each round, so long chains take a logarithm of rounds.
    """
    both = staged(edges.where("a <> b").select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("m"))
        low = labels.join(near, labels["node"] == near["n"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        low = staged(low)
        jump = low.select(F.col("node").alias("l"), F.col("label").alias("up"))
        new = staged(low.join(jump, low["label"] == jump["l"]).select("node", "old", F.least("label", "up").alias("label")))
        if new.where("old <> label").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
