"""Shared plumbing: scratch tables, Arrow batch limits, skew-safe lookups, text loading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a Python worker holds a bounded piece of text.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def tune(spark: SparkSession) -> None:
    """Bounds what one Arrow batch hands to a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share.

    Only where that setting is empty in a bare local session is a temporary folder used; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/strandline-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a scan out evenly when it has fewer splits than the cluster has cores (one small file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    tune(df.sparkSession)
    return df.mapInArrow(fn, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: A key with at least this share of the rows counts as hot; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """Left join of ``rows`` with ``table`` (unique in ``key``; ``count`` says how many rows carry the key).

    Keys that hold at least HOT_SHARE of all counted rows are joined by a broadcast of at most
    1 / HOT_SHARE rows, all others by a shuffle on the key: no task gets a hot key's rows.
    ``count`` is dropped from the result; a null key finds nothing.
    """
    values = [c for c in table.columns if c not in (key, count)]
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = table.where(F.col(count) >= max(2.0, HOT_SHARE * total))
    cold = table.where(F.col(count) < max(2.0, HOT_SHARE * total)).drop(count)
    named = hot.select(key, F.struct(*values).alias("_hot"))
    out = rows.join(F.broadcast(named), key, "left")
    # rows whose key was found already get a null key spread over all partitions
    cold_key = F.when(F.col("_hot").isNull(), F.col(key))
    out = out.withColumn("_cold", cold_key).withColumn("_salt", F.when(F.col("_cold").isNull(), F.spark_partition_id()).otherwise(0))
    found = cold.select(F.col(key).alias("_cold"), F.lit(0).alias("_salt"), F.struct(*values).alias("_found"))
    out = out.join(found, ["_cold", "_salt"], "left")
    pick = F.coalesce("_hot", "_found")
    return out.select(*rows.columns, *[pick[v].alias(v) for v in values])


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and ASCII control white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def spread_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)
