"""Incremental k-mer counts of a stream of reads: each micro-batch is counted and kept as a table of its own.

Counts add up, so a batch that is replayed overwrites its own table and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import kmers as K


def count_stream(reads: DataFrame, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Counts the canonical k-mers of streamed reads (read_id, seq) below ``path``, one folder for each batch."""

    def keep(batch: DataFrame, epoch: int) -> None:
        K.count(batch, k).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return reads.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(spark: SparkSession, path: str) -> DataFrame:
    """The sum over all batches."""
    return K.union_sum(spark.read.parquet(path).select("kmer", "count"))
