"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, staged


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge list of longs; component is the smallest node reached.

    Self-loops and repeated edges are harmless; nodes without edges do not occur in the result.
    Each round is written to the shared folder, so a lost executor costs one round at most, and
    nothing but a count and a checksum goes to the driver. Every step is a min-aggregation (combined
    before its shuffle) and an equi-join on the same key.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = staged(e, "edges")
    mark = _mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = staged(small, "round")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


#: Edges (of 16 bytes) up to which one task finishes what is left after partitions have been contracted.
SMALL_EDGES = 1 << 20


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the least node that each reaches: labels fall to the lesser end's, then jump."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[i], label[j]
        low = np.minimum(x, y)
        if (x == y).all():
            return nodes, nodes[label]
        for k in (x, y):
            np.minimum.at(label, k, low)
        while (label[label] != label).any():
            label = label[label]


def _contract(rows: int, *names: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, least node) of each ``rows`` edges of a partition: as many edges as nodes at most."""
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
            nodes, root = _roots(a, b)
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], names=list(names))

        for x in batches:
            held.append(x)
            size += len(x)
            if size >= rows:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def bounded_components(edges: DataFrame) -> DataFrame:
    """As ``connected_components``, in two steps where few edges are left.

    Partitions are contracted to spanning stars first. If no more than SMALL_EDGES edges are left, which is
    counted, one task has room for all and finishes; otherwise rounds over the cluster do.
    """
    stars = staged(map_arrow(edges.select("a", "b"), _contract(SMALL_EDGES, "a", "b"), "a bigint, b bigint").where("a <> b").distinct(), "stars")
    if stars.count() > SMALL_EDGES:
        return connected_components(stars)
    return staged(map_arrow(stars.coalesce(1), _contract(2 * SMALL_EDGES, "node", "component"), "node bigint, component bigint"), "components")
