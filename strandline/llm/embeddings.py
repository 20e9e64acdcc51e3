"""Embedding near-duplicates with randomised-rotation binary codes (after RaBitQ, Gao and Long 2024).

Unit vectors are rotated by seeded random orthogonal matrices; the signs are the code, and the inner product of the
code's unit vector with the rotated vector is stored as its correction factor. A code over its factor, rotated back,
is an unbiased estimate of the vector; the codes' rotations are dealt into two halves, whose errors are independent, so
the inner product of one vector's first estimate with another's second is an unbiased estimate of their cosine, with a
bound on its error. Pairs are sought in several tables whose keys are sets of code bits, so that a pair at the threshold
meets in at least one with probability ``RECALL``; a pair that meets in many counts in its first.

Only codes are shuffled to find pairs. Vectors travel to the buckets in which their upper bound with some other reaches
the threshold, and there the pairs whose bound does are computed exactly, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, map_arrow, spread, spread_by, staged
from .components import connected_components

#: Probability that a pair at the threshold shares a bucket; least code bits; width of the confidence bound
#: in standard errors; vectors of a bucket that a task compares (larger ones go by pairs of blocks).
RECALL, CODE_BITS, EPSILON, BUCKET_ROWS = 0.95, 256, 3.0, 2048
CODES = "key bigint, tab int, node bigint, code binary, f0 float, f1 float"


def plan_tables(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a key and number of tables for ``n`` distinct vectors: some 2 ** 8 vectors in a bucket."""
    p = 1 - math.acos(threshold) / math.pi
    bits = max(8, round(math.log2(max(n, 2))) - 8)
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - p**bits)))


@lru_cache(maxsize=8)
def rotations(d: int, bits: int, tables: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """A frame of whole rotations, at least CODE_BITS rows, and the rows that each table's key takes."""
    r = np.random.default_rng([seed, d])
    k = max(math.ceil(CODE_BITS / d), math.ceil(bits * tables / d), math.ceil(bits / d))
    frame = np.concatenate([np.linalg.qr(r.standard_normal((d, d)))[0] for _ in range(k)])
    order = np.concatenate([r.permutation(k * d) for _ in range(-(-bits * tables // (k * d)))])
    return frame, order[: bits * tables].reshape(tables, bits)


def halves(d: int) -> int:
    """Rotations of each of the two halves that estimates take: CODE_BITS bits together, and one whole rotation each at least."""
    return max(1, math.ceil(CODE_BITS / (2 * d)))


def coded(v: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of unit vectors, and the correction factors of the two halves."""
    x, d = v @ frame.T, v.shape[1]
    k = halves(d) * d
    return x > 0, np.stack([np.abs(x[:, h * k : (h + 1) * k]).sum(1) / (k / math.sqrt(d)) for h in (0, 1)], 1)


def estimates(bits: np.ndarray, factor: np.ndarray, frame: np.ndarray, d: int) -> list[np.ndarray]:
    """Both halves' unbiased estimates of the vectors of codes: a half's signs, rotated back and scaled by the factor."""
    k = halves(d) * d
    return [(np.where(bits[:, h * k : (h + 1) * k], np.float32(1), np.float32(-1)) @ frame[h * k : (h + 1) * k].astype(np.float32)) * (math.sqrt(d) / k / factor[:, h : h + 1]).astype(np.float32) for h in (0, 1)]


def upper_bounds(bits: np.ndarray, factor: np.ndarray, frame: np.ndarray, d: int) -> np.ndarray:
    """Upper confidence bounds of the cosines of all pairs of coded vectors."""
    one, two = estimates(bits, factor, frame, d)
    cosine = one @ two.T
    cosine = (cosine + cosine.T) / 2
    # an estimate's error lies in the d - 1 directions across its vector; rotations of a half are independent of each other
    spread = np.maximum(1 / np.mean(factor, 1) ** 2 - 1, 0) / halves(d) / max(d - 1, 1)
    error = np.sqrt((spread[:, None] + spread[None, :]) / 2 + spread[:, None] * spread[None, :] * max(d - 1, 1) / 2)
    return cosine + EPSILON * error


def _maybe(code: np.ndarray, factor: np.ndarray, frame: np.ndarray, d: int, threshold: float, own: np.ndarray, crossed: bool) -> np.ndarray:
    """Pairs of a bucket whose bound reaches the threshold; in a pair of blocks, those across them."""
    some = upper_bounds(code, factor, frame, d) >= threshold
    if crossed:
        some &= own[:, None] != own[None, :]
    np.fill_diagonal(some, False)
    return some


def _forest(link: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that span the components of a symmetric boolean matrix."""
    left, a, b = link.any(0), [], []
    while left.any():
        todo = [int(left.argmax())]
        left[todo[0]] = False
        while todo:
            i = todo.pop()
            new = np.flatnonzero(link[i] & left)
            left[new] = False
            a += [i] * len(new)
            b += new.tolist()
            todo += new.tolist()
    return a, b


def _bucket(rows: dict, bits: int, tables: int, threshold: float) -> tuple[np.ndarray, list[int], list[int]] | None:
    """Weighted link counts and spanning edges of one bucket's rows."""
    v = rows["v"]
    frame, keys = rotations(v.shape[1], bits, tables)
    code, factor = coded(v, frame)
    i, j = np.nonzero(np.triu(_maybe(code, factor.astype(np.float32), frame, v.shape[1], threshold, rows["own"], rows["crossed"]), 1))
    if not len(i):
        return None
    exact = np.concatenate([np.einsum("ij,ij->i", v[i[k : k + 65536]], v[j[k : k + 65536]]) for k in range(0, len(i), 65536)])
    i, j = i[exact >= threshold], j[exact >= threshold]
    power = 1 << np.arange(bits, dtype=np.int64)
    for t in range(rows["table"]):  # pairs that met in an earlier table count there
        key = code[:, keys[t]] @ power
        new = key[i] != key[j]
        i, j = i[new], j[new]
    if not len(i):
        return None
    links = np.bincount(i, rows["n"][j], len(v)) + np.bincount(j, rows["n"][i], len(v))
    matrix = np.zeros((len(v), len(v)), bool)
    matrix[i, j] = matrix[j, i] = True
    return links.astype(np.int64), *_forest(matrix)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def _unit(column: pa.Array) -> np.ndarray:
    v = _vectors(column).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # no overflow in squares
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _codes_of(bits: int, tables: int, keys_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct vector's code once for each table, or its keys alone."""
        power = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            dims = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            for d in map(int, np.unique(dims)):
                x = b.filter(pa.array(dims == d))
                for at in range(0, len(x), 1000):
                    part = x.slice(at, 1000)
                    frame, keys = rotations(d, bits, tables)
                    code, factor = coded(_unit(part.column(1)), frame)
                    codes = None if keys_only else pa.array([r.tobytes() for r in np.packbits(code, axis=1, bitorder="little")], pa.binary())
                    for t in range(tables):
                        key = pa.array((code[:, keys[t]] @ power) | np.int64(t << 40) | np.int64(d << 50))
                        if keys_only:
                            yield pa.RecordBatch.from_arrays([key], names=["key"])
                        else:
                            yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(part), t, np.int32)), part.column(0), codes, *(pa.array(factor[:, h].astype(np.float32)) for h in (0, 1))], names=["key", "tab", "node", "code", "f0", "f1"])

    return run


def _by_key(flush):
    """A function of whole keys' rows, as one of Arrow batches sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            if held[0].column(0)[0] == b.column(0)[len(b) - 1]:
                continue
            t = pa.Table.from_batches(held)
            end = int(np.searchsorted(t["key"].to_numpy(), b.column(0)[len(b) - 1].as_py()))
            yield flush(t.slice(0, end).combine_chunks())
            held = t.slice(end).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return run


def _buckets(t: pa.Table) -> Iterator[tuple[int, int]]:
    """Where the keys of two rows or more begin and end."""
    key = t["key"].to_numpy()
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    many = np.diff(cut) > 1
    yield from zip(cut[:-1][many].tolist(), cut[1:][many].tolist(), strict=True)


def _candidates(bits: int, tables: int, threshold: float):
    def flush(t: pa.Table) -> pa.RecordBatch:
        """Rows of ``t`` (without codes) whose bound with another of their bucket reaches the threshold."""
        found = [np.empty(0, np.int64)]
        own, crossed = t["own"].to_numpy(), t["crossed"].to_numpy()
        for lo, hi in _buckets(t):
            d = t["dims"][lo].as_py()
            frame, _ = rotations(d, bits, tables)
            code = np.unpackbits(np.frombuffer(b"".join(t["code"].slice(lo, hi - lo).to_pylist()), np.uint8).reshape(hi - lo, -1), axis=1, count=len(frame), bitorder="little").astype(bool)
            factor = np.stack([t[f].slice(lo, hi - lo).to_numpy() for f in ("f0", "f1")], 1)
            found.append(lo + np.flatnonzero(_maybe(code, factor, frame, d, threshold, own[lo:hi], bool(crossed[lo])).any(1)))
        return t.select(["key", "crossed", "own", "tab", "node"]).take(pa.array(np.concatenate(found))).combine_chunks().to_batches()[0] if sum(map(len, found)) else pa.RecordBatch.from_pylist([], t.select(["key", "crossed", "own", "tab", "node"]).schema)

    return _by_key(flush)


def _links_of(bits: int, tables: int, threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def flush(t: pa.Table) -> pa.RecordBatch:
        """(node, null, links) and spanning edges (node, other, 0) of each bucket."""
        node, n, own = t["node"].to_numpy(), t["n"].to_numpy(), t["own"].to_numpy()
        out: list[list] = [[], [], []]
        for lo, hi in _buckets(t):
            rows = {"v": _unit(t["v"].slice(lo, hi - lo).combine_chunks()), "n": n[lo:hi], "own": own[lo:hi], "crossed": t["crossed"][lo].as_py(), "table": t["tab"][lo].as_py()}
            if (found := _bucket(rows, bits, tables, threshold)) is not None:
                links, a, b = found
                some, at = np.flatnonzero(links), node[lo:hi]
                out[0] += [*at[some].tolist(), *at[a].tolist()]
                out[1] += [*[None] * len(some), *at[b].tolist()]
                out[2] += [*links[some].tolist(), *[0] * len(a)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    return _by_key(flush)


def _usable(v: str) -> object:
    """Neither null nor zero, all components finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(v).isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def similar_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Equal vectors are one class (told apart by a 64-bit hash), compared once and counted by their
    number; repeated rows each get a row. Vectors that are null, zero, or hold null or non-finite components, and rows without id,
    link with nothing; vectors of different length never link. A bucket of more than BUCKET_ROWS
    classes is compared in pairs of blocks on different tasks; counts and spanning edges leave a task,
    pairs do not.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    ok = _usable("v") & F.col("vec_id").isNotNull()
    rows = rows.withColumn("node", F.when(ok, F.xxhash64("v")))
    classes = staged(rows.where(ok).groupBy("node").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")), "classes")
    n = classes.count()
    bits, tables = plan_tables(n, threshold)
    rows_ = spread(classes.select("node", "v"))
    hot = map_arrow(rows_, _codes_of(bits, tables, keys_only=True), "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BUCKET_ROWS)
    hot = staged(hot.select(F.col("key").alias("large"), F.ceil(F.col("size") / (BUCKET_ROWS // 2)).alias("blocks")), "hot_buckets")
    dealt = map_arrow(rows_, _codes_of(bits, tables, keys_only=False), CODES)
    plain = F.lit(False).alias("crossed"), F.lit(0).alias("own"), F.shiftright("key", 50).cast("int").alias("dims")
    if hot.isEmpty():
        dealt = dealt.select("*", *plain)
    else:
        own = F.coalesce(F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")), F.lit(0)).cast("int")
        split = dealt.join(hot, F.col("key") == F.col("large"), "left").withColumn("own", own)
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)).cast("int"))))
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        dealt = split.select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(pair).alias("key"), "tab", "node", "code", "f0", "f1", (F.col("own") != F.col("other")).alias("crossed"), "own", plain[2])
    ready = spread_by(dealt, "key").sortWithinPartitions("key", "own", "node")
    some = staged(map_arrow(ready, _candidates(bits, tables, threshold), "key bigint, crossed boolean, own int, tab int, node bigint"), "candidates")
    ready = spread_by(some.join(classes.select("node", "n", "v"), "node"), "key").sortWithinPartitions("key", "own", "node")
    found = staged(map_arrow(ready.select("key", "crossed", "own", "tab", "node", "n", "v"), _links_of(bits, tables, threshold), "a bigint, b bigint, links bigint"), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = connected_components(found.where("b is not null").select("a", "b"))
    joined = classes.select("node", "first", "n").join(links, "node", "left").join(labels, "node", "left")
    joined = staged(joined.select("node", "first", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("label")), "labels")
    least = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    table = staged(joined.join(least, "label").select("node", F.col("n").alias("copies"), (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"), "components")
    out = lookup(rows.select("vec_id", "node"), table, "node", "copies")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
