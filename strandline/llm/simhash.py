"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to their bit counts, kept in
unary (00, 01, 11), so that the Manhattan distance of two embeddings is the number of bits in which
they differ. It never exceeds the Hamming distance of the fingerprints. The embedding is laid on
grids: with its coordinates in g groups, two points at distance of ``distance`` or less agree in at
least g - distance groups, so they share a cell of at least one of C(g, distance) grids. Pairs of a
cell are tested by the Manhattan lower bound and then exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, lookup, map_arrow, spread, spread_by, staged
from .components import SMALL_EDGES, _roots, connected_components

#: Points of one cell that a task compares; larger cells are dealt out as pairs of blocks.
CELL_ROWS = 4096
HASHES = 1 << 17
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
EVEN = np.uint64(0x5555555555555555)


def shingle_hashes(text: bytes | None, words: int = 4, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``words`` words, repeats included; a shorter text is one run, one without words has none."""
    w = text.translate(LOWER).split() if text else []
    if not w:
        return []
    line, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return [digest(line, seed)]
    length = np.fromiter(map(len, w), np.int64, len(w)) + 1
    start = np.concatenate([[0], np.cumsum(length)])
    return [digest(line[a:b], seed) for a, b in zip(start[: len(w) - words + 1].tolist(), (start[words:] - 1).tolist(), strict=True)]


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, bit 0 first."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), HASHES):
        piece = np.ascontiguousarray(h[i : i + HASHES]).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """Bit set if set in over half of the hashes; 0 without words."""
    h = np.array(shingle_hashes(text, words, seed), np.uint64)
    bits = 2 * _bit_counts(h) > len(h)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def embed(x: np.ndarray) -> np.ndarray:
    """Bit counts of two-bit segments in unary."""
    some = (x | (x >> np.uint64(1))) & EVEN
    both = (x & (x >> np.uint64(1)) & EVEN) << np.uint64(1)
    return some | both


def _groups(g: int) -> list[int]:
    """Bit masks of g groups of whole segments."""
    cut = [round(i * 32 / g) for i in range(g + 1)]
    return [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cut, cut[1:])]


def grids(g: int, distance: int) -> list[int]:
    """Mask of the coordinates of each grid."""
    return [sum(m) for m in combinations(_groups(g), g - distance)]


def choose_groups(n: int, distance: int) -> int:
    """The number of groups with the least work: rows dealt out, and pairs that meet by chance (3/8 a segment)."""
    def work(g: int) -> float:
        c = math.comb(g, distance)
        return c * n + 0.01 * c * n * n / 2 * 0.375 ** (32 * (g - distance) / g)
    return min(range(distance + 2, distance + 9), key=work)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fp: np.ndarray, uv: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that connect what links in one cell: each point but the first of a component has one."""
    left, a, b = np.arange(1, len(fp)), [], []
    todo = [0]
    while True:
        if not todo:
            if not len(left):
                return a, b
            todo, left = [int(left[0])], left[1:]
        i = todo.pop()
        near = np.bitwise_count(uv[left] ^ uv[i]) <= distance
        if near.any():
            near[near] = np.bitwise_count(fp[left[near]] ^ fp[i]) <= distance
            new = left[near]
            if len(new):
                a.append(np.full(len(new), fp[i]))
                b.append(fp[new])
                left = left[~near]
                todo.extend(new.tolist())


def _cell_edges(fp: np.ndarray, key: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Linking edges of points sorted by cell."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(cut)
    uv, a, b = embed(fp), [], []
    of = np.repeat(size, size)
    for d in range(1, 9):  # cells of up to eight points at once, by lag
        i = np.flatnonzero((of[:-d] <= 8) & (key[:-d] == key[d:])) if len(key) > d else np.empty(0, np.int64)
        i = i[np.bitwise_count(uv[i] ^ uv[i + d]) <= distance]
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
        a.append(fp[i])
        b.append(fp[i + d])
    for k in np.flatnonzero(size > 8):
        x, y = _forest(fp[cut[k] : cut[k + 1]], uv[cut[k] : cut[k + 1]], distance)
        a += x
        b += y
    return np.concatenate(a), np.concatenate(b)


def _edges(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; the last cell of a batch waits for the next."""
        held: list[pa.RecordBatch] = []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def flush(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _cell_edges(fp, key, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for x in batches:
            key = np.concatenate([key, x.column(0).to_numpy()])
            fp = np.concatenate([fp, x.column(1).to_numpy().view(np.uint64)])
            end = int(np.searchsorted(key, key[-1])) if len(key) and key[0] != key[-1] else 0
            if end:
                yield flush(key[:end], fp[:end])
                key, fp = key[end:], fp[end:]
        if len(key):
            yield flush(key, fp)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, text_key, fp) with the fingerprint as a signed long; null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in as_bytes(b.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "text_key", "fp"])

    return map_arrow(_keyed(docs, id_col, text_col), run, "doc_id bigint, text_key bigint, fp bigint")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, text): rows are told apart by their id and a hash of their text."""
    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")))


def _first():
    """The row that a group keeps: the smallest id (null ids last), then the smallest hash of the text."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")


def fingerprint_edges(fps: DataFrame, n: int, distance: int = 4) -> DataFrame:
    """(a, b): links of distinct fingerprints that connect the same components as all links do."""
    masks = F.array(*[F.lit(_signed(m)) for m in grids(choose_groups(n, distance), distance)])
    some = F.col("fp").bitwiseOR(F.shiftrightunsigned("fp", 1)).bitwiseAND(F.lit(_signed(int(EVEN))))
    both = F.shiftleft(F.col("fp").bitwiseAND(F.shiftrightunsigned("fp", 1)).bitwiseAND(F.lit(_signed(int(EVEN)))), 1)
    cells = fps.select("fp", F.posexplode(masks).alias("grid", "mask"), some.bitwiseOR(both).alias("uv"))
    cells = cells.select(F.xxhash64("grid", F.col("uv").bitwiseAND(F.col("mask"))).alias("cell"), "fp")
    # cells too large for a task: their points take part in pairs of blocks
    hot = staged(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_ROWS).select("cell", F.ceil(F.col("n") / (CELL_ROWS // 2)).alias("blocks")), "hot_cells")
    if hot.isEmpty():
        dealt = cells
    else:
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks"))
        dealt = cells.join(hot, "cell", "left").withColumn("own", F.coalesce(own, F.lit(0)))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)).cast("int"))))
        pair = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
        dealt = dealt.select(F.when(F.col("blocks").isNull(), F.col("cell")).otherwise(pair).alias("cell"), "fp")
    ready = spread_by(dealt, "cell").sortWithinPartitions("cell")
    return map_arrow(ready, _edges(distance), "a bigint, b bigint")


def _fingerprint_groups(docs: DataFrame, distance: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, fp) of every row, and (fp, first, n, label) of every fingerprint; a label is a component."""
    fp = staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    reps = staged(fp.groupBy("fp").agg(_first(), F.count(F.lit(1)).alias("n")), "reps")
    edges = staged(fingerprint_edges(reps.select("fp"), reps.count(), distance), "edges")
    labels = connected_components(edges)
    joined = reps.join(labels, reps["fp"] == labels["node"], "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("label"))
    return fp, staged(joined, "labels")


def near_duplicates(docs: DataFrame, distance: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) for every row of ``docs``.

    Equal fingerprints are collapsed before pairs are sought; cells larger than CELL_ROWS are compared
    in pairs of blocks, and a cell yields edges of a spanning forest, never all its pairs. Null and
    empty texts share fingerprint 0 and link like any other; repeated rows stay, each with its
    component; a null id cannot be the smallest of a component, and a component of null ids has a null
    id. ``kept`` marks the row with doc_id = component_id (repeated rows of that id are all marked).
    """
    fp, joined = _fingerprint_groups(docs, distance, words, id_col, text_col)
    least = joined.groupBy("label").agg(F.min("first.doc_id").alias("component_id"))
    table = staged(joined.join(least, "label").select("fp", "n", "component_id"), "components")
    out = lookup(fp.select("doc_id", "fp"), table, "fp", "n")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", similarity: float | None = None, text_col: str = "text", **options) -> DataFrame:
    """One row of each group stays, the one with the smallest id; all columns as they were.

    Groups are those of ``near_duplicates``, or of ``similar_documents`` if a ``similarity`` is given. Null ids come
    last. Rows are told apart by id and text, so rows that share an id (or have none) but belong to different
    groups all stay; only rows that repeat with the same id and text are reduced to one.
    """
    if similarity is None:
        rows, joined = _fingerprint_groups(docs, id_col=id_col, text_col=text_col, **options)
    else:
        rows, joined = _similar_groups(docs, similarity, id_col=id_col, text_col=text_col, **options)
    keep = joined.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_d"), F.col("first.text_key").alias("_k"))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("_k"))
    found = docs.join(keep, same, "left_semi")
    # only repeated rows need a second look
    many = staged(rows.groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_d", "_k"), "repeated")
    if many.isEmpty():
        return found
    twice = found.join(many, same, "left_semi")
    once = found.join(many, same, "left_anti")
    by = [F.col(f"`{id_col}`").cast("long").alias("_d"), F.xxhash64(F.col(f"`{text_col}`")).alias("_k")]
    return once.unionByName(twice.groupBy(*by).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_r")).select("_r.*"))


# Similarity mode: wide fingerprints and sampled grids propose, exact similarities of shingle sets decide.

#: Words of a wide fingerprint, recall of the grids and standard deviations of the bit limit at the threshold (0.997
#: of such pairs, so that 0.99 and more are verified), chance points of a cell, largest cell compared by lag.
PARTS, RECALL, SIGMAS, CELL_POINTS, LAGS = 4, 0.994, 2.75, 60, 256
#: One node in so many is counted to find cells too large for a task: a cell of CELL_ROWS has 64 of them on average, and is
#: split from 16 on. What is split and what is not makes no difference to the result.
SAMPLED = 64
#: Shingle sets of one group that a task compares; larger groups are dealt out as pairs of blocks.
GROUP_ROWS = 1024
_PART_SEEDS = [xxhash.xxh64_intdigest(b"part", k) | 1 for k in range(PARTS)]


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """The distinct shingle hashes, in order."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def wide_fingerprint(h: np.ndarray) -> list[int]:
    """PARTS words of 64 bits: the majority of as many independent remixes of each hash of a shingle set."""
    out = []
    for seed in _PART_SEEDS:
        x = h * np.uint64(seed)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        bits = 2 * _bit_counts(x ^ (x >> np.uint64(32))) > len(h)
        out.append(int(np.packbits(bits, bitorder="little").view(np.uint64)[0]))
    return out


def flip_rate(similarity: float) -> float:
    """Chance that a bit differs for two shingle sets of equal size at a Jaccard similarity: the angle of their vectors over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def distance_limit(similarity: float) -> int:
    """Differing bits up to which the sets of two documents are compared: the expectation at the threshold plus SIGMAS standard deviations."""
    p, n = flip_rate(similarity), 64 * PARTS
    return round(n * p + SIGMAS * math.sqrt(n * p * (1 - p)))


def sampled_grids(n: int, similarity: float, seed: int = 5) -> list[list[int]]:
    """Masks of the segments that each grid's cells agree in: enough segments for CELL_POINTS chance points in a cell,
    and enough grids for RECALL at the threshold, over the binomial distribution of the segments that agree."""
    p, n_seg = flip_rate(similarity), 32 * PARTS
    same = (1 - p) ** 2 + p * p / 2
    k = max(4, min(32 * PARTS, round(math.log(max(n, 2) / CELL_POINTS) / math.log(8 / 3))))
    odds = [math.comb(n_seg, a) * same**a * (1 - same) ** (n_seg - a) for a in range(n_seg + 1)]
    meet = [math.comb(a, k) / math.comb(n_seg, k) for a in range(n_seg + 1)]
    count = 1
    while sum(o * (1 - m) ** count for o, m in zip(odds, meet, strict=True)) > 1 - RECALL:
        count += max(1, count // 50)
    r = np.random.default_rng([seed, k])
    out = []
    for _ in range(count):
        some = r.choice(32 * PARTS, k, replace=False)
        out.append([sum(3 << (2 * int(s % 32)) for s in some if s // 32 == w) for w in range(PARTS)])
    return out


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def _wide_edges(limit: int):
    def cell_edges(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> np.ndarray:
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(cut)
        of = np.repeat(size, size)
        uv = embed(fp)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        small = size[size <= LAGS].max(initial=1)
        for d in range(1, min(small, len(key))):  # small cells at once, by lag
            i = np.flatnonzero((of[:-d] <= LAGS) & (key[:-d] == key[d:]))
            i = i[_far(uv[i, :1], uv[i + d, :1]) <= limit]  # the Manhattan bound of one word, then of all, then exactly
            i = i[_far(uv[i], uv[i + d]) <= limit]
            i = i[_far(fp[i], fp[i + d]) <= limit]
            a.append(node[i])
            b.append(node[i + d])
        for k in np.flatnonzero(size > LAGS):  # spanning edges of large ones
            x, u, y, left, todo = fp[cut[k] : cut[k + 1]], uv[cut[k] : cut[k + 1]], node[cut[k] : cut[k + 1]], np.arange(1, size[k]), [0]
            while len(left):
                if not todo:
                    todo, left = [int(left[0])], left[1:]
                    continue
                i = todo.pop()
                near = _far(u[left], u[i]) <= limit
                near[near] = _far(x[left[near]], x[i]) <= limit
                a.append(np.full(int(near.sum()), y[i]))
                b.append(y[left[near]])
                todo += left[near].tolist()
                left = left[~near]
        return np.stack([np.concatenate(a), np.concatenate(b)], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; a partition's edges are contracted to stars, of which there are no more than its nodes."""
        key, node, fp = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, PARTS), np.uint64)
        held, size = [np.empty((0, 2), np.int64)], 0
        for x in _and_none(batches):
            if x is not None:
                key = np.concatenate([key, x.column(0).to_numpy()])
                node = np.concatenate([node, x.column(1).to_numpy()])
                fp = np.concatenate([fp, np.stack([x.column(2 + k).to_numpy().view(np.uint64) for k in range(PARTS)], 1)])
            end = len(key) if x is None else int(np.searchsorted(key, key[-1])) if len(key) else 0
            if end:
                held.append(cell_edges(key[:end], node[:end], fp[:end]))
                size += len(held[-1])
                key, node, fp = key[end:], node[end:], fp[end:]
            if size > SMALL_EDGES or x is None and size:
                e = np.concatenate(held)
                nodes, root = _roots(e[:, 0], e[:, 1])
                held, size = [np.stack([nodes, root], 1)], len(nodes)
                if x is None or size > SMALL_EDGES:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], names=["a", "b"])
                    held, size = [], 0

    return run


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and None behind the last."""
    yield from batches
    yield None


def _verified(similarity: float, limit: int):
    def flush(t: pa.Table) -> pa.RecordBatch:
        """Spanning edges of each key's sets that have the similarity; bit distance and sizes rule out most others."""
        key, node = t["key"].to_numpy(), t["node"].to_numpy()
        fp = np.stack([t[f"f{k}"].to_numpy().view(np.uint64) for k in range(PARTS)], 1)
        sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
        m = np.array([len(x) for x in sets], np.int64)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        for lo, hi in zip(cut, cut[1:]):
            left, todo = np.arange(lo + 1, hi), [int(lo)]
            while len(left):
                if not todo:
                    todo, left = [int(left[0])], left[1:]
                    continue
                i = todo.pop()
                maybe = (_far(fp[left], fp[i]) <= limit) & (np.minimum(m[left], m[i]) >= similarity * np.maximum(m[left], m[i])) & (m[left] > 0)
                both = np.zeros(len(left), np.int64)
                at = np.flatnonzero(maybe)
                for k in range(0, len(at), 64):
                    part = left[at[k : k + 64]]
                    same = np.isin(np.concatenate([sets[x] for x in part]), sets[i])
                    both[at[k : k + 64]] = np.add.reduceat(same, np.cumsum(m[part]) - m[part], dtype=np.int64)
                near = maybe & (both >= similarity * (m[left] + m[i] - both))
                a.append(np.full(int(near.sum()), node[i]))
                b.append(node[left[near]])
                todo += left[near].tolist()
                left = left[~near]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the last key of a batch waits for the next."""
        held: list[pa.RecordBatch] = []
        for x in batches:
            if not len(x):
                continue
            held.append(x)
            if held[0].column(0)[0] == x.column(0)[len(x) - 1]:
                continue
            t = pa.Table.from_batches(held)
            end = int(np.searchsorted(t["key"].to_numpy(), x.column(0)[len(x) - 1].as_py()))
            yield flush(t.slice(0, end))
            held = t.slice(end).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def _verified_edges(docs: DataFrame, groups: DataFrame, similarity: float, words: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): nodes of a loose group (``key``) with the similarity; they span the components of all such pairs within the bit limit.

    Each node's set is made from one text that has it, and is moved once, or once a block in groups too large for a task.
    """
    names = [f"f{k}" for k in range(PARTS)]
    size = groups.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > GROUP_ROWS)
    size = staged(size.select(F.col("key").alias("_large"), F.ceil(F.col("size") / (GROUP_ROWS // 2)).alias("blocks")), "large_groups")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_d"), F.xxhash64(F.col(f"`{text_col}`")).alias("_k"), F.col(f"`{text_col}`").alias("text"))
    found = rows.join(groups, F.col("_d").eqNullSafe(F.col("first.doc_id")) & (F.col("_k") == F.col("first.text_key"))).select("key", "node", *names, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, words).tobytes() for t in as_bytes(b.column(2 + PARTS))]
            yield pa.RecordBatch.from_arrays([*b.columns[: 2 + PARTS], pa.array(sets, pa.binary())], names=["key", "node", *names, "shingles"])

    sets = map_arrow(found, run, "key bigint, node bigint, " + ", ".join(f"{c} bigint" for c in names) + ", shingles binary")
    if not size.isEmpty():
        sets = sets.join(F.broadcast(size), F.col("key") == F.col("_large"), "left")
        own = F.coalesce(F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")), F.lit(0))
        sets = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        sets = sets.select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(pair).alias("key"), "node", *names, "shingles")
    ready = spread_by(sets, "key").sortWithinPartitions("key")
    return map_arrow(ready, _verified(similarity, limit=distance_limit(similarity)), "a bigint, b bigint")


def _similar_groups(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, node) of every row, and (node, first, n, label) of every node; a label is a component.

    A node is a shingle set. Fingerprints within the bit limit in any grid's cell join nodes to loose groups, and
    within those the sets are compared exactly.
    """
    names = [f"f{k}" for k in range(PARTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, words) for t in as_bytes(b.column(2))]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64)
            fp = np.array([wide_fingerprint(h) for h in sets], np.uint64).reshape(-1, PARTS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node.view(np.int64)), *[pa.array(np.ascontiguousarray(fp[:, k]).view(np.int64)) for k in range(PARTS)]], names=["doc_id", "text_key", "node", *names])

    fp = map_arrow(_keyed(docs, id_col, text_col), run, "doc_id bigint, text_key bigint, node bigint, " + ", ".join(f"{c} bigint" for c in names))
    fp = staged(fp, "fingerprints")
    reps = staged(fp.groupBy("node", *names).agg(_first(), F.count(F.lit(1)).alias("n")), "reps")
    grids_ = F.array(*[F.array(*[F.lit(_signed(m)) for m in g]) for g in sampled_grids(reps.count(), similarity)])
    even = F.lit(_signed(int(EVEN)))

    def unary(c: str):
        some = F.col(c).bitwiseOR(F.shiftrightunsigned(c, 1)).bitwiseAND(even)
        return some.bitwiseOR(F.shiftleft(F.col(c).bitwiseAND(F.shiftrightunsigned(c, 1)).bitwiseAND(even), 1))

    cells = reps.select("node", *names, *[unary(c).alias(f"u{k}") for k, c in enumerate(names)], F.posexplode(grids_).alias("grid", "mask"))
    cells = cells.select(F.xxhash64("grid", *[F.col(f"u{k}").bitwiseAND(F.col("mask")[k]) for k in range(PARTS)]).alias("cell"), "node", *names)
    # cells too large for a task, by the share of nodes that tells them apart for sure, take part in pairs of blocks
    some = cells.where(F.pmod(F.xxhash64("node", F.lit(11)), F.lit(SAMPLED)) == 0)
    hot = some.groupBy("cell").agg((F.count(F.lit(1)) * SAMPLED).alias("size")).where(F.col("size") > CELL_ROWS // 4)
    hot = staged(hot.select(F.col("cell").alias("_large"), F.ceil(F.col("size") / (CELL_ROWS // 2)).alias("blocks")), "hot_cells")
    if not hot.isEmpty():
        own = F.coalesce(F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")), F.lit(0))
        split = cells.join(hot, F.col("cell") == F.col("_large"), "left").withColumn("own", own)
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
        pair = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
        cells = split.select(F.when(F.col("blocks") > 1, pair).otherwise(F.col("cell")).alias("cell"), "node", *names)
    ready = spread_by(cells, "cell").sortWithinPartitions("cell")
    limit = distance_limit(similarity)
    loose = connected_components(staged(map_arrow(ready, _wide_edges(limit), "a bigint, b bigint").distinct(), "edges"))
    groups = staged(reps.join(loose, "node").select("node", "first", *names, F.col("component").alias("key")), "groups")
    edges = staged(_verified_edges(docs, groups, similarity, words, id_col, text_col), "verified")
    labels = connected_components(edges)
    joined = reps.select("node", "first", "n").join(labels, "node", "left").select("node", "first", "n", F.coalesce("component", "node").alias("label"))
    return fp.select("doc_id", "text_key", "node"), staged(joined, "labels")


def similar_documents(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id, kept) of every row: links at a Jaccard similarity of ``similarity`` or more of the sets of shingles.

    At such a threshold fingerprints of 64 bits differ in ten bits and more, so they have PARTS * 64 bits
    here, and grids are sampled: a pair at the threshold shares a cell with probability RECALL, closer ones
    more surely. What is found that way links only if the sets have the similarity. The number of grids grows as about the third root of the number of documents. Nulls, empty
    texts, repeated rows and empty tables are treated as in ``near_duplicates``.
    """
    rows, joined = _similar_groups(docs, similarity, words, id_col, text_col)
    least = joined.groupBy("label").agg(F.min("first.doc_id").alias("component_id"))
    table = staged(joined.join(least, "label").select("node", "n", "component_id"), "components")
    out = lookup(rows.select("doc_id", "node"), table, "node", "n")
    return out.select("doc_id", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
