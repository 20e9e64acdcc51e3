"""Substring dedup: paragraphs cut by content, MinHash banding, exact Jaccard, components.

Passages sit anywhere in a text, so paragraphs are cut where content says so: by winnowing, the least
5-word shingle hash of any SPAN consecutive ones starts a paragraph of WORDS words. Two texts that share
SPAN + WORDS - 1 words in a row share at least one paragraph, wherever it lies in them. Equal paragraphs
are one class from the start; classes are banded by MinHash, those that meet in a band are verified by
the exact Jaccard similarity of their shingle sets, and components of verified links are one passage
class. A class in two documents or more is removed from all but the one with the smallest id.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, lookup, map_arrow, spread, spread_by, staged
from .components import bounded_components
from .decontaminate import TABLE, WORD

#: Words of a shingle, of a paragraph, and shingles of which one starts a paragraph (49 words in a row are found for sure).
SHINGLE, WORDS, SPAN = 5, 24, 26
#: Bands and MinHash values of a band: a pair of paragraphs at Jaccard 0.8 meets with probability 1 - (1 - 0.8 ** 2) ** 5 = 0.99,
#: one at the least similarity that two paragraphs can have from there on, 18 of 22 shingles, more surely.
BANDS, VALUES, SIMILAR = 5, 2, 0.8
#: Paragraphs of a band key that a task compares at once, and bytes of text that are cut at once.
BUCKET_ROWS, BLOCK = 1024, 1 << 18
#: One distinct paragraph in so many tells which band keys are hot: those with HOT_ROWS or more of them by its count are
#: dealt out over several tasks. What is dealt out and what is not makes no difference to the result.
SAMPLED, HOT_ROWS = 64, 4096
SET = WORDS - SHINGLE + 1
U = np.uint64
_POWERS = np.array([xxhash.xxh64_intdigest(b"power", k) | 1 for k in range(WORDS)], U)
_SEEDS = np.array([xxhash.xxh64_intdigest(b"seed", k) for k in range(BANDS * VALUES)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on all (two multiply-xorshift rounds)."""
    x = (x ^ (x >> U(32))) * U(0x9FB21C651E98DF25)
    x = (x ^ (x >> U(29))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@functools.cache
def _bases(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    odd = xxhash.xxh64_intdigest(b"base") | 1
    up, down = np.full(n, odd, U), np.full(n, pow(odd, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of a normalised line's words: mixed polynomials of their bytes, from prefix sums over BLOCK bytes at a time."""
    out, first, lo = [np.empty(0, U)], [np.empty(0, np.int64)], 0
    while lo < len(line):
        hi = lo + BLOCK
        if hi < len(line):  # between words
            cut = line.rfind(b" ", lo, hi)
            cut = cut if cut > lo else line.find(b" ", hi)
            hi = cut if cut > 0 else len(line)
        b = np.frombuffer(line[lo:hi], np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], b != 32, [False]]).view(np.int8)))
        bgn, end = edge[::2], edge[1::2]
        up, down = _bases(BLOCK if len(b) <= BLOCK else 1 << len(b).bit_length())
        sums = np.zeros(len(b) + 1, U)
        np.cumsum(b * up[: len(b)], out=sums[1:])
        out.append(mix((sums[end] - sums[bgn]) * down[bgn] + (end - bgn).astype(U)))
        first.append(bgn + lo)
        lo += len(b)
    return np.concatenate(out), np.concatenate(first)


def _sliding(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """``best`` over every ``n`` consecutive values, by doubling."""
    k = 1
    while 2 * k <= n:
        x = best(x[:-k], x[k:])
        k *= 2
    return best(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


@dataclass
class Cut:
    """Paragraphs of some texts: which text, first word in it, and first word among all words of the batch."""

    text: np.ndarray
    pos: np.ndarray
    at: np.ndarray
    words: np.ndarray
    shingles: np.ndarray


def cut(texts: list[bytes | None]) -> Iterator[Cut]:
    """Paragraphs of texts, BLOCK bytes or a longer text at a time; a start is the least shingle (all of equal ones) of some SPAN in a row."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or b"") <= BLOCK):
            size += len(texts[hi] or b"")
            hi += 1
        part = [t or b"" for t in texts[lo:hi]]
        w, byte = word_hashes(b" ".join(part).translate(TABLE))
        if len(w) >= WORDS:
            of = np.searchsorted(np.cumsum([0] + [len(t) + 1 for t in part[:-1]]), byte, "right") - 1
            count = np.bincount(of, minlength=len(part))
            first = np.cumsum(count) - count
            pos = np.arange(len(w)) - first[of]
            fits = pos <= count[of] - WORDS
            s = np.zeros(len(w), U)
            for k in range(SHINGLE):
                s[: len(w) - SHINGLE + 1] += w[k : len(w) - SHINGLE + 1 + k] * _POWERS[k]
            s = mix(s)
            start = np.zeros(len(w), bool)
            if len(w) >= SPAN:
                least = _sliding(np.where(fits, s, U(2**64 - 1)), SPAN, np.minimum)
                least[~(fits[SPAN - 1 :] & (of[SPAN - 1 :] == of[: len(least)]))] = 0
                edge = np.zeros(SPAN - 1, U)
                start = fits & (_sliding(np.concatenate([edge, least, edge]), SPAN, np.maximum) == s)
            room = count - WORDS + 1
            for d in np.flatnonzero((room > 0) & (room < SPAN)):  # texts too short for a whole span
                start[first[d] + s[first[d] : first[d] + room[d]].argmin()] = True
            at = np.flatnonzero(start)
            if len(at):
                yield Cut(of[at] + lo, pos[at], at, w, s)
        lo = hi


def paragraph_hashes(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), U)
    for k in range(WORDS):
        out += w[at + k] * _POWERS[k]
    return mix(out)


def band_keys(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key for each paragraph (row) and band, of the least hashes under VALUES seeds."""
    keys = np.empty((len(at), BANDS), U)
    for b in range(BANDS):
        key = np.full(len(at), b, U)
        for seed in _SEEDS[b * VALUES : (b + 1) * VALUES]:
            # the hashes are mixed already: a multiplication by an odd seed ranks them anew
            x = s * (seed | U(1))
            x ^= x >> U(31)
            key = mix(key + _sliding(x, SET, np.minimum)[at])
        keys[:, b] = key
    return keys


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, k0, k1, ...) of each paragraph; band keys only of the paragraphs that SAMPLED picks."""
    for b in batches:
        for c in cut(as_bytes(b.column(1))):
            h = paragraph_hashes(c.words, c.at)
            picked = mix(h) % U(SAMPLED) == 0
            k = np.zeros((len(h), BANDS), U)
            if picked.any():
                k[picked] = band_keys(c.shingles, c.at[picked])
            keys = [pa.array(np.ascontiguousarray(k[:, j]).view(np.int64), mask=~picked) for j in range(BANDS)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c.text)), _signed(h), *keys], names=["doc_id", "h", *[f"k{j}" for j in range(BANDS)]])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, h, doc_id): each band key of each distinct paragraph of a batch, with the least document that has it."""
    for b in batches:
        doc = b.column(0).to_numpy()
        parts = [(band_keys(c.shingles, c.at).T.ravel(), np.tile(paragraph_hashes(c.words, c.at), BANDS), np.tile(doc[c.text], BANDS)) for c in cut(as_bytes(b.column(1)))]
        if parts:
            key, h, of = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((of, h, key))
            key, h, of = key[order], h[order], of[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])])
            yield pa.RecordBatch.from_arrays([_signed(key[new]), _signed(h[new]), pa.array(of[new])], names=["key", "h", "doc_id"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, h, doc_id, size) sorted by key, h and doc_id: one (key, n, h, doc_id) for each paragraph of a key that has others.

    ``size`` is null but for hot keys, which are dealt out: those have others for sure, and ``size`` takes the place of their number.
    Paragraphs that all have the same first document do not meet: overlapping ones of one text would, and a link between
    them can add no document to their class that comes before that one.
    """
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("doc_id", pa.int64())])
    held = np.empty((0, 4), np.int64)

    def told(x: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate([[True], x[1:, 0] != x[:-1, 0], [True]]))
        size = np.diff(edge)
        n = np.where(x[:, 3] > 0, x[:, 3], np.repeat(size, size))
        apart = np.minimum.reduceat(x[:, 2], edge[:-1]) < np.maximum.reduceat(x[:, 2], edge[:-1])
        some = (n > 1) & (np.repeat(apart, size) | (x[:, 3] > 0))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (x[some, 0], n[some], x[some, 1], x[some, 2])], schema=schema)

    for b in batches:
        if not len(b):
            continue
        size = pc.fill_null(b.column(3), 0).to_numpy(zero_copy_only=False)
        held = np.concatenate([held, np.stack([*(b.column(k).to_numpy() for k in range(3)), size], 1)])
        new = np.concatenate([[True], (held[1:, :2] != held[:-1, :2]).any(1)])
        held = held[new]  # the first of a paragraph's rows has the least document
        end = int(np.searchsorted(held[:, 0], held[-1, 0]))
        if end:
            yield told(held[:end])
            held = held[end:]
    if len(held):
        yield told(held)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, pos, h) of each paragraph."""
    for b in batches:
        texts = as_bytes(b.column(1))
        for c in cut(texts):
            some, back = np.unique(c.text, return_inverse=True)
            key = np.array([xxhash.xxh64_intdigest(texts[i], 42) for i in some], U)[back]  # as Spark's xxhash64
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c.text)), _signed(key), pa.array(c.pos.astype(np.int32)), _signed(paragraph_hashes(c.words, c.at))], names=["doc_id", "text_key", "pos", "h"])


def paragraph_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, m, shingles) of the paragraphs ``wanted`` (doc_id, h): m distinct shingle hashes, padded to full length.

    The wanted hashes of a document are gathered (no more than it has paragraphs) and meet its text by id.
    """
    lists = wanted.groupBy("doc_id").agg(F.collect_list("h").alias("hs"))
    rows = docs.join(lists.withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d")).select("text", "hs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            want = np.stack([np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy()], 1)
            wanted = mix(want[:, 0].astype(U)) ^ want[:, 1].view(U)  # text and hash in one
            for c in cut(as_bytes(b.column(0))):
                h = paragraph_hashes(c.words, c.at)
                both, first = np.unique(mix(c.text.astype(U)) ^ h, return_index=True)
                first = first[np.isin(both, wanted)]
                h, at = h[first], c.at[first]
                own = np.sort(c.shingles[at[:, None] + np.arange(SET)], axis=1)
                again = np.zeros(own.shape, bool)
                again[:, 1:] = own[:, 1:] == own[:, :-1]
                # what repeats within a paragraph gives way to values that no other paragraph has
                sets = np.where(again, mix(h[:, None] + np.arange(1, SET + 1, dtype=U)), own)
                data = pa.Array.from_buffers(pa.binary(8 * SET), len(h), [None, pa.py_buffer(np.ascontiguousarray(sets))])
                yield pa.RecordBatch.from_arrays([_signed(h), pa.array((SET - again.sum(1)).astype(np.int32)), data.cast(pa.binary())], names=["h", "m", "shingles"])

    found = map_arrow(rows, run, "h bigint, m int, shingles binary")
    return found.groupBy("h").agg(F.first("m").alias("m"), F.first("shingles").alias("shingles"))  # an id that repeats yields a paragraph twice


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, h, m, shingles) sorted by key; spanning edges of what is similar in each bucket."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def bucket(h: np.ndarray, m: np.ndarray, s: np.ndarray, a: list, b: list) -> None:
        left = np.arange(1, len(h))
        todo = [0]
        while len(left):
            if not todo:
                todo, left = [int(left[0])], left[1:]
                continue
            i = todo.pop()
            both = np.isin(s[left], s[i]).sum(1)
            near = both >= SIMILAR * (m[left] + m[i] - both)
            new = left[near]
            a.append(np.full(len(new), h[i]))
            b.append(h[new])
            left = left[~near]
            todo += new.tolist()

    def flush(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        key, h, m = t["key"].to_numpy(), t["h"].to_numpy(), t["m"].to_numpy()
        s = np.frombuffer(b"".join(t["shingles"].to_pylist()), U).reshape(len(t), -1)
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(cut)
        of = np.repeat(size, size)
        a: list[np.ndarray] = [np.empty(0, np.int64)]
        b: list[np.ndarray] = [np.empty(0, np.int64)]
        for d in range(1, 8):  # buckets of up to eight paragraphs at once, by lag
            at = np.flatnonzero((of[:-d] <= 8) & (key[:-d] == key[d:])) if len(key) > d else np.empty(0, np.int64)
            for k in range(0, len(at), 4096):
                i = at[k : k + 4096]
                j = i + d
                both = (s[i][:, :, None] == s[j][:, None, :]).sum((1, 2))
                near = both >= SIMILAR * (m[i] + m[j] - both)
                a.append(h[i[near]])
                b.append(h[j[near]])
        for k in np.flatnonzero(size > 8):
            bucket(h[cut[k] : cut[k + 1]], m[cut[k] : cut[k + 1]], s[cut[k] : cut[k + 1]], a, b)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)

    held: list[pa.RecordBatch] = []
    for x in batches:
        if not len(x):
            continue
        held.append(x)
        t = pa.Table.from_batches(held)
        key = t["key"].to_numpy()
        end = int(np.searchsorted(key, key[-1]))
        if end:
            yield flush(t.slice(0, end))
            held = t.slice(end).combine_chunks().to_batches()
    if held:
        yield flush(pa.Table.from_batches(held))


def meetings(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, n, h, doc_id): distinct paragraphs that share a band key with others, the key's number of them, and a document of each.

    Repeats of a paragraph leave before the shuffle, as far as a batch has them; keys that the sampled classes
    show to be hot go to as many tasks as they have HOT_ROWS.
    """
    keys = F.explode(F.array(*[f"k{j}" for j in range(BANDS)])).alias("hot")
    hot = classes.where("k0 is not null").select(keys).groupBy("hot").agg((F.count(F.lit(1)) * SAMPLED).alias("size"))
    hot = staged(hot.where(F.col("size") >= HOT_ROWS), "hot_keys")
    entries = map_arrow(rows, _entries, "key bigint, h bigint, doc_id bigint")
    if hot.isEmpty():
        dealt = spread_by(entries.withColumn("size", F.lit(None).cast("bigint")), "key")
    else:
        found = entries.join(hot, F.col("key") == F.col("hot"), "left").drop("hot")
        salt = F.coalesce(F.pmod("h", F.ceil(F.col("size") / HOT_ROWS)), F.lit(0))
        dealt = spread_by(found.withColumn("salt", salt), "key", "salt").select("key", "h", "doc_id", "size")
    return staged(map_arrow(dealt.sortWithinPartitions("key", "h", "doc_id"), _met, "key bigint, n bigint, h bigint, doc_id bigint"), "met")


def near_edges(rows: DataFrame, met: DataFrame) -> DataFrame:
    """(a, b): paragraphs of Jaccard SIMILAR or more that meet in a band; they span the components of all such pairs."""
    sets = staged(paragraph_sets(rows, met.select("doc_id", "h").distinct()), "sets")
    rows = met.join(sets, "h").select("key", "n", "h", "m", "shingles")
    # buckets too large for a task: their paragraphs take part in pairs of blocks
    blocks = F.when(F.col("n") > BUCKET_ROWS, F.ceil(F.col("n") / (BUCKET_ROWS // 2))).otherwise(F.lit(1))
    own = F.pmod(F.xxhash64("h", F.lit(7)), blocks)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    pair = F.when(F.col("n") > BUCKET_ROWS, F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col("key"))
    ready = spread_by(rows.select(pair.alias("key"), "h", "m", "shingles"), "key").sortWithinPartitions("key")
    return map_arrow(ready, _similar, "a bigint, b bigint")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, start_word, end_word, n_words, component_id, kept): passages in two documents or more.

    One row for each maximal run of repeated paragraphs of a document; words count normalised words, end
    exclusive. component_id is the smallest doc_id among the documents that have any of its paragraphs'
    classes; ``kept`` runs are those of the document where a class came first. Null, empty and short
    texts (under WORDS words) have no paragraphs; rows without id repeat nothing; what one document
    repeats within itself, and rows that repeat with the same id, are no repetition across documents.
    Classes are told apart by a 64-bit hash of their words.
    """
    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col(id_col).isNotNull()))
    names = [f"k{j}" for j in range(BANDS)]
    cut = map_arrow(rows, _classes, "doc_id bigint, h bigint, " + ", ".join(f"{k} bigint" for k in names))
    classes = cut.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).cast("int").alias("n"), *[F.min(k).alias(k) for k in names])
    classes = staged(classes.where("n > 1 or k0 is not null"), "classes")
    many = classes.where("n > 1").select("h", "first", "last", "n")
    met = meetings(rows, classes)
    labels = bounded_components(near_edges(rows, met))
    # of a paragraph that occurs once, the document that the meetings name is the only one
    own = met.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    linked = labels.join(own, labels["node"] == own["h"]).select("h", "doc_id", "component").join(many, "h", "left")
    linked = staged(linked.select("h", "component", F.coalesce("first", "doc_id").alias("first"), F.coalesce("last", "doc_id").alias("last"), F.coalesce("n", F.lit(1)).alias("n")), "linked")
    joint = linked.groupBy("component").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    near = linked.select("h", "n", "component").join(joint, "component").select("h", "n", "first", "last")
    alone = many.where("first < last").join(labels, many["h"] == labels["node"], "left_anti")
    table = staged(near.unionByName(alone).where("first < last").select("h", "n", "first"), "repeated")
    places = map_arrow(rows, _places, "doc_id bigint, text_key bigint, pos int, h bigint")
    found = lookup(places, table, "h", "n").where("first is not null").withColumn("kept", F.col("first") == F.col("doc_id"))
    by = W.partitionBy("doc_id", "text_key", "kept").orderBy("pos")
    gap = F.col("pos") > F.lag("pos").over(by) + WORDS
    runs = found.withColumn("run", F.sum(F.when(gap, 1).otherwise(0)).over(by))
    out = runs.groupBy("doc_id", "text_key", "kept", "run").agg(F.min("pos").cast("long").alias("start_word"), (F.max("pos") + WORDS).cast("long").alias("end_word"), F.min("first").alias("component_id"))
    return out.select("doc_id", "text_key", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "component_id", "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of all documents but the first; other columns as they were."""
    gone = repeated_passages(docs, id_col, text_col).where("not kept").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start_word", "end_word")).alias("_gone"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_key"))
    rows = rows.join(gone.withColumnsRenamed({"doc_id": "_d", "text_key": "_k"}), (F.col("_id") == F.col("_d")) & (F.col("_key") == F.col("_k")), "left").select("_row", "_text", "_gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, gone in zip(b.column("_text").to_pylist(), b.column("_gone").to_pylist(), strict=True):
                if gone:
                    at = [m.span() for m in WORD.finditer(t)]
                    out, last = [], 0
                    for g in sorted(gone, key=lambda g: g["start_word"]):
                        out.append(t[last : at[g["start_word"]][0]])
                        last = max(last, at[g["end_word"] - 1][1])
                    t = "".join([*out, t[last:]])
                texts.append(t)
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(texts, pa.string()), b.column("_gone")], names=b.schema.names)

    cut = map_arrow(rows, run, rows.schema)
    return cut.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns])
