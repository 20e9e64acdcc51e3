"""k-mers in bins against plain ones, with bounds so small that passes and merges occur."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import haplotype as H
from strandline.operators import kmers as K
from strandline.operators import overlaps as O
from strandline.operators.kernels import binned as B
from strandline.operators.kernels import packed as P


def texts(seed, n=60, size=120):
    r = random.Random(seed)
    own = ["".join(r.choice("ACGTACGTACGTN") for _ in range(r.randint(0, size))) for _ in range(n)]
    turned = [t.translate(str.maketrans("ACGT", "TGCA"))[::-1] for t in own[:10]]
    return own + [t[5:80] for t in own[10:30]] + turned + ["A" * 300, "ACGT" * 40, "", None]


def plain(rows, k):
    of, pos, kmer, fw = (np.concatenate(x) for x in zip(*P.kmers([(t or "").encode() for _, t in rows], k), strict=True))
    return [(rows[o][0], int(m), bool(f), int(p)) for o, p, m, f in zip(of, pos, kmer, fw, strict=True)]


@pytest.mark.parametrize(("k", "size"), [(1, 50), (7, 64), (8, 10_000), (16, 90), (21, 333), (31, 5000)])
def test_stretches(k, size, monkeypatch):
    monkeypatch.setattr(B, "CHUNK", size)
    monkeypatch.setattr(B, "PASS", 100)
    rows = list(enumerate(texts(k)))
    bins = {}
    for chunk in B.pieces(((i, (t or "").encode()) for i, t in rows), k):
        for bin_, blob in B.deal(chunk, k, 7, True):
            bins.setdefault(bin_, []).append(blob)
    got, counts = [], Counter()
    for blobs in bins.values():
        parts = B.passes(blobs)
        for part in range(parts):
            for key, kmer, fw, pos, whole in B.read(blobs, k, part, parts):
                assert [len(rows[i][1]) for i in key] == whole.tolist()
                got += zip(key.tolist(), kmer.tolist(), fw.tolist(), pos.tolist(), strict=True)
            kmer, n, _, _ = B.counted(blobs, k, part, parts)
            assert not set(kmer.tolist()) & set(counts)  # a k-mer has one bin and pass
            counts.update(dict(zip(kmer.tolist(), n.tolist(), strict=True)))
    want = plain(rows, k)
    assert sorted(got) == sorted(want) and counts == Counter(m for _, m, _, _ in want)
    some = [x for blobs in bins.values() for found in B.occurrences(blobs, k, 2, 5) for x in zip(*(c.tolist() for c in found[:4]), strict=True)]
    assert sorted(some) == sorted(x for x in want if 2 <= counts[x[1]] <= 5)


def test_clusters(spark):
    rows = [(i, t, len(t or "")) for i, t in enumerate(texts(4))]
    df = spark.createDataFrame(rows, "read_id long, seq string, len long")
    want = O.seed_clusters(O.seed_pairs(df, 9, 2, 20), df, 9)
    for part in (want, want.where("seeds >= 3")):
        got = O.clusters(df, 9, 2, 20, 3 if part is not want else 1).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, part.collect())) and got.count() > 10
    assert got.where("flipped").count() > 0


def test_merged_tasks(monkeypatch):
    monkeypatch.setattr(B, "PASS", 10)
    rows = [(np.array([i % 3]), np.array([1]), np.array([1])) for i in range(100)]
    out = list(B.gathered(iter(rows), B.added))
    assert len(out) == 1 and out[0][2].tolist() == [34, 33, 33]


def test_batches_are_bounded(spark):
    """One batch of many k-mers was expanded at once, 16 bytes a k-mer and more for sorting, and each k-mer crossed the shuffle by itself."""
    df = spark.range(3000).select(F.col("id").alias("read_id"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 4).alias("t"))
    df = df.select("read_id", F.translate("t", "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))
    blobs = K.dealt(df, 21, "read_id", 256, positions=True)
    n = df.agg(F.sum(F.length("seq") - 20)).first()[0]
    assert blobs.agg(F.sum(F.length("stretches"))).first()[0] < 3 * n  # 25 bytes a k-mer before
    assert K.count_packed(df, 21).agg(F.sum("count")).first()[0] == n


def test_haplotypes(spark):
    r = random.Random(2)
    rows = [(i, "xyz"[i % 3], t, len(t or "")) for i, t in enumerate(texts(9))] + [(900 + i, None, "".join(r.choice("ACGT") for _ in range(50)), 50) for i in range(3)]
    df = spark.createDataFrame(rows, "read_id long, hap string, seq string, len long")
    named = {i: h for i, h, _, _ in rows}
    found = plain([(i, t) for i, _, t, _ in rows], 8)
    haps = {}
    for i, m, _, _ in found:
        if named[i]:
            haps.setdefault(m, set()).add(named[i])
    own = {m: h.copy().pop() for m, h in haps.items() if len(h) == 1}
    assert {(x.hap, x.kmer) for x in H.specific_kmers(df, 8).collect()} == {(h, m) for m, h in own.items()}
    sizes, hits = Counter(own.values()), Counter((i, own[m]) for i, m, _, _ in found if m in own)
    want = {}
    for i, _, _, n in rows:
        if n >= 20:
            s = sorted(((-hits[i, h] / sizes[h], h) for h in sizes if hits[i, h]))
            sure = s and (len(s) == 1 or s[0][0] / s[1][0] > 1.5)
            want[i] = (s[0][1] if sure else "ambiguous", round(-s[0][0], 12) if s else 0.0)
    got = {x.read_id: (x.hap, round(x.score, 12)) for x in H.assign(df, df, 8, 1.5, 20).collect()}
    assert got == want


@pytest.mark.parametrize("low", [0, -5, 1 << 40])
def test_rows_of_seeds_travel_whole(low):
    """Sums by pair are the same after a shuffle as before it, in a few bytes a row."""
    r = np.random.default_rng(6)
    n = 20_000
    a, b = low + r.integers(0, 400, n), low + 400 + r.integers(0, 3000, n)
    apos, bpos, of = r.integers(0, 5000, n), r.integers(0, 90_000, n), r.integers(0, 2, n) > 0
    d, one = apos - bpos, np.ones(n, np.int64)
    rows = B.clustered([(a, b, of, a * 0 + 5100, b * 0 + 90_100, one, d, d, d, apos, apos << 32 | bpos)])
    assert 0 < (rows[5] > 1).sum() < len(rows[5])
    [(bins, blobs)] = B.shipped(iter([rows]), 13)
    assert sorted(bins.tolist()) == list(range(13))
    back = B.clustered([B.unshipped(x) for x in blobs])
    assert all((x == y).all() for x, y in zip(rows, back, strict=True))
    assert sum(map(len, blobs)) < 16 * len(rows[0]) or low
    assert not list(B.shipped(iter([]), 13))
