import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import kmers as K
from strandline.operators.kernels import packed as P

TURN = str.maketrans("ACGT", "TGCA")


def plain(text, k):
    out = []
    for i in range(len(text) - k + 1):
        w = text[i : i + k]
        if set(w) <= set("ACGT"):
            r = w.translate(TURN)[::-1]
            out.append((i, min(w, r), w <= r))
    return out


@pytest.mark.parametrize("k", [1, 2, 5, 8, 16, 21, 31])
def test_against_strings(k, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 64)
    r = random.Random(k)
    texts = ["".join(r.choice("ACGTACGTN") for _ in range(n)) for n in (0, 1, k - 1, k, k + 1, 40, 64, 65, 300)] + ["ACGT" * 50, "n" * 40]
    got = sorted((int(t), int(p), int(m), bool(f)) for of, pos, kmer, fw in P.kmers([t.encode() for t in texts], k) for t, p, m, f in zip(of, pos, kmer, fw, strict=True))
    code = lambda w: int("".join(str("ACGT".index(c)) for c in w), 4)
    assert got == sorted((i, p, code(w), f) for i, t in enumerate(texts) for p, w, f in plain(t, k))


def test_range_of_k():
    with pytest.raises(ValueError, match="k is 32"):
        next(P.kmers([b"A" * 100], 32))


def test_counts_and_strings(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ACGT") for _ in range(r.randint(0, 90))) for _ in range(60)] + [None, "ACGTN" * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "read_id long, seq string")
    want = {}
    for t in texts:
        for _, w, _ in plain(t or "", 9):
            want[w] = want.get(w, 0) + 1
    assert {x.kmer: x["count"] for x in K.count(df, 9).collect()} == want
    strings = K.expand(df, 9, oriented=True)
    ints = K.expand_packed(df, 9).withColumn("kmer", K.unpacked(F.col("kmer"), 9)).select(*strings.columns)
    assert sorted(map(tuple, ints.collect())) == sorted(map(tuple, strings.collect()))
    assert K.count(df.limit(0), 9).collect() == [] and np.iinfo(np.int64).max > 4**P.MAX_K
