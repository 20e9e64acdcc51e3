import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
from pyspark.sql import functions as F

from strandline.operators import alignment as A
from strandline.operators import graph as H
from strandline.operators import kmers as K
from strandline.operators import overlaps as O
from strandline.operators.kernels import extend as X
from strandline.operators.kernels import packed as P


def codes(s):
    return np.frombuffer(s.encode(), np.uint8)


def table(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, rows[-1][j + 1] + 1, rows[-1][j] + (x != y)))
        rows.append(new)
    return rows


dna = st.text("ACGT", max_size=24)


@settings(deadline=None, max_examples=300)
@given(dna, dna)
def test_dovetails_have_the_fewest_errors(a, b):
    """With room for all errors, the end of either sequence is reached with as few errors as the whole table has there."""
    t = table(a, b)
    least = min([t[len(a)][j] for j in range(len(b) + 1)] + [t[i][len(b)] for i in range(len(a) + 1)])
    kind, i, j, e = X.extend(codes(a), codes(b), 60)
    assert kind == X.DOVETAIL and (i == len(a) or j == len(b)) and e == least == t[i][j]


def noisy(s, r, rate):
    out = []
    for c in s:
        u = r.random()
        if u < rate / 3:
            continue
        out.append(r.choice("ACGT") if u < 2 * rate / 3 else c)
        if u > 1 - rate / 3:
            out.append(r.choice("ACGT"))
    return "".join(out)


def test_overlap_and_branch():
    r = random.Random(2)
    g, h = ("".join(r.choice("ACGT") for _ in range(9000)) for _ in range(2))
    a, b = g[:6000], noisy(g[2000:8000], r, 0.03)
    seed = next((i, b.find(a[i : i + 21])) for i in range(3500, 5900) if b.find(a[i : i + 21]) >= 0)
    kind, a0, a1, b0, b1, e = X.overlap(a, b, *seed, 21, 0.06)
    assert kind == X.DOVETAIL and a1 == 6000 and b0 == 0 and abs(a0 - 2000) < 40 and 60 < e < 160
    kind, a0, a1, b0, b1, e = X.overlap(g[:6000], h[:2000] + g[2000:4000] + h[4000:], 3000, 3000, 21, 0.06)
    assert kind == X.BRANCH and abs(a0 - 2000) < 20 and abs(a1 - 4000) < 20 and e < 10


def test_many_extensions_are_those_of_one_by_one():
    r = random.Random(4)
    word = lambda n, of="ACGT": "".join(r.choice(of) for _ in range(n))
    xs, ys = [], []
    for _ in range(600):
        x = word(r.choice([0, 1, 7, 8, 9, 60, 700]), r.choice(["A", "AC", "ACGT", "ACGTN"]))
        xs.append(x)
        ys.append(r.choice([x, word(r.choice([0, 1, 30, 400])), noisy(x, r, r.choice([0.02, 0.1, 0.3])) + word(r.choice([0, 50])), noisy(x[: len(x) // 2], r, 0.05) + word(300)]))
    most = np.array([r.choice([0, 1, 5, 40, 200]) for _ in xs])
    kind, *found = X.extend_all([codes(x) for x in xs], [codes(y) for y in ys], most)
    got = [(X.DOVETAIL if k else X.BRANCH, *map(int, f)) for k, *f in zip(kind, *found, strict=True)]
    assert got == [X.extend(codes(x), codes(y), int(e)) for x, y, e in zip(xs, ys, most, strict=True)]
    assert {k for k, *_ in got} == {X.DOVETAIL, X.BRANCH} and not len(X.extend_all([], [], most[:0])[0])


def test_room_is_enough_for_the_errors(spark):
    n = spark.range(-30, 6000).select(F.col("id").alias("n"), *(A.room(F.col("id"), x).alias(str(i)) for i, x in enumerate((0.001, 0.02, 0.1, 0.3))))
    for row in n.collect():
        assert all(row[1 + i] >= X.error_bound(max(row.n, 0), x) + 2 for i, x in enumerate((0.001, 0.02, 0.1, 0.3)))


def test_folded_texts():
    for t in (b"", b"A", b"ACG", b"TTGCA", b"ACGTACGT", b"ACGNA", b"acgt", b"G" * 1001):
        letters, blob = P.folded(t)
        assert P.text(blob, letters) == t and letters == (1 if set(t) - set(b"ACGT") else 4)
        assert len(blob) == (len(t) if letters == 1 else -(-len(t) // 4) + 1)


def written(spark):
    """Bytes that shuffles have written."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_parts_of_reads_give_what_whole_ones_give(spark, monkeypatch):
    """Reads of other letters, turned ones and short ones in long ones; a pair moves no more than the extension can come to."""
    monkeypatch.setattr(X, "PAIRS", 7)
    r = random.Random(5)
    g = "".join(r.choice("ACGT") for _ in range(300_000))
    turn = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    texts = {1: g, 2: turn(g[1000:9000])}
    for i in range(3, 60):
        at = r.randrange(0, 290_000)
        t = noisy(g[at : at + r.choice([60, 300, 1500])], r, r.choice([0, 0.03, 0.2]))
        t = "".join(r.choice("ACGT") for _ in range(400)) + t if i % 5 == 0 else t
        texts[i] = turn(t) if i % 3 == 0 else t[:30] + "N" + t[31:] if i % 4 == 0 else t
    reads = spark.createDataFrame([*texts.items(), (99, None)], "read_id long, seq string").repartition(4)
    folded = K.folded(reads)
    lens = spark.createDataFrame([(i, len(t)) for i, t in texts.items()], "read_id long, len long")
    found = O.clusters(reads, 15, 2, 20, 1)
    assert sorted(found.collect()) == sorted(O.clusters(folded, 15, 2, 20, 1).collect())
    assert {(x.read_id, len(P.text(x.bases, x.letters))) for x in folded.collect()} == {tuple(x) for x in lens.collect()}
    rows = found.collect()
    c = spark.createDataFrame(rows, found.schema)
    before = written(spark)
    got = sorted(tuple(x) for x in A.aligned(c, reads, 15, 0.1).collect())
    moved = written(spark) - before
    whole = []
    for x in rows:
        a, b = texts[x.a_id], turn(texts[x.b_id]) if x.flipped else texts[x.b_id]
        whole.append((x.a_id, x.b_id, x.flipped, *X.overlap(a, b, x.a_seed, x.b_seed, 15, 0.1), len(a), len(b)))
    assert got == sorted(whole) and len(got) > 30 and {x[3] for x in got} == {X.DOVETAIL, X.BRANCH}
    assert moved < 500_000  # each pair with its whole reads: several million


def test_from_clusters_to_overlaps(spark):
    r = random.Random(3)
    g = "".join(r.choice("ACGT") for _ in range(3000))
    turn = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    reads = spark.createDataFrame([(1, g[:1500]), (2, turn(g[900:2400])), (3, g[2000:])], "read_id long, seq string")
    rows = [(1, 2, True, 5, 1000, 100), (2, 3, True, 1, 200, 800), (1, 3, False, 1, 700, 700)]
    c = spark.createDataFrame(rows, "a_id long, b_id long, flipped boolean, seeds int, a_seed long, b_seed long")
    found = A.emitted(A.distinct(A.accepted(A.aligned(c, reads, 15, 0.02), 300, 0.02))).collect()
    got = {(x.a_id, x.b_id): x for x in found}
    assert (got[1, 2].ahg5, got[1, 2].ahg3, got[1, 2].bhg5, got[1, 2].bhg3, got[1, 2].evalue) == (900, 0, 0, 900, 0)
    assert got[1, 2].for_utg and (1, 3) not in got
    lens = c.selectExpr("*", "1500L AS a_len", "1500L AS b_len")
    assert {(x.a_id, x.b_id) for x in A.hopeful(lens, 15).collect()} == {(1, 2)}


@pytest.mark.parametrize("spur", [True, False])
def test_spur_edges(spark, spur):
    """A spur's edge to a read that is none goes, unless it is mutual."""
    edges = [(1, False, 2, True), (2, True, 1, False), (3, False, 1, False), (4, True, 5, False), (5, False, 4, True)]
    best = spark.createDataFrame(edges, "read_id long, end3p boolean, b_id long, b3p boolean")
    marked = spark.createDataFrame([(3,), (4,)] if spur else [], "read_id long")
    assert {x.read_id for x in H.repair_spurs(best, marked).collect()} == ({1, 2, 4, 5} if spur else {1, 2, 3, 4, 5})
