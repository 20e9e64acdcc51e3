"""Properties and plain counterparts of operators that SQL does not check."""

import gzip
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.components import connected
from strandline.functions import geometry as G
from strandline.functions import seq as S
from strandline.operators import errors as E
from strandline.operators import graph as H
from strandline.operators import intervals as I
from strandline.operators import kmers as K
from strandline.operators import layouts as L
from strandline.operators import overlaps as O
from strandline.operators import trimming as T
from strandline.operators.kernels.align import align, edit_distance, prefix_extension
from strandline.operators.kernels.consensus import consensus, stitch, trim_circular
from strandline.sources import fastq as FQ
from strandline.sources import text as X
from strandline.streaming import kmers as SK

dna = st.text("ACGT", max_size=30)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@settings(deadline=None, max_examples=80)
@given(dna, dna, st.integers(0, 12))
def test_edit_distance(a, b, limit):
    d = plain_distance(a, b)
    assert edit_distance(a, b) == d
    assert edit_distance(a, b, limit) == min(d, limit + 1)


@settings(deadline=None, max_examples=60)
@given(st.text("ACGT", min_size=1, max_size=30), st.text("ACGT", min_size=1, max_size=20))
def test_alignment_replays(t, r):
    begin, d, ops = align(t, r)
    assert sum(k != "=" for k, _, _ in ops) == d
    assert "".join(b for k, _, b in ops if k != "D") == r
    assert [at for k, at, _ in ops if k != "I"] == list(range(begin, begin + sum(k != "I" for k, _, _ in ops)))
    assert d == min(plain_distance(t[i:j], r) for i in range(len(t) + 1) for j in range(i, len(t) + 1))


def test_prefix_extension():
    assert prefix_extension("ACGTACGTAA", "ACGTACGT", 2) == (8, 8, 0)
    assert prefix_extension("ACGTTTTTTT", "ACGTGGGGGG", 1)[:2] == (4, 4)


def noisy(g, r, rate):
    out = []
    for c in g:
        x = r.random()
        if x < rate / 3:
            continue
        out.append(r.choice("ACGT") if x < 2 * rate / 3 else c)
        if x > 1 - rate / 3:
            out.append(r.choice("ACGT"))
    return "".join(out)


def test_consensus_and_stitch():
    r = random.Random(3)
    g = "".join(r.choice("ACGT") for _ in range(300))
    got, quality = consensus(noisy(g, r, 0.05), [noisy(g, r, 0.05) for _ in range(15)])
    assert plain_distance(got, g) <= 2 and len(quality) > 0
    assert stitch([(i, i + 100, g[i : i + 100]) for i in range(0, 201, 50)]) == g
    assert trim_circular(g + g[:80]) == (0, 300) and trim_circular(g) == (0, 300)


def test_geometry_twins(spark):
    o = X.random_overlaps(spark, 300, 20, 1000)
    twice = G.twins(G.twins(o))
    assert twice.exceptAll(o).isEmpty() and o.exceptAll(twice).isEmpty()
    s = O.symmetrise(o)
    assert s.join(G.twins(s.select("a_id", "b_id", "flipped", "ahg5", "ahg3", "bhg5", "bhg3", "evalue")), ["a_id", "b_id", "flipped", "evalue"]).count() >= s.count()


def test_sweep_area_and_merge(spark):
    r = random.Random(1)
    iv = spark.createDataFrame([(k, lo, lo + r.randint(1, 50)) for k in range(3) for lo in [r.randint(0, 500) for _ in range(60)]], "key long, lo long, hi long")
    area = iv.agg(F.sum(F.col("hi") - F.col("lo"))).first()[0]
    assert I.depth(iv).agg(F.sum((F.col("hi") - F.col("lo")) * F.col("depth"))).first()[0] == area
    covered = {(k, x) for k, lo, hi in iv.collect() for x in range(lo, hi)}
    got = [(k, x) for k, lo, hi, _ in I.merge(iv).collect() for x in range(lo, hi)]
    assert len(got) == len(set(got)) and set(got) == covered
    assert I.merge(iv.limit(0)).collect() == [] and I.depth(iv.limit(0)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100


def test_chunks_with_cycle_and_tail(spark):
    # 1 -> 2 -> 3 -> 1 is a circle walked forward, 9 leads into it, 20 -> 21 ends
    e = [(1, 2), (2, 3), (3, 1), (9, 1), (20, 21)]
    best = spark.createDataFrame([(a, True, b, False) for a, b in e], "read_id long, end3p boolean, b_id long, b3p boolean")
    got = {r.read_id: r.path_len for r in H.chunk_lengths(best).collect()}
    assert got == {1: 4, 2: 4, 3: 4, 9: 5, 20: 3}


def test_largest_covered(spark):
    rows = [(1, b, False, lo, 1000 - hi, 0, 0, 10, 1000) for b, lo, hi in [(2, 0, 600), (3, 300, 1000), (4, 305, 900), (5, 100, 595)]]
    o = spark.createDataFrame(rows, "a_id long, b_id long, flipped boolean, ahg5 long, ahg3 long, bhg5 long, bhg3 long, evalue long, a_len long")
    assert [tuple(r) for r in T.largest_covered(o, 100, 100).collect()] == [(1, 0, 1000)]
    import pandas as pd

    # within 10 bases of an accepted begin (300) or end (600): both go
    pdf = pd.DataFrame({"lo": [0, 300, 305, 100], "hi": [600, 1000, 900, 595], "a_len": 1000})
    assert T.accept_in_order(pdf, 500).index.tolist() == [0, 1]


def test_votes_and_fix(spark):
    g = "ACGTTGCAAGGCTTACGATCGATTACAGGCAT"
    bad = g[:15] + ("A" if g[15] != "A" else "C") + g[16:]
    t = E.tally(E.votes(spark.createDataFrame([(1, bad, g)] * 4, "read_id long, seq string, other string")))
    base = F.substring(F.lit(bad), F.col("pos") + 1, F.lit(1))
    change = t.select("read_id", "pos", E.check_del_subst(base, 2, 5).alias("c")).where("c is not null")
    edits = change.select("read_id", "pos", F.upper(F.substring("c", 1, 1)).alias("new"))
    fixed = E.fix_reads(spark.createDataFrame([(1, bad)], "read_id long, seq string"), edits).first()
    assert fixed.seq == g


def test_scalars():
    assert S.scaled_number("4.8m") == 4.8e6 and S.scaled_number("3g") == 3e9 and S.scaled_number("12") == 12
    assert S.haplotype_k(1e8) == 17 and S.binomial_bound(1000, 0.01) > 10
    assert K.histogram_plot([(2, 70), (3, 7), (40, 1)])[0].endswith("*" * 70)


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">r1 x y\nACGT\nNN\n>r2\nTT\n")
    (tmp_path / "a.fastq").write_text("@q1 z\nACGT\n+\n@III\n@q2\nGG\n+q2\nII\n")
    assert [tuple(r) for r in X.read_fasta(spark, str(tmp_path / "a.fasta")).collect()] == [("r1", "x y", "ACGTNN"), ("r2", "", "TT")]
    want = [("q1", "z", "ACGT", "@III"), ("q2", "", "GG", "II")]
    for size in (1000, 11, 7, 3):  # ranges that begin anywhere in a record
        assert sorted(tuple(r) for r in FQ.read_fastq(spark, str(tmp_path / "a.fastq"), size).collect()) == want
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write("@q1 z\nACGT\n+\n@III\n")
    assert FQ.read_fastq(spark, str(tmp_path / "b.fastq.gz")).count() == 1
    seg, links = X.parse_gfa(spark.createDataFrame([("S\ttig00000012\t*\tLN:i:40",), ("L\ttig1\t+\ttig2\t-\t10M2D",)], "value string"))
    assert tuple(seg.first()) == ("tig00000012", 12, None, 40) and links.first().ref_len == 12


def test_streamed_counts(spark, tmp_path):
    rows = [(1, "ACGTACGTA"), (2, "TTTTACGT")]
    spark.createDataFrame(rows[:1], "read_id long, seq string").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "read_id long, seq string"
    for more in ([], rows[1:]):
        if more:
            spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = SK.count_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 4, str(tmp_path / "k"), str(tmp_path / "c"))
        q.awaitTermination()
    want = {r.kmer: r["count"] for r in K.count(spark.createDataFrame(rows, schema), 4).collect()}
    assert {r.kmer: r["count"] for r in SK.counts(spark, str(tmp_path / "k")).collect()} == want


def test_thickest_neighbours(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), i, lo := rng.randrange(900), lo + rng.randrange(1, 40)) for i in range(400)]
    placed = spark.createDataFrame(rows, "tig_id long, read_id long, lo long, hi long")
    regions = spark.createDataFrame([(t, lo, lo + 150) for t in range(3) for lo in range(0, 1200, 200)], "tig_id long, rlo long, rhi long")
    for after in (False, True):
        want = set()
        for t, i, lo, hi in rows:
            for rlo in range(0, 1200, 200):
                if rlo <= (hi if after else lo) <= rlo + 150:
                    others = [x for x in rows if x[0] == t and ((x[2:], x[1]) > ((lo, hi), i) if after else (x[2:], x[1]) < ((lo, hi), i))]
                    found = [(hi - x[2] if after else x[3] - lo, -x[1], x[2] if after else x[3]) for x in others]
                    if found and max(found)[0] > 0 and rlo <= max(found)[2] <= rlo + 150:
                        want.add((t, i, -max(found)[1], max(found)[0]))
        assert {tuple(r) for r in L.thickest(placed, regions, after, bin_size=64).collect()} == want and len(want) > 20


def test_thickest_in_deep_tig(spark):
    """60,000 reads that all overlap: 1.8 thousand million pairs, which took minutes when they were joined."""
    placed = spark.range(60_000).selectExpr("1L tig_id", "id read_id", "id % 100 lo", "200 + id hi")
    regions = spark.createDataFrame([(1, 0, 100_000)], "tig_id long, rlo long, rhi long")
    began = time.time()
    assert L.thickest(placed, regions, False).count() == 59_999 and L.thickest(placed, regions, True).count() == 59_999
    assert time.time() - began < 60
