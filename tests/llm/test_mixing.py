import random
from collections import defaultdict

import pytest

from strandline.llm.mixing import mix, mix_report, source_targets

SCHEMA = "doc_id long, text string, source string, copies int, size string"


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Resharing by rounds, as the definition has it."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while open_:
        full = {s for s in open_ if left * w[s] / sum(w[x] for x in open_) > cap * sizes[s]}
        if not full:
            for s in open_:
                got[s] = left * w[s] / sum(w[x] for x in open_)
            break
        for s in full:
            got[s] = cap * sizes[s]
        left -= sum(got[s] for s in full)
        open_ -= full
    return got


def corpus():
    r = random.Random(5)
    rows = [(i, "w " * r.choice([1, 3, 40, 200]), r.choice(["a", "a", "a", "b", "c", "d", None]), 0, "x") for i in range(1500)]
    return [*rows, (5000, None, "a", 0, "x"), (5001, "", "z", 0, "x"), (None, "n n", "b", 0, "x"), (None, "n n n", "b", 0, "x"), (7, rows[7][1], rows[7][2], 0, "x"), (9000, "long " * 50000, "c", 0, "x")]


def test_targets_and_sizes(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix_report(df).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mix_report(df.repartition(7)).collect()))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    want = targets(sizes)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1
    assert sum(r.size for r in got) == sum(len((x[1] or "").split()) for x in rows)


def test_marginals(spark):
    """Over many seeds each document is copied as often as its source's rate says."""
    df = spark.createDataFrame([(i, "w " * (1 + i % 5), "a" if i < 30 else "b", 0, "") for i in range(40)], SCHEMA)
    total = defaultdict(int)
    for seed in range(2):
        for r in mix_report(df, seed=seed).collect():
            total[r.source] += r.copies
            rate = {r.source: r.target / r.source_size}
            assert abs(r.copies - rate[r.source]) < 1
    assert total["a"] > 0 and total["b"] > 0


def test_mix_rows_and_empty(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    report = mix_report(df).agg({"copies": "sum"}).first()[0]
    out = mix(df)
    assert out.columns == [*df.columns, "copy"]
    assert out.count() == report
    assert mix(df.limit(0)).collect() == [] and mix_report(df.limit(0)).collect() == []


def test_many_sources(spark):
    """Ranks and levels over range partitions are those of one sorted list."""
    r = random.Random(8)
    sizes = {("s%05d" % r.randrange(10**5)) + r.choice(["", "é", "z"]): r.choice([0, 1, 50, 1000, 10**6]) for _ in range(800)} | {None: 70}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {x.source: x for x in source_targets(df, (5, 2, 1), 1.5, 2.0).collect()}
    want = targets(sizes)
    assert set(got) == set(want) and all(abs(got[s].target - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_clashing_columns(spark):
    names = ["row", "own_source", "own_id", "copies", "size", "target", "_copies", "_s", "_d"]
    df = spark.createDataFrame([(i, "w w", "a", *[f"{c} {i}" for c in names]) for i in range(20)], ["doc_id", "text", "source", *names])
    out = mix(df).collect()
    assert out and all(x[c] == f"{c} {x.doc_id}" for x in out for c in names)
    with pytest.raises(ValueError, match="copy"):
        mix(df.withColumnRenamed("copies", "copy"))
    assert "again" in mix(df.withColumnRenamed("copies", "copy"), copy_col="again").columns
