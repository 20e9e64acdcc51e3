import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from strandline.llm import simhash
from strandline.llm.components import connected_components
from strandline.llm.simhash import drop_near_duplicates, fingerprint, near_duplicates

SCHEMA = "doc_id long, text string, fp string, n int"


def plain(text):
    """The fingerprint, bit by bit."""
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, distance=4):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = top(ids[a]), top(ids[b])
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def corpus():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(r.randint(1, 120))]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            c = list(base)
            c[r.randrange(len(c))] = word()
            texts.append(" ".join(c).title())
    return [*texts, texts[0], None, "", " \t\n", "Ünï Cödé", "x " * 30000]


def test_fingerprint():
    for t in corpus()[:40] + ["One", "one two three four five", "É à\x0bB\x0cc d e", "A b C d"]:
        assert fingerprint(t.encode()) == plain(t)


def test_against_all_pairs(spark):
    t = corpus()
    got = near_duplicates(spark.createDataFrame([(i, x, "clash", 1) for i, x in enumerate(t)], SCHEMA)).collect()
    fps = [fingerprint(x.encode() if x is not None else None) for x in t]
    want = classes(list(range(len(t))), fps)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("cell_rows", [4096, 8])
def test_dense_and_random_fingerprints(spark, monkeypatch, cell_rows):
    """Clusters that hang together by chains only, and cells larger than a task's share."""
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    r, fps = random.Random(2), []
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 5, 40])):
            for b in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << b
            fps.append(x)
    fps = sorted({simhash._signed(x) for x in fps})
    edges = simhash.fingerprint_edges(spark.createDataFrame([(x,) for x in fps], "fp long"), len(fps))
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want = classes(fps, [x & (1 << 64) - 1 for x in fps])
    assert {x: got.get(x, x) for x in fps} == want


def test_manhattan_bounds_hamming():
    r = np.random.default_rng(3)
    x, y = r.integers(0, 1 << 63, 500, dtype=np.uint64), r.integers(0, 1 << 63, 500, dtype=np.uint64)
    low = np.bitwise_count(simhash.embed(x) ^ simhash.embed(y))
    counts = lambda v: np.array([[int(k) >> (2 * s) & 3 for s in range(32)] for k in v])
    ones = np.array([0, 1, 1, 2])
    assert (low == np.abs(ones[counts(x)] - ones[counts(y)]).sum(1)).all()
    assert (low <= np.bitwise_count(x ^ y)).all()


def test_keep_one_and_edges(spark):
    rows = [(3, "a b c d e", "k", 1), (1, "A B c d e", "k", 2), (1, "A B c d e", "k", 2), (None, "q w e r t y", "k", 3), (None, "q w e r t y", "k", 3), (7, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = drop_near_duplicates(df).collect()
    by = defaultdict(int)
    for r in got:
        by[r.doc_id] += 1
    assert by == {1: 1, None: 1, 7: 1}
    assert got[0].asDict().keys() == {"doc_id", "text", "fp", "n"}
    assert near_duplicates(df.limit(0)).collect() == []
    assert drop_near_duplicates(df.limit(0)).collect() == []


def test_similarity_mode(spark):
    """Against all pairs of shingle sets: what is well above the threshold is found, what is well below is not."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(r.randint(80, 300))]
        texts.append(base)
        for share in (0.004, 0.01, 0.2):
            texts.append([word() if r.random() < share else w for w in base])
    rows = [(i, " ".join(t), "clash", 1) for i, t in enumerate(texts)] + [(500, None, None, 1), (501, "", None, 1), (None, rows_text := " ".join(texts[0]), None, 1), (0, rows_text, None, 1)]
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    high = low = 0
    for a in range(len(texts)):
        for b in range(a):
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= 0.86:
                high += 1
                assert got[a] == got[b], j
            elif j < 0.5:
                low += got[a] == got[b]
    assert high > 50 and low == 0
    assert got[500] == got[501] == 500 and got[None] == 0
    assert simhash.similar_documents(spark.createDataFrame(rows, SCHEMA).limit(0)).collect() == []


@pytest.mark.parametrize("options", [{}, {"similarity": 0.8, "words": 5}])
def test_null_and_repeated_ids(spark, options):
    """Rows that share an id, or have none, stay if their texts differ; one row of each group of texts stays."""
    r = random.Random(9)
    say = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c, d, e, f = (say() for _ in range(6))
    rows = [(None, a, "k", 1), (None, b, "k", 1), (None, b, "k", 1), (5, c, "k", 1), (5, d, "k", 1), (5, d, "k", 2), (5, e, "k", 1), (2, e, "k", 1), (None, f, "k", 1), (9, f, "k", 1)]
    got = drop_near_duplicates(spark.createDataFrame(rows, SCHEMA), **options).collect()
    assert sorted((x.doc_id or 0, x.text) for x in got) == sorted([(0, a), (0, b), (5, c), (5, d), (2, e), (9, f)])


@pytest.mark.parametrize("group_rows", [1024, 8])
def test_similarity_is_exact(spark, monkeypatch, group_rows):
    """Pairs just above the threshold link, pairs just below do not, and repeats within a text do not count."""
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = []
    for n in range(120):
        base = [word() for _ in range(200)]
        k = 4 if n % 2 else 6  # replaced words far from each other: (196 - 5k) / (196 + 5k) is 0.815 or 0.734
        texts += [base, [word() if i % 30 == 10 and i < 30 * k else w for i, w in enumerate(base)]]
    loud = [word() for _ in range(20)]
    texts += [[word() for _ in range(60)] + loud * 40, [word() for _ in range(60)] + loud * 40]
    base = [word() for _ in range(100)]
    texts += [[*base[:50], f"v{i}", *base[51:]] for i in range(40)]
    rows = [(i, " ".join(t), "k", 1) for i, t in enumerate(texts)]
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    linked = [got[i] == got[i + 1] for i in range(0, 240, 2)]
    assert sum(linked[1::2]) >= 59 and not any(linked[::2])
    assert got[240] != got[241]
    assert {got[i] for i in range(242, 282)} == {242}
