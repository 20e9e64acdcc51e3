import random
from collections import defaultdict

import numpy as np

from strandline.llm import passages as p

SCHEMA = "doc_id long, text string, kept string, h int"


def word(r):
    return "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7)))


def corpus():
    r = random.Random(3)
    say = lambda n: [word(r) for _ in range(n)]
    docs = [say(r.randint(0, 300)) for _ in range(80)]
    shared = [say(n) for n in (50, 60, 80, 200)]
    planted = defaultdict(list)
    for k, s in enumerate(shared):
        for i in r.sample(range(80), 6):
            at = r.randint(0, len(docs[i]))
            docs[i][at:at] = s
            planted[k].append(i)
    rows = [(i, " ".join(d).capitalize(), "clash", 1) for i, d in enumerate(docs)]
    clean = [i for i in range(80) if not any(i in v for v in planted.values())]
    rows += [(80, None, None, 1), (81, "", None, 1), (82, "few words only", None, 1), (83, "few words only", None, 1)]
    rows += [(7, rows[7][1], "clash", 1), (None, rows[8][1], None, 1), (84, "one two three " * 30000, None, 1), (85, "one two three " * 200, None, 1)]
    return rows, shared, planted, clean


def test_planted_and_clean(spark):
    rows, shared, planted, clean = corpus()
    got = p.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for s, ids in zip(shared, planted.values(), strict=True):
        for i in ids:
            assert any(r.kept == (i == min(ids)) or r.component_id <= min(ids) for r in by[i]), (i, ids)
    assert not set(clean) & set(by)
    assert {84, 85} <= set(by) and not {80, 81, 82, 83, None} & set(by)
    assert all(r.n_words == r.end_word - r.start_word >= p.WORDS for r in got)


def test_exact_classes(spark):
    """Every paragraph of two documents is found, by a plain count over all paragraphs."""
    rows, *_ = corpus()
    seen = defaultdict(set)
    for i, t, *_ in rows:
        words = (t or "").encode().translate(p.TABLE).split()
        for c in p.cut([(t or "").encode()] if i is not None else []):
            for a in c.pos:
                seen[tuple(words[a : a + p.WORDS])].add((i, int(a)))
    want = {(i, a) for v in seen.values() if len({i for i, _ in v}) > 1 for i, a in v}
    runs = p.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    cover = defaultdict(list)
    for r in runs:
        cover[r.doc_id].append((r.start_word, r.end_word))
    assert all(any(lo <= a and a + p.WORDS <= hi for lo, hi in cover[i]) for i, a in want)
    kept = {i for v in seen.values() if len({i for i, _ in v}) > 1 for i in [min(i for i, _ in v)]}
    assert kept <= {r.doc_id for r in runs if r.kept}


def test_near_paragraphs_and_blocks(spark, monkeypatch):
    """A paragraph with its last word changed links by Jaccard; one with half its words changed does not. Blocks and dealt out keys make no difference."""
    r = random.Random(8)
    base = [word(r) for _ in range(p.WORDS)]
    near = base[:-1] + ["zz"]
    far = base[: p.WORDS // 2] + [word(r) for _ in range(p.WORDS // 2)]
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in (("b", base), ("n", near), ("f", far))}
    j = lambda x, y: len(sets[x] & sets[y]) / len(sets[x] | sets[y])
    assert j("b", "n") >= 0.8 > j("b", "f")
    rows = [(i, " ".join(base[:-1] + [f"v{i}"]), None, 0) for i in range(40)] + [(100, " ".join(far), None, 0)]
    for size in (1024, 8):
        monkeypatch.setattr(p, "BUCKET_ROWS", size)
        if size == 8:  # all classes are sampled, and keys of three paragraphs are hot
            monkeypatch.setattr(p, "SAMPLED", 1)
            monkeypatch.setattr(p, "HOT_ROWS", 3)
        got = p.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
        ids = {x.doc_id for x in got}
        assert 100 not in ids and len(ids) >= 38 and len({x.component_id for x in got}) == 1


def test_cut_and_empty(spark):
    rows, shared, planted, _ = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    out = p.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    by = {r.doc_id: r.text for r in out.collect()}
    gone = {i: sum(r.n_words for r in p.repeated_passages(df).where(f"doc_id = {i} and not kept").collect()) for i in planted[3][:3]}
    for i, n in gone.items():
        assert len((by[i] or "").split()) == len(rows[i][1].split()) - n
    assert p.repeated_passages(df.limit(0)).collect() == []


def test_starts():
    """Cut alone or among others, a text has the same paragraphs, and no SPAN of starts is without one."""
    r = random.Random(1)
    texts = [" ".join(word(r) for _ in range(n)).encode() for n in (5000, 0, 24, 30, 49, 50, 23, 400)] + [None]
    together = {(int(t), int(a)) for c in p.cut(texts) for t, a in zip(c.text, c.pos, strict=True)}
    alone = {(i, int(a)) for i, t in enumerate(texts) for c in p.cut([t]) for a in c.pos}
    assert together == alone
    for i, t in enumerate(texts):
        n = len((t or b"").split())
        at = sorted(a for d, a in alone if d == i)
        assert (len(at) > 0) == (n >= p.WORDS)
        if at:
            assert at[0] < p.SPAN and at[-1] <= n - p.WORDS < at[-1] + p.SPAN and all(b - a <= p.SPAN for a, b in zip(at, at[1:]))
    long = [b"x" * (p.BLOCK + 5) + b" y" * 40]
    assert sum(len(c.at) for c in p.cut(long)) > 0


def test_band_recall():
    """Of pairs of paragraphs at the least Jaccard similarity from 0.8 on (18 of 22 shingles), 0.98 and more meet in a band."""
    r = np.random.default_rng(4)
    met, n = 0, 1500
    for _ in range(n):
        x = p.mix(r.integers(1, 1 << 63, p.SET + 2, dtype=np.uint64))
        a, b = (p.band_keys(s, np.array([0])) for s in (x[: p.SET], x[2:]))
        met += bool((a == b).any())
    assert met >= 0.98 * n


def test_near_pairs_against_all_pairs(spark):
    """Two documents of one paragraph each, many times over: pairs from 0.8 on link with 0.98 and more, those below never."""
    r = random.Random(21)
    rows, near = [], {}
    for i in range(400):
        base = [word(r) + str(i) for _ in range(p.WORDS)]
        other = list(base)
        for k in r.choice([[0], [p.WORDS - 1], [1], [0, p.WORDS - 1], [12], [0, 1]]):
            other[k] = "changed"
        sets = [{tuple(w[j : j + 5]) for j in range(p.WORDS - 4)} for w in (base, other)]
        near[i] = len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.8
        rows += [(2 * i, " ".join(base), "k", 1), (2 * i + 1, " ".join(other), "k", 1)]
    got = {x.doc_id: x.component_id for x in p.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    linked = {i for i in near if 2 * i in got and got[2 * i] == got.get(2 * i + 1)}
    assert set(got) == {x for i in linked for x in (2 * i, 2 * i + 1)}
    assert not linked & {i for i, x in near.items() if not x}
    assert len(linked) >= 0.98 * sum(near.values()) > 100
