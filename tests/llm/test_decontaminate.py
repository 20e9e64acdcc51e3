import random
import re

import pytest

from strandline.llm import decontaminate as d

DOC, ITEM = "doc_id long, text string, n_hit string", "item_id long, text string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(text, bench, window=13):
    w, hit, items = words(text), set(), set()
    for i, t in bench:
        b = words(t)
        for win in {tuple(b[k : k + window]) for k in range(max(1, len(b) - window + 1))} if b else ():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    items.add(str(i))
    return len(w), len(hit), sorted(items)


def cases():
    r = random.Random(4)
    word = lambda: r.choice(["the", "of", "Ça", "été", "x1", "q"])
    bench = [(i, " ".join(word() for _ in range(r.choice([1, 5, 13, 20, 40])))) for i in range(12)] + [(12, None), (13, ""), (14, "?!"), (None, "the of")]
    docs = []
    for i in range(60):
        t = [word() for _ in range(r.randint(0, 80))]
        for _ in range(r.choice([0, 1, 2])):
            k = r.randint(0, len(t))
            t[k:k] = (bench[r.randrange(12)][1] or "").upper().split()
        docs.append((i, r.choice([" ", " -- ", "\n"]).join(t), "clash"))
    return [*docs, (60, None, None), (61, "", None), (None, bench[2][1], None), (5, docs[5][1], None), (62, "word " * 40000 + bench[4][1], None)], bench


@pytest.mark.parametrize("chars", [4_000_000, 300])
def test_against_all_windows(spark, chars):
    docs, bench = cases()
    got = d.decontamination_report(spark.createDataFrame(docs, DOC), spark.createDataFrame(bench, ITEM), max_pattern_chars=chars).collect()
    bench = [b for b in bench if b[0] is not None]
    key = lambda x: str(x[:4])
    want = sorted(((i, *plain(t, bench)) for i, t, _ in docs), key=key)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in got), key=key) == want
    for r in got:
        text = next(t for i, t, _ in docs if i == r.doc_id) or ""
        assert sum(len(words(text[s.lo : s.hi])) for s in r.spans) == r.n_hit
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) and r.n_items == len(r["items"])


def test_drop_and_empty(spark):
    docs, bench = cases()
    a, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(bench, ITEM)
    report = d.decontamination_report(a, b)
    kept = d.drop_contaminated(a, b)
    assert kept.columns == a.columns and kept.count() == report.where("n_hit = 0").count()
    assert d.drop_contaminated(a, b, share=20).count() == report.where("not contaminated").count()
    assert d.drop_contaminated(a, b.limit(0)).count() == len(docs)
    assert d.drop_contaminated(a.limit(0), b).count() == 0


def test_one_window_in_a_long_document_is_enough_to_drop_it(spark):
    item = " ".join(f"w{k}" for k in range(30))
    own = [f"own{k}" for k in range(2000)]
    rows = [(1, " ".join(own[:1200] + item.upper().split()[5:18] + own[1200:]), "x"), (2, " ".join(own[:1200] + item.split()[5:17] + own[1200:]), "x"), (3, None, "x"), (4, "", "x")]
    a, b = spark.createDataFrame(rows, DOC), spark.createDataFrame([(1, item)], ITEM)
    assert {r.doc_id for r in d.drop_contaminated(a, b).collect()} == {2, 3, 4}
    assert {r.doc_id for r in d.drop_contaminated(a, b, share=20).collect()} == {1, 2, 3, 4}
