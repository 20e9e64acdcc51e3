import random
import zlib

import numpy as np

from strandline.llm import language as L

SCHEMA = "doc_id long, text string, lang string, score string"
WORDS = {"xx": ["thé", "qua", "rond", "lire"], "yy": ["bok", "strum", "hvad", "ÆØ"], "zz": ["ona", "lita", "pero", "mas"]}


def corpus(n=240):
    r = random.Random(2)
    rows = []
    for i in range(n):
        k = r.choice(sorted(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[k]) for _ in range(r.randint(3, 60))), k, "clash"))
    return rows


def plain_bits(counts, text, used):
    """Code length by walking the contexts of each byte, with the classes of the model."""
    b = b"\0\0\0" + text
    total = 0.0
    for i in range(3, len(b)):
        p = np.full(256, 1 / 256)
        for order in range(4):
            c = np.zeros(256)
            for g, n in counts.items():
                if order == 0 or (g[3 - order : 3] == b[i - order : i]):
                    c[g[3]] += n
            if order == 3 and c.sum() == 0 or c.sum() == 0:
                continue
            seen = c > 0
            d = seen.sum()
            rest = p[~seen].sum()
            p = np.where(seen, c / (c.sum() + d), d / (c.sum() + d) * p / rest)
        total -= np.log2(p[b[i]])
    return total


def test_code_lengths():
    train = [b"abracadabra", b"abba cada", b"brab"]
    counts = {}
    for t in train:
        for g, n in zip(*L.gram_counts(t), strict=True):
            k = int(g).to_bytes(4, "big")
            counts[k] = counts.get(k, 0) + int(n)
    g = np.array(sorted(int.from_bytes(k, "big") for k in counts), np.int64)
    m = L.build({"a": (g, np.array([counts[int(x).to_bytes(4, "big")] for x in g]))})
    for t in (b"abra", b"cadab rab", b"abraz", b"a", b"brabra abba" * 5):
        assert abs(m.lengths([t])[0, 0] - plain_bits(counts, t, None)) < 0.01 * len(t) + 0.05
    both = m.lengths([b"abra", b"cadab rab"])
    assert np.allclose(both[:, 0], [m.lengths([b"abra"])[0, 0], m.lengths([b"cadab rab"])[0, 0]])


def test_contexts_of_other_languages():
    """A context that does not occur in a language falls back as if the tables had none of it; any number of languages."""
    r = random.Random(7)
    texts = {f"l{k:02d}": " ".join("".join(r.choice("abcdefgh"[k % 4 : k % 4 + 4]) for _ in range(5)) for _ in range(6)).encode() for k in range(70)}
    grams = {k: L.gram_counts(t) for k, t in texts.items()}
    m = L.build(grams)
    some = b"abcd efg gfe dcba"
    got = m.lengths([some])[0]
    assert len(got) == 70
    for i, k in enumerate(m.languages):
        if i % 9 == 0:
            counts = {int(g).to_bytes(4, "big"): int(n) for g, n in zip(*grams[k], strict=True)}
            assert abs(got[i] - plain_bits(counts, some, None)) < 0.01 * len(some) + 0.05
    assert all(m.languages[int(m.lengths([t])[0].argmin())] == k for k, t in texts.items())


def test_segments(monkeypatch):
    rows = corpus(60)
    g = [np.concatenate([x.encode() and L.gram_counts(x.encode())[0] for _, x, k, _ in rows if k == lang]) for lang in sorted(WORDS)]
    m = L.build({k: np.unique(x, return_counts=True) for k, x in zip(sorted(WORDS), g, strict=True)})
    text = " ".join(x for _, x, *_ in rows).encode()
    whole = m.lengths([text, b"bok", text[:99]])
    monkeypatch.setattr(L, "SEGMENT", 64)
    assert np.allclose(whole, m.lengths([text, b"bok", text[:99]]))


def test_held_out_accuracy(spark):
    rows = corpus() + [(900, None, "xx", ""), (901, "", None, ""), (902, "123 ?!", "yy", ""), (None, "bok strum", None, ""), (903, "bok strum hvad " * 20000, None, ""), (5, corpus()[5][1], corpus()[5][2], "")]
    got = L.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902)) and by[903].lang_pred == "yy" and by[None].held_out is False
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got if r.doc_id is not None)
    held = [(by[i].lang_pred, k) for i, _, k, _ in rows[:240] if by[i].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95


def test_keep_and_empty(spark):
    rows = corpus() + [(900, None, "xx", ""), (902, "123 ?!", "yy", ""), (903, "bok strum", None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = L.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {900, 902}
    assert L.identify(df.limit(0)).collect() == [] and L.keep_identified(df.limit(0)).collect() == []
    none = df.withColumn("lang", df["lang"].substr(1, 0).cast("string")).selectExpr("doc_id", "text", "cast(null as string) lang", "score")
    assert {r.lang_pred for r in L.identify(none).collect()} == {"und"}
