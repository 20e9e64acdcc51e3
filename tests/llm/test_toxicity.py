import random
import zlib

import numpy as np
import zstandard

from strandline.llm import toxicity as X

DOC, LABEL = "doc_id long, text string, score string", "doc_id long, toxic int, quality int"


def corpus(n=900):
    r = random.Random(4)
    word = lambda: "".join(r.choice(["ba", "ne", "ti", "lo", "ra", "mu", "so"]) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(10, 200))]
        bad = i % 4 == 0
        for _ in range(r.randint(2, 6) if bad else 0):
            w[r.randrange(len(w))] = r.choice(["vilefoo", "scumbarq", "hatezzy"])
        docs.append((i, " ".join(w), "clash"))
        labels.append((i, int(bad), 1))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    docs += [(2000, None, ""), (2001, "", ""), (None, "ba ne ti", ""), (2002, "ba ne " * 40000 + "vilefoo", ""), (3, docs[3][1], "")]
    labels += [(5000, 1, 0), (None, 1, 0), (7, None, 0)]
    got = X.toxicity(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [(by[i].predicted, y) for i, y, _ in labels if i in by and by[i].held_out and y is not None]
    assert len(held) > 100
    assert np.mean([p for p, y in held if y]) > 0.9 and np.mean([p for p, y in held if not y]) < 0.05
    assert by[2000].score == by[2001].score and by[2000].predicted == 0


def test_windows():
    text = b"one two  three " * 40 + b"x" * 500
    w = X.windows(text)
    assert b"".join(w) == text and max(map(len, w)) <= X.WINDOW and X.windows(b"") == []


def test_without_labels_or_documents(spark):
    docs, labels = corpus(40)
    a, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)
    assert {r.predicted for r in X.toxicity(a, b.limit(0)).collect()} == {0}
    assert {r.predicted for r in X.toxicity(a, b.where("toxic = 1")).collect()} == {0}
    assert X.toxicity(a.limit(0), b).collect() == []


def plain_length(window, content):
    """Length of a window's frame by a compressor that is made for it alone."""
    made = zstandard.ZstdCompressionParameters.from_level(X.LEVEL, source_size=X.WINDOW, dict_size=len(content), min_match=X.MATCH, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=made)
    return len(zstandard.ZstdCompressor(dict_data=d, compression_params=made).compress(window))


def test_distances_are_differences_of_compressed_lengths():
    docs, labels = corpus(300)
    toxic = [[w for (i, t, _), (_, y, _) in zip(docs, labels) if y and i % 8 // 4 == h for w in X.windows(t.encode())] for h in (0, 1)]
    ordinary = [[w for (i, t, _), (_, y, _) in zip(docs, labels) if not y and i % 2 == h for w in X.windows(t.encode())] for h in (0, 1)]
    history = X.trained(ordinary[0], 4096)
    o, t = X.dictionaries(toxic, ordinary, history)
    assert len(o) == len(t) == X.ROUNDS[-1][0] and (o, t) == X.dictionaries(toxic, ordinary, history)
    some = [*toxic[0][:40], *ordinary[1][:40], b"x", b"vilefoo " * 4]
    assert X.Distance(o, t, history).of(some).tolist() == [plain_length(w, o + history) - plain_length(w, t + history) for w in some]


def test_text_ids(spark):
    docs, labels = corpus(300)
    a = spark.createDataFrame([(f"d{i}", t) for i, t, _ in docs], "doc_id string, text string")
    b = spark.createDataFrame([(f"d{i}", y) for i, y, _ in labels], "doc_id string, toxic int")
    assert X.toxicity(a, b).count() == 300
