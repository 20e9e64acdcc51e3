import math

import numpy as np
import pytest

from strandline.llm import embeddings as e

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def plain(rows, threshold=0.9):
    """Links and components of all pairs in double precision."""
    ok = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, up = dict.fromkeys([i for i, *_ in rows], 0), {i: i for i, *_ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a][1], ok[b][1]
            if len(x) == len(y) and (x @ y) / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[ok[a][0]] += 1
                links[ok[b][0]] += 1
                p, q = top(ok[a][0]), top(ok[b][0])
                up[max(p, q)] = min(p, q)
    return {i: (links[i], top(i) if i is not None else None) for i in links}


def corpus():
    r = np.random.default_rng(1)
    out = []
    for c in range(25):
        x = r.standard_normal(64)
        for _ in range(r.integers(1, 40)):
            out.append((x + 0.15 * r.standard_normal(64)).astype(np.float32).tolist())
    out += [out[0], out[0], [2 * x for x in out[1]], [0.0] * 64, None, [], [float("nan")] + [1.0] * 63, [float("inf")] * 64, [None] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]
    rows = [(i, v, 1, "clash") for i, v in enumerate(out)]
    return [*rows, (None, out[2], 0, None)]


@pytest.mark.parametrize("size", [2048, 20])
def test_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(e, "BUCKET_ROWS", size)
    rows = corpus()
    got = {r.vec_id: r for r in e.similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for i, (n, c) in want.items():
        assert got[i].n_links <= n and got[i].kept == (i == got[i].component_id)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) > 0.99


def test_estimates():
    """Estimates from codes and factors alone are unbiased, also between vectors that are close; bounds hold."""
    r = np.random.default_rng(2)
    v = r.standard_normal((400, 64))
    v[200:] = v[:200] + 0.3 * r.standard_normal((200, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    near, off, held = [], [], []
    for seed in range(6):
        frame, _ = e.rotations(64, 8, 9, seed)
        bits, factor = e.coded(v, frame)
        one, two = e.estimates(bits, factor, frame, 64)
        wrong = one @ two.T - v @ v.T
        near.append(wrong[np.arange(200), 200 + np.arange(200)].mean())
        off.append(wrong[~np.eye(400, dtype=bool)].mean())
        held.append((e.upper_bounds(bits, factor, frame, 64) >= v @ v.T).mean())
    assert abs(np.mean(near)) < 0.01 and abs(np.mean(off)) < 0.003 and min(held) > 0.995


def test_empty(spark):
    assert e.similar_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
