import random
from collections import defaultdict

import pytest

from strandline.llm import lines as N

SCHEMA = "doc_id long, text string, source string, n_lines int"


def corpus():
    r = random.Random(3)
    common = {k: f"common line number {k} of the sites" for k in range(1, 25)}
    rows = []
    for i in range(400):
        own = [f"own line {i} {k} with words" for k in range(r.randint(0, 4))]
        own += [common[k] for k in common if r.random() < k / 60]
        r.shuffle(own)
        rows.append((i, "\n".join(own), f"s{r.randrange(24)}", 1))
    return [*rows, (900, None, "s1", 1), (901, "", "s2", 1), (902, " \n\n", None, 1), (None, common[24], "s3", 1), (903, f"{common[24]}\n{common[23]}", None, 1), (5, rows[5][1], rows[5][2], 1), (904, "z" * 200000, "s1", 1)]


def plain(rows, sites):
    where, first = defaultdict(set), {}
    for i, t, s, _ in rows:
        for k, x in enumerate((t or "").split("\n")):
            x = x.strip(" ")
            if len(x) >= N.MIN_CHARS:
                where[x].add(s)
                at = (i is None, i or 0, k)
                first[x] = min(first.get(x, at), at)
    out = []
    for i, t, _, _ in rows:
        keep = [x for k, x in enumerate((t or "").split("\n")) if not (len(where[x.strip(" ")]) >= sites and first[x.strip(" ")] != (i is None, i or 0, k))]
        out.append((i, None if t is None else "\n".join(keep)))
    return out


@pytest.mark.parametrize("sites", [3, 10, 20])
def test_against_counts(spark, sites):
    rows = corpus()
    got = N.clean_lines(spark.createDataFrame(rows, SCHEMA), min_sites=sites).collect()
    assert sorted(map(str, ((r.row.doc_id, r.clean) for r in got))) == sorted(map(str, plain(rows, sites)))
    texts = {}
    for i, t, *_ in rows:
        texts[i] = len((t or "").split("\n")) if t is not None else 0
    assert {r.row.doc_id: r["lines"] for r in got} == texts
    assert all(r["lines"] - r.removed == (len(r.clean.split("\n")) if r.clean else r["lines"] - r.removed) for r in got)


def test_near_the_threshold(spark):
    """Whatever the sketches say, lines near the threshold are counted."""
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    lines = N.line_rows(df)
    exact = {r.h for r in N.spread_of_lines(lines, 12, margin=0.99).collect()}
    assert exact == {r.h for r in N.spread_of_lines(lines, 12).collect()} and exact


def test_drop_only_emptied_and_empty_table(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    out = N.without_boilerplate(df, min_sites=3)
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == df.columns and {900, 901, 902, 904} <= ids
    want = {i for i, t in plain(rows, 3) if t is None or t.strip() or not (dict((r[0], r[1]) for r in rows)[i] or "").strip()}
    assert ids == want
    assert N.line_report(df.limit(0)).collect() == []


def test_clashing_columns_and_long_texts(spark):
    names = ["row", "clean", "lines", "removed", "gone", "gone_id", "gone_key", "id", "key", "h", "n", "pos", "first", "site", "line", "doc_key", "_key", "_d", "_k", "_gone", "_clean", "_lines", "_removed"]
    common = [f"line {k} that all sites have" for k in range(40_000)]
    rows = [(i, "\n".join(common if i < 2 else common[:3]), f"s{i}", *[f"{c} {i}" for c in names]) for i in range(12)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    got = {r.doc_id: r for r in N.without_boilerplate(df, min_sites=10).collect()}
    assert set(got) == {0, 1}  # the others have nothing of their own
    assert got[0].text == rows[0][1] and got[1].text == "\n".join(common[3:])
    assert all(got[i][c] == f"{c} {i}" for i in got for c in names)
