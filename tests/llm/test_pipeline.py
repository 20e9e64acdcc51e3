import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from strandline.llm import components  # noqa: E402
from strandline.llm.common import load, staged  # noqa: E402
from strandline.llm.components import connected_components  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = load(spark, SF, "documents")
    columns = docs.columns
    before = {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = staged(stage(spark, docs, SF), name)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids and ids <= before
        before = ids
        assert docs.columns == (columns if k < 4 else [*columns, "copy"])
    again = {(r.doc_id, r.copy) for r in corpus_pipeline.run(spark, SF).collect()}
    assert again == {(r.doc_id, r.copy) for r in docs.collect()}


def test_components(spark):
    e = [(i, i + 1) for i in range(50)] + [(200, 201), (-5, -9), (-9, 3), (8, 8)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got[i] == -9 for i in range(51)) and got[201] == 200 and len(got) == 55
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("small", [1 << 20, 5])
def test_bounded_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL_EDGES", small)
    r = random.Random(1)
    e = [(r.randrange(300), r.randrange(300)) for _ in range(170)]
    df = spark.createDataFrame(e, "a long, b long").repartition(5)
    want = {x.node: x.component for x in connected_components(df).collect()}
    got = {x.node: x.component for x in components.bounded_components(df).collect()}
    assert got == want
    assert components.bounded_components(df.limit(0)).collect() == []
