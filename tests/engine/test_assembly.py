import random

import pytest
from pyspark.sql import functions as F

from strandline.plans import assembly as A


def genome(n, seed=1):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def turn(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def cut(g, length, step, circular):
    n = len(g)
    at = range(0, n if circular else n - length + 1, step)
    reads = [(g + g)[i : i + length] for i in at]
    return [(i + 1, turn(s) if i % 3 == 0 else s, len(s)) for i, s in enumerate(reads)]


@pytest.mark.parametrize("circular", [False, True])
def test_contig_is_the_genome(spark, tmp_path, circular):
    g = genome(3000)
    rows = cut(g, 300, 60, circular)
    rows += [(900, g[500:640], 140), (901, turn(g[1000:1200]), 200)]  # contained reads
    reads = spark.createDataFrame(rows, "read_id long, seq string, len long")
    out = A.run(spark, reads, str(tmp_path), len(g), "assemble", {"pacbio"}, k=21, min_overlap=100, min_read_length=100, min_coverage=1, max_kmer_count=50)
    got = out.collect()
    assert len(got) == 1 and got[0]["reads"] == len(rows)
    bases = got[0]["bases"].upper()
    assert any(s in (g + g) for s in (bases[20:2900], turn(bases)[20:2900])) and abs(len(bases) - len(g)) < 400
    # finished stages are read again, not run
    assert A.run(spark, reads.limit(0).withColumn("len", F.col("len")), str(tmp_path), len(g), "assemble", {"pacbio"}, min_coverage=1, min_read_length=100).count() == 1


def test_presets():
    assert A.preset({"nanopore", "pacbio"}).cor_error == 0.3 and A.preset({"hifi"}).compress
    with pytest.raises(ValueError):
        A.preset({"hifi", "pacbio"})
    with pytest.raises(ValueError):
        A.preset({"other"})


def test_low_coverage(spark, tmp_path):
    reads = spark.createDataFrame([(1, "ACGT" * 300, 1200)], "read_id long, seq string, len long")
    with pytest.raises(ValueError, match="coverage"):
        A.run(spark, reads, str(tmp_path), 1e6)
