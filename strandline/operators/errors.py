"""Error detection by votes of aligned reads, error-adjusted overlaps, and consensus by tig."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.seq import EVALUE_SCALE
from .kernels.align import align, edit_distance
from .kernels.consensus import consensus, stitch

VOTES = ("deletes", "a_subst", "c_subst", "g_subst", "t_subst", "confirmed", "no_insert")
#: Bases at both ends of an alignment that do not vote.
FLANK = 5


@F.pandas_udf(T.IntegerType())
def distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x, y) for x, y in zip(a, b, strict=True)])


def votes(pairs: DataFrame) -> DataFrame:
    """(read_id, pos, vote, base, n) of pairs (read_id, seq, other): each other read is aligned and votes on every base but the flanks.

    A join brings the pairs, Arrow batches align them, one aggregation counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, seq, other in pdf.itertuples(index=False):
                _, _, ops = align(seq, other)
                for k, at, base in ops[FLANK : len(ops) - FLANK]:
                    vote = {"=": "confirmed", "D": "deletes", "I": "insert"}.get(k) or f"{base.lower()}_subst"
                    rows.append((i, at, vote, base if vote == "insert" else None))
            yield pd.DataFrame(rows, columns=["read_id", "pos", "vote", "base"])

    cast = pairs.select("read_id", "seq", "other").mapInPandas(run, "read_id bigint, pos int, vote string, base string")
    return cast.groupBy("read_id", "pos", "vote", "base").agg(F.count(F.lit(1)).alias("n"))


def tally(cast: DataFrame) -> DataFrame:
    """One row for each (read_id, pos) with a count for each vote."""
    return cast.groupBy("read_id", "pos").pivot("vote", list(VOTES)).agg(F.sum("n")).na.fill(0, list(VOTES))


def check_del_subst(base: Column, expected: int = 1, confirm: int = 5) -> Column:
    """The majority vote (deletes or a substitution) that changes ``base``, else null.

    Not if it says what is there, is alone, has no majority, is one of ``expected`` alleles or more with
    ``confirm`` votes, or is weak against a confirmation.
    """
    c = F.col
    five = [c(v) for v in VOTES[:5]]
    top = F.greatest(*five)
    total = sum(five[1:], five[0]) + c("confirmed")
    winner = F.when(c("deletes") == top, "deletes")
    for v in VOTES[1:5]:
        winner = winner.when(c(v) == top, v)
    alleles = sum(((x >= confirm).cast("int") for x in five[1:]), (five[0] >= confirm).cast("int"))
    same = winner == F.concat(F.lower(base), F.lit("_subst"))
    ok = ~same & (total > 1) & (2 * top > total) & (alleles < expected) & ~((c("confirmed") == 1) & (top <= 6))
    return F.when(ok, winner)


def check_insert(inserts: DataFrame, votes: DataFrame, expected: int = 1, confirm: int = 5, strong: int = 2) -> DataFrame:
    """(read_id, pos, ins): insertions to make, of counts (read_id, pos, ins, n) and of votes against any (read_id, pos, no_insert, conf_no_insert).

    Not if the position is confirmed as it is, if there is one vote alone, if the most frequent insertion has no majority, if ``expected``
    alleles or more have ``confirm`` votes (none counts as one), or if it is weak against a confirmation. Of equals the least is taken.
    """
    top = F.min(F.struct((-F.col("n")).alias("neg"), "ins")).alias("top")
    per = inserts.groupBy("read_id", "pos").agg(F.sum("n").alias("total"), F.count_if(F.col("n") >= confirm).alias("alleles"), top)
    j = per.join(votes.select("read_id", "pos", "no_insert", "conf_no_insert"), ["read_id", "pos"], "left").na.fill(0, ["no_insert", "conf_no_insert"])
    most = -F.col("top.neg")
    alleles = F.col("alleles") + (F.col("no_insert") >= confirm).cast("int")
    ok = (F.col("conf_no_insert") < strong) & (F.col("total") > 1) & (2 * most > F.col("total") + F.col("no_insert")) & (alleles < expected)
    return j.where(ok & ~((F.col("conf_no_insert") == 1) & (most <= 6))).select("read_id", "pos", "top.ins")


def frozen_deletes(votes: DataFrame, confirm: int = 5, freeze: int = 1) -> DataFrame:
    """(read_id, pos): positions within ``freeze`` of one where ``confirm`` votes say it is deleted and as many that it is not; no deletion is made there."""
    five = [F.col(v) for v in (*VOTES[1:5], "confirmed")]
    het = votes.where((F.col("deletes") >= confirm) & (sum(five[1:], five[0]) >= confirm))
    near = F.explode(F.sequence(F.col("pos") - freeze, F.col("pos") + freeze)).alias("pos")
    return het.select("read_id", near).distinct().join(votes.select("read_id", "pos"), ["read_id", "pos"], "left_semi")


def corrected_evalues(overlaps: DataFrame) -> DataFrame:
    """(a_id, b_id, flipped, evalue) of overlapping parts (aseq, bseq) aligned anew: differences over alignment length."""
    d = distance("aseq", "bseq")
    n = F.greatest(F.length("aseq"), F.length("bseq"))
    return overlaps.select("a_id", "b_id", "flipped", F.least(F.lit(65535), F.floor(d / n * EVALUE_SCALE + 0.5)).cast("int").alias("evalue"))


def apply_edits(seq: str, edits: list[tuple[int, str]]) -> str:
    """Edits (position, new bases), each in place of one base; an empty string deletes."""
    out, at = [], 0
    for pos, new in sorted(edits):
        out += [seq[at:pos], new]
        at = pos + 1
    return "".join([*out, seq[at:]])


def fix_reads(reads: DataFrame, edits: DataFrame) -> DataFrame:
    """Reads (read_id, seq) with their edits (read_id, pos, new) applied; a read has no more edits than bases."""
    lists = edits.groupBy("read_id").agg(F.collect_list(F.struct("pos", "new")).alias("edits"))

    @F.pandas_udf("string")
    def fixed(seq: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([s if x is None else apply_edits(s, [(r["pos"], r["new"]) for r in x]) for s, x in zip(seq, e, strict=True)])

    return reads.join(lists, "read_id", "left").withColumn("seq", fixed("seq", "edits")).drop("edits")


def tig_consensus(placed: DataFrame, max_coverage: int = 50) -> DataFrame:
    """(tig_id, bases, quality) of reads (tig_id, read_id, lo, hi, seq), stitched and voted; a tig is one task's work.

    ``max_coverage`` bounds a tig by its length: excess reads are dropped beforehand (drop_excess_coverage).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["lo"], pdf["hi"], pdf["seq"], strict=True))
        bases, quality = consensus(stitch(rows), [r[2] for r in rows], rounds=1)
        return pd.DataFrame([(pdf["tig_id"].iloc[0], bases, "".join(chr(33 + min(60, q)) for q in quality))], columns=["tig_id", "bases", "quality"])

    return placed.select("tig_id", "lo", "hi", "seq").groupBy("tig_id").applyInPandas(run, "tig_id bigint, bases string, quality string")


def template_consensus(evidence: DataFrame, min_coverage: int = 4) -> DataFrame:
    """(read_id, seq): templates (read_id, template, others) corrected by their evidence, longest part in upper case."""

    @F.pandas_udf("string")
    def corrected(template: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([consensus(t, list(o), rounds=1, min_coverage=min_coverage)[0] for t, o in zip(template, others, strict=True)])

    good = F.regexp_extract_all(corrected("template", "others"), F.lit("([ACGT]+)"), 1)
    return evidence.select("read_id", F.element_at(F.array_sort(good, lambda a, b: F.length(b) - F.length(a)), 1).alias("seq"))
