"""Column functions on sequences, names, CIGARs and error values. All stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Overlap error is an integer in units of 1e-5, capped at 16 bits.
EVALUE_SCALE, EVALUE_MAX = 100_000, 65_535


def reverse_complement(s: Column) -> Column:
    return F.translate(F.reverse(s), "ACGT", "TGCA")


def canonical(s: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(s, reverse_complement(s))


def homopolymer_compress(s: Column) -> Column:
    return F.regexp_replace(s, r"(.)\1+", "$1")


def trim_n(s: Column) -> Column:
    return F.regexp_replace(s, "^[Nn]+|[Nn]+$", "")


def normalise_bases(s: Column) -> Column:
    """Upper case, U as T."""
    return F.translate(F.upper(s), "U", "T")


def valid_bases(s: Column) -> Column:
    return s.rlike("^[ACGTNacgtn]*$")


def clear_range(s: Column, bgn: Column, end: Column) -> Column:
    return F.substring(s, bgn + 1, end - bgn)


def sanitise_name(s: Column) -> Column:
    """White space and slashes are not allowed in library names."""
    return F.regexp_replace(s, r"[\s/]", "_")


def encode_evalue(erate: Column) -> Column:
    return F.least(F.lit(EVALUE_MAX), F.floor(erate * EVALUE_SCALE + 0.5)).cast("int")


def decode_evalue(evalue: Column) -> Column:
    return evalue / F.lit(float(EVALUE_SCALE))


def mapq(placements: Column) -> Column:
    return F.when(placements <= 1, F.lit(60)).otherwise(F.floor(-10 * F.log10(1 - 1 / placements))).cast("int")


def _cigar_sum(cigar: Column, ops: str) -> Column:
    found = F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{ops}]"), 1)
    return F.aggregate(found, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def cigar_query_length(c: Column) -> Column:
    return _cigar_sum(c, "MIS=X")


def cigar_reference_length(c: Column) -> Column:
    return _cigar_sum(c, "MDN=X")


def cigar_align_length(c: Column) -> Column:
    return _cigar_sum(c, "MIDN=X")


def tag_value(tags: Column, name: str) -> Column:
    """Value of a NN:T:value tag in a tab-separated list."""
    return F.regexp_extract(tags, rf"(?:^|\t){name}:[A-Za-z]:([^\t]*)", 1)


def tig_number(name: Column) -> Column:
    """Number of a name like tig00000012, utg3 or ctg4."""
    return F.regexp_extract(name, r"^(?:tig|utg|ctg)0*([0-9]+)", 1).try_cast("bigint")


def scaled_number(text: str) -> float:
    """A number with a suffix k, m, g or t (thousands)."""
    text = text.strip().lower().removesuffix("b").removesuffix("p")
    power = {"k": 3, "m": 6, "g": 9, "t": 12}.get(text[-1:], 0)
    return float(text[:-1] if power else text) * 10**power


def haplotype_k(genome_size: float, error: float = 0.01) -> int:
    """Shortest k for which a random match in the genome is rarer than ``error``."""
    return math.ceil(math.log(genome_size * (1 - error) / error) / math.log(4))


def seed_minimum(k: int, erate: float, length: Column, least: int) -> Column:
    """Shared seeds that an overlap of ``length`` at ``erate`` is expected to have, ``least`` at least."""
    return F.greatest(F.lit(least), F.floor(F.lit(math.exp(-k * erate)) * (length - k + 1)).cast("int"))


def binomial_bound(length: int, erate: float, tail: float = 1e-4) -> int:
    """Least e so that more than e errors in ``length`` bases at ``erate`` are rarer than ``tail``."""
    if length <= 0:
        return 0
    if length * erate > 400:  # (1 - erate) ** length underflows: the normal distribution has the same tail there
        from statistics import NormalDist

        return min(length, math.ceil(length * erate - NormalDist().inv_cdf(tail) * math.sqrt(length * erate * (1 - erate))))
    p, total = (1 - erate) ** length, 0.0
    for e in range(length + 1):
        total += p
        if 1 - total < tail:
            return e
        p *= (length - e) / (e + 1) * erate / (1 - erate)
    return length
