"""Overlap geometry as column functions.

Columns: a_id, b_id, ahg5, ahg3, bhg5, bhg3 (unaligned bases at each end), flipped, evalue, span.
Two notions of dovetail exist side by side: by unaligned ends (an end of either read reaches) and by
signed hangs (both strictly of one sign); they have different names here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .seq import decode_evalue

c = F.col


def a_hang() -> Column:
    return c("ahg5") - c("bhg5")


def b_hang() -> Column:
    return c("bhg3") - c("ahg3")


def a_bgn() -> Column:
    return c("ahg5")


def a_end(a_len: Column) -> Column:
    return a_len - c("ahg3")


def b_bgn(b_len: Column) -> Column:
    """Of a flipped overlap begin is above end."""
    return F.when(c("flipped"), b_len - c("bhg5")).otherwise(c("bhg5"))


def b_end(b_len: Column) -> Column:
    return F.when(c("flipped"), c("bhg3")).otherwise(b_len - c("bhg3"))


def a_aligned(a_len: Column) -> Column:
    return a_len - c("ahg5") - c("ahg3")


def b_aligned(b_len: Column) -> Column:
    return b_len - c("bhg5") - c("bhg3")


def aligned(a_len: Column, b_len: Column) -> Column:
    return F.floor((a_aligned(a_len) + b_aligned(b_len)) / 2)


def reaches_ends() -> Column:
    """Dovetail or containment by unaligned ends."""
    return ((c("ahg5") == 0) | (c("bhg5") == 0)) & ((c("ahg3") == 0) | (c("bhg3") == 0))


def partial() -> Column:
    return ((c("ahg5") > 0) & (c("bhg5") > 0)) | ((c("ahg3") > 0) & (c("bhg3") > 0))


def a_contained() -> Column:
    return (c("ahg5") == 0) & (c("ahg3") == 0)


def a_container() -> Column:
    return (c("bhg5") == 0) & (c("bhg3") == 0)


def at_a5() -> Column:
    return (c("bhg5") > 0) & (c("ahg3") > 0)


def at_a3() -> Column:
    return (c("ahg5") > 0) & (c("bhg3") > 0)


# by signed hangs


def hang_dovetail() -> Column:
    return ((a_hang() < 0) & (b_hang() < 0)) | ((a_hang() > 0) & (b_hang() > 0))


def hang_a5() -> Column:
    return (a_hang() < 0) & (b_hang() < 0)


def hang_a3() -> Column:
    return (a_hang() > 0) & (b_hang() > 0)


def hang_a_contained() -> Column:
    return (a_hang() <= 0) & (b_hang() >= 0)


def hang_a_container() -> Column:
    return (a_hang() >= 0) & (b_hang() <= 0)


def overlap_length(a_len: Column, b_len: Column) -> Column:
    """The larger number of bases covered on either read, by the four sign cases, within [0, length]."""
    a, b = a_hang(), b_hang()
    on_a = F.when(a < 0, F.when(b < 0, a_len + b).otherwise(a_len)).otherwise(F.when(b < 0, a_len - a + b).otherwise(a_len - a))
    on_b = F.when(a < 0, F.when(b < 0, b_len + a).otherwise(b_len + a - b)).otherwise(F.when(b < 0, b_len).otherwise(b_len - b))
    return F.greatest(F.greatest(F.lit(0), F.least(on_a, a_len)), F.greatest(F.lit(0), F.least(on_b, b_len)))


def overlap_score(side_aligned: Column, read_len: Column) -> Column:
    return F.floor(16384.0 * (1 - decode_evalue(c("evalue"))) * side_aligned / read_len).cast("int")


def edge_score(a_len: Column) -> Column:
    """Length of a dovetail on its read, then accuracy, as one number to compare."""
    length = F.when(hang_dovetail(), F.when(a_hang() > 0, a_len - a_hang()).otherwise(a_len + b_hang())).otherwise(F.lit(0))
    return length * F.lit(65536) + (F.lit(65535) - c("evalue"))


def twins(overlaps: DataFrame) -> DataFrame:
    """Each overlap seen from its other read."""
    f = c("flipped")
    swapped = {
        "a_id": c("b_id"),
        "b_id": c("a_id"),
        "ahg5": F.when(f, c("bhg3")).otherwise(c("bhg5")),
        "ahg3": F.when(f, c("bhg5")).otherwise(c("bhg3")),
        "bhg5": F.when(f, c("ahg3")).otherwise(c("ahg5")),
        "bhg3": F.when(f, c("ahg5")).otherwise(c("ahg3")),
    }
    return overlaps.select(*[swapped.get(x, c(x)).alias(x) for x in overlaps.columns])
