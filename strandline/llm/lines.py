"""Line dedup by distinct-site spread.

Every line's hash gets a HyperLogLog sketch of the sites it occurs on; sketches merge by aggregation,
before and after the shuffle. Lines far above the threshold are boilerplate by their estimate, lines
near it by an exact distinct count. Boilerplate is removed from all documents but the first that has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, staged

#: Sites from which on a line is boilerplate, shortest such line, sketch size (2 ** LG_K registers, about
#: 1.04 / sqrt(2 ** LG_K) relative error) and the part of the threshold around it that is counted exactly (9 sigma).
MIN_SITES, MIN_CHARS, LG_K, MARGIN = 10, 16, 12, 0.15


def _key(text: Column) -> Column:
    return F.xxhash64(F.trim(text))


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, doc_key, pos, h, site) of each line that is long enough; h is a 64-bit hash of the trimmed line.

    A null site is a site of its own. Line breaks are \\n.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("doc_key"), F.concat_ws("", F.when(F.col(site_col).isNull(), F.lit("n")).otherwise(F.lit("s")), F.col(site_col).cast("string")).alias("site"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    return rows.where(F.length(F.trim("line")) >= min_chars).select("doc_id", "doc_key", "pos", _key(F.col("line")).alias("h"), "site")


def spread_of_lines(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, lg_k: int = LG_K) -> DataFrame:
    """(h, n, first) of boilerplate lines: n occurrences, first = (doc_id, doc_key, pos) of the kept one."""
    per = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_key", "pos")).alias("first"))
    per = per.where(F.col("n") >= min_sites).withColumn("sites", F.hll_sketch_estimate("sketch"))
    low, high = min_sites * (1 - margin), min_sites * (1 + margin)
    per = staged(per.where(F.col("sites") >= low).select("h", "n", "first", "sites"), "spread")
    near = staged(per.where((F.col("sites") < high)).select("h", "n", F.lit(True).alias("near")), "near")
    found = lookup(lines.select("h", "site"), near, "h", "n").where("near")
    exact = found.distinct().groupBy("h").agg(F.count(F.lit(1)).alias("exact"))
    joined = per.join(exact, "h", "left")
    return staged(joined.where(F.coalesce(F.col("exact"), F.col("sites")) >= min_sites).select("h", "n", "first"), "boilerplate")


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, clean, lines, removed): each row of ``docs`` as a struct, its text without boilerplate, lines, lines removed.

    Of a boilerplate line one occurrence stays, in the document with the smallest id (null ids last);
    documents that repeat as whole rows are treated alike. Null text stays null, with no lines; an empty
    text has one line. Columns of ``docs`` may have any names. Lines are told apart by a 64-bit hash. Only
    hashes are shuffled to find boilerplate; texts move once, by id, unless Spark knows the list of
    removals to be below its broadcast threshold.
    """
    lines = staged(line_rows(docs, id_col, text_col, site_col, min_chars), "lines")
    boiler = spread_of_lines(lines, min_sites)
    hit = lookup(lines.select("doc_id", "doc_key", "pos", "h"), boiler, "h", "n").where(F.col("first").isNotNull())
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_key", "pos")
    gone = hit.where(~first.eqNullSafe(F.col("first")))
    gone = staged(gone.distinct().groupBy(F.col("doc_id").alias("gone_id"), F.col("doc_key").alias("gone_key")).agg(F.collect_list("pos").alias("gone")), "removals")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("key"))
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left")
    split = F.split("text", "\n", -1)

    def kept(all_lines: Column) -> Column:
        """Lines at positions that are not gone; set difference and look-ups by position keep this linear."""
        at = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone"))
        return F.array_join(F.transform(at, lambda i: F.get(all_lines, i)), "\n")

    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.element_at(F.transform(F.array(split), kept), 1))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(split)).cast("long")
    return out.select("row", clean.alias("clean"), n.alias("lines"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("removed"))


def line_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, clean_sha256 (of the cleaned text; null text as empty)."""
    out = clean_lines(docs, id_col=id_col, **options)
    return out.select(F.col("row").getField(id_col).alias("doc_id"), F.col("lines").alias("n_lines"), F.col("removed").alias("n_removed"), F.sha2(F.coalesce("clean", F.lit("")).cast("binary"), 256).alias("clean_sha256"))


def without_boilerplate(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with boilerplate lines removed, other columns as they were; a document goes only if nothing but such lines was in it."""
    out = clean_lines(docs, text_col=text_col, **options)
    empty = (F.col("removed") > 0) & ~F.col("clean").rlike(r"\S")
    return out.where(~F.coalesce(empty, F.lit(False))).select(*[F.col("clean").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
