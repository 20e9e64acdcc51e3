"""Text formats as columns: FASTA, FASTQ, PAF, MHAP, overlap text, GFA, BED and layouts, in and out.

Readers are Spark text scans with parsing expressions (splittable, any Hadoop store); writers make a
single string column for ``DataFrame.write.text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.seq import cigar_align_length, cigar_query_length, cigar_reference_length, decode_evalue, encode_evalue, reverse_complement, tag_value, tig_number


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, flags, seq). Records are split at > after a line break, so files of any size split by records; .gz and .bz2 are read whole."""
    rec = spark.read.option("lineSep", "\n>").text(path)
    return fasta_records(rec)


def fasta_records(rec: DataFrame) -> DataFrame:
    """Parses records (value) that begin with the header, with or without its >."""
    head = F.regexp_extract("value", r"^>?([^\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^>?[^\n]*\n?", ""), r"\s", "")
    return rec.where(F.trim("value") != "").select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_extract(head, r"^\S*(.*)", 1)).alias("flags"), seq.alias("seq"))


def fastq_records(files: DataFrame) -> DataFrame:
    """(name, flags, seq, qual) of texts (value) of whole four-line records; files are read by sources.fastq."""
    recs = F.regexp_extract_all("value", F.lit(r"(?m)^@[^\n]*\n[^\n]*\n\+[^\n]*\n[^\n]*"), 0)
    r = files.select(F.explode(recs).alias("r")).select(F.split("r", "\n").alias("l"))
    return r.select(F.regexp_extract(F.col("l")[0], r"^@(\S*)", 1).alias("name"), F.trim(F.regexp_extract(F.col("l")[0], r"^@\S*(.*)", 1)).alias("flags"), F.trim(F.col("l")[1]).alias("seq"), F.trim(F.col("l")[3]).alias("qual"))


def fasta(reads: DataFrame, name: str = "read_id", width: int | None = None, reverse: bool = False) -> DataFrame:
    seq = reverse_complement(F.col("seq")) if reverse else F.col("seq")
    seq = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n") if width else seq
    return reads.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), seq).alias("value"))


def fastq(reads: DataFrame, name: str = "read_id", quality: str = "!") -> DataFrame:
    return reads.select(F.concat(F.lit("@"), F.col(name).cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.repeat(F.lit(quality), F.length("seq"))).alias("value"))


def _number(c: Column) -> Column:
    """Digits behind an optional letter prefix such as read."""
    return F.regexp_extract(c, r"^[A-Za-z]*([0-9]+)$", 1).try_cast("bigint")


def parse_mhap(lines: DataFrame, min_length: int = 0) -> DataFrame:
    """Overlaps of 12-column lines (value); pairs of a read with itself and those short on both sides go."""
    w = F.split(F.trim("value"), r"\s+")
    n = lambda i: F.get(w, F.lit(i)).try_cast("bigint")
    flipped = F.get(w, F.lit(8)) != "0"
    o = lines.select(_number(F.get(w, F.lit(0))).alias("a_id"), _number(F.get(w, F.lit(1))).alias("b_id"), flipped.alias("flipped"), n(5).alias("ahg5"), (n(7) - n(6)).alias("ahg3"), F.when(flipped, n(11) - n(10)).otherwise(n(9)).alias("bhg5"), F.when(flipped, n(9)).otherwise(n(11) - n(10)).alias("bhg3"), encode_evalue(F.get(w, F.lit(2)).try_cast("double")).cast("bigint").alias("evalue"), n(7).alias("a_len"), n(11).alias("b_len"))
    return o.where((F.col("a_id") != F.col("b_id")) & ((G.a_aligned(F.col("a_len")) >= min_length) | (G.b_aligned(F.col("b_len")) >= min_length)))


def parse_paf(lines: DataFrame, min_length: int = 0, max_erate: float = 1.0, partial: bool = False) -> DataFrame:
    """Overlaps of PAF lines (value): both sides long enough, dv within the limit; for_utg only if no end is partial."""
    w = F.split("value", "\t")
    n = lambda i: F.get(w, F.lit(i)).try_cast("bigint")
    flipped = F.get(w, F.lit(4)) == "-"
    e = tag_value(F.col("value"), "dv").try_cast("double")
    o = lines.select(_number(F.get(w, F.lit(0))).alias("a_id"), _number(F.get(w, F.lit(5))).alias("b_id"), flipped.alias("flipped"), n(2).alias("ahg5"), (n(1) - n(3)).alias("ahg3"), F.when(flipped, n(6) - n(8)).otherwise(n(7)).alias("bhg5"), F.when(flipped, n(7)).otherwise(n(6) - n(8)).alias("bhg3"), encode_evalue(e).cast("bigint").alias("evalue"), n(1).alias("a_len"), n(6).alias("b_len"))
    long = (G.a_aligned(F.col("a_len")) >= min_length) & (G.b_aligned(F.col("b_len")) >= min_length)
    good = o.where((F.col("a_id") != F.col("b_id")) & long & (decode_evalue(F.col("evalue")) <= max_erate))
    return good.withColumn("for_utg", F.lit(not partial) & G.reaches_ends()).withColumn("for_obt", F.lit(partial))


def paf(overlaps: DataFrame) -> DataFrame:
    """PAF lines of overlaps with a_len and b_len."""
    c, tab = F.col, F.lit("\t")
    lo, hi = F.least(G.b_bgn(c("b_len")), G.b_end(c("b_len"))), F.greatest(G.b_bgn(c("b_len")), G.b_end(c("b_len")))
    n = G.aligned(c("a_len"), c("b_len"))
    parts = [F.concat(F.lit("read"), c("a_id")), c("a_len"), G.a_bgn(), G.a_end(c("a_len")), F.when(c("flipped"), "-").otherwise("+"), F.concat(F.lit("read"), c("b_id")), c("b_len"), lo, hi, F.round(n * (1 - decode_evalue(c("evalue")))).cast("bigint"), n, F.lit(255), F.concat(F.lit("dv:f:"), F.format_number(decode_evalue(c("evalue")), 6))]
    return overlaps.select(F.concat_ws("\t", *[p.cast("string") for p in parts]).alias("value"))


def overlap_text(overlaps: DataFrame, form: str) -> DataFrame:
    """Lines in hangs, coords or unaligned form, as FIXTURES.md lists their columns."""
    c = F.col
    flip, e = F.when(c("flipped"), "I").otherwise("N"), F.format_string("%.5f", decode_evalue(c("evalue")))
    body = {"hangs": [G.a_hang(), c("span"), G.b_hang(), e], "coords": [c("span"), G.a_bgn(), G.a_end(c("a_len")), G.b_bgn(c("b_len")), G.b_end(c("b_len")), e], "unaligned": [c("span"), c("ahg5"), c("ahg3"), c("bhg5"), c("bhg3"), e]}[form]
    return overlaps.select(F.concat_ws("\t", *[x.cast("string") for x in [c("a_id"), c("b_id"), flip, *body]]).alias("value"))


def parse_overlap_text(lines: DataFrame, form: str, lengths: DataFrame | None = None) -> DataFrame:
    """Overlaps of such lines; coords needs (read_id, len)."""
    w = F.split(F.trim("value"), r"\s+")
    n = lambda i: F.get(w, F.lit(i)).try_cast("bigint")
    flipped = F.get(w, F.lit(2)) == "I"
    zero = F.lit(0).cast("bigint")
    if form == "hangs":
        hang = lambda x: F.greatest(x, zero)
        return lines.select(n(0).alias("a_id"), n(1).alias("b_id"), flipped.alias("flipped"), hang(n(3)).alias("ahg5"), hang(-n(5)).alias("ahg3"), hang(-n(3)).alias("bhg5"), hang(n(5)).alias("bhg3"), encode_evalue(F.get(w, F.lit(6)).try_cast("double")).cast("bigint").alias("evalue"), n(4).alias("span"))
    if form == "unaligned":
        return lines.select(n(0).alias("a_id"), n(1).alias("b_id"), flipped.alias("flipped"), n(4).alias("ahg5"), n(5).alias("ahg3"), n(6).alias("bhg5"), n(7).alias("bhg3"), encode_evalue(F.get(w, F.lit(8)).try_cast("double")).cast("bigint").alias("evalue"), n(3).alias("span"))
    o = lines.select(n(0).alias("a_id"), n(1).alias("b_id"), flipped.alias("flipped"), n(3).alias("span"), n(4).alias("ab"), n(5).alias("ae"), n(6).alias("bb"), n(7).alias("be"), encode_evalue(F.get(w, F.lit(8)).try_cast("double")).cast("bigint").alias("evalue"))
    la, lb = lengths.select(F.col("read_id").alias("a_id"), F.col("len").alias("al")), lengths.select(F.col("read_id").alias("b_id"), F.col("len").alias("bl"))
    f = F.col("flipped")
    return o.join(la, "a_id").join(lb, "b_id").select("a_id", "b_id", "flipped", F.col("ab").alias("ahg5"), (F.col("al") - F.col("ae")).alias("ahg3"), F.when(f, F.col("bl") - F.col("bb")).otherwise(F.col("bb")).alias("bhg5"), F.when(f, F.col("be")).otherwise(F.col("bl") - F.col("be")).alias("bhg3"), "evalue", "span")


def parse_gfa(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, links) of GFA1 lines (value)."""
    w = F.split("value", "\t")
    g = lambda i: F.get(w, F.lit(i))
    length = F.coalesce(tag_value(F.col("value"), "LN").try_cast("bigint"), F.length(g(2)).cast("bigint"))
    seg = lines.where(F.col("value").startswith("S\t")).select(g(1).alias("name"), tig_number(g(1)).alias("tig_id"), F.when(g(2) != "*", g(2)).alias("seq"), length.alias("len"))
    cig = g(5)
    link = lines.where(F.col("value").startswith("L\t")).select(g(1).alias("a"), (g(2) == "-").alias("a_rev"), g(3).alias("b"), (g(4) == "-").alias("b_rev"), cig.alias("cigar"), cigar_query_length(cig).alias("query_len"), cigar_reference_length(cig).alias("ref_len"), cigar_align_length(cig).alias("align_len"))
    return seg, link


def gfa(segments: DataFrame, links: DataFrame) -> DataFrame:
    s = segments.select(F.concat_ws("\t", F.lit("S"), "name", F.coalesce("seq", F.lit("*")), F.concat(F.lit("LN:i:"), F.col("len"))).alias("value"))
    sign = lambda c: F.when(F.col(c), "-").otherwise("+")
    l = links.select(F.concat_ws("\t", F.lit("L"), "a", sign("a_rev"), "b", sign("b_rev"), "cigar").alias("value"))
    return s.unionByName(l)


def parse_bed(lines: DataFrame) -> DataFrame:
    w = F.split("value", "\t")
    g = lambda i: F.get(w, F.lit(i))
    return lines.where(~F.col("value").startswith("#") & (F.size(w) >= 3)).select(g(0).alias("seq_name"), g(1).try_cast("bigint").alias("bgn"), g(2).try_cast("bigint").alias("end"), g(3).alias("name"), g(4).try_cast("double").alias("score"), (g(5) == "-").alias("reverse"))


def bed(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("\t", "seq_name", "bgn", "end", "name", F.col("score").cast("bigint"), F.when(F.col("reverse"), "-").otherwise("+")).alias("value"))


def read_to_tig(layout: DataFrame, kind: str = "ungapped") -> DataFrame:
    """Lines readID, tigID, coordType, begin, end; begin above end if reverse."""
    r = F.col("reverse")
    return layout.select(F.concat_ws("\t", F.col("read_id").cast("string"), F.col("tig_id").cast("string"), F.lit(kind), F.when(r, F.col("hi")).otherwise(F.col("lo")).cast("string"), F.when(r, F.col("lo")).otherwise(F.col("hi")).cast("string")).alias("value"))


def parse_read_to_tig(lines: DataFrame) -> DataFrame:
    w = F.split("value", "\t")
    n = lambda i: F.get(w, F.lit(i)).try_cast("bigint")
    return lines.where(n(0).isNotNull()).select(n(1).alias("tig_id"), n(0).alias("read_id"), F.least(n(3), n(4)).alias("lo"), F.greatest(n(3), n(4)).alias("hi"), (n(3) > n(4)).alias("reverse"))


def sam(layout: DataFrame) -> DataFrame:
    """SAM lines of reads placed in tigs, without gaps."""
    flag = F.when(F.col("reverse"), 16).otherwise(0)
    seq = F.when(F.col("reverse"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return layout.select(F.concat_ws("\t", F.col("read_id").cast("string"), flag.cast("string"), F.concat(F.lit("tig"), F.lpad(F.col("tig_id").cast("string"), 8, "0")), (F.col("lo") + 1).cast("string"), F.lit("60"), F.concat(F.length("seq").cast("string"), F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), seq, F.lit("*")).alias("value"))


def random_overlaps(spark: SparkSession, n: int, reads: int, length: int, seed: int = 1) -> DataFrame:
    """Uniformly random overlaps for stress tests."""
    r = spark.range(n)
    start = lambda k: (F.col("id") * 31 + k * 7919 + seed * 104_729) % 2_147_483_647
    pick = lambda k, m: start(k) * 48_271 % 2_147_483_647 * 69_621 % 2_147_483_647 % m
    o = r.select((pick(1, reads) + 1).alias("a_id"), (pick(2, reads) + 1).alias("b_id"), (pick(3, 2) == 1).alias("flipped"), pick(4, length // 2).alias("ahg5"), pick(5, length // 2).alias("bhg3"), pick(6, 1000).alias("evalue"))
    z = F.lit(0).cast("bigint")
    return o.where("a_id <> b_id").select("a_id", "b_id", "flipped", "ahg5", z.alias("ahg3"), z.alias("bhg5"), "bhg3", "evalue", (length - F.greatest("ahg5", "bhg3")).alias("span"))
