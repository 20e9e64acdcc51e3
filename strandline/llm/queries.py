"""The contract queries of this subpackage, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load
from .decontaminate import decontamination_report
from .embeddings import similar_vectors
from .language import identify
from .lines import line_report
from .mixing import mix_report
from .passages import repeated_passages
from .pii import pii_report
from .simhash import near_duplicates
from .toxicity import toxicity
from .warc import archive_report


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 on all documents: passages that two documents or more share, each with where it is kept."""
    return repeated_passages(load(spark, sf_dir, "documents")).drop("text_key")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 2: 4-word shingles, links at 4 or fewer differing bits."""
    return near_duplicates(load(spark, sf_dir, "documents"), distance=4, words=4)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 3: learns outside the fold crc32 mod 3 = 1, predicts every document."""
    return identify(load(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 4: pages written as WARC records, and what the archives say of them."""
    return archive_report(load(spark, sf_dir, "pages")).drop("target_uri")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 5: 13-word windows of all benchmark items in all documents."""
    found = decontamination_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), window=13)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 on all documents: lines on 10 or more sources go, but for their first occurrence."""
    return line_report(load(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 7: base patterns and additions of all documents."""
    return pii_report(load(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 8: all documents, weights 5, 2, 1, 150 % of all words, capped at 2."""
    return mix_report(load(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 9: all vectors whatever their labels, links at cosine 0.9 or more."""
    return similar_vectors(load(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 10: learns labels outside the fold crc32 mod 5 = 0, scores every document."""
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_language_id": op3_language_id,
    "op4_warc": op4_warc,
    "op5_decontaminate": op5_decontaminate,
    "op6_line_dedup": op6_line_dedup,
    "op7_pii": op7_pii,
    "op8_mix_sources": op8_mix_sources,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op5_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, trim(line, ' ') AS key FROM l),
b AS (SELECT key, min((doc_id, pos)) AS first FROM k WHERE length(key) >= 16 GROUP BY key HAVING count(DISTINCT source) + max((source IS NULL)::INT) >= 10),
m AS (SELECT k.doc_id, k.pos, k.line, b.key IS NOT NULL AND (k.doc_id, k.pos) <> b.first AS gone FROM k LEFT JOIN b USING (key)),
c AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS clean FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(clean, '')) AS clean_sha256
FROM documents d LEFT JOIN c USING (doc_id)""",
}
