"""The corpus pipeline: documents in, a mixed training corpus out.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as
Parquet and read again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import load, staged
from strandline.llm.decontaminate import drop_contaminated
from strandline.llm.language import keep_identified
from strandline.llm.lines import without_boilerplate
from strandline.llm.mixing import mix
from strandline.llm.simhash import drop_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents in none of the learned languages go, among them null and empty texts and those without letters.

    Long texts are scored whole; repeated rows are decided alike and all stay; columns of any name come back unchanged; of an
    empty table nothing stays, and without any label all texts with letters do.
    """
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: boilerplate lines go; a document goes only if it had nothing else.

    Null texts stay null, empty ones empty; null sources are a source; one occurrence of a line stays, in the document with the
    smallest id, null ids last; rows that repeat with id and text are treated alike; columns of any name come back unchanged.
    """
    return without_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group stays, the one with the smallest id; shingles of five words, similarity 0.8.

    Null ids come last; rows that share an id but differ in text are documents of their own; of rows that repeat with id and text
    one stays. Null and empty texts have no shingles and are one group of equal sets. Columns of any name come back unchanged.
    """
    return drop_near_duplicates(docs, similarity=0.8, words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents in which any window of 13 words of a benchmark item (or a whole shorter item) occurs go.

    Null and empty texts have no words and stay; null and empty items have no windows; repeated rows are decided alike.
    """
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each document as often as the mix takes it, with ``copy`` from 1.

    Null texts have size 0, null sources are a source; rows that repeat with id and source are taken or left together; a column
    ``copy`` in the documents is an error.
    """
    return mix(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]

#: SQL can express neither the language model nor SimHash; the tests run the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
