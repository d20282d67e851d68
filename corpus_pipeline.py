"""From raw documents to packed training sequences: five stages, each an operator of ``trendloom.llm``.

Defined results, for every stage: one row in is one row out or none. Rows that share an id, or have none, are told apart
by a row number in id order; of equal rows near_dedup keeps one. A null or empty text fails the quality rules; the later stages
keep it (it has no words to compare), and packing makes the end id of it. Null language or source form groups of their
own. Extra columns go, an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm.common import checkpoint, table
from trendloom.llm.decontaminate import contaminated
from trendloom.llm.near_dedup import near_duplicates
from trendloom.llm.packing import pack_documents
from trendloom.llm.passage_dedup import remove_repeated_passages
from trendloom.llm.quality import quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = "_row"


def numbered(docs: DataFrame) -> DataFrame:
    """The columns of documents with a number for each row: the id where ids are unique, else the place in id order."""
    docs = docs.select(*COLUMNS)
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if not repeated.limit(1).count():
        return docs.withColumn(ROW, F.col("doc_id").cast("bigint"))
    # written once, so that a lost executor does not number rows anew
    return checkpoint(docs.orderBy("doc_id", "text").withColumn(ROW, F.monotonically_increasing_id()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows = numbered(docs)
    kept = quality_rules(rows, id_col=ROW).filter("kept").select(ROW)
    return rows.join(kept, ROW, "left_semi").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id."""
    rows = numbered(docs)
    kept = near_duplicates(rows, id_col=ROW).filter("kept").select(ROW)
    return rows.join(kept, ROW, "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier place has; ``n_chars`` follows the text."""
    rows = numbered(docs)
    kept = remove_repeated_passages(rows, id_col=ROW).select(ROW, "text")
    return rows.drop("text", "n_chars").join(kept, ROW).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold a benchmark item."""
    rows = numbered(docs)
    found = contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=ROW).select(ROW).distinct()
    return rows.join(found, ROW, "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token documents with their places in sequences of 2048."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokenizers, recurrences and alignments have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
