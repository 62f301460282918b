"""From raw documents to training sequences: five stages, each over all that the one before kept.

Documents have doc_id, text and lang; other columns go through, whatever their names. Texts that are null, empty or have
no letter go in the first stage, for they have no language. Rows that repeat id and text lose the same lines and become
one in near_dedup; rows that share an id alone are documents of their own; a null id loses to others among near copies.
An empty table gives no rows. Each stage's docstring links to the operator that says the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, line_dedup, packing, secret_scan, simhash
from tidemark.llm.common import forget, saved


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough certainty (langid.keep_identified)."""
    return langid.keep_identified(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that an earlier document has; those of such chunks alone go (line_dedup.dedup_lines)."""
    return _counted(line_dedup.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 and more) the document with the smallest id (simhash.keep_first)."""
    return simhash.keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked (secret_scan.redact)."""
    return _counted(secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences (packing.pack_documents)."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", pack)]

#: Training, hashing and tokenising have no SQL form; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again, and goes once it is read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = saved(stage(spark, docs, sf_dir), name)
        if before:
            forget(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
