"""Documents to training sequences: quality, near duplicates, benchmark leaks, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs; all but
the last return the columns of documents. Rejected documents, near duplicates and documents with benchmark items go, secrets are
cut out of the texts that stay, and what stays is packed.

No stage fails on nulls in any column, empty or very long texts, repeated rows, an empty table or more columns; what each does with them
is said where it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symloom.llm.op1_decontaminate import without_leaks
from symloom.llm.op3_pack import pack
from symloom.llm.op4_quality import accepted, fitted
from symloom.llm.op6_near_dedup import one_of_each
from symloom.llm.op8_secrets import redacted
from symloom.llm.store import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neighbours among the labelled ones don't vote against. A null text is judged as an empty one, rows that repeat are judged each and
    all columns stay; without labels, or without documents, nothing is rejected."""
    return accepted(docs, fitted(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near duplicates, that of the least doc_id. Rows with a null doc_id or text stay, of rows with one doc_id and
    text one stays, and different texts of a doc_id are judged each."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark item. Rows are judged one by one, so nulls and repeated rows stay if their text is clean; with an empty
    benchmark all do."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by the rule's name and n_chars made to fit. Null and empty texts stay as they are."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a bin. Null and empty texts are in no bin, repeated rows and null doc_ids are packed like others."""
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("pack", packing)]
#: Models, sketches and packing plans aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
