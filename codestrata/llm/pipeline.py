"""The stages of the corpus pipeline, from raw documents to token files; ``corpus_pipeline`` runs them one after the other.

Every stage takes the columns of ``documents`` by name, so further columns, whatever their names, end with the first stage. Nulls, empty and
very long texts, repeated rows and empty tables give what the operators define: quality rules drop null and empty texts, so later stages
meet none of their own; of rows equal in doc_id and text one stays after near-duplicates; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import op1_decontamination, op2_quality_rules, op3_token_files, op4_source_mix, op10_near_duplicates
from codestrata.llm._common import read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy passes, repeated rows included; a null text is rejected."""
    return op2_quality_rules.kept_documents(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that of the least doc_id; of rows equal in id and text the least by their other columns. Null texts stay."""
    return op10_near_duplicates.one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``; null and empty texts hold none."""
    return op1_decontamination.clean_documents(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass over a document, with the words that the mix takes in it; a text without words is never taken."""
    return op4_source_mix.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every row, read back from the files; a null or empty text has the end id only."""
    return op3_token_files.encode_and_read(docs)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token files", token_files),
]
