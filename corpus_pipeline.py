"""From raw documents to token files in five stages, each written as Parquet and read again as the next one's input.

quality rules -> MinHash near-duplicates -> benchmark decontamination -> mixing of sources to target weights -> token files.
All stages but the last return the columns of ``documents``; each works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm._common import discard, read, written
from codestrata.llm.pipeline import COLUMNS, STAGES  # noqa: F401

#: Near-duplicate classes, permutations and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's rows are deleted once the next one's are written."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        done = written(stage(spark, docs, sf_dir), f"stage-{k}")
        discard(docs)
        docs = done
    return docs
