"""The queries of this subpackage by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name to module; a module has ``query`` and, where SQL can express it, ``ORACLE_SQL``.
MODULES = {
    "op1_decontamination": "codestrata.llm.op1_decontamination",
    "op2_quality_rules": "codestrata.llm.op2_quality_rules",
    "op3_token_files": "codestrata.llm.op3_token_files",
    "op4_source_mix": "codestrata.llm.op4_source_mix",
    "op5_url_filter": "codestrata.llm.op5_url_filter",
    "op6_fuzzy_lines": "codestrata.llm.op6_fuzzy_lines",
    "op7_main_text": "codestrata.llm.op7_main_text",
    "op8_hilbert_shards": "codestrata.llm.op8_hilbert_shards",
    "op9_personal_data": "codestrata.llm.op9_personal_data",
    "pipeline": "corpus_pipeline",
    "op10_near_duplicates": "codestrata.llm.op10_near_duplicates",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(module), "run" if name == "pipeline" else "query") for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(module), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
