"""Budgets over measured values, and the composite index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PASS, BREACH, USAGE, INTERNAL = range(4)

#: Metric, label, unit, digits.
REGISTRY = [
    ("avg_complexity", "Average cyclomatic complexity (per function)", "", 2),
    ("worst_complexity", "Worst cyclomatic complexity (single function)", "", 0),
    ("max_duplication_pct", "Duplicated tokens, % of all tokens", "%", 2),
    ("max_cycle_members", "Largest dependency cycle (files)", "files", 0),
    ("max_in_cycle_pct", "Files that sit in a dependency cycle", "%", 2),
    ("avg_cognitive_complexity", "Average cognitive complexity (per function)", "", 2),
    ("worst_cognitive_complexity", "Worst cognitive complexity (single function)", "", 0),
    ("max_function_length", "Longest function (non-comment lines)", "lines", 0),
    ("max_nesting", "Deepest control-structure nesting", "", 0),
    ("max_params", "Largest parameter count", "", 0),
    ("max_duplicated_lines_pct", "Duplicated lines, % of physical lines", "%", 2),
    ("max_issues", "Total structural smell issues", "issues", 0),
    ("max_blocker_issues", "Blocker-severity issues", "issues", 0),
    ("max_high_issues", "High-severity issues", "issues", 0),
    ("max_medium_issues", "Medium-severity issues", "issues", 0),
    ("max_low_issues", "Low-severity issues", "issues", 0),
    ("max_info_issues", "Info-severity issues", "issues", 0),
]
METRICS = {key: (label, unit, digits) for key, label, unit, digits in REGISTRY}
#: The metrics that a summary gives, by its columns.
SUMMARY_METRICS = {
    "avg_complexity": "avg_complexity",
    "worst_complexity": "worst_complexity",
    "max_duplication_pct": "dup_pct",
    "avg_cognitive_complexity": "avg_cognitive",
    "worst_cognitive_complexity": "worst_cognitive",
    "max_function_length": "max_function_length",
    "max_nesting": "max_nesting",
    "max_params": "max_params",
    "max_duplicated_lines_pct": "dup_lines_pct",
    "max_issues": "issues",
}
CYCLE_METRICS = {"max_cycle_members": "max_cycle_members", "max_in_cycle_pct": "in_cycle_pct"}


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "key string, label string, unit string, digits int")


def unpivoted(summary: DataFrame, columns: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """``(by..., key, value)``: the named columns of a summary as rows."""
    pairs = [x for key, column in columns.items() for x in (F.lit(key), F.col(column).cast("double"))]
    return summary.select(*(by or []), F.stack(F.lit(len(columns)), *pairs).alias("key", "value"))


def severity_metrics(histogram: DataFrame) -> DataFrame:
    return histogram.select(F.concat(F.lit("max_"), "severity", F.lit("_issues")).alias("key"), F.col("n").cast("double").alias("value"))


def evaluate(budgets: DataFrame, measures: DataFrame) -> DataFrame:
    """``(lang, key, value, limit, tier, breached)`` of ``budgets(lang, key, limit, tier)``: a breach is a value above the limit; what is not measured is 0.

    lang is ``''`` for the whole code base.
    """
    rows = budgets.join(measures.select("lang", "key", "value"), ["lang", "key"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return rows.select("lang", "key", "value", "limit", "tier", (F.col("value") > F.col("limit")).alias("breached"))


def exit_code(results: DataFrame) -> DataFrame:
    """``(exit_code, breaches)``: 1 if a budget of tier error is breached."""
    bad = F.col("breached") & (F.col("tier") == "error")
    return results.agg(F.when(F.coalesce(F.bool_or(bad), F.lit(False)), BREACH).otherwise(PASS).alias("exit_code"), F.count_if("breached").alias("breaches"))


def composite(results: DataFrame, weights: DataFrame) -> DataFrame:
    """``(score)``: the weighted mean of 100 * (1 - value / limit), held between 0 and 100, over weighted budgets of the whole code base.

    A limit of 0 or less scores nothing but weighs; without weights the score is 100.
    """
    rows = results.filter("lang = ''").join(weights, "key")
    score = F.when(F.col("limit") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (1 - F.col("value") / F.nullif(F.col("limit"), F.lit(0.0)))))).otherwise(0.0)
    total = F.coalesce(F.sum("weight"), F.lit(0.0))
    return rows.agg(F.when(total > 0, F.sum(score * F.col("weight")) / F.nullif(total, F.lit(0.0))).otherwise(100.0).alias("score"))


def ordered(results: DataFrame) -> DataFrame:
    return results.orderBy("lang", "key")


def unknown(keys: list[str]) -> list[str]:
    return sorted(k for k in keys if k not in METRICS)
