"""Threshold rules over functions, files and types that yield located issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.expressions import ratio

#: Languages in their order.
LANGUAGES = ["go", "typescript", "javascript", "python", "c", "cpp", "java", "rust"]
#: Rule, target, severity, threshold, thresholds by language.
CATALOG = [
    ("cognitive-complexity", "function", "high", 15.0, {}),
    ("cyclomatic-complexity", "function", "medium", 10.0, {}),
    ("function-length", "function", "high", 60.0, {"python": 50.0}),
    ("nesting-depth", "function", "medium", 4.0, {"typescript": 3.0, "javascript": 3.0}),
    ("parameter-count", "function", "medium", 7.0, {}),
    ("file-length", "file", "low", 750.0, {}),
    ("duplicated-file", "file", "medium", 10.0, {}),
    ("comment-density", "file", "low", 25.0, {}),
    ("boolean-complexity", "expression", "medium", 3.0, {}),
    ("too-many-methods", "type", "low", 35.0, {}),
]
SEVERITIES = ["blocker", "high", "medium", "low", "info"]
#: Physical lines a file needs before its comment density counts.
COMMENT_FLOOR = 50
#: Function measures by the rule that reads them.
FUNCTION_RULES = {
    "cognitive-complexity": "cognitive",
    "cyclomatic-complexity": "complexity",
    "function-length": "length",
    "nesting-depth": "nesting",
    "parameter-count": "params",
    "boolean-complexity": "bool_max",
}
_OVERRIDE = "rule string, lang string, enabled boolean, threshold double, severity string"


def catalog(spark: SparkSession, languages: list[str] | None = None) -> DataFrame:
    """``(rule, target, lang, enabled, threshold, severity)``: the built-in settings for each language."""
    rows = [(rule, target, lang, True, own.get(lang, limit), severity) for rule, target, severity, limit, own in CATALOG for lang in languages or LANGUAGES]
    return spark.createDataFrame(rows, "rule string, target string, lang string, enabled boolean, threshold double, severity string")


def resolve_rules(built_in: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Settings after ``overrides(rule, lang, enabled, threshold, severity)``: field by field the language's, then the global one (lang null), then the built-in."""
    if overrides is None:
        return built_in
    fields = ["enabled", "threshold", "severity"]
    general = overrides.filter("lang is null").select("rule", *[F.col(c).alias(f"g_{c}") for c in fields])
    own = overrides.filter("lang is not null").select("rule", "lang", *[F.col(c).alias(f"l_{c}") for c in fields])
    rows = built_in.join(general, "rule", "left").join(own, ["rule", "lang"], "left")
    return rows.select("rule", "target", "lang", *[F.coalesce(f"l_{c}", f"g_{c}", c).alias(c) for c in fields])


def methods_per_type(functions: DataFrame) -> DataFrame:
    """``(path, lang, enclosing, methods, line)`` of named functions with an enclosing type; line is the first method's."""
    named = functions.filter("not anonymous and enclosing <> ''")
    return named.groupBy("path", "lang", "enclosing").agg(F.count("*").alias("methods"), F.min_by("start_line", "ord").alias("line"))


def shown(value: Column) -> Column:
    """Two digits, halves up, as issues show them."""
    return F.floor(value * 100 + 0.5) / 100


def issues(files: DataFrame, functions: DataFrame, rules: DataFrame) -> DataFrame:
    """``(rule, severity, file, line, function, value, threshold)``.

    ``files(path, lang, physical_sloc, comment_lines, dup_lines)`` and ``functions(path, lang, ord, name, enclosing, anonymous, start_line, ...)``
    become one row a rule and value, which meets the settings of its rule and language; these are a row for each rule and language.
    """
    measures = F.stack(F.lit(len(FUNCTION_RULES)), *[x for rule, column in FUNCTION_RULES.items() for x in (F.lit(rule), F.col(column).cast("double"))]).alias("rule", "value")
    by_function = functions.select("path", "lang", F.col("start_line").cast("long").alias("line"), F.col("name").alias("function"), measures)
    sloc, comments = F.col("physical_sloc"), F.col("comment_lines")
    of_file = F.array(
        F.struct(F.lit("file-length").alias("rule"), sloc.cast("double").alias("value")),
        F.struct(F.lit("duplicated-file").alias("rule"), F.when(sloc > 0, ratio(F.col("dup_lines"), sloc)).alias("value")),
        F.struct(F.lit("comment-density").alias("rule"), F.when(sloc >= COMMENT_FLOOR, ratio(comments, sloc + comments)).alias("value")),
    )
    by_file = files.select("path", "lang", F.lit(1).cast("long").alias("line"), F.lit(None).cast("string").alias("function"), F.inline(of_file))
    by_type = methods_per_type(functions).select("path", "lang", F.col("line").cast("long").alias("line"), F.col("enclosing").alias("function"), F.lit("too-many-methods").alias("rule"), F.col("methods").cast("double").alias("value"))
    rows = by_function.unionByName(by_file).unionByName(by_type).filter("value is not null")
    met = rows.join(rules.filter("enabled"), ["rule", "lang"])
    breach = F.when(F.col("rule") == "comment-density", F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    return met.filter(breach).select("rule", "severity", F.col("path").alias("file"), "line", "function", shown(F.col("value")).alias("value"), "threshold")


def ordered(found: DataFrame) -> DataFrame:
    """By file, line and rule, then function and value."""
    return found.orderBy("file", "line", "rule", "function", "value")


def severity_histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("n"))


def flagged_functions(functions: DataFrame, found: DataFrame) -> DataFrame:
    """Functions with an issue, matched by file and name."""
    flags = found.filter("function is not null").select(F.col("file").alias("path"), F.col("function").alias("name"))
    return functions.join(flags, ["path", "name"], "left_semi")
