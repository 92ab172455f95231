"""Line and token measures of text units, and their roll-ups by unit, language and code base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.expressions import SIGNIFICANT, line_count, mean, ratio, rounded


def line_measures(units: DataFrame) -> DataFrame:
    """``(path, lang, total_lines, physical_sloc, comment_lines, comment_pct)`` of ``units(path, lang, text)``.

    A physical line has a token, a significant line a letter or digit; both are counted on whole texts without exploding them.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", -1)
    sloc = F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long")
    significant = F.size(F.filter(lines, lambda x: x.rlike(SIGNIFICANT))).cast("long")
    out = units.select("path", "lang", line_count(text).alias("total_lines"), sloc.alias("physical_sloc"), significant.alias("comment_lines"))
    return out.withColumn("comment_pct", ratio(F.col("comment_lines"), F.col("physical_sloc") + F.col("comment_lines"), 1))


def tokens(units: DataFrame) -> DataFrame:
    """``(path, pos, text, line)``: the words of a unit at white space, with their lines from 1."""
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "words")
    rows = units.select("path", lines).select("path", "line", F.filter(F.split(F.trim("words"), r"[ \t\r\f\x0B]+"), lambda w: w != "").alias("words"))
    return rows.select("path", (F.col("line") + 1).alias("line"), F.posexplode("words").alias("at", "text"))


def token_arrays(units: DataFrame) -> DataFrame:
    """``(path, lang, toks array<string>, tok_lines array<int>)``: a unit's tokens in order, as arrays made in one pass."""
    pairs = F.flatten(
        F.transform(
            F.split(F.coalesce("text", F.lit("")), "\n", -1),
            lambda line, i: F.transform(F.filter(F.split(F.trim(line), r"[ \t\r\f\x0B]+"), lambda w: w != ""), lambda w: F.struct(w.alias("w"), (i + 1).alias("l"))),
        )
    )
    rows = units.select("path", "lang", pairs.alias("p"))
    return rows.select("path", "lang", F.transform("p", lambda p: p["w"]).alias("toks"), F.transform("p", lambda p: p["l"]).alias("tok_lines"))


_FUNCTION_SUMS = {"complexity": "avg_complexity", "cognitive": "avg_cognitive"}
_FUNCTION_MAXES = {"complexity": "worst_complexity", "cognitive": "worst_cognitive", "length": "max_function_length", "nesting": "max_nesting", "params": "max_params"}


def function_rollup(functions: DataFrame, by: list[str], digits: int = 1) -> DataFrame:
    """Counts, means and maxima of ``functions(path, ord, name, complexity, cognitive, length, nesting, params)`` by columns, and the worst function.

    Of functions of equal complexity the first by path and order is the worst; none is where all are 0.
    """
    first = F.struct(F.col("complexity"), F.negative(F.col("ord")))
    aggregates = [F.count("*").alias("functions")]
    aggregates += [mean(F.sum(c), F.count("*"), digits).alias(n) for c, n in _FUNCTION_SUMS.items()]
    aggregates += [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(n) for c, n in _FUNCTION_MAXES.items()]
    label = F.concat_ws(": ", "path", "name") if "path" not in by else F.col("name")
    tail = [] if "path" in by else ["path"]
    if tail:
        best = F.min_by(label, F.struct(F.negative(F.col("complexity")), F.col("path"), F.col("ord")))
    else:
        best = F.max_by(label, first)
    aggregates.append(F.when(F.max("complexity") > 0, best).otherwise("").alias("worst_function"))
    return functions.groupBy(*by).agg(*aggregates) if by else functions.agg(*aggregates)


def unit_rollup(units: DataFrame, by: list[str]) -> DataFrame:
    """Additive measures of ``units(physical_sloc, logical_loc, comment_lines, tokens, dup_tokens, dup_lines, types, abstract_types)`` by columns."""
    sums = {c: c for c in ("physical_sloc", "logical_loc", "comment_lines", "types", "abstract_types", "dup_tokens")}
    sums |= {"tokens": "total_tokens", "dup_lines": "duplicated_lines"}
    aggregates = [F.count("*").alias("prod_files"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in sums.items()]]
    out = units.groupBy(*by).agg(*aggregates) if by else units.agg(*aggregates)
    return out.withColumns(
        {"comment_pct": ratio(F.col("comment_lines"), F.col("physical_sloc") + F.col("comment_lines"), 1), "dup_pct": ratio(F.col("dup_tokens"), F.col("total_tokens"), 1)}
    )


def function_lengths(functions: DataFrame, code_lines: DataFrame, bucket: int = 64) -> DataFrame:
    """``(path, ord, length)``: distinct code lines of ``code_lines(path, line)`` inside each function's ``start_line..end_line``.

    A range join as an equi-join on the path and on buckets of lines.
    """
    spans = functions.select("path", "ord", "start_line", "end_line", F.explode(F.sequence(F.expr(f"start_line div {bucket}"), F.expr(f"end_line div {bucket}"))).alias("bucket"))
    lines = code_lines.select("path", "line", F.expr(f"line div {bucket}").cast("long").alias("bucket")).distinct()
    spans = spans.withColumn("bucket", F.col("bucket").cast("long"))
    inside = spans.join(lines, ["path", "bucket"]).filter("line between start_line and end_line").groupBy("path", "ord").agg(F.count("*").alias("length"))
    return functions.select("path", "ord").join(inside, ["path", "ord"], "left").select("path", "ord", F.coalesce("length", F.lit(0)).alias("length"))


def comment_pct_unrounded(comments: Column, sloc: Column) -> Column:
    return ratio(comments, sloc + comments)


def dup_lines_pct(lines: Column, sloc: Column) -> Column:
    return ratio(lines, sloc, 2)


__all__ = ["comment_pct_unrounded", "dup_lines_pct", "function_lengths", "function_rollup", "line_measures", "rounded", "token_arrays", "tokens", "unit_rollup"]
