"""A source tree from scan to verdict, as one plan of frames."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import parsers
from codestrata.functions.expressions import cut, mean, ratio
from codestrata.operators import duplication, gate, graph, measures, resolve, smells
from codestrata.plans.config import Config, budget_rows, include_dirs, override_rows, validate
from codestrata.sources import tree


@dataclass
class Report:
    root: str
    module: str
    verbose: bool
    files: DataFrame
    functions: DataFrame
    issues: DataFrame
    edges: DataFrame
    cycles: DataFrame
    summary: DataFrame
    languages: DataFrame
    budgets: DataFrame
    composite: DataFrame
    verdict: DataFrame


def _module(root: str) -> tuple[str, str]:
    """(module path, path of the root below the module's folder) of the nearest module file upwards."""
    at = os.path.abspath(root)
    while True:
        file = os.path.join(at, tree.MODULE_FILE)
        if os.path.isfile(file):
            with open(file, encoding="utf-8") as lines:
                name = next((x.split(None, 1)[1].strip() for x in lines if x.strip().startswith("module ")), "")
            below = os.path.relpath(os.path.abspath(root), at)
            return name, "" if below == "." else below
        if os.path.dirname(at) == at:
            return "", ""
        at = os.path.dirname(at)


def function_rows(units: DataFrame) -> DataFrame:
    return units.select("path", "lang", F.inline("functions"))


def by_class(units: DataFrame, of: str) -> DataFrame:
    """Units of class prod or test that are not generated."""
    return units.filter(~F.col("is_generated") & (F.col("class") == of))


def analyze_units(units: DataFrame, cfg: Config, skipped: DataFrame, root: str, module: str, verbose: bool = False) -> Report:
    """The report over parsed units (schema.UNIT)."""
    spark = units.sparkSession
    broken = [r.error for r in units.filter("error is not null").select("error").orderBy("error").collect()]
    if broken:
        raise ValueError("; ".join(broken))
    counts = units.agg(F.count_if("is_generated").alias("generated_files"), F.count_if(~F.col("is_generated") & (F.col("class") == "test")).alias("test_files"))
    kept = units.filter(~F.col("is_generated"))
    prod = cut(resolve.resolve(by_class(units, "prod"), include_dirs(cfg, root) if "://" not in root else cfg.include_dirs))
    edges = cut(graph.build_edges(prod))
    members = cut(graph.components(edges))
    cycles = cut(graph.cycles(members)) if not members.isEmpty() else graph.cycles(members)
    covered = cut(duplication.coverage(prod.select("path", "lang", "toks", "tok_lines")))
    blocks = duplication.blocks(prod.select("path", "toks"))
    functions = cut(function_rows(prod))
    types = prod.select("path", F.size("types").cast("long").alias("types"), F.size(F.filter("types", lambda t: t["abstract"])).cast("long").alias("abstract_types"))
    sized = prod.select("path", "lang", "physical_sloc", "logical_loc", "comment_lines", F.size("toks").cast("long").alias("tokens")).join(types, "path").join(covered.select("path", "dup_tokens", "dup_lines"), "path")
    sized = cut(sized)
    rules = smells.resolve_rules(smells.catalog(spark), spark.createDataFrame(override_rows(cfg), smells._OVERRIDE))
    issues = cut(smells.ordered(smells.issues(sized, functions, rules)))

    def summarised(by: list[str]) -> DataFrame:
        rows = measures.unit_rollup(sized, by)
        rolled = measures.function_rollup(functions, by)
        langs = sized.select(F.col("path").alias("file"), "lang")
        found = issues.join(langs, "file").groupBy(*by).agg(F.count("*").alias("issues")) if by else issues.agg(F.count("*").alias("issues"))
        out = rows.join(rolled, by, "left").join(found, by, "left") if by else rows.crossJoin(rolled).crossJoin(found)  # one row each
        numbers = ["functions", "avg_complexity", "avg_cognitive", "worst_complexity", "worst_cognitive", "max_function_length", "max_nesting", "max_params", "issues"]
        out = out.fillna(0, numbers).fillna("", ["worst_function"])
        return out.withColumn("dup_lines_pct", ratio(F.col("duplicated_lines"), F.col("physical_sloc"), 2))

    summary = summarised([]).crossJoin(counts).crossJoin(skipped).crossJoin(graph.cycle_summary(members, prod)).crossJoin(blocks)  # one row each
    summary, languages = cut(summary), cut(summarised(["lang"]))
    severities = gate.severity_metrics(smells.severity_histogram(issues)).withColumn("lang", F.lit(""))
    every = gate.unpivoted(summary.withColumn("lang", F.lit("")), gate.SUMMARY_METRICS | gate.CYCLE_METRICS, ["lang"])
    values = every.unionByName(severities).unionByName(gate.unpivoted(languages, gate.SUMMARY_METRICS, ["lang"]))
    budgets = cut(gate.evaluate(spark.createDataFrame(budget_rows(cfg), "lang string, key string, limit double, tier string"), values))
    weights = spark.createDataFrame([(k, float(w)) for k, w in cfg.weights.items()], "key string, weight double")
    return Report(
        root, module, verbose, cut(file_rows(kept, sized, covered, edges, members, cycles)), functions, issues, edges, cycles, summary, languages, gate.ordered(budgets), gate.composite(budgets, weights), gate.exit_code(budgets)
    )


def file_rows(kept: DataFrame, sized: DataFrame, covered: DataFrame, edges: DataFrame, members: DataFrame, cycles: DataFrame) -> DataFrame:
    """A row for each production and test file; graph and duplication are 0 for tests."""
    rolled = measures.function_rollup(function_rows(kept), ["path"], 2)
    coupled = graph.coupling(sized.select("path", "types", "abstract_types"), edges)
    named = members.join(cycles.select(F.col("name").alias("root"), "cycle_idx"), "root").select("path", F.concat(F.lit("cycle-"), "cycle_idx").alias("cycle"))
    base = kept.select(
        "path", "lang", "class", "package", "import_path", "total_lines", "physical_sloc", "logical_loc", "comment_lines", F.size("types").alias("types"), F.size(F.filter("types", lambda t: t["abstract"])).alias("abstract_types")
    ).withColumn("comment_pct", ratio(F.col("comment_lines"), F.col("physical_sloc") + F.col("comment_lines"), 1))
    rows = base.join(rolled, "path", "left").join(coupled, "path", "left").join(covered.select("path", "dup_tokens", "dup_lines", "dup_pct"), "path", "left").join(named, "path", "left")
    numbers = ["functions", "avg_complexity", "avg_cognitive", "worst_complexity", "worst_cognitive", "max_function_length", "max_nesting", "max_params", "ca", "ce", "instability", "abstractness", "distance", "dup_tokens", "dup_lines", "dup_pct"]
    return rows.fillna(0, numbers).fillna("", ["worst_function", "cycle"]).withColumn("in_cycle", F.col("cycle") != "")


def analyze(spark: SparkSession, root: str, cfg: Config | None = None, verbose: bool = False) -> Report:
    """Scan, parse and analyse a folder; of a file, the folder that holds it."""
    cfg = cfg or Config()
    validate(cfg)
    root = os.path.dirname(root) if os.path.isfile(root) else root
    address = root if "://" in root else f"file://{os.path.abspath(root)}"
    module, below = _module(root) if "://" not in root else ("", "")
    found, skipped = tree.scan(spark, address, cfg.exclude)
    files = tree.load(found.repartition(max(2, spark.sparkContext.defaultParallelism)), address)
    folder = tree.directory(F.col("path"))
    inside = F.concat(F.lit(below), F.when((folder != "") & F.lit(below != ""), "/").otherwise(""), folder)
    files = files.withColumn("import_path", F.lit("") if not module else F.when(inside == "", module).otherwise(F.concat(F.lit(module + "/"), inside)))
    units = cut(parsers.parsed(files))
    return analyze_units(units, cfg, skipped, root, module, verbose)


__all__ = ["Report", "analyze", "analyze_units", "mean"]
