"""The library's operators bound to the driver's tables, and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions.expressions import basename
from codestrata.operators import duplication, gate, graph, measures, resolve, smells
from codestrata.plans.analyze import by_class
from codestrata.sources import tree

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "lang", "text")


_LINES = """
lines AS (SELECT doc_id AS path, lang, text, string_split(text, chr(10)) AS ls FROM documents),
measured AS (
  SELECT path, lang, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS total_lines,
    len(list_filter(ls, lambda x: trim(x) <> ''))::BIGINT AS physical_sloc, len(list_filter(ls, lambda x: regexp_matches(x, '[\\p{L}\\p{Nd}]')))::BIGINT AS comment_lines FROM lines),
line_measures AS (SELECT *, coalesce(round(100.0 * comment_lines / nullif(physical_sloc + comment_lines, 0) * 10) / 10, 0.0)::DOUBLE AS comment_pct FROM measured)"""
_TOKENS = """
tok AS (
  SELECT path, row_number() OVER (PARTITION BY path ORDER BY line, i) - 1 AS pos, w[i] AS t, line FROM (
    SELECT path, line, w, unnest(range(1, len(w) + 1)) AS i FROM (
      SELECT path, line, regexp_extract_all(l, '[^ \\t\\r\\f\\x0B]+') AS w FROM (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)))),
win AS (
  SELECT path, pos, string_agg(t, chr(0)) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS g, count(*) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n FROM tok),
h AS (SELECT path, pos, hash(g) AS h FROM win WHERE n = 20),
st AS (SELECT path, pos, min(path) OVER a <> max(path) OVER a OR pos - min(pos) OVER b >= 20 OR max(pos) OVER b - pos >= 20 AS dup FROM h WINDOW a AS (PARTITION BY h), b AS (PARTITION BY h, path)),
cov AS (
  SELECT tok.path, tok.line, coalesce(max(CASE WHEN st.dup THEN 1 ELSE 0 END) OVER (PARTITION BY tok.path ORDER BY tok.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS c FROM tok LEFT JOIN st USING (path, pos)),
dup AS (
  SELECT doc_id AS path, lang, count(cov.path)::BIGINT AS tokens, coalesce(sum(c), 0)::BIGINT AS dup_tokens, count(DISTINCT CASE WHEN c = 1 THEN line END)::BIGINT AS dup_lines
  FROM documents LEFT JOIN cov ON path = doc_id GROUP BY ALL)"""


@query(f"WITH {_LINES} SELECT path, lang, total_lines, physical_sloc, comment_lines, comment_pct FROM line_measures")
def line_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.line_measures(text_units(spark, sf_dir))


@query(f"WITH {_TOKENS} SELECT path, lang, tokens, dup_tokens, dup_lines, coalesce(round(100.0 * dup_tokens / nullif(tokens, 0) * 100) / 100, 0.0)::DOUBLE AS dup_pct FROM dup")
def dup_tokens_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplication.coverage(measures.token_arrays(text_units(spark, sf_dir)))


@query(
    f"WITH {_TOKENS} SELECT sum(tokens)::BIGINT AS total_tokens, sum(dup_tokens)::BIGINT AS dup_tokens, sum(dup_lines)::BIGINT AS dup_lines, "
    "coalesce(round(100.0 * sum(dup_tokens) / nullif(sum(tokens), 0) * 10) / 10, 0.0)::DOUBLE AS dup_pct FROM dup"
)
def dup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplication.summary(dup_tokens_by_unit(spark, sf_dir))


_REPORT = f"""WITH {_LINES}, {_TOKENS},
report AS (
  SELECT path, lang, total_lines, physical_sloc, comment_lines, comment_pct, tokens, dup_tokens, dup_lines,
    coalesce(round(100.0 * dup_tokens / nullif(tokens, 0) * 100) / 100, 0.0)::DOUBLE AS dup_pct, coalesce(round(100.0 * dup_lines / nullif(physical_sloc, 0) * 100) / 100, 0.0)::DOUBLE AS dup_lines_pct
  FROM line_measures JOIN dup USING (path, lang))"""


@query(f"{_REPORT} SELECT * FROM report")
def unit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = text_units(spark, sf_dir)
    rows = measures.line_measures(units).join(duplication.coverage(measures.token_arrays(units)).drop("lang"), "path")
    rows = rows.withColumn("dup_lines_pct", measures.dup_lines_pct(F.col("dup_lines"), F.col("physical_sloc")))
    return rows.select("path", "lang", "total_lines", "physical_sloc", "comment_lines", "comment_pct", "tokens", "dup_tokens", "dup_lines", "dup_pct", "dup_lines_pct")


_ROLLUP = """count(*)::BIGINT AS prod_files, sum(physical_sloc)::BIGINT AS physical_sloc, sum(total_lines)::BIGINT AS logical_loc, sum(comment_lines)::BIGINT AS comment_lines,
  count(*)::BIGINT AS types, 0::BIGINT AS abstract_types, sum(dup_tokens)::BIGINT AS dup_tokens, sum(tokens)::BIGINT AS total_tokens, sum(dup_lines)::BIGINT AS duplicated_lines,
  coalesce(round(100.0 * sum(comment_lines) / nullif(sum(physical_sloc) + sum(comment_lines), 0) * 10) / 10, 0.0)::DOUBLE AS comment_pct,
  coalesce(round(100.0 * sum(dup_tokens) / nullif(sum(tokens), 0) * 10) / 10, 0.0)::DOUBLE AS dup_pct"""


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_report(spark, sf_dir).withColumns({"logical_loc": F.col("total_lines"), "types": F.lit(1), "abstract_types": F.lit(0)})


@query(f"{_REPORT} SELECT {_ROLLUP} FROM report")
def global_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.unit_rollup(_typed(spark, sf_dir), [])


@query(f"{_REPORT} SELECT lang, {_ROLLUP} FROM report GROUP BY lang")
def language_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.unit_rollup(_typed(spark, sf_dir), ["lang"])


@query()
def dup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("path"), F.lit("en").alias("lang"), "text")
    return duplication.blocks(measures.token_arrays(units), 3)


# orders as files, their lines as functions, in languages by flag
_FUNCTIONS_SQL = """
functions AS (
  SELECT l_orderkey AS path, CASE l_returnflag WHEN 'A' THEN 'go' WHEN 'N' THEN 'python' ELSE 'typescript' END AS lang, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + l_quantity::BIGINT AS ord, 'f' || l_partkey AS name, 'T' || l_suppkey % 3 AS enclosing,
    l_linestatus = 'O' AND l_linenumber % 2 = 0 AS anonymous, l_partkey % 500 AS start_line, l_partkey % 500 + l_quantity::BIGINT AS end_line, l_quantity::BIGINT AS complexity, (l_quantity * l_linenumber)::BIGINT AS cognitive,
    l_partkey % 80 AS length, l_suppkey % 6 AS nesting, l_linenumber + l_partkey % 4 AS params, l_suppkey % 5 AS bool_max FROM lineitem)"""


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as path", "case l_returnflag when 'A' then 'go' when 'N' then 'python' else 'typescript' end as lang", "l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + cast(l_quantity as bigint) as ord", "concat('f', l_partkey) as name",
        "concat('T', l_suppkey % 3) as enclosing", "l_linestatus = 'O' and l_linenumber % 2 = 0 as anonymous", "l_partkey % 500 as start_line", "l_partkey % 500 + cast(l_quantity as bigint) as end_line",
        "cast(l_quantity as bigint) as complexity", "cast(l_quantity * l_linenumber as bigint) as cognitive", "l_partkey % 80 as length", "l_suppkey % 6 as nesting",
        "l_linenumber + l_partkey % 4 as params", "l_suppkey % 5 as bool_max",
    )


def _function_sql(digits: int) -> str:
    s = 10**digits
    return f"""count(*)::BIGINT AS functions, round(sum(complexity)::DOUBLE / count(*) * {s}) / {s} AS avg_complexity, round(sum(cognitive)::DOUBLE / count(*) * {s}) / {s} AS avg_cognitive, max(complexity)::BIGINT AS worst_complexity,
  max(cognitive)::BIGINT AS worst_cognitive, max(length)::BIGINT AS max_function_length, max(nesting)::BIGINT AS max_nesting, max(params)::BIGINT AS max_params"""


@query(f"WITH {_FUNCTIONS_SQL} SELECT path, {_function_sql(2)}, first(name ORDER BY complexity DESC, ord) AS worst_function FROM functions GROUP BY path")
def function_rollup_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.function_rollup(functions(spark, sf_dir), ["path"], 2)


@query(f"WITH {_FUNCTIONS_SQL} SELECT lang, {_function_sql(1)}, first(path || ': ' || name ORDER BY complexity DESC, path, ord) AS worst_function FROM functions GROUP BY lang")
def function_rollup_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.function_rollup(functions(spark, sf_dir), ["lang"])


@query(f"WITH {_FUNCTIONS_SQL} SELECT {_function_sql(1)}, first(path || ': ' || name ORDER BY complexity DESC, path, ord) AS worst_function FROM functions")
def worst_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.function_rollup(functions(spark, sf_dir), [])


@query(
    f"""WITH {_FUNCTIONS_SQL}, code AS (SELECT DISTINCT l_orderkey AS path, l_suppkey * 7 % 560 AS line FROM lineitem)
SELECT f.path, f.ord, count(code.line)::BIGINT AS length FROM functions f LEFT JOIN code ON code.path = f.path AND code.line BETWEEN start_line AND end_line GROUP BY f.path, f.ord"""
)
def function_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as path", "l_suppkey * 7 % 560 as line")
    return measures.function_lengths(functions(spark, sf_dir), code)


# rules
_RULES_SQL = "rules(rule, lang, severity, threshold) AS (VALUES " + ", ".join(f"('{r}', '{lang}', '{s}', {own.get(lang, t)})" for r, _, s, t, own in smells.CATALOG for lang in smells.LANGUAGES) + ")"
_FILES_SQL = """files AS (
  SELECT o_orderkey AS path, CASE o_orderstatus WHEN 'F' THEN 'go' WHEN 'O' THEN 'python' ELSE 'java' END AS lang, floor(o_totalprice / 200)::BIGINT AS physical_sloc, o_custkey % 200 AS comment_lines, o_orderkey % 120 AS dup_lines FROM orders)"""
_ISSUES_SQL = f"""{_FUNCTIONS_SQL}, {_FILES_SQL}, {_RULES_SQL},
vals AS (
  SELECT rule, path, lang, start_line AS line, name AS function, value::DOUBLE AS value FROM (
    SELECT path, lang, start_line, name, unnest(['cognitive-complexity', 'cyclomatic-complexity', 'function-length', 'nesting-depth', 'parameter-count', 'boolean-complexity']) AS rule,
      unnest([cognitive, complexity, length, nesting, params, bool_max]) AS value FROM functions)
  UNION ALL SELECT 'file-length', path, lang, 1, NULL, physical_sloc FROM files
  UNION ALL SELECT 'duplicated-file', path, lang, 1, NULL, 100.0 * dup_lines / physical_sloc FROM files WHERE physical_sloc > 0
  UNION ALL SELECT 'comment-density', path, lang, 1, NULL, 100.0 * comment_lines / (physical_sloc + comment_lines) FROM files WHERE physical_sloc >= 50
  UNION ALL SELECT 'too-many-methods', path, lang, first(start_line ORDER BY ord), enclosing, count(*) FROM functions WHERE NOT anonymous GROUP BY path, lang, enclosing),
issues AS (
  SELECT rule, severity, path AS file, line, function, (floor(value * 100 + 0.5) / 100)::DOUBLE AS value, threshold::DOUBLE AS threshold FROM vals JOIN rules USING (rule, lang)
  WHERE CASE WHEN rule = 'comment-density' THEN value < threshold ELSE value > threshold END)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as path", "case o_orderstatus when 'F' then 'go' when 'O' then 'python' else 'java' end as lang", "cast(floor(o_totalprice / 200) as bigint) as physical_sloc", "o_custkey % 200 as comment_lines", "o_orderkey % 120 as dup_lines"
    )


@query(f"WITH {_ISSUES_SQL} SELECT * FROM issues")
def smell_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smells.issues(files(spark, sf_dir), functions(spark, sf_dir), smells.catalog(spark))


@query(f"WITH {_ISSUES_SQL} SELECT severity, count(*)::BIGINT AS n FROM issues GROUP BY severity")
def severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smells.severity_histogram(smell_issues(spark, sf_dir))


@query(
    f"WITH {_FUNCTIONS_SQL} SELECT path, lang, enclosing, count(*)::BIGINT AS methods, first(start_line ORDER BY ord) AS line FROM functions WHERE NOT anonymous AND enclosing <> '' GROUP BY path, lang, enclosing"
)
def methods_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smells.methods_per_type(functions(spark, sf_dir))


@query(f"WITH {_ISSUES_SQL} SELECT path, name, lang, complexity FROM functions f WHERE EXISTS (SELECT 1 FROM issues i WHERE i.file = f.path AND i.function = f.name)")
def flagged_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = functions(spark, sf_dir)
    return smells.flagged_functions(own, smell_issues(spark, sf_dir)).select("path", "name", "lang", "complexity")


@query(
    f"WITH {_RULES_SQL} SELECT rule, lang, CASE WHEN rule = 'nesting-depth' AND lang = 'go' THEN false ELSE true END AS enabled, "
    "(CASE WHEN rule = 'cognitive-complexity' THEN CASE lang WHEN 'python' THEN 40 ELSE 70 END ELSE threshold END)::DOUBLE AS threshold, "
    "CASE WHEN rule = 'cognitive-complexity' THEN CASE lang WHEN 'python' THEN 'low' ELSE 'blocker' END ELSE severity END AS severity FROM rules"
)
def smell_override_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("cognitive-complexity", None, None, 70.0, "blocker"), ("cognitive-complexity", "python", None, 40.0, "low"), ("nesting-depth", "go", False, None, None)]
    overrides = spark.createDataFrame(rows, "rule string, lang string, enabled boolean, threshold double, severity string")
    return smells.resolve_rules(smells.catalog(spark), overrides).select("rule", "lang", "enabled", "threshold", "severity")


# budgets
_SUMMARY_SQL = f"""{_FUNCTIONS_SQL},
summary AS (SELECT 'all' AS lang, {_function_sql(1)} FROM functions UNION ALL SELECT lang, {_function_sql(1)} FROM functions GROUP BY lang),
measures AS (
  SELECT CASE lang WHEN 'all' THEN '' ELSE lang END AS lang, unnest(['avg_complexity', 'worst_complexity', 'avg_cognitive_complexity', 'worst_cognitive_complexity', 'max_function_length', 'max_nesting', 'max_params']) AS key,
    unnest([avg_complexity, worst_complexity, avg_cognitive, worst_cognitive, max_function_length, max_nesting, max_params])::DOUBLE AS value FROM summary)"""
_BUDGETS = [("", "avg_complexity", 20.0, "error"), ("", "worst_complexity", 50.0, "error"), ("", "max_function_length", 100.0, "warn"), ("", "max_issues", 10.0, "warn"), ("", "max_params", 0.0, "warn"),
            ("python", "avg_complexity", 8.0, "error"), ("typescript", "max_nesting", 5.0, "warn"), ("rust", "max_nesting", 3.0, "error")]
_WEIGHTS = [("avg_complexity", 25.0), ("worst_complexity", 15.0), ("max_function_length", 20.0), ("max_params", 20.0), ("max_nesting", 20.0)]
_BUDGETS_SQL = f"""{_SUMMARY_SQL},
budgets(lang, key, "limit", tier) AS (VALUES {", ".join(str(b) for b in _BUDGETS)}), weights(key, weight) AS (VALUES {", ".join(str(w) for w in _WEIGHTS)}),
results AS (SELECT b.lang, b.key, coalesce(value, 0.0)::DOUBLE AS value, "limit"::DOUBLE AS "limit", tier, coalesce(value, 0.0) > "limit" AS breached FROM budgets b LEFT JOIN measures m ON m.lang = b.lang AND m.key = b.key)"""
_COLUMNS = {k: v for k, v in gate.SUMMARY_METRICS.items() if v not in ("dup_pct", "dup_lines_pct", "issues")}


@query(f"WITH {_SUMMARY_SQL} SELECT lang, key, value FROM measures")
def metric_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = functions(spark, sf_dir)
    every = measures.function_rollup(own, []).withColumn("lang", F.lit(""))
    return gate.unpivoted(every.unionByName(measures.function_rollup(own, ["lang"])), _COLUMNS, ["lang"])


@query(f"WITH {_ISSUES_SQL} SELECT 'max_' || severity || '_issues' AS key, count(*)::DOUBLE AS value FROM issues GROUP BY severity")
def severity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.severity_metrics(severity_histogram(spark, sf_dir))


@query(f"WITH {_BUDGETS_SQL} SELECT * FROM results")
def budget_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    budgets = spark.createDataFrame(_BUDGETS, "lang string, key string, limit double, tier string")
    return gate.evaluate(budgets, metric_unpivot(spark, sf_dir))


@query(f"WITH {_BUDGETS_SQL} SELECT CASE WHEN bool_or(breached AND tier = 'error') THEN 1 ELSE 0 END AS exit_code, (count(*) FILTER (breached))::BIGINT AS breaches FROM results")
def gate_exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.exit_code(budget_results(spark, sf_dir))


@query(
    f"""WITH {_BUDGETS_SQL} SELECT sum(weight * CASE WHEN "limit" > 0 THEN greatest(0.0, least(100.0, 100.0 * (1 - value / nullif("limit", 0)))) ELSE 0 END)::DOUBLE / sum(weight)::DOUBLE AS score FROM results JOIN weights USING (key) WHERE lang = ''"""
)
def composite_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.composite(budget_results(spark, sf_dir), spark.createDataFrame(_WEIGHTS, "key string, weight double"))


# trade between nations as a dependency graph
_TRADE_SQL = """
trade AS (
  SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
edges AS (SELECT src, dst FROM trade WHERE src <> dst AND n * 400 >= (SELECT count(*) FROM lineitem)),
nodes AS (SELECT n_nationkey AS path, n_regionkey + 1 AS types, n_nationkey % (n_regionkey + 1) AS abstract_types FROM nation)"""
_SCC_SQL = f"""{_TRADE_SQL},
reach AS (WITH RECURSIVE r(a, b) AS (SELECT src, dst FROM edges UNION SELECT r.a, e.dst FROM r JOIN edges e ON e.src = r.b) SELECT * FROM r),
members AS (SELECT x.a AS path, least(x.a, min(x.b)) AS root FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"""


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    pairs = lines.join(orders, "l_orderkey").join(customers, "o_custkey").join(suppliers, "l_suppkey").groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over pairs of nations
    return pairs.withColumn("total", total).filter("src <> dst and n * 400 >= total").select("src", "dst")


def nation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").selectExpr("n_nationkey as path", "n_regionkey + 1 as types", "n_nationkey % (n_regionkey + 1) as abstract_types")


@query(f"WITH {_TRADE_SQL} SELECT src, dst FROM edges")
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_edges(spark, sf_dir)


@query(
    f"""WITH {_TRADE_SQL}, d AS (
  SELECT path, (SELECT count(*) FROM edges WHERE dst = path)::BIGINT AS ca, (SELECT count(*) FROM edges WHERE src = path)::BIGINT AS ce, coalesce(abstract_types / nullif(types, 0), 0.0) AS a FROM nodes)
SELECT path, ca, ce, round(coalesce(ce / nullif(ca + ce, 0), 0.0) * 1000) / 1000 AS instability, round(a * 1000) / 1000 AS abstractness, round(abs(a + coalesce(ce / nullif(ca + ce, 0), 0.0) - 1) * 1000) / 1000 AS distance FROM d"""
)
def coupling_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coupling(nation_nodes(spark, sf_dir), trade_edges(spark, sf_dir))


@query(f"WITH {_SCC_SQL} SELECT path, root FROM members")
def scc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(trade_edges(spark, sf_dir))


@query(f"WITH {_SCC_SQL} SELECT (row_number() OVER (ORDER BY root) - 1)::INTEGER AS cycle_idx, root AS name, count(*)::BIGINT AS size, list_sort(list(path)) AS members FROM members GROUP BY root")
def scc_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(graph.components(trade_edges(spark, sf_dir)))


@query(
    f"""WITH {_SCC_SQL}, s AS (SELECT root, count(*) AS n FROM members GROUP BY root)
SELECT count(*)::BIGINT AS cycles, coalesce(max(n), 0)::BIGINT AS max_cycle_members, coalesce(sum(n), 0)::BIGINT AS files_in_cycle, (round(100.0 * coalesce(sum(n), 0) / (SELECT count(*) FROM nodes) * 10) / 10)::DOUBLE AS in_cycle_pct FROM s"""
)
def cycle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycle_summary(graph.components(trade_edges(spark, sf_dir)), nation_nodes(spark, sf_dir))


_MOVES_SQL = """
moves AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)"""


@query(f"WITH {_MOVES_SQL} SELECT DISTINCT src, dst FROM moves WHERE dst IS NOT NULL AND src <> dst")
def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("src"), after.alias("dst")).filter("dst is not null and src <> dst").distinct()


@query(
    f"""WITH RECURSIVE {_MOVES_SQL.strip()}, e AS (SELECT DISTINCT src, dst FROM moves WHERE dst IS NOT NULL AND src <> dst), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
SELECT x.a AS path, least(x.a, min(x.b)) AS root FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a"""
)
def event_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(event_edges(spark, sf_dir))


# parts as source files
_PARTS_SQL = """
parts AS (SELECT p_partkey AS k, 'src/' || p_partkey % 7 || '/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '/index.ts' END AS path FROM part),
imp AS (SELECT path, k, CASE k % 3 WHEN 2 THEN '../' ELSE './' END || (k + d * 7) AS spec, d, 'src/' || k % 7 || '/' || (k + d * 7) AS base FROM parts, (SELECT unnest([1, 2]) AS d))"""


def part_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey as k", "concat('src/', p_partkey % 7, '/', p_partkey, case p_partkey % 3 when 0 then '.ts' when 1 then '.js' else '/index.ts' end) as path", "p_brand")
    up = F.when(F.col("k") % 3 == 2, "../").otherwise("./")
    return rows.withColumn("imports", F.array(*[F.concat(up, F.col("k") + 7 * d) for d in (1, 2)])).withColumns({"lang": F.lit("typescript"), "package": F.lit("")})


@query(
    f"""WITH {_PARTS_SQL}, cand AS (SELECT path, d, base || e AS target, i FROM imp, (SELECT unnest(['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs']) AS e, unnest(range(13)) AS i)),
hit AS (SELECT c.path, d, arg_min(target, i) AS target FROM cand c JOIN parts p ON p.path = c.target GROUP BY c.path, d)
SELECT p.path, coalesce(list(target ORDER BY d) FILTER (target IS NOT NULL), []) AS deps FROM parts p LEFT JOIN hit USING (path) GROUP BY p.path"""
)
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(part_units(spark, sf_dir)).select("path", "deps")


_JAVA_SQL = """
units AS (SELECT p_partkey AS k, 'src/C' || p_partkey || '.java' AS path, 'pkg.b' || p_partkey % 40 AS package FROM part),
imports AS (SELECT path, 'pkg.b' || (k + 1) % 40 || '.*' AS spec FROM units WHERE k % 10 = 0 UNION ALL SELECT path, 'pkg.b' || (k + 2) % 40 || '.C' || (k + 2) FROM units)"""


def java_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey as k", "concat('src/C', p_partkey, '.java') as path", "concat('pkg.b', p_partkey % 40) as package")
    wild = F.when(F.col("k") % 10 == 0, F.concat(F.lit("pkg.b"), (F.col("k") + 1) % 40, F.lit(".*")))
    exact = F.concat(F.lit("pkg.b"), (F.col("k") + 2) % 40, F.lit(".C"), F.col("k") + 2)
    return rows.withColumn("imports", F.array_compact(F.array(wild, exact))).withColumn("lang", F.lit("java"))


@query(
    f"""WITH {_JAVA_SQL}, hit AS (
  SELECT i.path, u.path AS target FROM imports i JOIN units u ON ends_with(spec, '.*') AND spec = u.package || '.*' UNION SELECT i.path, u.path FROM imports i JOIN units u ON spec = u.package || '.' || 'C' || u.k)
SELECT path, list(target ORDER BY target) AS deps FROM hit GROUP BY path"""
)
def java_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = java_units(spark, sf_dir)
    return resolve.resolve_java(units.select("path", F.posexplode("imports").alias("ord", "spec")), units)


@query(
    f"""WITH {_JAVA_SQL} SELECT DISTINCT a.path AS src, b.path AS dst FROM units a JOIN units b ON b.package = 'pkg.b' || (a.k + 1) % 40 WHERE a.k % 10 = 0 AND a.path <> b.path"""
)
def package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = java_units(spark, sf_dir).withColumn("imports", F.when(F.col("k") % 10 == 0, F.array(F.concat(F.lit("pkg.b"), (F.col("k") + 1) % 40))).otherwise(F.array()))
    return graph.build_edges(units.select("path", F.col("package").alias("import_path"), "imports", F.array().cast("array<string>").alias("deps")))


# pages as paths
_PATHS_SQL = "paths AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in (".py", "_test.py", ".test.ts", ".java", "Test.java", ".rs", ".c", ".h", ".md", "/test/x.go")]), (F.col("page_id") % 10 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), ext).alias("path"))


_EXT_SQL = _PATHS_SQL.replace("'') AS path", "'') || ['.py', '_test.py', '.test.ts', '.java', 'Test.java', '.rs', '.c', '.h', '.md', '/test/x.go'][page_id % 10 + 1] AS path")


@query(
    f"""WITH {_EXT_SQL} SELECT page_id, path, CASE regexp_extract(path, '(\\.[^./]*)$', 1) WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.java' THEN 'java' WHEN '.rs' THEN 'rust' WHEN '.c' THEN 'c' WHEN '.h' THEN 'cpp' WHEN '.go' THEN 'go' END AS lang FROM paths"""
)
def path_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_paths(spark, sf_dir).withColumn("lang", tree.language_of(F.col("path")))


@query(
    f"""WITH {_EXT_SQL} SELECT page_id, path, list_contains(string_split(path, '/')[:-2], 'test') OR list_contains(string_split(path, '/')[:-2], 'tests') OR CASE
  WHEN path LIKE '%.py' THEN ends_with(path, '_test.py') OR starts_with(regexp_extract(path, '([^/]*)$', 1), 'test_') WHEN path LIKE '%.ts' THEN strpos(path, '.test.') > 1 OR strpos(path, '.spec.') > 1
  WHEN path LIKE '%.java' THEN regexp_matches(path, '(Test|Tests|TestCase)\\.java$') OR starts_with(regexp_extract(path, '([^/]*)$', 1), 'Test') WHEN path LIKE '%.rs' THEN ends_with(path, '_test.rs') OR starts_with(regexp_extract(path, '([^/]*)$', 1), 'test_')
  WHEN path LIKE '%.c' OR path LIKE '%.h' THEN starts_with(regexp_extract(path, '([^/]*)$', 1), 'test_') OR contains(regexp_extract(path, '([^/]*)$', 1), '_test.') WHEN path LIKE '%.go' THEN ends_with(path, '_test.go') ELSE false END AS is_test FROM paths"""
)
def test_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return page_paths(spark, sf_dir).withColumn("is_test", tree.is_test(path, tree.language_of(path)))


@query(
    f"""WITH {_PATHS_SQL} SELECT page_id, path, len(list_filter(string_split(path, '/')[:-2], lambda d: d IN ('en', 'out') OR regexp_matches(d, '^blog\\.[^/]*$'))) > 0 AS excluded,
  list_filter(string_split(path, '/')[:-2], lambda d: d IN ('en', 'out') OR regexp_matches(d, '^blog\\.[^/]*$'))[1] AS by_dir FROM paths"""
)
def dir_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("rel_path"))
    out = tree.pruned(rows, ["en", "out", "blog.*"])
    return out.select("page_id", F.col("rel_path").alias("path"), tree.in_excluded(F.col("rel_path"), ["en", "out", "blog.*"]).alias("excluded"), basename(F.col("pruned")).alias("by_dir"))


@query(
    """WITH s AS (SELECT page_id, html, regexp_replace(html, '(?s)//[^\\n]*|/\\*.*?(?:\\*/|\\z)|"(?:\\\\.|[^"\\\\])*"?|''(?:\\\\.|[^''\\\\])*''?', ' ', 'g') AS code FROM pages)
SELECT page_id, contains(html, 'extern "C"') OR regexp_matches(code, '(^|[^\\p{L}\\p{Nd}_])(class|template|namespace)($|[^\\p{L}\\p{Nd}_])') OR contains(code, '::') AS is_cpp, length(code)::INTEGER AS n_code FROM s"""
)
def cpp_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", tree.has_cpp_markers(F.col("html")).alias("is_cpp"), F.length(tree.stripped(F.col("html"))).alias("n_code"))


@query("SELECT page_id, contains(html, 'Code generated') AND contains(html, 'DO NOT EDIT') AS generated, contains(html, '@generated') OR contains(lower(html), '<auto-generated>') OR contains(html, 'Code generated') AND contains(html, 'DO NOT EDIT') AS java_generated FROM pages")
def generated_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return read(spark, sf_dir, "pages").select("page_id", tree.is_generated(html, F.lit("python")).alias("generated"), tree.is_generated(html, F.lit("java")).alias("java_generated"))


@query("SELECT d.lang, count(*)::BIGINT AS prod_files, sum(n_chars)::BIGINT AS chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) GROUP BY d.lang")
def prod_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit(True))
    units = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(test, "doc_id", "left")
    units = units.select("*", F.when(F.col("toxic"), "test").otherwise("prod").alias("class"), F.lit(False).alias("is_generated"))
    return by_class(units, "prod").groupBy("lang").agg(F.count("*").alias("prod_files"), F.sum("n_chars").alias("chars"))
