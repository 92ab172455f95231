"""Queries over source files generated from the tables, whose measures SQL can state, and over paths and imports in the forms of each language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import parsers
from codestrata.operators import gate, graph, resolve, smells
from codestrata.plans import queries as q
from codestrata.plans import report
from codestrata.plans.queries import query, read
from codestrata.sources import tree

LANGS = ["go", "typescript", "javascript", "python", "c", "cpp", "java", "rust"]
#: For each language the lines before a function, its first line, the parts of its parameters, an open ``if``, a statement, and a line that imports m<k>.
_SHAPES = {
    "go": ("package p", "func f{k}({p}) int {{", "a{i} int", "if {c} {{", "a1 = 2", 'import "x/m{k}"', "x/m{k}"),
    "typescript": (None, "function f{k}({p}): number {{", "a{i}: number", "if ({c}) {{", "a1 = 2;", "import y from './m{k}';", "./m{k}"),
    "javascript": (None, "function f{k}({p}) {{", "a{i}", "if ({c}) {{", "a1 = 2;", "import y from './m{k}';", "./m{k}"),
    "python": (None, "def f{k}({p}):", "a{i}", "if {c}:", "a1 = 2", "import x.m{k}", "x.m{k}"),
    "c": (None, "int f{k}({p}) {{", "int a{i}", "if ({c}) {{", "a1 = 2;", '#include "m{k}.h"', "m{k}.h"),
    "cpp": (None, "int f{k}({p}) {{", "int a{i}", "if ({c}) {{", "a1 = 2;", '#include "m{k}.h"', "m{k}.h"),
    "java": ("class C{k} {{", "int f{k}({p}) {{", "int a{i}", "if ({c}) {{", "a1 = 2;", "import x.M{k};", "x.M{k}"),
    "rust": (None, "fn f{k}({p}) -> i32 {{", "a{i}: i32", "if {c} {{", "a1 = 2;", "use crate::m{k};", "crate::m{k}"),
}


def _filled(shape: str, **values: Column) -> Column:
    """A shape with its named places filled, and doubled braces made single."""
    out, rest = [], shape.replace("{{", "\0").replace("}}", "\1")
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [F.lit(head), values[name].cast("string")]
    return F.concat(*[F.regexp_replace(x, "\0", "{") for x in [*out, F.lit(rest)]])


def _nested(opened: str, wide: Column):
    """The i-th ``if``, of which the first has the wide condition."""
    return lambda i: F.concat(F.repeat(F.lit("    "), i.cast("int")), _filled(opened, c=F.when(i == 1, wide).otherwise("a1 > 1")))


def _parameter(param: str):
    return lambda i: _filled(param, i=i)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, lang, class, import_path, text)``: a function of p_partkey % 4 nested ifs, the first with p_partkey % 3 further operands, and 1 + p_partkey % 3 parameters."""
    k = F.col("p_partkey")
    depth, more, params = k % 4, k % 3, 1 + k % 3
    numbers = lambda n: F.filter(F.sequence(F.lit(0), n.cast("int")), lambda i: i > 0)
    text = F.lit(None).cast("string")
    for n, lang in enumerate(LANGS):
        before, first, param, opened, statement, imported, _ = _SHAPES[lang]
        python = lang == "python"
        word = " and " if python else " && "
        wide = F.concat(F.lit("a1 > 1"), F.repeat(F.lit(f"{word}a1 > 2"), more.cast("int")))
        ifs = F.transform(numbers(depth), _nested(opened, wide))
        closes = F.transform(numbers(depth), lambda i: F.lit("}")) if not python else F.array().cast("array<string>")
        mark = F.lit("# note" if python else "// note")
        end = "" if lang in ("go", "python") else ";"
        listed = F.array_join(F.transform(numbers(params), _parameter(param)), ", ")
        lines = F.concat(
            F.when(k % 2 == 1, F.array(mark)).otherwise(F.array().cast("array<string>")),
            F.array(*([_filled(before, k=k), _filled(imported, k=k)] if lang == "go" else [_filled(imported, k=k)] + ([_filled(before, k=k)] if before else []))),
            F.array(_filled(first, k=k, p=listed)),
            ifs,
            F.array(F.concat(F.repeat(F.lit("    "), (depth + 1).cast("int")), F.lit(statement))),
            closes,
            F.array(F.lit(f"    return a1{end}")),
            F.array(*[F.lit("}")] * (0 if python else 2 if lang == "java" else 1)) if not python else F.array().cast("array<string>"),
        )
        text = F.when(k % 8 == n, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(text)
    lang = F.element_at(F.array(*[F.lit(x) for x in LANGS]), (k % 8 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(F.concat(F.lit("src/s"), k).alias("path"), lang.alias("lang"), F.lit("prod").alias("class"), F.lit("").alias("import_path"), text.alias("text"))


_SOURCE_SQL = """
src AS (SELECT p_partkey AS k, 'src/s' || p_partkey AS path, ['go', 'typescript', 'javascript', 'python', 'c', 'cpp', 'java', 'rust'][p_partkey % 8 + 1] AS lang, p_partkey % 4 AS d,
  CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 3 ELSE 0 END AS b, 1 + p_partkey % 3 AS p, p_partkey % 2 AS c FROM part),
shape AS (SELECT *, CASE lang WHEN 'python' THEN 0 ELSE 1 END AS br, CASE lang WHEN 'go' THEN 1 WHEN 'java' THEN 2 ELSE 0 END AS extra FROM src),
sized AS (SELECT *, 3 + d + d * br + br AS len FROM shape)"""


@query(
    f"WITH {_SOURCE_SQL} SELECT path, lang, 'f' || k AS name, (1 + d + b)::BIGINT AS complexity, (d * (d + 1) // 2 + CASE WHEN b > 0 THEN 1 ELSE 0 END)::BIGINT AS cognitive, d::BIGINT AS nesting, p::BIGINT AS params, len::BIGINT AS length, false AS anonymous FROM sized"
)
def source_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsers.parsed(source_files(spark, sf_dir)).select("path", "lang", F.explode("functions").alias("f"))
    whole = [F.col(f"f.{c}").cast("long").alias(c) for c in ("complexity", "cognitive", "nesting", "params", "length")]
    return rows.select("path", "lang", "f.name", *whole, "f.anonymous")


@query(f"WITH {_SOURCE_SQL} SELECT path, lang, (c + 1 + extra + len)::BIGINT AS total_lines, (1 + CASE lang WHEN 'java' THEN 0 ELSE extra END + len)::BIGINT AS physical_sloc, c::BIGINT AS comment_lines, false AS is_generated, (error IS NOT NULL) AS failed FROM (SELECT *, NULL AS error FROM sized)")
def source_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = [F.col(c).cast("long").alias(c) for c in ("total_lines", "physical_sloc", "comment_lines")]
    return parsers.parsed(source_files(spark, sf_dir)).select("path", "lang", *whole, "is_generated", F.col("error").isNotNull().alias("failed"))


_SPECS = " ".join(f"WHEN '{lang}' THEN '{s[6].split('{k}')[0]}' || k || '{s[6].split('{k}')[1]}'" for lang, s in _SHAPES.items())


@query(f"WITH {_SOURCE_SQL} SELECT path, lang, CASE lang {_SPECS} END AS spec FROM src")
def source_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.parsed(source_files(spark, sf_dir)).select("path", "lang", F.explode("imports").alias("spec"))


def _units(spark: SparkSession, sf_dir: str, lang: str, path: Column, specs: list[Column]) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return rows.select("k", path.alias("path"), F.lit(lang).alias("lang"), F.lit("").alias("package"), F.array(*specs).alias("imports"))


@query(
    """WITH u AS (SELECT p_partkey AS k, CASE p_partkey % 2 WHEN 0 THEN 'pkg/a/m' || p_partkey || '.py' ELSE 'pkg/a/m' || p_partkey || '/__init__.py' END AS path FROM part),
imp AS (SELECT path, 1 AS o, 'pkg/a/m' || (k + 1) AS base FROM u UNION ALL SELECT path, 2, CASE k % 2 WHEN 0 THEN 'pkg/a/m' ELSE 'pkg/m' END || (k + 2) FROM u),
hit AS (SELECT i.path, o, t.path AS target FROM imp i JOIN u t ON t.path = base || '.py' OR t.path = base || '/__init__.py')
SELECT u.path, coalesce(list(target ORDER BY o) FILTER (target IS NOT NULL), []) AS deps FROM u LEFT JOIN hit USING (path) GROUP BY u.path"""
)
def python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An absolute module, and a relative one: one dot from a file is its folder, two from a package's init file the folder above."""
    k = F.col("k")
    path = F.when(k % 2 == 0, F.concat(F.lit("pkg/a/m"), k, F.lit(".py"))).otherwise(F.concat(F.lit("pkg/a/m"), k, F.lit("/__init__.py")))
    near = F.concat(F.when(k % 2 == 0, F.lit(".m")).otherwise(F.lit("...m")), k + 2)
    return resolve.resolve(_units(spark, sf_dir, "python", path, [F.concat(F.lit("pkg.a.m"), k + 1), near])).select("path", "deps")


@query(
    """WITH u AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'inc/h' || p_partkey || '.h' ELSE 'src/h' || p_partkey || '.h' END AS path FROM part),
cand AS (SELECT path, 1 AS o, 1 AS i, regexp_extract(path, '^[a-z]+/', 0) || 'h' || (k + 1) || '.h' AS target FROM u UNION ALL SELECT path, 1, 2, 'inc/h' || (k + 1) || '.h' FROM u
  UNION ALL SELECT path, 2, 1, 'inc/h' || (k + 3) || '.h' FROM u),
hit AS (SELECT c.path, o, arg_min(target, i) AS target FROM cand c JOIN u t ON t.path = c.target GROUP BY c.path, o)
SELECT u.path, coalesce(list(target ORDER BY o) FILTER (target IS NOT NULL), []) AS deps FROM u LEFT JOIN hit USING (path) GROUP BY u.path"""
)
def include_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quoted include, beside the file or in the include folder, and one in angles, in the folder only."""
    k = F.col("k")
    path = F.concat(F.when(k % 3 == 0, F.lit("inc/h")).otherwise(F.lit("src/h")), k, F.lit(".h"))
    specs = [F.concat(F.lit("h"), k + 1, F.lit(".h")), F.concat(F.lit("<h"), k + 3, F.lit(".h>"))]
    return resolve.resolve(_units(spark, sf_dir, "cpp", path, specs), ["inc"]).select("path", "deps")


@query(
    """WITH u AS (SELECT p_partkey AS k, CASE p_partkey % 2 WHEN 0 THEN 'src/m' || p_partkey || '.rs' ELSE 'src/g/m' || p_partkey || '/mod.rs' END AS path FROM part),
imp AS (SELECT path, 1 AS o, CASE k % 2 WHEN 0 THEN 'src/g/m' || (k + 1) || '/mod.rs' ELSE 'src/m' || (k + 1) || '.rs' END AS target FROM u
  UNION ALL SELECT path, 2, CASE k % 2 WHEN 0 THEN 'src/m' || (k + 2) || '.rs' ELSE 'src/m' || (k + 3) || '.rs' END FROM u),
hit AS (SELECT i.path, o, target FROM imp i JOIN u t ON t.path = target)
SELECT u.path, coalesce(list(target ORDER BY o) FILTER (target IS NOT NULL), []) AS deps FROM u LEFT JOIN hit USING (path) GROUP BY u.path"""
)
def rust_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crate path that ends in an item, and a module beside the file by ``self``, or above a folder's own file by ``super``."""
    k = F.col("k")
    even = k % 2 == 0
    path = F.when(even, F.concat(F.lit("src/m"), k, F.lit(".rs"))).otherwise(F.concat(F.lit("src/g/m"), k, F.lit("/mod.rs")))
    item = F.concat(F.when(even, F.lit("crate::g::m")).otherwise(F.lit("crate::m")), k + 1, F.lit("::Item"))
    near = F.when(even, F.concat(F.lit("self::m"), k + 2)).otherwise(F.concat(F.lit("super::m"), k + 3))
    return resolve.resolve(_units(spark, sf_dir, "rust", path, [item, near])).select("path", "deps")


@query(
    f"""WITH {q._PARTS_SQL}, cand AS (SELECT path, base || e AS target, i, d FROM imp, (SELECT unnest(['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs']) AS e, unnest(range(13)) AS i)),
hit AS (SELECT c.path, d, arg_min(target, i) AS target FROM cand c JOIN parts p ON p.path = c.target GROUP BY c.path, d) SELECT DISTINCT path AS src, target AS dst FROM hit WHERE path <> target"""
)
def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = resolve.resolve(q.part_units(spark, sf_dir))
    return graph.build_edges(units.select("path", F.lit("").alias("import_path"), F.array().cast("array<string>").alias("imports"), "deps"))


@query(f"WITH {q._TRADE_SQL} SELECT DISTINCT dst FROM edges WHERE src = 3")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.successors(q.trade_edges(spark, sf_dir), 3)


@query(f"WITH {q._ISSUES_SQL} SELECT * FROM issues ORDER BY file, line, rule, function NULLS FIRST, value LIMIT 200")
def first_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of the report's list of issues."""
    return smells.ordered(q.smell_issues(spark, sf_dir)).limit(200)


@query(f'WITH {q._BUDGETS_SQL} SELECT * FROM results ORDER BY lang, key LIMIT 4')
def first_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of the report's list of budgets."""
    return gate.ordered(q.budget_results(spark, sf_dir)).limit(4)


@query("SELECT * FROM (VALUES " + ", ".join(str(tuple(r)) for r in gate.REGISTRY) + ") AS r(key, label, unit, digits)")
def metric_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.registry(spark)


_MODULES_SQL = """f AS (SELECT p_partkey AS k, 'a' || p_partkey % 5 || '/b' || p_partkey % 3 || CASE p_partkey % 7 WHEN 0 THEN '/vendor' ELSE '/c' || p_partkey % 2 END || '/x' || p_partkey || '.go' AS rel_path FROM part),
p AS (SELECT k, rel_path, CASE WHEN k % 5 = 1 THEN 'a1' WHEN k % 3 = 2 AND k % 5 = 4 THEN 'a4/b2' WHEN k % 7 = 0 THEN regexp_extract(rel_path, '^(.*/vendor)/', 1) END AS pruned FROM f)"""


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    inner = F.when(k % 7 == 0, F.lit("/vendor")).otherwise(F.concat(F.lit("/c"), k % 2))
    files = read(spark, sf_dir, "part").select(F.concat(F.lit("a"), k % 5, F.lit("/b"), k % 3, inner, F.lit("/x"), k, F.lit(".go")).alias("rel_path"))
    return tree.pruned(files, ["vendor"], spark.createDataFrame([("a1",), ("a4/b2",), ("",)], "dir string"))


@query(f"WITH {_MODULES_SQL} SELECT rel_path, pruned FROM p")
def nested_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return module_files(spark, sf_dir)


@query(f"WITH {_MODULES_SQL} SELECT count(DISTINCT pruned)::BIGINT AS skipped_dirs FROM p")
def skipped_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.skipped_dirs(module_files(spark, sf_dir))


@query(
    """SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN '' ELSE 'example.org/m' || p_partkey END AS module,
  CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'example.org/m' || p_partkey || '/in/d' || p_partkey % 4 ELSE 'example.org/m' || p_partkey || '/d' || p_partkey % 4 END AS import_path FROM part"""
)
def module_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, "// module none here\ngo 1.22\n").otherwise(F.concat(F.lit("// a file\nmodule example.org/m"), k, F.lit("  \ngo 1.22\n")))
    module = tree.module_line(text)
    path = F.concat(F.lit("in/d"), k % 4, F.lit("/x.go"))
    return read(spark, sf_dir, "part").select(k.alias("k"), module.alias("module"), tree.import_path(module, F.when(k % 3 == 2, "in").otherwise(""), path).alias("import_path"))


@query(
    """WITH c AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '// Code generated by x. DO NOT EDIT.' WHEN 1 THEN '/* Code generated by x. DO NOT EDIT. */' WHEN 2 THEN '// Code generated' ELSE '// @generated' END AS comment FROM part)
SELECT k, starts_with(comment, '// Code generated') AND contains(comment, 'DO NOT EDIT') AS go, contains(comment, 'Code generated') AND contains(comment, 'DO NOT EDIT') OR contains(comment, '@generated') AS rust FROM c"""
)
def generated_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    marks = ["// Code generated by x. DO NOT EDIT.", "/* Code generated by x. DO NOT EDIT. */", "// Code generated", "// @generated"]
    comment = F.element_at(F.array(*[F.lit(m) for m in marks]), (k % 4 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(k.alias("k"), tree.is_generated(comment, F.lit("go")).alias("go"), tree.is_generated(comment, F.lit("rust")).alias("rust"))


@query(
    f"""WITH {q._SCC_SQL}, named AS (SELECT path, root, 'f_src_n_' || path AS id, 'src/n-' || path AS p FROM members), sizes AS (SELECT root, count(*) AS n, row_number() OVER (ORDER BY 'src/n-' || root) - 1 AS idx FROM (SELECT min('src/n-' || path) AS r, root, count(*) AS n FROM members, LATERAL (SELECT 1) GROUP BY root), LATERAL (SELECT unnest(range(n))) GROUP BY root)
SELECT 'flowchart LR' AS line UNION ALL SELECT '  subgraph cycle' || idx || '["cycle-' || idx || ' · ' || n || ' files"]' FROM sizes UNION ALL SELECT '  end' FROM sizes
UNION ALL SELECT '    ' || id || '["' || p || '"]' FROM named UNION ALL SELECT '  f_src_n_' || path || '["src/n-' || path || '"]' FROM nodes WHERE path NOT IN (SELECT path FROM members)
UNION ALL SELECT '  f_src_n_' || src || ' --> f_src_n_' || dst FROM edges"""
)
def mermaid_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's flowchart of the graph of nations, line by line; one node a nation, so few rows meet on the driver."""
    name = lambda c: F.concat(F.lit("src/n-"), F.col(c))
    edges = q.trade_edges(spark, sf_dir).select(name("src").alias("src"), name("dst").alias("dst"))
    paths = [r.path for r in q.nation_nodes(spark, sf_dir).select(name("path").alias("path")).collect()]
    cycles = [r.asDict() for r in graph.cycles(graph.components(edges)).orderBy("cycle_idx").collect()]
    text = report.mermaid(paths, [(r.src, r.dst) for r in edges.orderBy("src", "dst").collect()], cycles)
    return spark.createDataFrame([(line,) for line in text.rstrip("\n").split("\n")], "line string")
