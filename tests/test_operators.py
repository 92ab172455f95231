import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codestrata.functions import expressions as X
from codestrata.operators import duplication, gate, graph, measures, resolve, smells
from codestrata.sources import tree


def test_rounding_and_ratios(spark):
    row = spark.range(1).select(X.rounded(F.lit(2.25), 1).alias("a"), X.ratio(F.lit(1), F.lit(0)).alias("b"), X.ratio(F.lit(1), F.lit(3), 2).alias("c"), X.mean(F.lit(0), F.lit(0), 1).alias("d")).first()
    assert tuple(row) == (2.3, 0.0, 33.33, 0.0)


@pytest.mark.parametrize("path,clean", [("a/./b", "a/b"), ("a/../b", "b"), ("../a", "../a"), ("/a//b/", "a/b"), ("a/b/../../..", "..")])
def test_clean_path(spark, path, clean):
    assert spark.range(1).select(X.clean_path(F.lit(path)).alias("p")).first().p == clean


def test_line_measures(spark):
    rows = spark.createDataFrame([("a", "en", "x\n\n  \n***\ny"), ("b", "en", ""), ("c", "en", None), ("d", "en", "x\n")], "path string, lang string, text string")
    got = {r.path: tuple(r)[2:] for r in measures.line_measures(rows).collect()}
    assert got == {"a": (5, 3, 2, 40.0), "b": (0, 0, 0, 0.0), "c": (0, 0, 0, 0.0), "d": (1, 1, 1, 50.0)}


def naive_coverage(units, size):
    windows = {(u, i): tuple(t[i : i + size]) for u, t in units.items() for i in range(len(t) - size + 1)}
    covered = {u: set() for u in units}
    for (u, i), (v, j) in itertools.permutations(windows, 2):
        if windows[u, i] == windows[v, j] and (u != v or abs(i - j) >= size):
            covered[u] |= set(range(i, i + size))
    return {u: len(c) for u, c in covered.items()}


def test_duplication_against_pairs(spark):
    draw = random.Random(4)
    cases = {f"{k}": [draw.choice("abc") for _ in range(draw.randrange(0, 14))] for k in range(12)}
    rows = spark.createDataFrame([(k, "x", t, list(range(len(t)))) for k, t in cases.items()], "path string, lang string, toks array<string>, tok_lines array<int>")
    for size in (3, 5):
        got = {r.path: r.dup_tokens for r in duplication.coverage(rows, size).collect()}
        assert got == naive_coverage(cases, size)


@pytest.mark.parametrize("a,b,size,want", [("alpha a b c d e f", "beta a b c d e f", 3, (6, 6, 1)), ("a b c d a b c d", "x", 3, (8, 0, 1)), ("p q r s", "z p q r s", 5, (0, 0, 0)), ("a b c", "d e f", 3, (0, 0, 0))])
def test_duplication_examples(spark, a, b, size, want):
    units = [("a", "x", a.split(), [1] * len(a.split())), ("b", "x", b.split(), [1] * len(b.split()))]
    rows = spark.createDataFrame(units, "path string, lang string, toks array<string>, tok_lines array<int>")
    got = {r.path: r.dup_tokens for r in duplication.coverage(rows, size).collect()}
    assert (got["a"], got["b"], duplication.blocks(rows, size).first().dup_blocks) == want
    assert duplication.count_blocks([a.split(), b.split()], size) == want[2]


def naive_scc(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in reach[n]:
                    reach[n] |= reach[b] | {b}
    parts = {n: frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    return {(n, min(p)) for n, p in parts.items() if len(p) > 1}


def test_components_on_driver_and_cluster(spark):
    draw = random.Random(8)
    for n, m, clusters in ((7, 9, True), (30, 45, False), (12, 40, False)):
        edges = list({(draw.randrange(n), draw.randrange(n)) for _ in range(m)})
        rows = spark.createDataFrame(edges, "src long, dst long")
        want = naive_scc([e for e in edges if e[0] != e[1]])
        assert {tuple(r) for r in graph.components(rows).collect()} == want
        if clusters:
            assert {tuple(r) for r in graph.components(rows, driver_edges=0).collect()} == want


def test_graph_build_and_coupling(spark):
    units = spark.createDataFrame(
        [("a", "p", ["q", "ext"], ["b"]), ("b", "q", [], ["b", "nowhere"]), ("c", "q", ["p"], []), ("d", "", ["p"], [])], "path string, import_path string, imports array<string>, deps array<string>"
    )
    edges = graph.build_edges(units)
    assert {tuple(r) for r in edges.collect()} == {("a", "b"), ("a", "c"), ("c", "a"), ("d", "a")}
    nodes = spark.createDataFrame([("a", 2, 1), ("b", 0, 0), ("c", 1, 0), ("d", 0, 0), ("e", 0, 0)], "path string, types long, abstract_types long")
    got = {r.path: tuple(r)[1:] for r in graph.coupling(nodes, edges).collect()}
    assert got == {"a": (2, 2, 0.5, 0.5, 0.0), "b": (1, 0, 0.0, 0.0, 1.0), "c": (1, 1, 0.5, 0.0, 0.5), "d": (0, 1, 1.0, 0.0, 0.0), "e": (0, 0, 0.0, 0.0, 1.0)}
    members = graph.components(edges)
    assert [tuple(r) for r in graph.cycles(members).collect()] == [(0, "a", 2, ["a", "c"])]
    assert tuple(graph.cycle_summary(members, nodes).first()) == (1, 2, 2, 40.0)
    assert [r.dst for r in graph.successors(edges, "c").collect()] == ["a"]


def test_resolution_takes_the_first_that_is_free(spark):
    rows = [
        ("src/a.ts", "typescript", "", ["./b", "./missing", "react", "./b", "./lib"]), ("src/b.ts", "typescript", "", []), ("src/b.js", "javascript", "", []), ("src/lib/index.ts", "typescript", "", []),
        ("pkg/a/a.py", "python", "", ["os", "pkg.b", "..b", "..c", "."]), ("pkg/b.py", "python", "", []), ("pkg/c/__init__.py", "python", "", []),
        ("lib/a.c", "c", "", ["a.h", "<sys.h>", "../inc/x.h"]), ("lib/a.h", "c", "", []), ("inc/sys.h", "c", "", []), ("inc/x.h", "c", "", []),
        ("src/main.rs", "rust", "", ["mod:alpha", "crate::alpha::run", "self::beta", "extern:x"]), ("src/alpha.rs", "rust", "", ["super::x", "crate::beta::{a, b}"]), ("src/beta/mod.rs", "rust", "", ["super::main"]), ("x.rs", "rust", "", []),
        ("j/A.java", "java", "p.a", ["p.b.*", "p.c.C", "java.util.List"]), ("j/B.java", "java", "p.b", []), ("j/D.java", "java", "p.b", []), ("j/C.java", "java", "p.c", []),
    ]
    units = spark.createDataFrame(rows, "path string, lang string, package string, imports array<string>")
    got = {r.path: r.deps for r in resolve.resolve(units, ["inc"]).collect() if r.deps}
    assert got == {
        "src/a.ts": ["src/b.ts", "src/b.js", "src/lib/index.ts"], "pkg/a/a.py": ["pkg/b.py", "pkg/c/__init__.py"], "lib/a.c": ["lib/a.h", "inc/sys.h", "inc/x.h"], "src/main.rs": ["src/alpha.rs", "src/beta/mod.rs"],
        "src/alpha.rs": ["x.rs", "src/beta/mod.rs"], "j/A.java": ["j/B.java", "j/C.java", "j/D.java"],
    }


def test_smells_and_their_overrides(spark):
    overrides = spark.createDataFrame([("function-length", None, None, 70.0, "high"), ("function-length", "python", None, 40.0, None), ("nesting-depth", "c", False, None, None)], smells._OVERRIDE)
    rules = {(r.rule, r.lang): (r.enabled, r.threshold, r.severity) for r in smells.resolve_rules(smells.catalog(spark), overrides).collect()}
    assert rules["function-length", "go"] == (True, 70.0, "high") and rules["function-length", "python"] == (True, 40.0, "high")
    assert rules["nesting-depth", "typescript"][1] == 3.0 and rules["nesting-depth", "go"][1] == 4.0 and not rules["nesting-depth", "c"][0]
    functions = spark.createDataFrame(
        [("f", "go", 0, "x", "T", False, 3, 5, 20, 10, 1, 9, 2)] + [("f", "go", i, f"m{i}", "T", False, i + 3, 1, 1, 1, 1, 1, 1) for i in range(1, 36)],
        "path string, lang string, ord int, name string, enclosing string, anonymous boolean, start_line int, complexity int, cognitive int, length int, nesting int, params int, bool_max int",
    )
    files = spark.createDataFrame([("f", "go", 49, 0, 5), ("g", "go", 50, 5, 4), ("h", "go", 0, 0, 0)], "path string, lang string, physical_sloc long, comment_lines long, dup_lines long")
    found = smells.issues(files, functions, smells.catalog(spark))
    got = {(r.rule, r.file, r.line, r.function, r.value) for r in found.collect()}
    assert got == {("cognitive-complexity", "f", 3, "x", 20.0), ("parameter-count", "f", 3, "x", 9.0), ("too-many-methods", "f", 3, "T", 36.0), ("duplicated-file", "f", 1, None, 10.2), ("comment-density", "g", 1, None, 9.09)}
    assert {tuple(r) for r in smells.severity_histogram(found).collect()} == {("high", 1), ("medium", 2), ("low", 2)}
    assert [r.name for r in smells.flagged_functions(functions, found).collect()] == ["x"]


@pytest.mark.parametrize("value,score", [(50.0, 50.0), (100.0, 0.0), (0.0, 100.0), (300.0, 0.0)])
def test_composite(spark, value, score):
    budgets = spark.createDataFrame([("", "max_params", 100.0, "warn"), ("python", "avg_complexity", 8.0, "error")], "lang string, key string, limit double, tier string")
    values = spark.createDataFrame([("", "max_params", value), ("python", "avg_complexity", 12.0)], "lang string, key string, value double")
    results = gate.evaluate(budgets, values)
    assert gate.composite(results, spark.createDataFrame([("max_params", 3.0)], "key string, weight double")).first().score == score
    assert tuple(gate.exit_code(results).first()) == (1, 1 + (value > 100))
    assert gate.composite(results, spark.createDataFrame([], "key string, weight double")).first().score == 100.0


@pytest.mark.parametrize(
    "path,lang,test",
    [("a_test.go", "go", True), ("a.go", "go", False), ("tests/x.go", "go", True), ("test_a.py", "python", True), ("a_test.py", "python", True), ("src/a.spec.ts", "typescript", True), (".test.ts", "typescript", False),
     ("ATest.java", "java", True), ("Testing.java", "java", True), ("a.java", "java", False), ("test_a.c", "c", True), ("x/test", "go", False), ("x_test.rs", "rust", True)],
)
def test_is_test(spark, path, lang, test):
    assert spark.range(1).select(tree.is_test(F.lit(path), F.lit(lang)).alias("t")).first().t == test


def test_pruning_and_sniffing(spark):
    files = spark.createDataFrame([("a/vendor/x/y.go",), ("sub/m.go",), ("sub/vendor/z.go",), ("ok/b.go",), ("gen-1/c.go",)], "rel_path string")
    modules = spark.createDataFrame([("sub",), ("",)], "dir string")
    got = tree.pruned(files, ["vendor", "gen-*", "a/vendor"], modules)
    assert {r.rel_path: r.pruned for r in got.collect()} == {"a/vendor/x/y.go": "a/vendor", "sub/m.go": "sub", "sub/vendor/z.go": "sub", "ok/b.go": None, "gen-1/c.go": "gen-1"}
    assert tree.skipped_dirs(got).first().skipped_dirs == 3
    sources = {"int f(void);": "c", "namespace n {}": "cpp", '#ifdef X\nextern "C" {': "cpp", "// class\nchar *s = \"a::b\";": "c", "a::b();": "cpp", "int subclass;": "c"}
    for text, lang in sources.items():
        assert spark.range(1).select(tree.sniffed(F.lit("cpp"), F.lit("x.h"), F.lit(text)).alias("l")).first().l == lang
    row = spark.range(1).select(tree.import_path(F.lit("m"), F.lit(""), F.lit("a/b.go")).alias("a"), tree.import_path(F.lit("m"), F.lit("a"), F.lit("a/b.go")).alias("b"), tree.module_line(F.lit("//\nmodule x/y\n")).alias("c"), tree.canonical(F.lit(" C++ ")).alias("d")).first()
    assert tuple(row) == ("m/a", "m", "x/y", "cpp")


def test_function_lengths(spark):
    functions = spark.createDataFrame([("a", 0, 1, 200), ("a", 1, 63, 65), ("b", 0, 5, 5)], "path string, ord int, start_line int, end_line int")
    lines = spark.createDataFrame([("a", n) for n in (1, 63, 64, 65, 66, 201, 64)], "path string, line int")
    assert Counter(tuple(r) for r in measures.function_lengths(functions, lines).collect()) == Counter([("a", 0, 5), ("a", 1, 3), ("b", 0, 0)])
