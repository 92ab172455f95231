import json

import pytest

from codestrata.parsers import parse
from codestrata.parsers.model import total_lines
from codestrata.plans import config
from codestrata.plans.analyze import analyze
from codestrata.plans.report import mermaid, node_id, render, short


def by_name(unit):
    return {f.name: f for f in unit.functions}


NESTED = {
    "go": "package x\nfunc deep(a, b bool, n int) int {\n\tif a && b {\n\t\tfor i := 0; i < n; i++ {\n\t\t\tif i > 1 {\n\t\t\t\treturn i\n\t\t\t}\n\t\t}\n\t} else if b {\n\t\treturn 1\n\t} else {\n\t\treturn 2\n\t}\n\treturn 0\n}\nfunc again(n int) int {\n\tif n <= 1 {\n\t\treturn n\n\t}\n\treturn again(n-1)\n}\n",
    "javascript": "export function deep(a, b, n) {\n  if (a && b) {\n    for (let i = 0; i < n; i++) {\n      if (i > 1) { return i; }\n    }\n  } else if (b) {\n    return 1;\n  } else {\n    return 2;\n  }\n  return 0;\n}\nfunction again(n) {\n  if (n <= 1) { return n; }\n  return again(n - 1);\n}\n",
    "java": "class K {\n  int deep(boolean a, boolean b, int n) {\n    if (a && b) {\n      for (int i = 0; i < n; i++) {\n        if (i > 1) { return i; }\n      }\n    } else if (b) {\n      return 1;\n    } else {\n      return 2;\n    }\n    return 0;\n  }\n  int again(int n) { if (n <= 1) return n; return again(n - 1); }\n}\n",
    "cpp": "int deep(bool a, bool b, int n) {\n  if (a && b) {\n    for (int i = 0; i < n; i++) {\n      if (i > 1) { return i; }\n    }\n  } else if (b) {\n    return 1;\n  } else {\n    return 2;\n  }\n  return 0;\n}\nint again(int n) { if (n <= 1) return n; return again(n - 1); }\n",
    "rust": "fn deep(a: bool, b: bool, n: i32) -> i32 {\n    if a && b {\n        for i in 0..n {\n            if i > 1 { return i; }\n        }\n    } else if b {\n        return 1;\n    } else {\n        return 2;\n    }\n    0\n}\nfn again(n: i32) -> i32 {\n    if n <= 1 { return n; }\n    again(n - 1)\n}\n",
    "python": "def deep(a, b, n):\n    if a and b:\n        for i in range(n):\n            if i > 1:\n                return i\n    elif b:\n        return 1\n    return 0\ndef again(n):\n    if n <= 1:\n        return n\n    return again(n - 1)\n",
}


@pytest.mark.parametrize("lang", NESTED)
def test_nested_decisions(lang):
    f = by_name(parse(lang, NESTED[lang]))
    deep, again = f["deep"], f["again"]
    assert (deep.complexity, deep.cognitive, deep.nesting, deep.params, deep.bool_max) == (6, 8 if lang == "python" else 9, 3, 3, 2)
    assert (again.complexity, again.cognitive) == (2, 2) and again.calls == ["again"]


def test_python_units():
    unit = parse("python", "import os\nfrom . import util\nfrom a.b import c\nclass Base:\n    def m(self, x=lambda q: q):\n        pass\n# note\ndef f(a, b=1):\n    if a and b:\n        try:\n            return 1 if a else 2\n        except ValueError:\n            return f'{a}'\n    while a:\n        a -= 1\n    return a\n")
    assert unit.imports == ["os", ".util", "a.b", "a.b.c"] and unit.types == [("Base", False)] and unit.comment_lines == 1
    f = by_name(unit)
    assert f["f"].complexity == 6 and f["m"].params == 1 and f["m"].enclosing == "Base" and any(x.anonymous for x in unit.functions)
    assert parse("python", "def broken(:\n").functions == []


def test_script_closures_types_and_imports():
    unit = parse("typescript", "import x from '../b';\nexport * from \"./c\";\nabstract class S { run(p: number): number { return p > 1 ? 1 : 2; } }\ninterface I { a: string }\nexport function outer() {\n  const inner = (a) => {\n    if (a) { log(a); }\n    return a ? 1 : 2;\n  };\n  return inner;\n}\n")
    assert unit.imports == ["../b", "./c"] and unit.types == [("S", True), ("I", True)]
    f = by_name(unit)
    assert f["run"].enclosing == "S" and f["run"].complexity == 2 and f["outer"].complexity == 1
    assert (f["<anonymous@6>"].complexity, f["<anonymous@6>"].params, f["<anonymous@6>"].anonymous) == (3, 1, True)


def test_c_family():
    unit = parse("c", '#include "dep.h"\n#include <stdio.h>\n// note\nint f(int a, int b) {\n    if (a && b) {\n        return 1;\n    }\n    return 0;\n}\nint g(void) { goto end; end: return 0; }\n')
    f = by_name(unit)
    assert unit.imports == ["dep.h", "<stdio.h>"] and (f["f"].complexity, f["f"].params, f["g"].params, f["g"].cognitive) == (3, 2, 0, 1) and unit.comment_lines == 1 and unit.types == []
    unit = parse("cpp", "class Base {\npublic:\n    virtual void run() = 0;\n};\nclass Impl : public Base {\n    void run() override {\n        for (int i = 0; i < 10; i++) {\n        }\n    }\n};\nint h() {\n    auto g = [](int x) { return x + 1; };\n    return g(1);\n}\n")
    f = by_name(unit)
    assert unit.types == [("Base", True), ("Impl", False)] and f["run"].enclosing == "Impl" and f["run"].complexity == 2 and f["run"].nesting == 1 and f["<anonymous@12>"].params == 1


def test_go_java_rust_declarations():
    go = parse("go", 'package x\n\nimport (\n\t"fmt"\n\ty "a/b"\n)\n\ntype I interface {\n\tM() int\n}\ntype E interface{}\ntype S struct{ a int }\n\nfunc (s *S) M() int {\n\tswitch s.a {\n\tcase 1:\n\t\treturn 1\n\tdefault:\n\t\treturn 2\n\t}\n}\n\nfunc run() {\n\tf := func(n int) int { return n }\n\tfmt.Println(f(1))\n}\n// *****\n/* block\n * word\n */\n')
    f = by_name(go)
    assert go.imports == ["fmt", "a/b"] and go.types == [("I", True), ("E", False), ("S", False)] and go.package == "x" and go.comment_lines == 2
    assert f["M"].enclosing == "S" and f["M"].complexity == 3 and f["M"].cognitive == 1 and f["<anonymous@24>"].enclosing == "run" and f["run"].calls == ["Println", "f"]
    java = parse("java", "package p.a;\nimport static p.b.*;\nimport p.c.C;\npublic abstract class K {\n  public K(int a) { run(() -> { if (a > 0) go(); }); }\n}\nrecord R(int x) {}\n@interface A {}\nenum E { X }\n")
    assert java.package == "p.a" and java.imports == ["p.b.*", "p.c.C"] and java.types == [("K", True), ("R", False), ("A", True), ("E", False)]
    f = by_name(java)
    assert f["K"].params == 1 and f["<anonymous@5>"].complexity == 2 and f["<anonymous@5>"].enclosing == "K"
    rust = parse("rust", "use crate::b::{c, d};\nmod m;\ntrait T { fn need(&self); fn has(&self) -> i32 { 1 } }\nstruct S<'a> { x: &'a str }\nimpl<'a> T for S<'a> {\n    fn need(&self) { match self.x { \"a\" => 1, _ if true || false => 2, _ => 3 }; let g = |v: i32| v + 1; g(1)?; }\n}\n")
    f = by_name(rust)
    assert rust.imports == ["crate::b::{c,d}", "mod:m"] and rust.types == [("T", True), ("S", False)] and f["has"].enclosing == "T" and f["need"].enclosing == "S"
    assert f["need"].params == 0 and f["need"].complexity == 5 and f["<anonymous@6>"].params == 1


def test_literals_and_lines():
    unit = parse("go", "package x\n\nvar s = `a\nb\nc`\nvar c = 'x'\nvar n = 0x1F\n")
    assert [t for t, _ in unit.tokens] == ["package", "x", "var", "s", "=", "STR", "var", "c", "=", "CHAR", "var", "n", "=", "NUM"] and unit.code_lines == {1, 3, 6, 7}
    assert [t for t, _ in parse("javascript", "a = /x[/]y/g; b = c / d;").tokens] == ["a", "=", "NUM", ";", "b", "=", "c", "/", "d", ";"]
    assert total_lines("") == 0 and total_lines("a\nb") == 2 and total_lines("a\n") == 1
    assert parse("go", "// Code generated by x. DO NOT EDIT.\npackage y\n").generated and parse("java", "@Generated class X {}").generated and not parse("go", "/* Code generated DO NOT EDIT */\npackage y\n").generated


@pytest.fixture(scope="module")
def source_tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {
        "go.mod": "module demo\n",
        "pkg/alpha/a.py": '"""Doc."""\n\nfrom ..beta import b\nfrom ..gamma import c\n\n\nclass Service:\n    def handle(self, x):\n        if x > 10:\n            return b.run(x)\n        return c.norm(x)\n',
        "pkg/beta/b.py": "from ..gamma import c\n\n\ndef run(v):\n    if v > 100:\n        return c.norm(v) + 1\n    return c.norm(v - 1)\n",
        "pkg/gamma/c.py": "from ..alpha import a\n\n\ndef norm(v):\n    return a.Service().handle(v) if v and v > 1 else v\n",
        "pkg/alpha/test_a.py": "def test_it():\n    assert True\n",
        "pkg/gen.py": "# Code generated by tool. DO NOT EDIT.\nX = 1\n",
        ".venv/lib/x.py": "Y = 1\n",
        "other/go.mod": "module other\n",
        "other/y.py": "Z = 1\n",
        "notes.txt": "text\n",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_analysis_of_a_tree(spark, source_tree):
    report = analyze(spark, str(source_tree), verbose=True)
    data = json.loads(render(report, "json"))
    s = data["summary"]
    assert (s["prod_files"], s["test_files"], s["generated_files"], s["skipped_dirs"]) == (3, 1, 1, 2)
    assert (s["cycles"], s["max_cycle_members"], s["in_cycle_pct"], s["worst_complexity"], s["worst_function"]) == (1, 3, 100.0, 3, "pkg/gamma/c.py: norm")
    files = {f["path"]: f for f in data["files"]}
    assert (files["pkg/gamma/c.py"]["ca"], files["pkg/gamma/c.py"]["ce"], files["pkg/gamma/c.py"]["import_path"]) == (2, 1, "demo/pkg/gamma") and files["pkg/alpha/test_a.py"]["class"] == "test"
    assert files["pkg/alpha/a.py"]["functions_detail"][0]["name"] == "handle" and data["exit_code"] == 0
    assert [b["breached"] for b in data["budgets"] if b["key"] == "max_in_cycle_pct"] == [True]
    text = render(report, "text")
    assert "cycle-0 (3 files): pkg/alpha/a.py -> pkg/beta/b.py -> pkg/gamma/c.py" in text and "[module demo]" in text
    graph = render(report, "mermaid")
    assert graph.startswith("flowchart LR\n  subgraph cycle0") and "  f_pkg_alpha_a_py --> f_pkg_beta_b_py\n" in graph
    yaml = pytest.importorskip("yaml")
    assert yaml.safe_load(render(report, "yaml")) == json.loads(render(report, "json").replace("\\u003c", "<"))


def test_report_helpers():
    assert node_id("a-b/c.py") == "f_a_b_c_py" and short("a/b/c") == "b/c" and short("a/b") == "a/b"
    assert mermaid(["x"], [("x", "x"), ("x", "y")], []) == 'flowchart LR\n  f_x["x"]\n  f_y["y"]\n  f_x --> f_y\n'


def test_config(tmp_path):
    pytest.importorskip("yaml")
    file = tmp_path / config.CONFIG_NAME
    file.write_text("version: 1\nexclude: [x]\nbudgets:\n  max_issues: {limit: 3, tier: warn}\nlanguages:\n  py:\n    budgets: {avg_complexity: {limit: 8, tier: error}}\n    smells: {function-length: {threshold: 40}}\n")
    assert config.discover(str(tmp_path)) == str(file)
    cfg = config.load(str(file))
    config.validate(cfg)
    assert cfg.exclude == ["x"] and {"max_issues", "avg_complexity"} <= set(cfg.budgets) and ("python", "avg_complexity", 8.0, "error") in config.budget_rows(cfg)
    assert config.override_rows(cfg) == [("function-length", "python", None, 40.0, None)]
    for bad in ({"weights": {"nope": 1.0}}, {"smells": {"nope": {}}}, {"smells": {"file-length": {"severity": "odd"}}}, {"languages": {"cobol": {}}}):
        with pytest.raises(ValueError):
            config.validate(config.Config(**bad))
    file.write_text("version: 2\n")
    with pytest.raises(config.UsageError):
        config.load(str(file))


def test_command_line(tmp_path, capsys):
    from codestrata.__main__ import main

    assert main(["version"]) == 0 and main(["analyze", "--format", "odd"]) == 2 and main(["analyze", str(tmp_path / "none")]) == 2
    assert main(["init", str(tmp_path)]) == 0 and main(["init", str(tmp_path)]) == 2 and main(["help"]) == 0 and main([]) == 2
