"""Source trees as frames: scan, language by extension, exclusion, modules, test and generated files, header sniffing."""

from __future__ import annotations

import re

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.expressions import basename, directory, has_word

#: Extension to language; headers are C until they are sniffed.
EXTENSIONS = {
    ".go": "go", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".c": "c", ".h": "cpp",
    ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".java": "java", ".rs": "rust",
}
#: Other names of languages.
ALIASES = {"ts": "typescript", "js": "javascript", "py": "python", "c++": "cpp", "cxx": "cpp", "rs": "rust"}
#: Directories left out by default.
EXCLUDED = [".git", "vendor", "node_modules", "testdata", "__pycache__", ".venv", "venv", "dist", "build", "target", ".gradle", "out"]
MODULE_FILE = "go.mod"


def canonical(name: Column) -> Column:
    """A language's own name for any of its names; others are null."""
    x = F.lower(F.trim(name))
    known = F.create_map(*[F.lit(y) for pair in (ALIASES | {v: v for v in EXTENSIONS.values()}).items() for y in pair])
    return F.try_element_at(known, x)


def language_of(path: Column) -> Column:
    """By extension, case-sensitive; null for others."""
    known = F.create_map(*[F.lit(y) for pair in EXTENSIONS.items() for y in pair])
    return F.try_element_at(known, F.regexp_extract(path, r"(\.[^./]*)$", 1))


def glob_pattern(glob: str) -> str:
    """A regular expression for ``*``, ``?`` and ``[...]``, none of which passes a slash."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            out += glob[i : end + 1]
            i = end
        else:
            out += "\\" + c if c in ".\\+()^$|{}]" else c
        i += 1
    return f"^{out}$"


def excluded_name(name: Column, patterns: list[str]) -> Column:
    """Whether a directory's own name is excluded: by equality, or by a glob where the pattern has one."""
    plain = [p for p in patterns if not any(c in p for c in "*?[")]
    out = name.isin(plain) if plain else F.lit(False)
    for p in patterns:
        if p not in plain:
            out = out | name.rlike(glob_pattern(p))
    return out


def components(path: Column) -> Column:
    """A path's directories, outermost first."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def in_excluded(path: Column, patterns: list[str]) -> Column:
    return F.exists(components(path), lambda d: excluded_name(d, patterns))


def under_test_dir(path: Column) -> Column:
    return F.exists(components(path), lambda d: d.isin("test", "tests"))


def is_test(path: Column, lang: Column) -> Column:
    """A directory named test or tests, or the language's own rule for names."""
    name = basename(path)
    rule = (
        F.when(lang == "go", name.endswith("_test.go"))
        .when(lang == "python", name.endswith("_test.py") | name.startswith("test_"))
        .when(lang.isin("typescript", "javascript"), (F.instr(path, ".test.") > 1) | (F.instr(path, ".spec.") > 1))
        .when(lang.isin("c", "cpp"), name.startswith("test_") | name.contains("_test."))
        .when(lang == "java", name.rlike(r"(?:Test|Tests|TestCase)\.java$") | name.startswith("Test"))
        .when(lang == "rust", name.startswith("test_") | name.endswith("_test.rs"))
        .otherwise(False)
    )
    return under_test_dir(path) | rule


def prefixes(path: Column) -> Column:
    """Every directory above a path, outermost first, without the root."""
    dirs = components(path)
    return F.when(F.size(dirs) > 0, F.transform(F.sequence(F.lit(1), F.size(dirs)), lambda n: F.array_join(F.slice(dirs, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def pruned(files: DataFrame, patterns: list[str], module_dirs: DataFrame | None = None) -> DataFrame:
    """``files(rel_path)`` with ``pruned``: the topmost directory that is excluded or holds a module of its own, null if none.

    ``module_dirs(dir)`` are directories below the root with a module file.
    """
    above = prefixes(F.col("rel_path"))
    own = F.filter(above, lambda p: excluded_name(basename(p), patterns))
    rows = files.withColumn("by_name", F.try_element_at(own, F.lit(1)))
    if module_dirs is None:
        return rows.withColumnRenamed("by_name", "pruned")
    nested = files.select("rel_path", F.explode(above).alias("dir")).join(module_dirs.filter("dir <> ''"), "dir", "left_semi").groupBy("rel_path").agg(F.min_by("dir", F.length("dir")).alias("by_module"))
    rows = rows.join(nested, "rel_path", "left")
    shorter = F.when(F.length("by_module") <= F.length("by_name"), F.col("by_module")).otherwise(F.coalesce("by_name", "by_module"))
    return rows.withColumn("pruned", F.coalesce(shorter, F.col("by_module"))).drop("by_name", "by_module")


def skipped_dirs(files: DataFrame) -> DataFrame:
    """``(skipped_dirs)``: how many topmost directories a result of ``pruned`` leaves out."""
    return files.agg(F.countDistinct("pruned").alias("skipped_dirs"))


def module_line(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"(?m)^\s*module (.+)$", 1))


def import_path(module: Column, module_dir: Column, path: Column) -> Column:
    """Module path and directory below the module; empty without a module."""
    below = F.when(module_dir == "", directory(path)).otherwise(F.substr(directory(path), F.length(module_dir) + 2))
    return F.when(F.coalesce(module, F.lit("")) == "", "").when(below == "", module).otherwise(F.concat(module, F.lit("/"), below))


#: Comments, then strings and characters with escapes: the leftmost wins, so that neither is found inside the other.
_STRIPPED = r"(?s)//[^\n]*|/\*.*?(?:\*/|\z)|\"(?:\\.|[^\"\\])*+\"?|'(?:\\.|[^'\\])*+'?"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _STRIPPED, " ")


def has_cpp_markers(text: Column) -> Column:
    """``extern "C"`` anywhere; class, template, namespace or ``::`` outside of comments and literals."""
    code = stripped(text)
    return text.contains('extern "C"') | has_word(code, "class") | has_word(code, "template") | has_word(code, "namespace") | code.contains("::")


def sniffed(lang: Column, path: Column, text: Column) -> Column:
    """Headers are C++ only with its markers."""
    return F.when(path.endswith(".h"), F.when(has_cpp_markers(text), "cpp").otherwise("c")).otherwise(lang)


def is_generated(comment: Column, lang: Column) -> Column:
    """Whether a comment marks its file as generated."""
    both = comment.contains("Code generated") & comment.contains("DO NOT EDIT")
    low = F.lower(comment)
    return F.when(lang == "go", comment.startswith("// Code generated") & both).when(lang.isin("java", "rust"), both | comment.contains("@generated") | low.contains("<auto-generated>")).otherwise(both)


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(path, rel_path, lang)`` of the files below a folder that have a known extension, and ``(skipped_dirs)``.

    Spark's own file listing drops names that begin with a dot or underscore, such as ``__init__.py``, so the driver walks the tree; it
    does not enter pruned directories and reads no contents. Entries that cannot be listed are left out.
    """
    where, top = fs.FileSystem.from_uri(root)
    patterns = EXCLUDED if patterns is None else patterns
    plain = {p for p in patterns if not any(c in p for c in "*?[")}
    globs = [re.compile(glob_pattern(p)) for p in patterns if p not in plain]
    files, skipped, todo = [], 0, [top.rstrip("/")]
    while todo:
        folder = todo.pop()
        try:
            entries = where.get_file_info(fs.FileSelector(folder))
        except OSError:
            continue
        if folder != top.rstrip("/") and any(e.base_name == MODULE_FILE and e.is_file for e in entries):
            skipped += 1
            continue
        for e in entries:
            if e.type == fs.FileType.Directory:
                if e.base_name in plain or any(g.match(e.base_name) for g in globs):
                    skipped += 1
                else:
                    todo.append(e.path)
            elif "." + e.extension in EXTENSIONS:
                files.append((e.path, e.path[len(top.rstrip("/")) + 1 :], EXTENSIONS["." + e.extension]))
    frame = spark.createDataFrame(sorted(files), "path string, rel_path string, lang string")
    return frame, spark.createDataFrame([(skipped,)], "skipped_dirs long")


def load(files: DataFrame, root: str) -> DataFrame:
    """``(path, lang, class, text)`` of scanned files, read by the executors and with headers sniffed; invalid bytes are replaced."""

    def contents(batches):
        where, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            texts = []
            for path in batch["path"]:
                with where.open_input_file(path) as source:
                    texts.append(source.read().decode("utf-8", "replace"))
            yield pd.DataFrame({"path": batch["rel_path"], "lang": batch["lang"], "text": texts})

    rows = files.mapInPandas(contents, "path string, lang string, text string")
    rows = rows.withColumn("class", F.when(is_test(F.col("path"), F.col("lang")), "test").otherwise("prod"))
    return rows.withColumn("lang", sniffed(F.col("lang"), F.col("path"), F.col("text")))
