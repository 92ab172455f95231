"""Imports to units: ordered candidate paths for each import, of which the first that exists and is not yet taken wins.

Candidates are expressions, existence is one equi-join of candidates with paths, and the ordered choice is a fold over a unit's imports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.expressions import basename, clean_path, directory

#: Extensions tried for an import without one, in order.
SCRIPT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
#: Parts into which the paths that name the same packages are dealt.
PARTS = 64


def _joined(base: Column, rest: Column) -> Column:
    return clean_path(F.concat(base, F.lit("/"), rest))


def script_candidates(path: Column, spec: Column) -> Column:
    """Relative imports only: the path as it is, then with an extension, then the index file of a directory."""
    base = _joined(directory(path), spec)
    own = [F.when(~base.endswith(e), F.concat(base, F.lit(e))) for e in SCRIPT_EXTENSIONS]
    index = [F.concat(base, F.lit("/index" + e)) for e in SCRIPT_EXTENSIONS]
    return F.when(spec.startswith("./") | spec.startswith("../"), F.array_compact(F.array(base, *own, *index)))


def python_candidates(path: Column, spec: Column) -> Column:
    """Dotted modules from the root, or from as many directories up as there are leading dots less one."""
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    rest = F.regexp_extract(spec, r"^\.*(.*)$", 1)
    parts = F.filter(F.split(directory(path), "/"), lambda x: x != "")
    up = F.slice(parts, 1, F.greatest(F.size(parts) - (dots - 1), F.lit(0)))
    base = F.when(dots == 0, rest).otherwise(_joined(F.array_join(up, "/"), rest))
    p = F.regexp_replace(base, r"\.", "/")
    return F.when(p == "", None).otherwise(F.array(F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py"))))


def include_candidates(path: Column, spec: Column, include_dirs: list[str]) -> Column:
    """Quoted includes: beside the unit, then the include directories; angle includes: only these."""
    angle = spec.startswith("<") & spec.endswith(">")
    name = F.regexp_replace(spec, r"^<|>$", "")
    own = F.when(~angle, _joined(directory(path), name))
    return F.array_compact(F.array(own, *[_joined(F.lit(d), name) for d in include_dirs]))


def rust_candidates(base: Column, spec: Column) -> Column:
    """The longest module path first; for each a file, then a ``mod.rs``."""
    parts = F.split(F.regexp_replace(F.regexp_extract(F.trim(spec), r"^([^{]*)", 1), "::$", ""), "::")
    ends = F.sequence(F.size(parts), F.lit(1), F.lit(-1))
    each = F.transform(ends, lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.flatten(F.transform(F.filter(each, lambda p: p != ""), lambda p: F.array(_joined(base, F.concat(p, F.lit(".rs"))), _joined(base, F.concat(p, F.lit("/mod.rs"))))))


def rust_bases(path: Column, spec: Column) -> Column:
    """(base, rest) alternatives of a reference: own directory, ``src`` and root for crate paths, upwards for each ``super``."""
    own = directory(path)
    parent = F.when(basename(path) == "mod.rs", directory(own)).otherwise(own)
    ups = F.size(F.split(F.regexp_extract(spec, r"^((?:super::)*)", 1), "::")) - 1
    parts = F.filter(F.split(parent, "/"), lambda x: x != "")
    above = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - ups, F.lit(0))), "/")
    pair = lambda base, rest: F.struct(base.alias("base"), rest.alias("rest"))
    return (
        F.when(spec.startswith("mod:"), F.array(pair(own, F.regexp_replace(spec, "^mod:", ""))))
        .when(spec.startswith("crate::"), F.array(pair(F.lit("src"), F.regexp_replace(spec, "^crate::", "")), pair(F.lit(""), F.regexp_replace(spec, "^crate::", ""))))
        .when(spec.startswith("self::"), F.array(pair(own, F.regexp_replace(spec, "^self::", ""))))
        .when(spec.startswith("super::"), F.array(pair(above, F.regexp_replace(spec, r"^(?:super::)+", ""))))
    )


def first_free(options: DataFrame, paths: DataFrame) -> DataFrame:
    """``(path, deps)`` of ``options(path, ord, candidates array<string>)``: for each import in order its first existing candidate not yet taken by the unit."""
    rows = options.select("path", "ord", F.posexplode("candidates").alias("priority", "target"))
    found = rows.join(paths.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    each = found.groupBy("path", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", "target"))), lambda x: x["target"]).alias("targets"))
    lists = each.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "targets"))), lambda x: x["targets"]).alias("all"))

    def take(acc: Column, targets: Column) -> Column:
        free = F.filter(targets, lambda t: ~F.array_contains(acc, t))
        return F.concat(acc, F.slice(free, 1, 1))

    return lists.select("path", F.aggregate("all", F.array().cast("array<string>"), take).alias("deps"))


def first_existing(options: DataFrame, paths: DataFrame) -> DataFrame:
    """``(path, ord, alternative, target)``: the first existing candidate of each alternative of an import, taken or not."""
    rows = options.select("path", "ord", "alternative", F.posexplode("candidates").alias("priority", "target"))
    found = rows.join(paths.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    return found.groupBy("path", "ord", "alternative").agg(F.min_by("target", "priority").alias("target"))


def resolve_rust(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """``(path, deps)`` of Rust ``imports(path, ord, spec)``; a crate path goes on to its second base where the first added nothing new."""
    spec = F.trim("spec")
    rows = imports.select("path", "ord", F.posexplode(rust_bases(F.col("path"), spec)).alias("alternative", "b"))
    options = rows.select("path", "ord", "alternative", rust_candidates(F.col("b.base"), F.col("b.rest")).alias("candidates"))
    each = first_existing(options, paths).groupBy("path", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("alternative", "target"))), lambda x: x["target"]).alias("targets"))
    lists = each.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "targets"))), lambda x: x["targets"]).alias("all"))
    take = lambda acc, t: F.concat(acc, F.slice(F.filter(t, lambda x: ~F.array_contains(acc, x)), 1, 1))
    return lists.select("path", F.aggregate("all", F.array().cast("array<string>"), take).alias("deps"))


def targets_of(wanted: DataFrame, packages: DataFrame, more: DataFrame) -> DataFrame:
    """``(path, listed, more)``: for each path the members of all packages that it names, in order, and its further targets that are not among them.

    Of ``wanted(path, package)``, ``packages(package, target)`` and ``more(path, target)``. The members are listed once for each set of packages that
    some path names, and the lists go to the paths in ``PARTS``: pairs of a path and a member are neither shuffled nor compared.
    Each task gives its longest lists first: a writer that has seen short rows puts off its next look at its memory for thousands of rows.
    """
    known = wanted.join(packages.groupBy("package").agg(F.count("*").alias("n")), "package").distinct()
    listed = more.join(packages, "target").join(known, ["path", "package"], "left_semi").select("path", "target")
    rest = more.join(listed, ["path", "target"], "left_anti").groupBy("path").agg(F.collect_set("target").alias("more"))
    sets = known.groupBy("path").agg(F.sort_array(F.collect_set("package")).alias("packages"), F.sum("n").alias("n"))
    key = F.struct(F.coalesce(-F.col("n"), F.lit(0)).alias("order"), "packages", F.pmod(F.xxhash64("path"), F.lit(PARTS)).alias("part"))
    rows = sets.join(rest, "path", "full").select("path", "more", key.alias("key"))
    named = rows.select("key").filter("key.packages is not null").distinct().withColumn("packages", F.col("key.packages"))
    each = named.select("packages").distinct().select("packages", F.explode("packages").alias("package"))
    lists = each.join(packages, "package").groupBy("packages").agg(F.sort_array(F.collect_set("target")).alias("listed"))
    none = F.array().cast(rest.schema["more"].dataType)
    if int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) < PARTS:
        rows = rows.repartition(PARTS, "key")  # a short key stands for a long list: few partitions are uneven
    found = rows.join(named.join(lists, "packages").select("key", "listed").hint("merge"), "key", "left")  # a merge join gives the keys in order
    return found.select("path", F.coalesce("listed", none).alias("listed"), F.coalesce("more", none).alias("more"))


def resolve_java(imports: DataFrame, units: DataFrame) -> DataFrame:
    """``(path, deps)`` of Java ``imports(path, ord, spec)``: all units of a package for ``p.*``, else the unit of a qualified type; of ``units(path, package)``."""
    own = units.filter("package <> ''")
    packages = own.select("package", F.col("path").alias("target"))
    types = own.select(F.concat("package", F.lit("."), F.regexp_replace(basename(F.col("path")), r"\.java$", "")).alias("type"), F.col("path").alias("target")).groupBy("type").agg(F.max("target").alias("target"))
    spec = F.trim("spec")
    wild = imports.filter(spec.endswith(".*")).select("path", F.regexp_replace(spec, r"\.\*$", "").alias("package"))
    exact = imports.filter(~spec.endswith(".*")).select("path", spec.alias("type")).join(types, "type").select("path", "target")
    return targets_of(wild, packages, exact).select("path", F.when(F.size("more") == 0, F.col("listed")).otherwise(F.sort_array(F.concat("listed", "more"))).alias("deps"))


def resolve(units: DataFrame, include_dirs: list[str] | None = None) -> DataFrame:
    """``units(path, lang, package, imports)`` with ``deps``; Go units depend by package only and have none."""
    rows = units.select("path", "lang", F.posexplode("imports").alias("ord", "spec"))
    path, spec = F.col("path"), F.col("spec")
    candidates = (
        F.when(F.col("lang").isin("typescript", "javascript"), script_candidates(path, spec))
        .when(F.col("lang") == "python", python_candidates(path, spec))
        .when(F.col("lang").isin("c", "cpp"), include_candidates(path, spec, include_dirs or []))
    )
    paths = units.select("path")
    plain = first_free(rows.select("path", "ord", candidates.alias("candidates")).filter("candidates is not null"), paths)
    rust = resolve_rust(rows.filter("lang = 'rust'"), paths)
    java = resolve_java(rows.filter("lang = 'java'"), units.filter("lang = 'java'").select("path", "package"))
    deps = plain.union(rust).union(java)
    return units.join(deps, "path", "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))
