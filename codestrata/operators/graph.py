"""The dependency graph: edges, coupling, strongly connected components and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.expressions import cut, ratio, rounded
from codestrata.operators.resolve import targets_of

#: Up to so many edges, counted first, components are found on the driver; beyond, by colouring on the cluster.
DRIVER_EDGES = 50_000


def build_edges(units: DataFrame) -> DataFrame:
    """``(src, dst)``: resolved dependencies, and every unit of an imported package, of ``units(path, import_path, imports, deps)``; no self edges."""
    paths = units.select(F.col("path").alias("target"))
    direct = units.select("path", F.explode("deps").alias("target")).join(paths, "target", "left_semi").select("path", "target")
    wanted = units.select("path", F.explode(F.array_distinct("imports")).alias("package"))
    packages = units.filter("import_path <> ''").select(F.col("import_path").alias("package"), F.col("path").alias("target"))
    found = targets_of(wanted, packages, direct)
    return found.select(F.col("path").alias("src"), F.explode(F.when(F.size("more") == 0, F.col("listed")).otherwise(F.concat("listed", "more"))).alias("dst")).filter("src <> dst")


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(path, ca, ce, instability, abstractness, distance)`` of ``nodes(path, types, abstract_types)`` over distinct ``edges(src, dst)``."""
    edges = edges.select("src", "dst").filter("src <> dst").distinct()
    degrees = edges.select(F.inline(F.array(F.struct(F.col("src").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    degrees = degrees.groupBy("path").agg(F.sum("i").cast("long").alias("ca"), F.sum("o").cast("long").alias("ce"))
    rows = nodes.join(degrees, "path", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("ca", "ce")})
    instability = F.coalesce(F.col("ce") / F.nullif(F.col("ca") + F.col("ce"), F.lit(0)), F.lit(0.0))
    abstract = F.coalesce(F.col("abstract_types") / F.nullif(F.col("types"), F.lit(0)), F.lit(0.0))
    return rows.select(
        "path", "ca", "ce", rounded(instability, 3).alias("instability"), rounded(abstract, 3).alias("abstractness"), rounded(F.abs(abstract + instability - 1), 3).alias("distance")
    )


def _tarjan(edges: list[tuple]) -> list[tuple]:
    """(node, least node of its component) for nodes in components of two or more, without recursion."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    index, low, on, stack, out = {}, {}, set(), [], []
    for root in sorted(after):
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in index:
                    index[other] = low[other] = len(index)
                    stack.append(other)
                    on.add(other)
                    work.append((other, iter(after[other])))
                    break
                if other in on:
                    low[node] = min(low[node], index[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = set()
                    while node not in part:
                        part.add(stack.pop())
                    on -= part
                    if len(part) > 1:
                        out += [(n, min(part)) for n in part]
    return out


def _reach(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The least label that reaches each node of ``labels(node, label)`` along ``edges``, by rounds with checkpoints."""
    while True:
        low = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("low"))
        after = cut(labels.join(low, "node", "left").select("node", F.least("label", "low").alias("label"), (F.col("low") < F.col("label")).alias("fell")))
        labels = after.select("node", "label")
        if after.filter("fell").isEmpty():
            return labels


def _colouring(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of components of two or more: trim, colour forward, keep what also reaches its colour's root, repeat on the rest."""
    out = None
    edges = cut(edges)
    while True:
        while True:
            keep = edges.select(F.col("src").alias("n")).intersect(edges.select(F.col("dst").alias("n")))
            trimmed = edges.join(keep.withColumnRenamed("n", "src"), "src", "left_semi").join(keep.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst")
            trimmed = cut(trimmed)
            same = trimmed.count() == edges.count()
            edges = trimmed
            if same:
                break
        if edges.isEmpty():
            return out
        nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
        colours = _reach(edges, nodes.withColumn("label", F.col("node")))
        coloured = edges.join(colours.select(F.col("node").alias("src"), F.col("label").alias("cs")), "src").join(colours.select(F.col("node").alias("dst"), F.col("label").alias("cd")), "dst")
        inner = cut(coloured.filter("cs = cd").select("src", "dst", F.col("cs").alias("root")))
        # backwards from each root within its colour
        found = cut(colours.filter("node = label").select("node", F.col("label").alias("root")))
        while True:
            more = inner.join(found.select(F.col("node").alias("dst"), "root"), ["dst", "root"]).select(F.col("src").alias("node"), "root").distinct().join(found.select("node"), "node", "left_anti")
            more = cut(more)
            if more.isEmpty():
                break
            found = cut(found.union(more))
        sizes = found.groupBy("root").count().filter("count > 1").select("root")
        new = found.join(sizes, "root", "left_semi").select("node", "root")
        out = cut(new if out is None else out.union(new))
        done = found.select("node")
        edges = cut(edges.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))


def components(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """``(path, root)``: the strongly connected components of two nodes or more of ``edges(src, dst)``, named by their least node."""
    spark = edges.sparkSession
    edges = edges.select("src", "dst").filter("src <> dst").distinct()
    kind = edges.schema["src"].dataType.simpleString()
    some = edges.limit(driver_edges + 1).collect()
    if len(some) <= driver_edges:
        return spark.createDataFrame(_tarjan([tuple(r) for r in some]), f"path {kind}, root {kind}")
    found = _colouring(edges)
    found = found if found is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("root")).limit(0)
    named = found.groupBy("root").agg(F.min("node").alias("least"))
    return found.join(named, "root").select(F.col("node").alias("path"), F.col("least").alias("root"))


def cycles(members: DataFrame) -> DataFrame:
    """``(cycle_idx, name, size, members)`` of ``components``, numbered by least member."""
    rows = members.groupBy(F.col("root").alias("name")).agg(F.count("*").alias("size"), F.array_sort(F.collect_list("path")).alias("members"))
    return rows.select((F.row_number().over(Window.orderBy("name")) - 1).alias("cycle_idx"), "name", "size", "members")


def cycle_summary(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(cycles, max_cycle_members, files_in_cycle, in_cycle_pct)`` over ``nodes(path)``."""
    sizes = members.groupBy("root").count().agg(F.count("*").alias("cycles"), F.coalesce(F.max("count"), F.lit(0)).alias("max_cycle_members"), F.coalesce(F.sum("count"), F.lit(0)).alias("files_in_cycle"))
    total = nodes.select("path").distinct().agg(F.count("*").alias("n"))
    return sizes.join(total).select("cycles", "max_cycle_members", "files_in_cycle", ratio(F.col("files_in_cycle"), F.col("n"), 1).alias("in_cycle_pct"))


def successors(edges: DataFrame, path) -> DataFrame:
    return edges.filter(F.col("src") == F.lit(path)).select("dst").distinct()
