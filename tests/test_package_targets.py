from pyspark.sql import functions as F

from codestrata.operators import graph, resolve


def shuffled(spark, df):
    """Rows written to shuffles while ``df`` runs."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def rows():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(n).shuffleWriteRecords() for n in range(stages.size()))

    before = rows()
    df.write.format("noop").mode("overwrite").save()
    return rows() - before


def test_java_wildcards_with_types_and_repeated_units(spark):
    units = spark.createDataFrame([("a/A.java", "a"), ("b/B.java", "b"), ("b/C.java", "b"), ("b/C.java", "b"), ("c/B.java", "c"), ("b/C.java", "d"), ("n/N.java", ""), (None, "c")], "path string, package string")
    specs = [("x", "b.*"), ("x", "c.B"), ("x", "b.C"), ("x", "java.util.*"), ("y", "b.*"), ("y", "d.*"), ("y", "a.A"), ("z", "d.C"), ("w", "no.*"), ("w", "no.X"), ("v", "d.*"), ("v", "b.C"), ("v", " b.B ")]
    imports = spark.createDataFrame([(p, n, s) for n, (p, s) in enumerate(specs)], "path string, ord int, spec string")
    got = {r.path: r.deps for r in resolve.resolve_java(imports, units).collect()}
    assert got == {"x": ["b/B.java", "b/C.java", "c/B.java"], "y": ["a/A.java", "b/B.java", "b/C.java"], "z": ["b/C.java"], "v": ["b/B.java", "b/C.java"]}


def test_java_wildcards_shuffle_no_pairs(spark):
    units = spark.range(2000).select(F.concat(F.lit("s/C"), "id", F.lit(".java")).alias("path"), F.lit("p").alias("package"))
    found = resolve.resolve_java(units.select("path", F.lit(0).alias("ord"), F.lit("p.*").alias("spec")), units)
    assert found.agg(F.sum(F.size("deps"))).first()[0] == 2000 * 2000
    assert shuffled(spark, found) < 100_000


def test_edges_of_packages_and_dependencies(spark):
    rows = [("a", "p", ["q", "q", "r", "none"], ["b", "e", "a", "gone"]), ("b", "q", ["q"], []), ("c", "q", [], ["a"]), ("c", "r", ["p"], []), ("e", "", [""], ["e"])]
    units = spark.createDataFrame(rows, "path string, import_path string, imports array<string>, deps array<string>")
    got = [tuple(r) for r in graph.build_edges(units).collect()]
    assert len(got) == len(set(got)) and set(got) == {("a", "b"), ("a", "c"), ("a", "e"), ("b", "c"), ("c", "a")}


def test_edges_of_packages_shuffle_no_pairs(spark):
    units = spark.range(2000).select(F.concat(F.lit("s/C"), "id").alias("path"), F.lit("p").alias("import_path"), F.array(F.lit("p")).alias("imports"), F.array().cast("array<string>").alias("deps"))
    edges = graph.build_edges(units)
    assert edges.count() == 2000 * 1999
    assert shuffled(spark, edges) < 100_000
