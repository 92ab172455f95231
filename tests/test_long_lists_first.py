from pyspark.sql import functions as F

from codestrata.operators import resolve


def test_java_lists_come_longest_first_in_each_task(spark):
    members = [(f"s/{p}{n}.java", p) for p, size in (("a", 40), ("b", 400), ("c", 4)) for n in range(size)]
    units = spark.createDataFrame(members, "path string, package string")
    specs = [(f"{kind}{n}", spec) for n in range(50) for kind, spec in (("t", f"a.a{n % 40}"), ("u", "a.*"), ("v", "b.*"), ("w", "c.*"), ("x", "b.*"), ("x", "c.*"))]
    imports = spark.createDataFrame([(p, n, s) for n, (p, s) in enumerate(specs)], "path string, ord int, spec string")
    rows = resolve.resolve_java(imports, units).select(F.spark_partition_id().alias("task"), F.left("path", F.lit(1)).alias("kind"), F.size("deps").alias("n")).collect()
    assert {(r.kind, r.n) for r in rows} == {("t", 1), ("u", 40), ("v", 400), ("w", 4), ("x", 404)} and len(rows) == 250
    for task in {r.task for r in rows}:
        sizes = [r.n for r in rows if r.task == task]
        assert sizes == sorted(sizes, reverse=True)
