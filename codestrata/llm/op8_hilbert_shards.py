"""Sharding along a Hilbert curve, by built-in functions only.

Language, source and size are quantised to ``BITS`` bits each (names by hash, so that equal names meet; sizes by logarithm, so that
neighbouring sizes meet). Documents are sorted by the index of their cell on the curve, and the order is cut into runs of equal
count: every shard is a run of neighbouring cells, so files can be skipped by minimum and maximum of any of the dimensions.

The law is ``rows``: shard counts differ by one at most. Ranks are exact without a global sort in one task: the order is dealt
into ranges, ranges are counted, and a prefix sum over the ranges gives each range its first rank.

Defined results: a null text has size 1 and crc 0; null language or source is a value of its own; equal rows are ordered by
size, checksum and id and, if wholly equal, in either order, which changes no column of the result; an empty table gives no rows.
Further columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.llm._common import cut, read, text_or_empty

SHARDS, BITS = 16, 6
#: Ranges into which the order is dealt, at least, and rows of a range beyond that; an even share of rows each.
RANGES, RANGE_ROWS = 256, 1 << 20


def cells() -> dict[str, Column]:
    """The coordinates of ``lang``, ``source`` and ``size``, each below 2 ** BITS."""
    top = (1 << BITS) - 1
    log = F.floor(F.log2(F.col("size")) * 2).cast("int")
    return {
        "x_source": F.pmod(F.xxhash64(F.coalesce("source", F.lit("\0"))), F.lit(top + 1)).cast("int"),
        "x_lang": F.pmod(F.xxhash64(F.coalesce("lang", F.lit("\0"))), F.lit(top + 1)).cast("int"),
        "x_size": F.least(log, F.lit(top)),
    }


def with_hilbert_index(rows: DataFrame, axes: list[str], name: str, bits: int = BITS) -> DataFrame:
    """``rows`` with the index of their cell on the Hilbert curve over integer columns ``axes`` in place of these.

    The axes are turned level by level into the transposed form of the index (Skilling, 2004), whose bits are then interleaved.
    Every step is a projection of its own on the last one's columns, so that no expression is computed twice.
    """
    rest = [c for c in rows.columns if c not in axes]
    x = [F.col(a) for a in axes]

    def step(rows: DataFrame, new: dict[int, Column]) -> DataFrame:
        return rows.select(*rest, *[new.get(i, x[i]).alias(a) for i, a in enumerate(axes)])

    for level in range(bits - 1, 0, -1):
        q, low = F.lit(1 << level), F.lit((1 << level) - 1)
        for i in range(len(axes)):
            flip = x[i].bitwiseAND(q) != 0
            if i == 0:
                rows = step(rows, {0: F.when(flip, x[0].bitwiseXOR(low)).otherwise(x[0])})
            else:
                swap = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
                rows = step(rows, {0: F.when(flip, x[0].bitwiseXOR(low)).otherwise(x[0].bitwiseXOR(swap)), i: F.when(flip, x[i]).otherwise(x[i].bitwiseXOR(swap))})
    for i in range(1, len(axes)):
        rows = step(rows, {i: x[i].bitwiseXOR(x[i - 1])})
    parity = F.lit(0)
    for level in range(bits - 1, 0, -1):
        parity = parity.bitwiseXOR(F.when(x[-1].bitwiseAND(F.lit(1 << level)) != 0, F.lit((1 << level) - 1)).otherwise(F.lit(0)))
    rows = rows.withColumn("parity", parity).select(*rest, *[a_.bitwiseXOR(F.col("parity")).alias(a) for a, a_ in zip(axes, x, strict=True)])
    index = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for axis in x:
            index = index * 2 + F.shiftright(axis, level).bitwiseAND(F.lit(1)).cast("long")
    return rows.select(*rest, index.alias(name))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve)`` for every row of ``docs(doc_id, text, lang, source, ...)``."""
    rows = docs.select("doc_id", (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"), "lang", "source")
    rows = rows.select("doc_id", "size", "text_crc32", *[c.alias(n) for n, c in cells().items()])
    rows = with_hilbert_index(rows, list(cells()), "curve")
    order = ["curve", "size", "text_crc32", "doc_id"]
    ranges = max(RANGES, docs.count() // RANGE_ROWS)
    dealt = cut(rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    # one row a range, so as many rows as ranges meet in the window without a key and are sent to the executors
    counts = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    ranked = dealt.join(F.broadcast(before), "range").withColumn("rank", rank)
    shard = F.expr(f"(rank * {shards}) div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the documents as one folder of Parquet a shard, sorted along the curve.

    Rows are matched by id, size and checksum; rows equal in these are alike and one of each is matched to each. The caller's columns are
    kept whatever their names, but for ``shard`` and ``slot``, which are those of the result.
    """
    key = ["__id", "__size", "__crc"]
    same = Window.partitionBy(*key)
    placed = assign(docs, shards).select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("text_crc32").alias("__crc"), "shard", "slot")
    placed = placed.withColumn("__copy", F.row_number().over(same.orderBy("shard", "slot")))
    size, crc = (F.octet_length(text_or_empty()) + 1).cast("long"), F.crc32(text_or_empty().cast("binary"))
    own = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), size.alias("__size"), crc.alias("__crc"))
    own = own.withColumn("__copy", F.row_number().over(same.orderBy("__row.lang", "__row.source")))
    on = own["__id"].eqNullSafe(placed["__id"])
    for k in ("__size", "__crc", "__copy"):
        on = on & (own[k] == placed[k])
    joined = own.join(placed, on).select(*[F.col("__row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
    joined.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents"))
