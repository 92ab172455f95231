"""Mixing sources to target weights by blocks.

Each source's words, in order of doc_id, are packed into blocks of ``BLOCK`` words; the last block of a source is what is left. A target
becomes whole passes over the blocks and a last pass over some of them, whose last slot is cut short, so that totals are met to a
word. Every output shard draws its counts of each source from a multinomial over what the sources have left. A source's q-th slot is
mapped through a pseudorandom permutation of its blocks (a keyed Feistel network, walked until it falls below the number of blocks,
with another key for each pass; the last pass takes the short block only after all others), and slots are joined with blocks by
source and index. A source passes over its blocks three times at most, so no document is taken more than three times.

The driver holds one number a source and shard, nothing that grows with the documents; slots are joined by a shuffle whatever their number.

Defined results: a null, empty or blank text has size 0 and is never taken; a null source is a source of its own and comes last;
null ids come first within their source, rows of equal id are ordered by a hash of their texts; of rows equal in id, text and source the mix
gives the least lang; an empty table gives no rows. Columns beside doc_id, text, source and lang may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.llm._common import WORD, cut, mix, read, text_or_empty

WEIGHTS, MOST_PASSES = (5, 2, 1), 3
#: Words of a block, output shards, and the seed of all draws.
BLOCK, SHARDS, SEED = 128, 64, 20_26
#: Ranges into which the documents are dealt for prefix sums, at least, and rows of a range beyond that; slots that one task row stands for.
RANGES, RANGE_ROWS, RUN = 256, 1 << 20, 1 << 16
#: Above so many sources their table is not broadcast.
BROADCAST_SOURCES = 50_000


@dataclass
class Plan:
    """What each source (in order) gives: words, target, blocks, words of its last pass, slots by shard."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    blocks: list[int]
    rests: list[int]
    slots: np.ndarray


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> list[float]:
    """Shares of ``sum(sizes)`` by weight, stopped at ``most`` times a source's size; what is over goes to the others by weight."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    capped: set[int] = set()
    while True:
        left = sum(sizes) - most * sum(sizes[i] for i in capped)
        shared = sum(w for i, w in enumerate(weight) if i not in capped)
        out = [float(most * s) if i in capped else left * w / shared for i, (s, w) in enumerate(zip(sizes, weight, strict=True))]
        over = {i for i, t in enumerate(out) if i not in capped and t > most * sizes[i]}
        if not over:
            return out
        capped |= over


def plan(totals: dict[str | None, int], shards: int = SHARDS, seed: int = SEED) -> Plan:
    sources = sorted(totals, key=lambda s: (s is None, s or ""))
    sizes = [totals[s] for s in sources]
    goal = targets(sizes) if sources else []
    blocks = [-(-n // BLOCK) for n in sizes]
    words = [min(MOST_PASSES * n, round(t)) for t, n in zip(goal, sizes, strict=True)]
    rests = [w % n if n else 0 for w, n in zip(words, sizes, strict=True)]
    slots = [w // n * b - (-r // BLOCK) if n else 0 for w, n, b, r in zip(words, sizes, blocks, rests, strict=True)]
    left, draw, table = np.array(slots, np.int64), np.random.default_rng(seed), []
    for shard in range(shards):
        due, counts = int(left.sum()) // (shards - shard), np.zeros(len(left), np.int64)
        while due:
            now = np.minimum(draw.multinomial(due, left / left.sum()), left)
            counts, left, due = counts + now, left - now, due - int(now.sum())
        table.append(counts)
    return Plan(sources, sizes, goal, blocks, rests, np.array(table, np.int64).reshape(shards, len(sources)))


def permute(q: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of range(n), at the places ``q``."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    rounds = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix(np.array([key], np.uint64)))
    x = q.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & low
        for k in rounds:
            left, right = right, left ^ (mix(right ^ k) & low)
        x[todo] = left << half | right
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def _draw(seed: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q = np.arange(row["first"], row["first"] + row["n"])
                turn, place = q // row["blocks"], q % row["blocks"]
                index, most = place.copy(), np.full(len(q), BLOCK)
                passes, rest = row["words"] // row["size"], row["words"] % row["size"]
                for t in np.unique(turn):
                    # a last pass draws from the whole blocks and comes to the short one only after these
                    among = row["size"] // BLOCK if t == passes else row["blocks"]
                    which = np.flatnonzero((turn == t) & (place < among))
                    index[which] = permute(place[which], among, seed * 1_000_003 + row["sid"] * (MOST_PASSES + 1) + int(t))
                most[(turn == passes) & (place == -(-rest // BLOCK) - 1)] = rest - BLOCK * (-(-rest // BLOCK) - 1)
                n = len(q)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["sid"]), pa.int32()), pa.array(index), pa.array(turn.astype(np.int32)), pa.array(np.full(n, row["shard"]), pa.int32()), pa.array(q), pa.array(most)],
                    ["sid", "block", "turn", "shard", "slot", "most"],
                )

    return run


def slots(spark: SparkSession, made: Plan, seed: int = SEED) -> DataFrame:
    """``(sid, block, turn, shard, slot, most)`` of every slot of a plan; most: the words that it takes of its block at most."""
    before = np.cumsum(made.slots, axis=0) - made.slots
    runs = [
        (sid, shard, int(before[shard, sid]), int(made.slots[shard, sid]), made.blocks[sid], made.sizes[sid], round(min(MOST_PASSES * made.sizes[sid], made.targets[sid]))) for shard in range(len(made.slots)) for sid in range(len(made.sources)) if made.slots[shard, sid]
    ]
    rows = spark.createDataFrame(runs, "sid int, shard int, first long, n long, blocks long, size long, words long")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long")))
    chunks = rows.select("sid", "shard", "blocks", "size", "words", "first", F.col("n").alias("all"), at.alias("at")).select(
        "sid", "shard", "blocks", "size", "words", (F.col("first") + F.col("at")).alias("first"), F.least(F.col("all") - F.col("at"), F.lit(RUN)).alias("n")
    )
    return chunks.repartition(int(made.slots.sum()) // RUN + 1).mapInArrow(_draw(seed), "sid int, block long, turn int, shard int, slot long, most long")


def _placed(docs: DataFrame) -> tuple[DataFrame, Plan]:
    """Every document with its source's number, the place of its first word in the source's stream, and a number within the source; and the plan."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("tie"))
    order = ["source", "doc_id", "tie"]
    ranges = max(RANGES, docs.count() // RANGE_ROWS)
    dealt = cut(rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    sums = cut(dealt.groupBy("source", "range").agg(F.sum("size").alias("words")))
    totals = {r.source: r.words for r in sums.groupBy("source").agg(F.sum("words").alias("words")).collect()}
    made = plan(totals)
    known = spark.createDataFrame([(s, i) for i, s in enumerate(made.sources)], "source string, sid int")
    known = F.broadcast(known) if len(made.sources) <= BROADCAST_SOURCES else known
    # rows of sums: at most the ranges plus the number of sources
    sums = sums.join(known, sums["source"].eqNullSafe(known["source"])).select("range", "sid", sums["source"].alias("of"), (F.sum("words").over(Window.partitionBy("sid").orderBy("range")) - F.col("words")).alias("before"))
    within = Window.partitionBy("range", "of").orderBy("doc_id", "tie")
    sums = F.broadcast(sums) if len(made.sources) <= BROADCAST_SOURCES else sums
    placed = dealt.join(sums, (dealt["range"] == sums["range"]) & dealt["source"].eqNullSafe(sums["of"])).select("doc_id", "size", "tie", "sid", "before", dealt["range"].alias("range"), "of")
    start = F.col("before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    row = F.shiftleft(F.col("range").cast("long"), 40) + F.row_number().over(within.orderBy("doc_id", "tie"))
    return cut(placed.select("doc_id", "size", "tie", "sid", F.col("of").alias("source"), start.alias("start"), row.alias("row"))), made


def _taken(placed: DataFrame, made: Plan) -> DataFrame:
    """``(sid, row, first, last, turn, shard, slot, ...)``: the words [first, last) of a document that a slot takes."""
    pieces = placed.filter("size > 0")
    pieces = pieces.select("doc_id", "tie", "source", "row", "sid", "start", "size", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})")).alias("block"))
    pieces = pieces.withColumn("begin", F.col("block") * BLOCK - F.col("start"))
    # by a shuffle: the planner knows only the runs that stand for the slots and would broadcast what they grow to
    met = pieces.join(slots(placed.sparkSession, made).hint("merge"), ["sid", "block"])
    first, last = F.greatest(F.col("begin"), F.lit(0)), F.least("size", F.col("begin") + F.col("most"))
    return met.select("doc_id", "tie", "source", "row", "sid", "turn", "shard", "slot", first.alias("first"), last.alias("last")).filter("first < last")


def mixed(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs(doc_id, text, source, ...)``."""
    placed, made = _placed(docs)
    known = docs.sparkSession.createDataFrame([(i, n, t) for i, (n, t) in enumerate(zip(made.sizes, made.targets, strict=True))], "sid int, source_size long, target double")
    known = F.broadcast(known) if len(made.sources) <= BROADCAST_SOURCES else known
    taken = _taken(placed, made).groupBy("sid", "row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    return placed.join(taken, ["sid", "row"], "left").join(known, "sid").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def _cut_words(schema: pa.Schema):
    """A row for each pass over the document, with the words taken in it, as they stand in the text."""
    import re

    word = re.compile(WORD)

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text, passes = row["text"], {}
                spans = [m.span() for m in word.finditer(text)]
                for piece in sorted(row.pop("pieces"), key=lambda p: (p["turn"], p["first"])):
                    stop = spans[piece["last"]][0] if piece["last"] < len(spans) else len(text)
                    passes.setdefault(piece["turn"], []).append(text[spans[piece["first"]][0] : stop])
                out += [row | {"text": (whole := "".join(parts).rstrip(" \t\n\v\f\r")), "n_chars": len(whole)} for parts in passes.values()]
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of documents: one for each pass in which a document is taken, holding the words taken in it."""
    placed, made = _placed(docs)
    pieces = _taken(placed, made).groupBy("doc_id", "tie", "source", "row").agg(F.collect_list(F.struct("first", "last", "turn")).alias("pieces"))  # as many as the document has blocks, three times
    pieces = pieces.select(F.struct("doc_id", "tie", "source").alias("at"), "pieces")
    own = docs.select(F.struct("doc_id", F.xxhash64("text").alias("tie"), "source").alias("at"), "text", "lang").groupBy("at").agg(F.first("text").alias("text"), F.min("lang").alias("lang"))
    joined = own.join(pieces, own["at"].eqNullSafe(pieces["at"])).select(own["at.doc_id"].alias("doc_id"), "text", "lang", own["at.source"].alias("source"), "pieces")
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    return joined.mapInArrow(_cut_words(schema), "doc_id long, text string, lang string, source string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents"))
