"""Token duplication: every window of ``size`` tokens that occurs in another unit, or in its own at a distance of ``size`` or more.

No pairs of windows are made. Windows are grouped by hash and unit, then by hash, both with partial aggregation, so that a
window in all units costs one row a unit; only repeated windows go back to their units, where coverage is a running maximum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.expressions import ratio

MIN_TOKENS = 20


def window_hashes(units: DataFrame, size: int = MIN_TOKENS) -> DataFrame:
    """``(path, h, at)``: hash and first position of every window of ``units(path, toks)``."""
    each = F.transform(F.sequence(F.lit(0), F.size("toks") - size), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("toks", i + 1, size)).alias("h")))
    return units.filter(F.size("toks") >= size).select("path", F.inline(each))


def repeated_windows(units: DataFrame, size: int = MIN_TOKENS) -> DataFrame:
    """``(path, starts array<int>)``: where repeated windows start, for units that have some."""
    here = window_hashes(units, size).groupBy("path", "h").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.collect_list("at").alias("places"))
    shared = here.groupBy("h").agg(F.count("*").alias("n"), F.max(F.col("last") - F.col("first")).alias("spread")).filter((F.col("n") > 1) | (F.col("spread") >= size))
    both = here.join(shared.select("h", "n"), "h")
    starts = F.when(F.col("n") > 1, F.col("places")).otherwise(F.filter("places", lambda p: (p - F.col("first") >= size) | (F.col("last") - p >= size)))
    return both.select("path", starts.alias("starts")).filter(F.size("starts") > 0).groupBy("path").agg(F.array_sort(F.flatten(F.collect_list("starts"))).alias("starts"))


def coverage(units: DataFrame, size: int = MIN_TOKENS) -> DataFrame:
    """``(path, lang, tokens, dup_tokens, dup_lines, dup_pct)`` of every row of ``units(path, lang, toks, tok_lines)``.

    A token is covered if a repeated window starts at it or at one of the ``size - 1`` tokens before it; lines count where a covered token starts.
    """
    starts = repeated_windows(units, size)
    rows = units.join(starts, "path", "left")
    # runs of starts that are less than a window apart are one stretch of covered tokens
    zero = F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def merge(acc, s):
        last = F.try_element_at(acc["out"], F.lit(-1))
        joined = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.struct(last["a"].alias("a"), (s + size).alias("b"))))
        new = F.concat(acc["out"], F.array(F.struct(s.alias("a"), (s + size).alias("b"))))
        return F.struct((s + size).alias("end"), F.when(s <= acc["end"], joined).otherwise(new).alias("out"))

    stretches = F.aggregate(F.coalesce("starts", F.array().cast("array<int>")), zero, merge, lambda acc: acc["out"])
    rows = rows.select("path", "lang", F.size("toks").cast("long").alias("tokens"), "tok_lines", stretches.alias("stretches"))
    covered = F.aggregate("stretches", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    lines = F.size(F.array_distinct(F.flatten(F.transform("stretches", lambda s: F.array_distinct(F.slice(F.col("tok_lines"), s["a"] + 1, s["b"] - s["a"]))))))
    out = rows.select("path", "lang", "tokens", covered.alias("dup_tokens"), lines.cast("long").alias("dup_lines"))
    return out.withColumn("dup_pct", ratio(F.col("dup_tokens"), F.col("tokens"), 2))


def summary(covered: DataFrame) -> DataFrame:
    """``(total_tokens, dup_tokens, dup_lines, dup_pct)`` over a result of ``coverage``."""
    sums = covered.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("tokens", "total_tokens"), ("dup_tokens", "dup_tokens"), ("dup_lines", "dup_lines"))])
    return sums.withColumn("dup_pct", ratio(F.col("dup_tokens"), F.col("total_tokens"), 1))


def count_blocks(units: list[list[str]], size: int = MIN_TOKENS) -> int:
    """Pairs of equal windows that, extended as far as they agree, cover a token of the left unit that none before has covered.

    The count depends on the order of the buckets, which is that of a rolling hash of first-appearance ids modulo 2 ** 64.
    """
    ids: dict[str, int] = {}
    streams = [[ids.setdefault(t, len(ids) + 1) for t in unit] for unit in units]
    base, mask = 1000003, 2**64 - 1
    buckets: dict[int, list[tuple[int, int]]] = {}
    for u, stream in enumerate(streams):
        for at in range(len(stream) - size + 1):
            h = 0
            for t in stream[at : at + size]:
                h = (h * base + t) & mask
            buckets.setdefault(h, []).append((u, at))
    covered = [np.zeros(len(s), bool) for s in streams]
    blocks = 0
    for _, places in sorted(buckets.items()):
        for i, (u, a) in enumerate(places):
            for v, b in places[i + 1 :]:
                if u == v and abs(a - b) < size or streams[u][a : a + size] != streams[v][b : b + size]:
                    continue
                x, y = streams[u], streams[v]
                low = 0
                while a - low > 0 and b - low > 0 and x[a - low - 1] == y[b - low - 1]:
                    low += 1
                high = size
                while a + high < len(x) and b + high < len(y) and x[a + high] == y[b + high]:
                    high += 1
                blocks += not covered[u][a - low : a + high].all()
                covered[u][a - low : a + high] = True
                covered[v][b - low : b + high] = True
    return blocks


def blocks(units: DataFrame, size: int = MIN_TOKENS) -> DataFrame:
    """``(dup_blocks)`` over ``units(path, toks)`` that have a repeated window: an ordered replay in one group, for code bases and not for corpora."""

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dup_blocks": [count_blocks([list(t) for t in rows.sort_values("path")["toks"]], size)]})

    some = units.select("path", "toks").join(repeated_windows(units, size).select("path"), "path", "left_semi")
    found = some.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(replay, "dup_blocks long")
    return found.agg(F.coalesce(F.sum("dup_blocks"), F.lit(0)).alias("dup_blocks"))
