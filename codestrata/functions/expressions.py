"""Scalar expressions shared by the operators."""

from __future__ import annotations

import tempfile
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A letter or digit makes a comment line count.
SIGNIFICANT = r"[\p{L}\p{Nd}]"


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero on the scaled double, not on its decimal string."""
    scale = float(10**digits)
    return F.round(x * scale) / scale


def ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    """100 * part / whole, 0 where whole is 0."""
    x = F.coalesce(100.0 * part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))
    return x if digits is None else rounded(x, digits)


def mean(total: Column, count: Column, digits: int) -> Column:
    return F.coalesce(rounded(total.cast("double") / F.nullif(count.cast("double"), F.lit(0.0)), digits), F.lit(0.0))


def line_count(text: Column) -> Column:
    """Line ends, and one more for a last line without one."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (ends + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def has_word(text: Column, word: str) -> Column:
    """Whether an identifier stands in the text by itself."""
    return text.rlike(rf"(?<![\p{{L}}\p{{Nd}}_]){word}(?![\p{{L}}\p{{Nd}}_])")


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise("")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def clean_path(path: Column) -> Column:
    """``.`` and empty components go and ``..`` takes its parent with it; leading ``..`` stay."""
    start = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != "..")
        return F.when((part == "") | (part == "."), acc).when(up, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='lineage-')}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the folder of ``spark.checkpoint.dir`` (one of our own only where that is unset and all runs on one machine)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or _own_folder())
    return df.checkpoint(eager=True)
