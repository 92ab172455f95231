"""Small tables with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

import random

from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["key", "id", "fp", "size", "rank", "range", "n", "comp", "hub", "file", "host", "path", "total", "shard", "slot", "c0", "n_words", "failed_bits", "tie", "hit", "text_crc32", "copy"]


def prose(seed: int, n: int, vocabulary: int = 3000) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def documents(spark, more=(), clashing=True):
    """Edge cases, then ``more`` as (doc_id, text)."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, base, "en", "a", 1), (1, base, "en", "a", 1), (2, " ".join(near), "en", "b", None), (3, None, None, None, None),
        (4, "", "en", "a", 0), (5, "   \n\t", "en", "", 1), (6, "one", "fr", "b", 3), (6, "one", "fr", "b", 3), (None, prose(2, 80), "en", "c", 5),
        (7, "line one here\nline one here\nother\nline one here " * 40, "en", "c", 5), (8, prose(3, 20_000), "de", "é", 9),
        (9, "x" * 100_000, "en", "a", 1), (10, "Où é́tait’s <|endoftext|> it's ＡＢ c \x1c   naïve. 12,3 ok!", "fr", "b", 2), (-5, prose(4, 60), "en", "c", 5),
    ]
    rows += [(i, t, "en", "a", len(t)) for i, t in more]
    df = spark.createDataFrame(rows, DOCUMENTS)
    return df.withColumns({c: F.lit(1) for c in CLASHING}) if clashing else df


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
