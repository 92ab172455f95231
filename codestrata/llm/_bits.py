"""A Bloom filter over 64-bit keys, for dropping rows without a partner before they are shuffled; sized by their number up to a bound."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm._common import mix

#: Bits for each key, and the least and most bits: 128 KiB to 64 MiB on every executor. A full filter only lets more rows pass.
BITS_A_KEY, LEAST, MOST = 16, 1 << 20, 1 << 29
#: Tasks that build the filter.
BUILDERS = 64

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each key."""
    x = keys.view(np.uint64)
    return np.stack([mix(x) % np.uint64(bits), mix(x + _STEP) % np.uint64(bits)]).astype(np.int64)


def _words(bits: int):
    def run(batches):
        """The bits of a task's keys, as (word, 32 bits): at most bits / 32 rows a task."""
        full = np.zeros(bits // 32, np.uint32)
        for batch in batches:
            at = _places(np.array(batch.column(0)), bits).ravel()
            np.bitwise_or.at(full, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
        some = np.flatnonzero(full)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(full[some].astype(np.int64))], ["word", "bits"])

    return run


def packed(keys: DataFrame, count: int) -> bytes:
    """The filter of a frame of one long column that has ``count`` rows."""
    bits = min(MOST, max(LEAST, 1 << math.ceil(math.log2(BITS_A_KEY * max(1, count)))))
    rows = keys.coalesce(BUILDERS).mapInArrow(_words(bits), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 32, "<u4")
    words[np.array(rows.column("word"))] = np.array(rows.column("bits"))
    return words.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")


def maybe(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each int64 key can be in the filter."""
    at = _places(keys, 32 * len(words))
    return ((words[at >> 5] >> (at & 31).astype(np.uint32)) & 1).all(axis=0)
