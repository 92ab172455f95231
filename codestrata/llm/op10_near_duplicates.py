"""Near-duplicate documents by DartMinHash over weighted five-word shingles.

A document is the multiset of its shingles of five words (all of its words where it has fewer); a shingle's weight is how often
it occurs. The weight axis of a shingle is cut into dyadic cells, and hashed darts fall on cell x rank as a Poisson process whose
gaps are hashed exponentials: the same for every document with that shingle. Darts inside the weight count; each coordinate keeps
its earliest dart, so two documents agree in a coordinate with the probability of their weighted Jaccard similarity. Only about
k ln k + 2k darts are thrown, however long the document is. Signatures are cut into bands; members of a band's bucket are verified
by the exact weighted Jaccard similarity of their whole texts, and verified links are joined into classes (``_linking``). Only texts that
pass a Bloom filter of these members are shuffled: it is sized by their number, up to 64 MiB, beyond which it lets more texts pass, and an
exact join follows.

Defined results: a null, empty or blank text has no shingles and is linked to equal texts only (null to nothing); equal texts are one
class, whatever their ids; a class is named by its least doc_id (null where it has none); an empty table gives no rows. Of rows that are
equal in doc_id and text, ``one_of_each`` keeps the least by their other columns. Columns beside doc_id and text may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import _bits
from codestrata.llm._common import mix, read, unit, written
from codestrata.llm._linking import PACKED, by_elements, ids_of, linked, members, packed, slices, words_of

SHINGLE, THRESHOLD = 5, 0.8
#: 20 bands of 6 coordinates: at a similarity of 0.8 one pair in 435 shares no band, at 0.5 one pair in four shares one.
BANDS, ROWS = 20, 6
#: Documents whose entries are packed at a time.
CHUNK = 8192

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIER = np.uint64(0xD1342543DE82EF95)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, split at ASCII white space: a polynomial over its hashed bytes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    blank = _BLANK[data]
    inside = ~blank
    starts = np.flatnonzero(inside & np.r_[True, blank[:-1]]) if len(data) else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.uint64)
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    lengths = np.diff(np.r_[first, len(at)])
    offset = np.arange(len(at)) - np.repeat(first, lengths)
    power = np.cumprod(np.full(int(lengths.max()), _MULTIPLIER, np.uint64))
    return mix(np.add.reduceat(_BYTES[data[at]] * power[offset], first))


def shingles(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their counts."""
    h = word_hashes(text)
    if not len(h):
        return h, np.empty(0, np.int64)
    size = min(size, len(h))
    rolled = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        rolled = rolled * _MULTIPLIER + h[k : len(h) - size + 1 + k]
    return np.unique(mix(rolled), return_counts=True)


def elements(text: str) -> np.ndarray:
    """The multiset of shingles as a set: the second of equal ones is another element than the first, and so on."""
    h, count = shingles(text)
    ends = np.cumsum(count)
    copy = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
    return np.where(copy > 0, mix(np.repeat(h, count) + copy.astype(np.uint64) * _STEP), np.repeat(h, count))


def _darts(seeds: np.ndarray, low: np.ndarray, limit: np.ndarray, width: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Ranks below ``reach`` and names of the darts that fall inside the weights, for cells of one width."""
    at, names = [], []
    rank, turn = np.zeros(len(seeds)), 0
    some = int(1.2 * reach * width) + 1
    while len(seeds):
        count = np.arange(turn + 1, turn + some + 1, dtype=np.uint64)
        name = mix(seeds[:, None] + count * _STEP)
        ranks = rank[:, None] + np.cumsum(np.log(unit(name)) / -width, axis=1)
        i, j = np.nonzero(ranks < reach)
        name = mix(name[i, j] + _STEP)
        inside = low[i] + unit(name) * width < limit[i]
        at.append(ranks[i, j][inside])
        names.append(name[inside])
        more = ranks[:, -1] < reach
        seeds, low, limit, rank, turn = seeds[more], low[more], limit[more], ranks[more, -1], turn + some
    return np.concatenate(at), np.concatenate(names)


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The k dart minhashes of a weighted set of uint64 elements with positive weights (real numbers are allowed)."""
    weights = np.asarray(weights, np.float64)
    reach = (k * (math.log(k) + 2)) / weights.sum()
    while True:
        at, names, cell = [], [], 0
        low, width = 0.0, 1.0
        while len(which := np.flatnonzero(weights > low)):
            seeds = mix(elements[which] + np.uint64(int(_STEP) * (cell + 1) % 2**64))
            found = _darts(seeds, np.full(len(which), low), weights[which], width, reach)
            at.append(found[0])
            names.append(found[1])
            low, width, cell = low + width, low + width, cell + 1
        rank, name = np.concatenate(at), np.concatenate(names)
        order = np.argsort(-rank)
        name = name[order]
        out, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
        slot = (mix(name) % np.uint64(k)).astype(np.int64)
        out[slot], filled[slot] = name, True  # of several darts the last assigned, which is the earliest, stays
        if filled.all():
            return out
        reach *= 2


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    x = mix(sig.reshape(bands, rows) + _STEP * np.arange(1, rows + 1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return mix(x + _STEP * np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)


def _sign(count: int):
    def run(batches):
        for batch in batches:
            keys, ids, seen = [], [], set()
            for fp, text in zip(batch.column("fp").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if fp in seen:
                    continue
                seen.add(fp)
                h, weights = shingles(text)
                if len(h):
                    keys.append(band_keys(signature(h, weights, BANDS * ROWS)))
                    ids.append(fp)
            for at in range(0, len(ids), CHUNK):
                yield packed(np.array(keys[at : at + CHUNK]), words_of(ids[at : at + CHUNK]), count)

    return run


def _passing(filtered):
    def run(batches):
        bits = _bits.unpacked(filtered.value)
        for batch in batches:
            some = batch.filter(pa.array(_bits.maybe(bits, np.array(batch.column("key"), np.int64))))
            if some.num_rows:
                yield some.select(["id", "text"])

    return run


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__fp``, the md5 of each row's text (null for a null text), and ``__comp``, that of its class.

    Equal texts are one node, so a text that a third of all rows share is banded and verified once.
    """
    own = docs.withColumn("__fp", F.unhex(F.md5("text")))
    texts = own.filter("text is not null").select(F.col("__fp").alias("fp"), "text")
    found = members(texts.mapInArrow(_sign(slices(docs)), PACKED), 2, True)
    wanted = written(ids_of(found), "ids")
    bits = docs.sparkSession.sparkContext.broadcast(_bits.packed(wanted.select(F.xxhash64("id")), wanted.count()))
    near = texts.select(F.xxhash64("fp").alias("key"), F.col("fp").alias("id"), "text").mapInArrow(_passing(bits), "id binary, text string")
    alike = written(near.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text")), "texts")
    comp = linked(found, alike, *by_elements(elements), THRESHOLD).select(F.col("id").alias("__fp"), F.col("comp").alias("__comp"))
    return own.join(comp, "__fp", "left").withColumn("__comp", F.coalesce("__comp", "__fp"))


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, class_id, n_class)`` for every row of ``docs(doc_id, text, ...)``."""
    named = _named(docs.select("doc_id", "text")).select("doc_id", "__comp")
    classes = named.filter("__comp is not null").groupBy("__comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_class"))
    return named.join(classes, "__comp", "left").select(
        "doc_id", F.when(F.col("__comp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_class", F.lit(1)).alias("n_class")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class one row of the least doc_id, a null id only where no other is. Null texts all stay."""
    named = _named(docs.select("doc_id", "text")).filter("__fp is not null").select("doc_id", "__fp", "__comp")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("__fp").alias("fp"))
    keep = written(named.groupBy("__comp").agg(F.min(first).alias("first")).select(F.col("first.doc_id").alias("__keep_id"), F.col("first.fp").alias("__keep_fp")), "kept")
    rest = [F.col(n) for n in docs.columns if n not in ("doc_id", "text")]
    own = docs.select(F.col("doc_id").alias("__id"), F.unhex(F.md5("text")).alias("__fp"), F.struct(F.lit(0).alias("__none"), *rest, F.col("doc_id"), F.col("text")).alias("__row"))
    on = F.col("__id").eqNullSafe(F.col("__keep_id")) & (F.col("__fp") == F.col("__keep_fp"))
    single = own.join(keep, on, "left_semi").groupBy("__id", "__fp").agg(F.min("__row").alias("__row"))
    return single.select(*[F.col("__row")[n].alias(n) for n in docs.columns]).unionByName(docs.filter("text is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(read(spark, sf_dir, "documents"))
