"""Benchmark decontamination by templates.

Texts become tokens with typed placeholders: numbers, names (capitalised words that do not begin a sentence) and units (known unit
words right after a number). Windows of ``WINDOW`` tokens are hashed, and windows of documents are hash-joined with those of the
benchmark items; a Bloom filter drops the windows without a partner before the shuffle. A window with fewer literal tokens than
placeholders has no template to speak of and is hashed by its words as they stand, so that only a copy of it meets it.

Windows of one document and item with the same offset are one alignment. A window counts if all its slots have the item's values, or if
each of the item's values in it stands for the document's value that most slots of the alignment give it, so that a question asked
again with other numbers and names is found, and a text that only has the same shape is not. A document is contaminated by an item if
windows that count hold at least ``SHARE`` of the item's windows.

Defined results: null, empty and blank texts have no windows; items of fewer tokens than a window are one window of their own length;
equal items are one, named by the least item_id (null where it has none); rows of equal doc_id and text are one document; an empty
table of either kind gives no leaks and leaves all documents clean. Columns beside doc_id, item_id and text may have any names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import _bits
from codestrata.llm._common import mix, read, written

WINDOW, SHARE = 8, 0.5
#: Words that a worker remembers before it starts anew.
MEMO = 200_000
#: Words that are units after a number.
UNITS = frozenset(
    "% percent ° °c °f mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes oz lb lbs pound pounds ml cl l litre litres liter liters gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years $ € £ ¥ usd eur gbp dollar dollars euro euros cent cents "
    "b kb mb gb tb hz khz mhz ghz w kw kwh v a mph kph km/h m/s".split()
)
_EDGE = ".,;:!?\"'()[]{}«»„“”‘’#*&<>|…"
_NUMBER = re.compile(r"[+-]?(?:[$€£¥])?\d[\d.,:/]*(%|°[cf]?|[a-z]{1,3})?", re.I)
_ENDS = (".", "!", "?", ":", "…")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIER = np.uint64(0xD1342543DE82EF95)
LITERAL, NUMBER, NAME, UNIT = range(4)


def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))


_MARK = {NUMBER: _hash("\0number"), NAME: _hash("\0name"), UNIT: _hash("\0unit")}


class Words:
    """What is known of each word by itself: token hash, kind away from and at the start of a sentence, whether it ends one, its value."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.values: list[str] = []
        self.rows: list[tuple[int, int, int, bool, bool]] = []
        self.table = np.empty((0, 5), np.uint64)

    def _learn(self, word: str) -> int:
        bare = word.strip(_EDGE)
        value = bare.lower() or word
        kind = NUMBER if _NUMBER.fullmatch(bare) else NAME if bare[:1].isupper() and bare[1:].islower() else LITERAL
        start = LITERAL if kind == NAME else kind
        at = self.place[word] = len(self.values)
        self.values.append(value)
        self.rows.append((_hash(value), kind, start, word.rstrip("\"')]}»”’").endswith(_ENDS), value in UNITS))
        return at

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.place) > MEMO:
            self.clear()
        place = self.place
        at = np.array([place[w] if w in place else self._learn(w) for w in words], np.int64)
        if len(self.rows) > len(self.table):
            fresh = np.array(self.rows[len(self.table) :], np.uint64)
            room = np.empty((max(2 * len(self.table), len(self.rows)), 5), np.uint64) if len(self.rows) > len(self._store()) else self._store()
            room[: len(self.table)] = self.table
            room[len(self.table) : len(self.rows)] = fresh
            self.store, self.table = room, room[: len(self.rows)]
        return at

    def _store(self) -> np.ndarray:
        return getattr(self, "store", self.table)


def tokens(text: str, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes (placeholders alike), kinds, and places in ``words.values``, of a whole text."""
    split = [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]
    at = words(split)
    table = words.table[at]
    starts = np.r_[True, table[:-1, 3] != 0] if len(at) else np.empty(0, bool)
    kind = np.where(starts, table[:, 2], table[:, 1]).astype(np.int64)
    unit = (table[:, 4] != 0) & np.r_[False, kind[:-1] == NUMBER] if len(at) else np.empty(0, bool)
    kind[unit] = UNIT
    h = table[:, 0].copy()
    for k, mark in _MARK.items():
        h[kind == k] = np.uint64(mark)
    return h, kind, at


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    x = h[:n].copy()
    for k in range(1, size):
        x = x * _MULTIPLIER + h[k : n + k]
    return mix(x + np.uint64(size * int(_STEP) % 2**64))


def windows(h: np.ndarray, kind: np.ndarray, plain: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows, and whether each is a template; the others are hashed by ``plain``, the hashes of the words themselves."""
    if len(h) < size:
        return np.empty(0, np.int64), np.empty(0, bool)
    literal = np.r_[0, np.cumsum(kind == LITERAL)]
    template = 2 * (literal[size:] - literal[:-size]) >= size
    x = _rolled(h, size)
    if not template.all():
        x = np.where(template, x, mix(_rolled(plain, size)))
    return x.view(np.int64), template


def _rows(text: str, size: int, words: Words, filter_bytes: np.ndarray | None = None) -> list[tuple[int, int, list[str]]]:
    """(hash, first place, slot values) of a text's windows."""
    h, kind, at = tokens(text, words)
    x, template = windows(h, kind, words.table[at][:, 0], size)
    first = np.arange(len(x))
    if filter_bytes is not None and len(x):
        first = np.flatnonzero(_bits.maybe(filter_bytes, x))
    values = words.values
    return [(int(x[i]), i, [values[at[j]] for j in range(i, i + size) if kind[j] != LITERAL] if template[i] else []) for i in first.tolist()]


_WINDOWS = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("slots", pa.list_(pa.string())), ("n", pa.int64()), ("size", pa.int32())])
_WINDOWS_SQL = "id long, tie long, h long, at long, slots array<string>, n long, size int"


def _item_windows(batches):
    words = Words()
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            size = min(WINDOW, len((row["text"] or "").encode("utf-8", "surrogatepass").split()))
            found = _rows(row["text"], size, words) if size else []
            out += [{"id": row["id"], "tie": row["tie"], "h": h, "at": i, "slots": s, "n": len(found), "size": size} for h, i, s in found]
        yield pa.RecordBatch.from_pylist(out, _WINDOWS)


def _document_windows(packed, sizes: list[int]):
    def run(batches):
        words, bits = Words(), _bits.unpacked(packed.value)
        for batch in batches:
            out = []
            for i, tie, text in zip(batch.column("id").to_pylist(), batch.column("tie").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for size in sizes:
                    out += [{"id": i, "tie": tie, "h": h, "at": at, "slots": s, "n": None, "size": size} for h, at, s in _rows(text or "", size, words, bits)]
            yield pa.RecordBatch.from_pylist(out, _WINDOWS)

    return run


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_windows, share, exact, tie)``: a row for each contaminated document and item.

    exact: no slot of a window that counts has another value than in the item. tie: xxhash64 of the document's text.
    """
    equal = items.select("item_id", "text").filter("text is not null").groupBy("text").agg(F.min("item_id").alias("id"))
    wanted = written(equal.select("id", F.xxhash64("text").alias("tie"), "text").mapInArrow(_item_windows, _WINDOWS_SQL), "item-windows")
    sizes = sorted(r.size for r in wanted.select(F.col("size").alias("size")).distinct().collect())  # at most WINDOW of them
    packed = docs.sparkSession.sparkContext.broadcast(_bits.packed(wanted.select("h"), wanted.count()))
    found = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"), "text").mapInArrow(_document_windows(packed, sizes), _WINDOWS_SQL)
    found = found.select("h", F.col("id").alias("doc_id"), "tie", "at", "slots").distinct()
    item = wanted.select("h", F.col("id").alias("item_id"), F.col("tie").alias("item"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), "n")
    met = found.join(item, "h").select("doc_id", "tie", "item_id", "item", "n", (F.col("at") - F.col("item_at")).alias("offset"), "item_at", F.arrays_zip(F.col("item_slots").alias("x"), F.col("slots").alias("y")).alias("pairs"))
    keys = ["doc_id", "tie", "item_id", "item", "n"]
    # an alignment has one window for each place of the item at most, or as many as its words repeat
    runs = met.groupBy(*keys, "offset").agg(F.collect_list(F.struct("item_at", "pairs", F.forall("pairs", lambda p: p["x"] == p["y"]).alias("exact"))).alias("windows"))
    runs = runs.withColumn("all", F.flatten(F.transform("windows", lambda w: w["pairs"])))

    def usual(p):
        own = F.filter("all", lambda q: q["x"] == p["x"])
        return 2 * F.size(F.filter(own, lambda q: q["y"] == p["y"])) > F.size(own)

    good = F.filter("windows", lambda w: w["exact"] | F.forall(w["pairs"], usual))
    runs = runs.select(*keys, F.transform(good, lambda w: w["item_at"]).alias("places"), F.forall(good, lambda w: w["exact"]).alias("exact")).filter(F.size("places") > 0)
    whole = runs.groupBy(*keys).agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_windows"), F.bool_and("exact").alias("exact"))
    return whole.filter(F.col("n_windows") >= SHARE * F.col("n")).select("doc_id", "item_id", "n_windows", (F.col("n_windows") / F.col("n")).alias("share"), "exact", "tie")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with their columns."""
    bad = leaks(docs, items).select(F.col("doc_id").alias("bad_id"), F.col("tie").alias("bad_tie")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_tie"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("tie")
