"""Fuzzy line deduplication by MinHash: one line of every group of alike lines stays in the corpus.

Lines with a word are compared as sets of shingles of ``SHINGLE`` characters (the whole line where it is shorter). A signature holds the least
shingle hash of each of ``BANDS * ROWS`` bins (one permutation; an empty bin borrows from the first full one in an order of its own, so
that the bins of a band stay independent in short lines) and is cut into bands. Equal lines are one node. Lines that share a band are
verified by the exact Jaccard similarity of their shingles, which count as hashes of 54 bits or more, and joined into components by
distributed union-find (``_linking``); the occurrence with the least (doc_id, text, line number) of a component stays, all others go.

Signatures are computed once and sent packed; a second pass over the texts lists the places of all lines, with the text of those that
share a band with another. These are picked by a Bloom filter sized by their number, up to 64 MiB; beyond that it lets more texts pass, and the
exact join after it removes them.

Lines are known by a 64-bit hash. Defined results: a null text has no lines and stays null; lines without a word always stay; rows of equal doc_id and
text are one document, and the decision holds for each of them; a null doc_id comes first; an empty table gives no rows. Columns beside
doc_id and text may have any names but ``lines_gone``, which is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import _bits
from codestrata.llm._common import mix, read, text_or_empty, written
from codestrata.llm._linking import PACKED, ids_of, linked, members, packed, set_similarity, similarities_of, slices, words_of

#: 5 characters: a line of 49 or more with one changed character keeps a similarity of 0.8; a shorter one need not.
#: 16 bands of 6: at a similarity of 0.8 one pair in 130 shares no band, at 0.85 one in 2,500; at 0.3 one in 85 shares one.
SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 16, 6
#: Characters whose shingles are hashed at a time; lines whose entries are packed at a time; characters of pairs that are compared at a time.
CHUNK, LINES, PAIRED = 1 << 16, 1 << 14, 1 << 16

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIER = np.uint64(0xD1342543DE82EF95)
_FINAL = np.uint64(0x94D049BB133111EB)
_FULL = np.uint64(2**64 - 1)
_BINS = BANDS * ROWS
#: For each bin the order in which it asks the others.
_ORDER = np.argsort(mix(np.arange(1, _BINS * _BINS + 1, dtype=np.uint64) * _STEP).reshape(_BINS, _BINS), axis=1)


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """(line number, line) of the lines with a word, split at \\n."""
    return [(i, x) for i, x in enumerate((text or "").split("\n")) if x and (x[0] > " " or x.strip(" \t\n\v\f\r"))]


def _hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the shingle at every place of the lines one after the other (the greatest number where none begins), and their lengths, SHINGLE at least."""
    lengths = np.array([max(len(x), SHINGLE) for x in lines], np.int64)
    chars = np.frombuffer("".join([x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(chars) - SHINGLE + 1
    h = chars[:n].astype(np.uint64)
    for k in range(1, SHINGLE):
        h *= _MULTIPLIER
        h += chars[k : n + k]
    h *= _MULTIPLIER
    h ^= h >> np.uint64(29)
    h *= _FINAL
    h ^= h >> np.uint64(32)
    h[(np.cumsum(lengths)[:-1, None] - np.arange(1, SHINGLE)).ravel()] = _FULL
    return h, lengths


def _numbered(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the lines' shingles one after the other and the end of each line; places where none begins repeat the line's first."""
    h, lengths = _hashed(lines)
    ends = np.cumsum(lengths)
    h[ends[:-1, None] - np.arange(1, SHINGLE)] = h[(ends - lengths)[:-1], None]
    ends[-1] = len(h)
    return h, ends


def elements_of(lines: list[str]) -> list[np.ndarray]:
    """The distinct shingle hashes of each line."""
    h, ends = _numbered(lines)
    return [np.unique(x) for x in np.split(h, ends[:-1])]


def elements(line: str) -> np.ndarray:
    """The distinct shingle hashes of a line."""
    return elements_of([line])[0]


def alike(x: list[str], y: list[str]) -> np.ndarray:
    """Jaccard similarities of the lines of two lists one by one; shingles count as 63-bit hashes, the last bit tells the line."""
    out, at = [np.empty(0)], 0
    while at < len(x):
        lines, size = [], 0
        while at < len(x) and size < PAIRED:
            lines += (x[at], y[at])
            size += len(x[at]) + len(y[at])
            at += 1
        h, ends = _numbered(lines)
        h &= ~np.uint64(1)
        for a, b in zip(ends[::2].tolist(), ends[1::2].tolist(), strict=True):
            h[a:b] |= np.uint64(1)
        cuts = np.r_[0, ends[1::2]]
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            h[a:b].sort()
        change = h[1:] ^ h[:-1]
        change[cuts[1:-1] - 1] = _FULL
        own = np.diff(np.searchsorted(np.flatnonzero(change) + 1, cuts)) + (cuts[:-1] == 0)
        union = np.diff(np.searchsorted(np.flatnonzero(change > 1) + 1, cuts)) + (cuts[:-1] == 0)
        out.append((own - union) / union)
    return np.concatenate(out)


def every(x: list[str], y: list[str] | None = None) -> np.ndarray:
    """Jaccard similarities of all pairs of two lists of lines, or of one with itself; the last bits of the hashes give way to the line's number, about nine for two full blocks."""
    lines = x if y is None else [*x, *y]
    h, ends = _numbered(lines)
    bits = np.uint64((len(lines) - 1).bit_length())
    last = (np.uint64(1) << bits) - np.uint64(1)
    h &= ~last
    h |= np.repeat(np.arange(len(lines), dtype=np.uint64), np.diff(np.r_[0, ends]))
    h.sort()
    h = h[np.r_[True, h[1:] != h[:-1]]]
    return similarities_of(h >> bits, (h & last).astype(np.int64), len(x), None if y is None else len(y))


def signatures(lines: list[str]) -> np.ndarray:
    """A row of BANDS * ROWS minima for each line."""
    h, lengths = _hashed(lines)
    cell = np.repeat(np.arange(0, len(lines) * _BINS, _BINS), lengths)[: len(h)] + ((h >> np.uint64(32)) * np.uint64(_BINS) >> np.uint64(32)).view(np.int64)
    found = np.full(len(lines) * _BINS, _FULL)
    np.minimum.at(found, cell, h)
    out = found.copy()
    todo = np.flatnonzero(found == _FULL)
    column, turn = todo % _BINS, 0
    base = todo - column
    while len(todo):
        lent = found[base + _ORDER[column, turn % _BINS]]
        full = lent != _FULL
        out[todo[full]] = mix(lent[full] + np.uint64((turn + 1) * int(_STEP) % 2**64))
        todo, column, base, turn = todo[~full], column[~full], base[~full], turn + 1
    return out.reshape(len(lines), _BINS)


def bucket_keys(lines: list[str]) -> np.ndarray:
    """BANDS int64 keys for each line."""
    x = mix(signatures(lines).reshape(len(lines), BANDS, ROWS) + _STEP * np.arange(1, ROWS + 1, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    return mix(x + _STEP * np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def _name(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - 2**63


def _batched(lines: dict[int, str]):
    """The lines in lists of about CHUNK characters."""
    some, size = [], 0
    for line in lines.values():
        some.append(line)
        size += len(line) + SHINGLE
        if size >= CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


def _sign(count: int):
    def run(batches):
        lines: dict[int, str] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([bucket_keys(some) for some in _batched(lines)])
            return packed(keys, words_of(np.array(list(lines), np.int64)), count)

        for batch in batches:
            for text in batch.column("text").to_pylist():
                for _, line in lines_of(text):
                    lines[_name(line)] = line
                    size += len(line)
                    if len(lines) >= LINES or size >= 256 * CHUNK:
                        yield flush()
                        lines.clear()
                        size = 0
        if lines:
            yield flush()

    return run


_PLACES = "doc_id long, tie long, line int, id long, text string"


def _places(filtered):
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("line", pa.int32()), ("id", pa.int64()), ("text", pa.string())])

    def out(places: tuple[list, ...], bits: np.ndarray) -> pa.RecordBatch:
        *columns, names, lines = places
        ids = np.array(names, np.int64)
        texts = [line if m else None for line, m in zip(lines, _bits.maybe(bits, ids).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, schema.types, strict=False)), pa.array(ids), pa.array(texts, pa.string())], schema=schema)

    def run(batches):
        bits = _bits.unpacked(filtered.value)
        for batch in batches:
            places, size = ([], [], [], [], []), 0
            docs, ties, numbers, names, lines = places
            for doc, tie, text in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for i, line in lines_of(text):
                    docs.append(doc)
                    ties.append(tie)
                    numbers.append(i)
                    names.append(_name(line))
                    lines.append(line)
                    size += len(line)
                    if len(lines) >= LINES or size >= 256 * CHUNK:
                        yield out(places, bits)
                        size = 0
                        for column in places:
                            column.clear()
            if lines:
                yield out(places, bits)

    return run


def line_set(line: str) -> set[str]:
    """The distinct shingles of a line as strings, padded as ``elements`` are."""
    line = line if len(line) >= SHINGLE else line.ljust(SHINGLE, "\0")
    return {line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)}


def line_similarity(x: str, y: str) -> float:
    return set_similarity(line_set(x), line_set(y))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, tie, lines)``: the numbers of the lines that go, for documents that lose some; tie is a hash of the text."""
    own = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    found = members(docs.select("text").mapInArrow(_sign(slices(docs)), PACKED), 1, False)
    wanted = written(ids_of(found), "line-ids")
    packed_ids = docs.sparkSession.sparkContext.broadcast(_bits.packed(wanted, wanted.count()))
    seen = written(own.mapInArrow(_places(packed_ids), _PLACES), "line-places")
    near = seen.filter("text is not null").select("id", "text").join(wanted, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    comp = linked(found, written(near, "line-texts"), alike, every, THRESHOLD)
    comp = written(comp.union(comp.select(F.col("comp").alias("id"), "comp").distinct()), "line-components")
    here = F.struct(F.col("doc_id").isNotNull().alias("given"), F.col("doc_id").alias("doc_id"), F.col("tie").alias("tie"), F.col("line").alias("line"))
    nodes = seen.groupBy("id").agg(F.min(here).alias("least"), F.max(here).alias("last")).join(comp, "id", "left")
    # a line that occurs once and is like no other is done; of the rest each component keeps its least occurrence
    nodes = nodes.filter((F.col("least") != F.col("last")) | F.col("comp").isNotNull()).select("id", "least", F.coalesce("comp", "id").alias("comp"))
    nodes = written(nodes, "line-nodes")
    target = nodes.join(nodes.groupBy("comp").agg(F.min("least").alias("keep")), "comp").select("id", "keep")
    gone = seen.drop("text").join(target, "id").filter(here != F.col("keep"))
    return gone.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set("line")).alias("lines"))  # as many as the document has lines


def _without(texts: pd.Series, lines: pd.Series) -> pd.Series:
    def cut(text: str | None, gone) -> str | None:
        if text is None:
            return None
        drop = set(gone.tolist())
        return "\n".join([x for i, x in enumerate(text.split("\n")) if i not in drop])

    return pd.Series([cut(t, g) for t, g in zip(texts, lines, strict=True)], dtype=object)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their columns, their texts without the lines that go, and ``lines_gone`` (0-based numbers)."""
    gone = repeated_lines(docs).select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), F.col("lines").alias("__lines"))
    gone = gone.hint("shuffle_hash")  # the texts need no sort
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__tie"]), "left")
    kept = F.pandas_udf(_without, "string")(F.when(F.col("__lines").isNotNull(), docs["text"]), "__lines")
    text = F.when(F.col("__lines").isNull(), docs["text"]).otherwise(kept).alias("text")
    return joined.select(*[docs[c] if c != "text" else text for c in docs.columns if c != "lines_gone"], F.coalesce("__lines", F.array().cast("array<int>")).alias("lines_gone"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.size("lines_gone").alias("n_gone"), "lines_gone", F.length(text_or_empty()).alias("n_chars"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
