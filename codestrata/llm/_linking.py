"""From band keys to components of verified links, without anything on the driver and without pairing a bucket of copies.

Map tasks send the (key, id) entries of a chunk packed, a binary row for each slice of the key space, after linking ids of one key within
the chunk to the least of them; so a key that a third of all rows share arrives once a chunk. Slices are sorted in turn and yield
``members(key, id, hub)``: for every key the ids below which another id of that key is known.

Every id is first held against one hub, the least over its buckets, which turns groups of copies into one component. Buckets that then
still span several components are compared in full, in blocks of ``BLOCK`` members, by a product of incidence matrices that gives
the exact similarity of all pairs of a block. Where that would be many pairs a member, ids meet further hubs first, so that large groups
shrink at linear cost; a round that leaves most pairs, as in buckets of texts that are half alike, is the last. The result is that of verifying
every pair that shares a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm._common import discard, written

#: Members of a block; pairs a member above which buckets meet one more hub first; rounds of such hubs at most; share of the pairs that a round has to leave less than.
BLOCK, PAIRS_A_MEMBER, HUB_ROUNDS, LEFT = 256, 64, 6, 0.75
#: Slices of the key space for each shuffle partition; bytes of a packed row; columns of an incidence matrix at a time.
SLICES, PACKED_BYTES, COLUMNS = 2, 8192, 8192
#: Rows of a frame that one task writes, and pairs that one task verifies, where fewer tasks than shuffle partitions do.
ROWS_A_TASK, PAIRS_A_TASK = 50_000, 2_000
#: Characters of units of two members that are compared together.
TOGETHER = 1 << 20

PACKED = "slice int, entries binary, local binary"
_PACKED = pa.schema([("slice", pa.int32()), ("entries", pa.binary()), ("local", pa.binary())])


def slices(df: DataFrame) -> int:
    return SLICES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _tasks(rows: int, each: int = ROWS_A_TASK) -> int:
    return 1 + rows // each


def words_of(ids: list[bytes] | np.ndarray) -> np.ndarray:
    """Ids as rows of unsigned 64-bit words: binary ids of a multiple of eight bytes, or int64."""
    if isinstance(ids, np.ndarray):
        return ids.view(np.uint64).reshape(-1, 1)
    width = len(ids[0]) // 8 if ids else 1
    return np.frombuffer(b"".join(ids), ">u8").astype(np.uint64).reshape(-1, width)


def _id_column(words: np.ndarray, binary: bool) -> pa.Array:
    if not binary:
        return pa.array(np.ascontiguousarray(words[:, 0]).view(np.int64))
    data = words.astype(">u8").tobytes()
    width = 8 * words.shape[1]
    return pa.array([data[i : i + width] for i in range(0, len(data), width)], pa.binary())


def _hubs(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct entries (key, ids words) in order, and for each the place of the first, which is the least, of its key."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.r_[True, k[1:] != k[:-1]]
    alone = new & np.r_[new[1:], True]
    some = order[~alone]
    if len(some):  # the order of ids matters only in runs
        some = some[np.lexsort([*(ids[some, j] for j in range(ids.shape[1] - 1, -1, -1)), keys[some]])]
        equal = (keys[some][1:] == keys[some][:-1]) & (ids[some][1:] == ids[some][:-1]).all(axis=1)
        some = some[np.r_[True, ~equal]]
    order = np.concatenate([order[alone], some])
    k = keys[order]
    start = np.r_[True, k[1:] != k[:-1]]
    first = np.flatnonzero(start)
    return k, ids[order], np.repeat(first, np.diff(np.r_[first, len(k)]))


def packed(keys: np.ndarray, ids: np.ndarray, count: int) -> pa.RecordBatch:
    """The entries of a chunk by slice: one entry for each key, and (key, id, hub) for the ids of a key that are not its least."""
    flat = keys.reshape(-1).view(np.uint64)
    k, i, hub = _hubs(flat, np.repeat(ids, keys.shape[1], axis=0))
    place = np.arange(len(k))
    entries = np.column_stack([k, i])[hub == place]
    local = np.column_stack([k, i, i[hub]])[hub != place]
    rows: list[tuple[int, bytes, bytes]] = []
    for table, empty in ((entries, lambda s, x: (s, x, b"")), (local, lambda s, x: (s, b"", x))):
        slot = (table[:, 0] >> np.uint64(32)) % np.uint64(count)
        order = np.argsort(slot.astype(np.uint16) if count < 1 << 16 else slot, kind="stable")  # small numbers are sorted by digits
        table, slot = table[order], slot[order]
        cuts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.empty(0, np.int64)
        step = max(1, PACKED_BYTES // (8 * table.shape[1]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(slot)], strict=False):
            rows += [empty(int(slot[a]), table[c : min(b, c + step)].tobytes()) for c in range(a, b, step)]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], schema=_PACKED)


def _unpacked(width: int, binary: bool):
    names = pa.schema([("key", pa.int64()), ("id", pa.binary() if binary else pa.int64()), ("hub", pa.binary() if binary else pa.int64())])

    def out(keys: np.ndarray, ids: np.ndarray, hubs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys).view(np.int64)), _id_column(ids, binary), _id_column(hubs, binary)], schema=names)

    def flush(parts: list[bytes]):
        table = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 1 + width)
        k, i, hub = _hubs(table[:, 0].copy(), table[:, 1:])
        low = np.flatnonzero(hub != np.arange(len(k)))
        yield out(k[low], i[low], i[hub[low]])

    def run(batches):
        now, parts = None, []
        for batch in batches:
            local = np.frombuffer(b"".join(batch.column("local").to_pylist()), np.uint64).reshape(-1, 1 + 2 * width)
            yield out(local[:, 0], local[:, 1 : 1 + width], local[:, 1 + width :])
            for s, x in zip(batch.column("slice").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                if s != now and parts:
                    yield from flush(parts)
                    parts = []
                now = s
                if x:
                    parts.append(x)
        if parts:
            yield from flush(parts)

    return run


def members(rows: DataFrame, width: int, binary: bool) -> DataFrame:
    """``(key, id, hub)`` of keys with two ids or more, from packed rows; one slice at a time is in memory."""
    kind = "binary" if binary else "long"
    dealt = rows.repartition("slice").sortWithinPartitions("slice")
    return written(dealt.mapInArrow(_unpacked(width, binary), f"key long, id {kind}, hub {kind}"), "members")


def ids_of(found: DataFrame) -> DataFrame:
    return found.select("id").union(found.select(F.col("hub").alias("id"))).distinct()


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct elements."""
    both = len(x) + len(y) - len(np.union1d(x, y))
    return both / max(1, len(x) + len(y) - both)


def set_similarity(x: set, y: set) -> float:
    both = len(x & y)
    return both / max(1, len(x) + len(y) - both)


def _pair_links(alike: Callable[[list[str], list[str]], np.ndarray], threshold: float):
    def run(batches):
        for batch in batches:
            keep = alike(batch.column("x").to_pylist(), batch.column("y").to_pylist()) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def similarities(x: list[np.ndarray], y: list[np.ndarray] | None = None) -> np.ndarray:
    """Jaccard similarities of all pairs of two lists of arrays of distinct elements, or of one list with itself."""
    texts = x if y is None else [*x, *y]
    flat = np.concatenate(texts) if texts else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(v) for v in texts])
    order = np.argsort(flat)
    return similarities_of(flat[order], owner[order], len(x), None if y is None else len(y))


def similarities_of(flat: np.ndarray, owner: np.ndarray, one: int, two: int | None) -> np.ndarray:
    """The same from the elements of all texts in order, each with the number of its text: below ``one`` for the first list."""
    lengths = np.bincount(owner, minlength=one + (two or 0))
    column = np.cumsum(np.r_[True, flat[1:] != flat[:-1]]) - 1 if len(flat) else np.empty(0, np.int64)
    left = owner < one
    if two is None:
        shared = np.bincount(column) > 1
    else:
        total = int(column[-1]) + 1 if len(column) else 0
        shared = (np.bincount(column[left], minlength=total) > 0) & (np.bincount(column[~left], minlength=total) > 0)
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    count = int(shared.sum())
    both = np.zeros((one, one if two is None else two), np.float32)
    for at in range(0, count, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        incidence = np.zeros((len(lengths), min(COLUMNS, count - at)), np.float32)
        incidence[owner[a:b], column[a:b] - at] = 1
        both += incidence[:one] @ (incidence if two is None else incidence[one:]).T
    first, second = lengths[:one].astype(np.float32), lengths[0 if two is None else one :].astype(np.float32)
    if two is None:
        np.fill_diagonal(both, first)  # elements of one text only have no column
    return both / np.maximum(1, first[:, None] + second - both)


def by_elements(elements: Callable[[str], np.ndarray]) -> tuple[Callable, Callable]:
    """``alike`` and ``every`` of ``linked`` from the distinct elements of each text."""

    def alike(x: list[str], y: list[str]) -> np.ndarray:
        out, last, hub = [], None, np.empty(0)
        for s, t in zip(x, y, strict=True):
            if s != last:
                last, hub = s, elements(s)
            out.append(similarity(hub, elements(t)))
        return np.array(out, np.float64)

    def every(x: list[str], y: list[str] | None) -> np.ndarray:
        return similarities([elements(t) for t in x], None if y is None else [elements(t) for t in y])

    return alike, every


def _block_links(alike: Callable[[list[str], list[str]], np.ndarray], every: Callable[..., np.ndarray], threshold: float, binary: bool):
    kind = pa.binary() if binary else pa.int64()

    def links(rows: list[tuple]) -> list[tuple]:
        """Links that join the components of a unit as far as its verified pairs do: fewer than it has components."""
        i, j = rows[0][1], rows[0][2]
        first = [r for r in rows if r[3] == i]
        other = first if i == j else [r for r in rows if r[3] == j]
        near = every([r[6] for r in first], None if i == j else [r[6] for r in other]) >= threshold
        root = {r[5]: r[5] for r in rows}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        found = []
        for p, q in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1) if i == j else near)), strict=True):
            a, b = first[p], other[q]
            if a[5] != b[5] and (x := find(a[5])) != (y := find(b[5])):
                root[x] = y
                found.append((a[4], b[4]))
        return found

    def out(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], kind) for n in (0, 1)], ["a", "b"])

    def run(batches):
        rows: list[tuple] = []
        two: list[tuple] = []  # units of two members: they are compared together
        found: list[tuple] = []
        size = 0

        def compare():
            near = alike([r[6] for r, _ in two], [s[6] for _, s in two]) >= threshold
            found.extend((r[4], s[4]) for (r, s), is_near in zip(two, near.tolist(), strict=True) if is_near)
            two.clear()

        def end() -> int:
            """Characters put off."""
            if len(rows) > 2:
                found.extend(links(rows))
            elif len(rows) == 2 and rows[0][5] != rows[1][5]:
                two.append(tuple(rows))
                return len(rows[0][6]) + len(rows[1][6])
            return 0

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("key", "i", "j", "block", "id", "comp", "text")), strict=True):
                if rows and row[:3] != rows[0][:3]:
                    size += end()
                    rows.clear()
                    if size >= TOGETHER:
                        compare()
                        size = 0
                rows.append(row)
            if found:
                yield out(found)
                found.clear()
        end()
        if two:
            compare()
        if found:
            yield out(found)

    return run


def components(edges: DataFrame, count: int | None = None) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(id, comp)`` with comp the least id: least labels of neighbours with pointer jumping.

    ``count`` is the number of edges where it is known. Labels only fall, and every round halves the distance along label chains, so long chains take a logarithmic number of rounds. Rounds are written
    as files: a checkpoint would keep the constraints of its plan, which multiply from round to round.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("peer")).filter("id <> peer")
    tasks = _tasks(2 * (edges.count() if count is None else count))
    both = written(both.union(both.select("peer", "id")).distinct(), "edges", tasks)
    labels = written(both.groupBy("id").agg(F.min("peer").alias("low")).select("id", F.least("id", "low").alias("comp")), "labels", tasks)
    while True:
        low = both.join(labels.select(F.col("id").alias("peer"), "comp"), "peer").groupBy("id").agg(F.min("comp").alias("low"))
        near = written(labels.join(low, "id").select("id", F.least("comp", "low").alias("comp"), F.col("comp").alias("was")), "labels", tasks)
        jump = near.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        after = written(near.join(jump, "comp", "left").select("id", F.least("comp", F.coalesce("next", "comp")).alias("comp"), "was"), "labels", tasks)
        discard(labels, near)
        labels = after.select("id", "comp")
        if after.filter("comp <> was").isEmpty():
            discard(both)
            return labels


def _roots(parents: DataFrame) -> DataFrame:
    """``(id, comp)`` from ``parents(id, comp)``, each with a lesser parent: pointers are doubled until all are roots."""
    tasks = _tasks(parents.count())
    while True:
        up = parents.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        after = written(parents.join(up, "comp", "left").select("id", F.coalesce("next", "comp").alias("comp"), F.col("next").isNotNull().alias("moved")), "roots", tasks)
        discard(parents)
        parents = after
        if after.filter("moved").isEmpty():
            return after.select("id", "comp")


def _relabelled(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links; ids without a row are their own component."""
    own = lambda side: comp.select(F.col("id").alias(side), F.col("comp").alias(f"comp_{side}"))
    edges = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    labels = components(edges, links.count())
    new = labels.select(F.col("id").alias("comp"), F.col("comp").alias("low"))
    after = comp.join(new, "comp", "left").select("id", F.coalesce("low", "comp").alias("comp")).union(labels.filter("id <> comp"))
    return written(after, "components", _tasks(comp.count() + links.count()))


def linked(found: DataFrame, texts: DataFrame, alike: Callable[[list[str], list[str]], np.ndarray], every: Callable[[list[str], list[str] | None], np.ndarray], threshold: float) -> DataFrame:
    """Components over ids that share a bucket and are alike, as ``(id, comp)`` with comp an id of the component; ids without a row stand alone.

    ``found(key, id, hub)`` are members, ``texts(id, text)`` the texts of all their ids. ``alike(x, y)`` gives the similarities of two lists of
    texts one by one, ``every(x, y)`` those of all pairs of them, or of all pairs in x where y is None.
    """
    kind = found.schema["id"].dataType.simpleString().replace("bigint", "long")

    def verified(pairs: DataFrame) -> DataFrame:
        y = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
        x = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
        return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_pair_links(alike, threshold), f"a {kind}, b {kind}")

    least = found.groupBy("id").agg(F.min("hub").alias("hub"))
    first = verified(least.select(F.col("hub").alias("a"), F.col("id").alias("b")))
    comp = _roots(written(first.select(F.col("b").alias("id"), F.col("a").alias("comp")), "parents"))
    rows = found.select("key", "id").union(found.select("key", F.col("hub").alias("id"))).distinct()
    tasks = _tasks(2 * found.count())
    before = None
    for turn in range(HUB_ROUNDS + 1):
        known = rows.select("key", "id").join(comp, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
        each = known.groupBy("key", "comp").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("of"), F.min("id").alias("low"), F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("hub"))
        # of each bucket its members, its pairs across components, and a hub from its largest component; of buckets with the same members one
        buckets = each.groupBy("key").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.count("*").alias("parts"), F.bit_xor("of").alias("of"), F.min("low").alias("low"), F.max_by(F.struct("hub", "comp"), F.struct("n", "comp")).alias("most")
        )
        one = F.min_by(F.struct("key", "same", "most"), "key").alias("one")
        buckets = buckets.filter("parts > 1").groupBy("n", "of", "low").agg(one).select("n", "one.*")
        mixed = written(known.join(buckets, "key").select("key", "id", "comp", "n", F.expr("(n * n - same) / (2 * n)").alias("pairs"), F.col("most.hub").alias("hub"), F.col("most.comp").alias("hub_comp")), "mixed", tasks)
        size = mixed.agg(F.count("*").alias("n"), F.sum("pairs").alias("pairs")).first()
        if not size.n:
            return comp
        if turn == HUB_ROUNDS or size.pairs <= PAIRS_A_MEMBER * size.n or before is not None and size.pairs > LEFT * before:
            break
        before = size.pairs
        pairs = mixed.filter("comp <> hub_comp").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
        more = written(verified(pairs), "links", _tasks(size.n, PAIRS_A_TASK))
        if more.limit(1).isEmpty():
            break
        after = _relabelled(comp, more)
        discard(comp, more, rows)
        # buckets of one component stay so: the next turn reads the others only
        comp, rows = after, mixed
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = mixed.withColumn("count", count).withColumn("block", F.pmod(F.xxhash64("id"), "count").cast("int")).join(texts, "id")
    dealt = dealt.select("key", "id", "comp", "text", "block", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("other"))
    units = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "comp", "text")
    units = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = written(units.mapInArrow(_block_links(alike, every, threshold, kind == "binary"), f"a {kind}, b {kind}"), "links")
    if links.isEmpty():
        return comp
    return _relabelled(comp, links)
