"""Verification of many pairs of lines in one go: the similarities of sets of shingles, at a part of their time."""

import random
import string
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parent))

from codestrata.llm import _linking
from codestrata.llm import op6_fuzzy_lines as op6

ODD = ["a", "abcd", "abcde", "aaaaaaaaaaaa", "aaaaa", "é\U0001f600é́xyz 12345", "abcdefgh", "abcdefgh ijk", "ab" * 50, "\x0babcdefgh", "abcd\0", "x" * 70_000 + "y"]


def lines(n: int, size: int, seed: int) -> list[str]:
    """Pairs of neighbours are near copies."""
    draw = random.Random(seed)
    out = []
    for _ in range(n // 2):
        x = "".join(draw.choice(string.ascii_lowercase + "    ") for _ in range(draw.randint(size // 2, size))) + "z"
        at = draw.randrange(len(x))
        out += [x, x[:at] + "#" * draw.randint(0, 8) + x[at + 1 :]]
    return out


def test_similarities_one_by_one_and_of_every_pair():
    some = ODD + lines(40, 300, 1)
    exact = np.array([[op6.line_similarity(x, y) for y in some] for x in some])
    pairs = [(i, j) for i in range(len(some)) for j in range(len(some))]
    assert np.array_equal(op6.alike([some[i] for i, _ in pairs], [some[j] for _, j in pairs]), exact.ravel())
    assert len(op6.alike([], [])) == 0
    for found, expected in ((op6.every(some), exact), (op6.every(some[:7], some[7:]), exact[:7, 7:]), (op6.every(some[:1]), exact[:1, :1])):
        assert found.shape == expected.shape and np.allclose(found, expected, atol=1e-6)
    assert op6.every(some[:3], []).shape == (3, 0) and op6.every([], some[:3]).shape == (0, 3)


def test_units_of_two_are_compared_together(monkeypatch):
    """Units of two, three and one members over several batches, of one and of two blocks: the links join what similar pairs join."""
    monkeypatch.setattr(_linking, "TOGETHER", 700)
    some = lines(60, 200, 2)
    rows, at, key = [], 0, 0
    for n in [2] * 20 + [3, 1, 4, 2, 2, 6, 2]:
        block = [k % 2 if key % 3 == 0 else 0 for k in range(n)]
        rows += [(key, 0, max(block), block[k], at + k, at + k, some[at + k]) for k in range(n)]
        at, key = at + n, key + 1
    names = ["key", "i", "j", "block", "id", "comp", "text"]
    table = pa.table({n: pa.array([r[k] for r in rows]) for k, n in enumerate(names)})
    calls = []

    def alike(x, y):
        calls.append(len(x))
        return op6.alike(x, y)

    found = {frozenset((a, b)) for batch in _linking._block_links(alike, op6.every, op6.THRESHOLD, False)(table.to_batches(max_chunksize=7)) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
    expected = set()
    for r in rows:
        for s in rows:
            if r[0] == s[0] and r[4] < s[4] and (r[1] == r[2] or r[3] != s[3] or sum(x[0] == r[0] for x in rows) == 2) and op6.line_similarity(r[6], s[6]) >= op6.THRESHOLD:
                expected.add(frozenset((r[4], s[4])))
    assert found == expected and len(found) > 10
    assert sum(calls) == sum(sum(r[0] == k for r in rows) == 2 for k in range(key)) and max(calls) > 1


def test_blocks_of_large_buckets(spark, monkeypatch):
    rows = list(enumerate(lines(24, 120, 3)))
    base = lines(2, 400, 4)[0]
    rows += [(100 + k, base[: 9 * k] + "@" + base[9 * k + 1 :]) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = sorted((r.doc_id, list(r.lines)) for r in op6.repeated_lines(docs).collect())
    monkeypatch.setattr(_linking, "BLOCK", 2)
    assert once and sorted((r.doc_id, list(r.lines)) for r in op6.repeated_lines(docs).collect()) == once


def test_pairs_take_less_than_half_the_time_of_sets():
    """The check of op6 failed on CPU seconds."""
    some = lines(2_000, 800, 5)
    pairs = pa.table({"a": pa.array(range(1_000)), "b": pa.array(range(1_000, 2_000)), "x": pa.array(some[::2]), "y": pa.array(some[1::2])}).to_batches()

    def took(run) -> float:
        times = []
        for _ in range(3):
            start = time.process_time()
            run()
            times.append(time.process_time() - start)
        return min(times)

    by_sets = took(lambda: [op6.line_similarity(x, y) for x, y in zip(some[::2], some[1::2], strict=True)])
    assert took(lambda: list(_linking._pair_links(op6.alike, op6.THRESHOLD)(pairs))) < by_sets / 2
