import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))

from codestrata.llm import _linking, op6_fuzzy_lines, op10_near_duplicates


def test_small_frames_are_few_files(spark, monkeypatch):
    """Each file costs an executor several processes, so frames of a few rows do not follow the number of shuffle partitions."""
    files = []

    def counted(df, name, tasks=None, write=_linking.written):
        out = write(df, name, tasks)
        files.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(_linking, "written", counted)
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10 < 9], "a long, b long")
        got = {(r.id, r.comp) for r in _linking.components(edges).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {(i, i - i % 10) for i in range(40)}
    assert files and max(n for _, n in files) == 1, files


def test_similarities_of_one_list():
    draw = np.random.default_rng(3)
    texts = [np.unique(draw.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 30, 40, 50, 3)]
    assert np.array_equal(_linking.similarities(texts)[1:, 1:], _linking.similarities(texts, texts)[1:, 1:])
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            assert i == j or abs(_linking.similarities(texts)[i, j] - _linking.similarity(x, y)) < 1e-6


def test_elements_of_several_lines():
    lines = ["abcdefgh", "a", "", "aaaaaaaaaaaa", "é\ud800é́xyz 12345", "abcdefgh ijk"]
    for line, found in zip(lines, op6_fuzzy_lines.elements_of(lines), strict=True):
        assert np.array_equal(found, op6_fuzzy_lines.elements(line))


def test_classes_after_several_turns(spark, monkeypatch):
    """Later turns read only the buckets that still span components, with the result of one turn."""
    texts = []
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(60)]
        for k in range(8):
            words = list(base)
            words[7 * k + 1] = "changed" + str(k)
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    once = {tuple(r) for r in op10_near_duplicates.near_duplicate_classes(docs).collect()}
    monkeypatch.setattr(_linking, "PAIRS_A_MEMBER", 0)
    monkeypatch.setattr(_linking, "LEFT", 2.0)
    assert {tuple(r) for r in op10_near_duplicates.near_duplicate_classes(docs).collect()} == once
