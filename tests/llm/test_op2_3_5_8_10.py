import itertools
import os
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import rows as R

from codestrata.llm import op2_quality_rules as op2
from codestrata.llm import op3_token_files as op3
from codestrata.llm import op5_url_filter as op5
from codestrata.llm import op8_hilbert_shards as op8
from codestrata.llm import op10_near_duplicates as op10


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", [None, "", " \n ", "a", "a b c a b c", "a a a a", "x y\nx y\n\n z|#", "a b c d a b c e f b c d", "Ünï cödé x"])
def test_measures(text):
    assert op2.measure(text) == brute_measures(text)


def test_ledger_policies_and_ablation(spark):
    docs = R.documents(spark, [(20, R.prose(9, 60) + " #$%" * 20)])
    found = {(r.doc_id, r.n_words): r for r in op2.ledger(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        m = brute_measures(r.text)
        assert tuple(found[r.doc_id, m[0]][k] for k in op2.MEASURES) == m
    kept = op2.kept_documents(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {0, 1, 2, None, 8, -5} == ids
    policy = op2.POLICIES["v1"]
    rows = [r.failed_bits for r in op2.ledger(docs).collect()]
    for r in op2.ablation(op2.ledger(docs), policy).collect():
        bit = 1 << list(op2.RULES).index(r.rule)
        assert (r.failed, r.only, r.kept_without) == (sum(b & bit > 0 for b in rows), sum(b & policy.mask == bit for b in rows), sum(b & policy.mask & ~bit == 0 for b in rows))
    assert op2.kept_documents(R.empty(spark)).count() == 0 and op2.ablation(op2.ledger(R.empty(spark)), policy).count() == 0


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(op3.VOCABULARY))
    docs = R.documents(spark, [(100 + i, R.prose(i, 30) + "." * (i % 3)) for i in range(40)])
    want, start = [], 0
    data = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r in data:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = op3.encode_and_read(docs).orderBy("start").collect()
    assert [tuple(r) for r in found] == want
    assert op3.encode_and_read(R.empty(spark)).count() == 0


def test_encoder_forgets_and_agrees(monkeypatch):
    monkeypatch.setattr(op3, "MEMO", 50)
    encoder = op3.Encoder(public_tokenizers.path(op3.VOCABULARY))
    for k in range(5):
        texts = [R.prose(k * 10 + i, 20) + "! don't, A.B.C; Ωmega. 3.14" for i in range(6)]
        want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, encoder.dtype).tobytes() for t in texts]
        assert encoder.encode(texts) == want


def test_url_parts_rules_and_list(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/x?q", "https://a.example.com/en/1#t", "http://b.net/es/", "http://b.net/esx", "http://net/fr/1", "http://x.org/a/b/?u=1", "http://deep.bad.org:80", "http://deep.bad.org/z", "http://www.x.org/a/b", "ftp://x.org", "http://xcom/", "http://a.com?x/y"]
    pages = spark.createDataFrame(list(enumerate([*urls, *urls])), "page_id long, url string").withColumns({"key": F.lit(1), "host": F.lit(2), "block": F.lit(3)})
    listed = spark.createDataFrame([("x.org/a/b/",), ("bad.org/",), (None,), ("bad.org/",)], "key string")
    got = {r.page_id: r for r in op5.judge(pages, op5.RULES, listed).collect()}
    assert len(got) == 2 * len(urls)
    want = {4: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 5: ("a.example.com", "/en/1", "example.com/en/", "block"), 6: ("b.net", "/es/", "net/es/", "block"), 7: ("b.net", "/esx", None, "allow"),
            8: ("net", "/fr/1", "net/fr/", "block"), 9: ("x.org", "/a/b/", None, "block"), 10: ("deep.bad.org:80", "", None, "allow"), 11: ("deep.bad.org", "/z", None, "block"), 12: ("www.x.org", "/a/b", None, "block"),
            13: ("x.org", "", None, "allow"), 14: ("xcom", "/", None, "allow"), 15: ("a.com", "", None, "allow")}
    for k in range(len(urls)):
        r = got[k]
        assert tuple(r)[1:] == tuple(got[k + len(urls)])[1:] == want.get(k, ("", "", None, "allow")), (k, r)
    assert op5.judge(pages.limit(0), op5.RULES, listed).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(5000).select(F.concat(F.lit("h"), "id", F.lit(".org/")).alias("key"))
    urls = spark.range(0, 10_000).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"), F.lit("/q").alias("path"))
    assert op5.listed_urls(urls, listed).count() == 5000


def test_hilbert_index_is_a_curve(spark):
    for n, bits in ((2, 4), (3, 3)):
        axes = spark.range(1 << bits * n).select(*[((F.col("id") / (1 << bits * i)).cast("long") % (1 << bits)).cast("int").alias(f"a{i}") for i in range(n)])
        cells = [tuple(r)[:n] for r in op8.with_hilbert_index(axes.withColumns({f"b{i}": F.col(f"a{i}") for i in range(n)}), [f"b{i}" for i in range(n)], "h", bits).orderBy("h").collect()]
        assert len(set(cells)) == 1 << bits * n
        assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in itertools.pairwise(cells))


def test_shards_are_runs_of_equal_count(spark):
    docs = R.documents(spark, [(i, R.prose(i, i % 50)) for i in range(100, 400)])
    got = sorted(op8.assign(docs).collect(), key=lambda r: (r.shard, r.slot))
    counts = Counter(r.shard for r in got)
    assert len(got) == docs.count() and set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert [r.slot for r in got] == [i for s in sorted(counts) for i in range(counts[s])]
    assert [r.curve for r in got] == sorted(r.curve for r in got)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert op8.assign(R.empty(spark)).count() == 0


def test_shards_are_written_whole(spark, tmp_path):
    docs = R.documents(spark).withColumns({c: F.lit(7) for c in ("size", "copy", "text_crc32")})
    op8.write_shards(docs, f"file://{tmp_path}/s", 4)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert set(docs.columns) <= set(back.columns) and back.filter("size <> 7 or copy <> 7 or text_crc32 <> 7").count() == 0
    key = lambda rows: Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows)
    assert key(back.collect()) == key(docs.collect())


def classes_by_brute_force(data):
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    split = [(t or "").encode().split() for _, t in data]
    sets = [Counter(zip(*[w[i:] for i in range(min(5, len(w)))], strict=False)) if w else Counter() for w in split]
    assert all(len(op10.shingles(t or "")[0]) == len(s) for (_, t), s in zip(data, sets, strict=True))
    for i, j in itertools.combinations(range(len(data)), 2):
        x, y = sets[i], sets[j]
        if data[i][1] is not None and data[i][1] == data[j][1] or x and y and sum((x & y).values()) >= 0.8 * sum((x | y).values()):
            parent[find(i)] = find(j)
    return [sorted(data[j][0] for j in range(len(data)) if find(j) == find(i) and data[j][0] is not None) for i in range(len(data))]


def test_near_duplicates_against_brute_force(spark):
    more, base = [], R.prose(77, 200).split()
    for i in range(60):
        edited = list(base)
        for k in range(i % 12):
            edited[(i * 37 + k * 17) % 200] = f"e{i}.{k}"
        more.append((1000 + i, " ".join(edited)))
    more += [(2000 + i, R.prose(500 + i, 40) + " " + " ".join(base[:60])) for i in range(20)]
    docs = R.documents(spark, more)
    data = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter((d, g[0] if g else None, max(1, len(g or []))) for (d, _), g in zip(data, classes_by_brute_force(data), strict=True) if d is not None)
    got = Counter(tuple(r) for r in op10.near_duplicate_classes(docs).collect() if r.doc_id is not None)
    assert got == want
    assert op10.near_duplicate_classes(R.empty(spark)).count() == 0


def test_dart_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(5)
    elements = draw.integers(0, 2**63, 300).astype(np.uint64)
    x, y = draw.gamma(1, 2, 300) + 0.01, draw.gamma(1, 2, 300) + 0.01
    true = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    agree = (op10.signature(elements, x, 2048) == op10.signature(elements, y, 2048)).mean()
    assert abs(agree - true) < 0.05


def test_ids_are_the_library_s_over_odd_letters():
    encoder = op3.Encoder(public_tokenizers.path(op3.VOCABULARY))
    of = lambda t: np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, encoder.dtype).tobytes()
    texts = ["İ.", "a İ.", "Σ. Σα. ΑΣ", "ŉ! ǅ, ﬁ.", "é. É!", "1. 12, ²;", "it's. I'LL!", "<|endoftext|>. x<|startoftext|>y"]
    texts += [f"{a}{chr(c)}{m}" for c in range(0x21, 0x250) for a in ("", "a") for m in (".", "!?")]
    assert encoder.encode(texts) == [of(t) for t in texts]
