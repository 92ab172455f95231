import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers

sys.path.insert(0, str(Path(__file__).parent))
import rows as R
from test_op2_3_5_8_10 import brute_measures, classes_by_brute_force

import corpus_pipeline
from codestrata.llm import op3_token_files as op3


def test_each_stage_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    item = R.prose(900, 30)
    base = R.prose(77, 150).split()
    more = [(100 + i, R.prose(300 + i, 55 + i)) for i in range(40)] + [(200 + i, " ".join([*base[:i], f"e{i}", *base[i + 1 :]])) for i in range(6)]
    more += [(300, R.prose(31, 40) + " " + item + " " + R.prose(32, 30)), (301, R.prose(5, 60) + " ###" * 40)]
    R.documents(spark, more, clashing=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "stage")
        kept.append(docs.collect())
    assert all(list(r.asDict()) == corpus_pipeline.COLUMNS for rows in kept[:4] for r in rows)
    raw = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    good = []
    for r in raw:
        n, chars, symbols, lines, dup, repeated = brute_measures(r.text)
        if n >= 50 and 100 * repeated <= 50 * n and 10 * symbols <= n and 100 * dup <= 40 * lines and 3 * n <= chars <= 10 * n:
            good.append(r)
    key = lambda rows: Counter((r.doc_id, r.text) for r in rows)
    assert key(kept[0]) == key(good)
    data = [(r.doc_id, r.text) for r in kept[0]]
    classes = classes_by_brute_force(data)
    assert key(kept[1]) == Counter((d, t) for (d, t), c in zip(data, classes, strict=True) if d is None or d == c[0])
    assert key(kept[2]) == Counter({k: n for k, n in key(kept[1]).items() if item not in k[1]})
    texts = {r.doc_id: r.text for r in kept[2]}
    assert all(set(r.text.split()) <= set(texts[r.doc_id].split()) for r in kept[3])
    words = sum(len(r.text.split()) for r in kept[3])
    assert abs(words - sum(len(t.split()) for t in texts.values())) <= 0.03 * words
    tokenizer = Tokenizer.from_file(public_tokenizers.path(op3.VOCABULARY))
    ids = [tokenizer.encode(r.text, add_special_tokens=False).ids + [1] for r in kept[3]]
    want = Counter((r.doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(kept[3], ids, strict=True))
    last = sorted(kept[4], key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in last) == want
    assert [r.start for r in last] == [0, *np.cumsum([r.n_tokens for r in last])[:-1].tolist()]
    order = [(r.doc_id is not None, r.doc_id or 0) for r in last]
    assert order == sorted(order)


def test_empty_tables(spark, tmp_path):
    R.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
