import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from codestrata.llm import op9_personal_data as op9


def test_cards_beside_short_numbers(spark):
    texts = ["card 4111.1111.1111.1111 123 ok", "card 4111 1111 1111 1111 12/27 ok", "card 2 4111.1111.1111.1111 ok", "pay 4111.1111.1111.1111 5500.0000.0000.0004 now"]
    cards = [["4111.1111.1111.1111"], ["4111 1111 1111 1111"], ["4111.1111.1111.1111"], ["4111.1111.1111.1111", "5500.0000.0000.0004"]]
    docs = spark.createDataFrame([*enumerate(texts), (9, "0 " * 100)], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.added] for r in op9.spans(docs).collect()}
    for i, (text, want) in enumerate(zip(texts, cards, strict=True)):
        assert [text[s:e] for s, k, e in sorted(got[i]) if op9.KINDS[k] == "card"] == want
    assert all(a[2] <= b[0] or b[2] <= a[0] for x in got.values() for a in x for b in x if a != b)


def test_secrets_where_the_text_says_so(spark):
    key = "908038b7daaf91e730d2f64001c52934d43d9336"
    texts = [f'the token = "{key}" is', f"password: {key}", f"commit {key} of", "a well-known-and-long-word-2 here", " ".join(f"user{i}@mail{i}.org" for i in range(16_000))]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (len(r.base), [(s, e) for s, k, e in r.added if op9.ALL_KINDS[k] == "secret"]) for r in op9.spans(docs).select("doc_id", "base", "added").collect()}
    assert [[t[s:e] for s, e in got[i][1]] for i, t in enumerate(texts)] == [[key], [key], [], [], []]
    assert got[4][0] == 16_000
