import hashlib
import itertools
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import rows as R

from codestrata.llm import op1_decontamination as op1
from codestrata.llm import op4_source_mix as op4
from codestrata.llm import op6_fuzzy_lines as op6
from codestrata.llm import op7_main_text as op7
from codestrata.llm import op9_personal_data as op9

ITEM = "At noon Anna walks 12 km to the old mill. Then Anna carries 5 kg of flour back home for 3 hours. How far is that in all?"


def test_leaks_copies_and_asked_again(spark):
    again = ITEM.replace("Anna", "Bert").replace("12", "40").replace("5 kg", "7 kg")
    torn = ITEM.replace("Anna walks", "Bert walks").replace("12", "40")  # Anna is Bert in one place only
    items = spark.createDataFrame([(1, ITEM), (7, ITEM), (2, R.prose(50, 30)), (3, None), (4, ""), (5, "three small words"), (6, "1 2 3 4 5 6 7 8 9")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    more = [(50, R.prose(5, 40) + " " + ITEM + " " + R.prose(6, 40)), (51, R.prose(7, 30) + ". " + again), (52, torn), (53, R.prose(50, 30)), (54, R.prose(50, 30)[:60]), (55, "so three small words"), (56, "1 2 3 4 5 6 7 8 9 10"), (50, ITEM)]
    docs = R.documents(spark, more)
    found = {(r.doc_id, r.item_id, r.exact) for r in op1.leaks(docs, items).collect()}
    # 52 has another number throughout and another name in one place; 56 copies an item of numbers only, which has no template
    assert found == {(50, 1, True), (51, 1, False), (52, 1, False), (53, 2, True), (55, 5, True), (56, 6, True)}
    clean = op1.clean_documents(docs, items)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in docs.collect() if r.doc_id not in (50, 51, 52, 53, 55, 56))
    assert op1.leaks(docs, items.limit(0)).count() == 0 and op1.leaks(R.empty(spark), items).count() == 0


def test_words_table_grows_and_forgets(monkeypatch):
    monkeypatch.setattr(op1, "MEMO", 20)
    words = op1.Words()
    for k in range(6):
        text = R.prose(k, 40) + " 5 kg. Then Bert ran"
        h, kind, at = op1.tokens(text, words)
        fresh = op1.Words()
        assert (h == op1.tokens(text, fresh)[0]).all()
        assert [words.values[i] for i in at[-5:]] == ["5", "kg", "then", "bert", "ran"] and list(kind[-5:]) == [op1.NUMBER, op1.UNIT, op1.LITERAL, op1.NAME, op1.LITERAL]


def test_permutations_and_targets():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(op4.permute(np.arange(n), n, 5)) == list(range(n))
    assert (op4.permute(np.arange(1000), 1000, 5) != op4.permute(np.arange(1000), 1000, 6)).any()
    assert op4.targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    assert op4.targets([10, 1000, 0]) == [30.0, 980.0, 0.0]
    assert op4.targets([]) == [] and op4.targets([0, 0]) == [0.0, 0.0]


def test_mix_takes_near_targets(spark):
    docs = R.documents(spark, [(i, R.prose(i, 20 + i % 300)) for i in range(100, 500)])
    docs = docs.withColumn("source", F.when(F.col("doc_id") > 450, None).when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    got = op4.mixed(docs).collect()
    word = re.compile(op4.WORD)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, len(word.findall(r.text or ""))) for r in docs.collect())
    by = {}
    for r in got:
        assert r.taken <= 3 * r.size
        t = by.setdefault((r.source_size, r.target), [0, 0])
        t[0] += r.taken
        t[1] += r["size"]
    for (size, target), (taken, own) in by.items():
        assert own == size and abs(taken - target) <= 0.03 * target + 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, op4.mixed(docs).collect()), key=str)
    assert op4.mixed(R.empty(spark)).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    docs = R.documents(spark, [(i, R.prose(i, 20 + i % 300)) for i in range(100, 200)])
    mixed = op4.mixed_documents(docs)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    taken, words = Counter(), Counter()
    for r in op4.mixed(docs).collect():
        taken[r.doc_id] += r.taken
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).update((r.text or "").encode().split())
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.encode().split())
        assert set(r.text.encode().split()) <= texts[r.doc_id] and r.n_chars == len(r.text)
    assert +words == +taken
    assert op4.mixed_documents(R.empty(spark)).count() == 0


def lines_by_brute_force(data):
    places = sorted({((d is not None, d or 0, tie), i, x) for d, tie, t in data for i, x in op6.lines_of(t)})
    parent = list(range(len(places)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(places)), 2):
        x, y = places[i][2], places[j][2]
        if x == y or min(len(x), len(y)) > 0.7 * max(len(x), len(y)) and op6.line_similarity(x, y) >= op6.THRESHOLD:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    gone = {}
    for i, (doc, line, _) in enumerate(places):
        if find(i) != i:
            gone.setdefault(doc, []).append(line)
    return gone


def test_fuzzy_lines_against_brute_force(spark):
    base = R.prose(33, 30)
    variants = [base.replace(f"w{k}", f"v{k}", 1) for k in range(10)] + [base + " x", base[:-4], base]
    docs = R.documents(spark, [(100 + i, f"{v}\n\n{R.prose(700 + i, 12)}\nshort\n{v if i % 2 else ''}") for i, v in enumerate(variants)])
    data = [tuple(r) for r in docs.select("doc_id", F.xxhash64("text"), "text").collect()]
    want = lines_by_brute_force(data)
    got = {(r.doc_id is not None, r.doc_id or 0, r.tie): list(r.lines) for r in op6.repeated_lines(docs).collect()}
    assert got == want
    out = op6.deduplicated(docs)
    assert out.columns == [*docs.columns, "lines_gone"] and out.count() == docs.count()
    for r in out.select("doc_id", "text", "lines_gone").collect():
        whole = next(t for d, _, t in data if d == r.doc_id)
        assert r.text == (None if whole is None else "\n".join(x for i, x in enumerate(whole.split("\n")) if i not in set(r.lines_gone)))
    assert op6.deduplicated(R.empty(spark)).count() == 0


PAGE = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><div class='top'><p>Site name</p></div>{}<div>Impressum und Daten</div></body>"


def test_page_text_by_rules():
    page = op7.Page(
        "<!DOCTYPE html><body><nav>Menu</nav><header><h1>Site</h1></header><article><header><h1>A &amp; B</h1></header><p>one<br>two <b>bo</b>ld<p>three\n &nbsp;four"
        "<div class='share-bar'>Share</div><aside>Side</aside><ul><li>x<li>y</ul><section id=comments><p>Nice!</p></section><form>f</form></article><footer>F</footer>"
    )
    assert page.text() == "A & B\n\none two bold\n\nthree four\n\nx\n\ny"
    assert op7.Page(None).text() == op7.Page("").text() == "" and op7.Page("plain <i>te</i>xt").text() == "plain text"
    assert op7.Page("<p>a" * 3000).text().count("a") == 3000 and op7.Page("<div>" * 3000 + "deep").text() == "deep"


def tree(source):
    page = op7.Page(source)
    return op7.Tree(page.parents, page.labels, page.hashes())


def brute_match(x, y, a=-1, b=-1):
    xs, ys = x.children.get(a, []), y.children.get(b, [])
    m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, c in enumerate(xs):
        for j, d in enumerate(ys):
            w = 0 if x.labels[c] != y.labels[d] else 1 + brute_match(x, y, c, d) + (x.texts[c] == y.texts[d] != 0)
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + w)
    return m[-1][-1]


def test_tree_matching_is_maximal():
    draw = np.random.default_rng(3)

    def some(depth):
        return "".join(f"<{t}>{some(depth - 1) if depth and draw.random() < 0.7 else draw.integers(3)}</{t}>" for t in draw.choice(["div", "ul", "section"], draw.integers(1, 4)))

    for _ in range(30):
        x, y = tree(some(3)), tree(some(3))
        pairs = op7.match(x, y)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert all(x.labels[i] == y.labels[j] for i, j in pairs)
        assert len(pairs) + sum(x.texts[i] == y.texts[j] != 0 for i, j in pairs) == brute_match(x, y)


def test_wrapper_induction_removes_what_a_host_repeats(spark):
    bodies = [f"<div class='x'><p>{R.prose(i, 30)}</p><p>{R.prose(50 + i, 20)}</p></div>" for i in range(8)]
    rows = [(i, f"https://Site.org/{i}", PAGE.format(b)) for i, b in enumerate(bodies)] + [(i, "https://site.org/0", PAGE.format(bodies[0])) for i in range(20, 60)]
    rows += [(70, "https://other.org/", PAGE.format(bodies[0])), (71, None, PAGE.format(bodies[0])), (72, "https://site.org/n", None), (73, "https://site.org/e", ""), (None, "https://site.org/1", PAGE.format(bodies[1]))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "fp", "gone", "text", "n")})
    got = {r.page_id: r.text for r in op7.main_texts(pages).collect()}
    assert len(got) == len(rows)
    for i in (*range(8), *range(20, 60), None):
        k = i if i is not None and i < 8 else 1 if i is None else 0
        assert got[i] == f"{R.prose(k, 30)}\n\n{R.prose(50 + k, 20)}"
    for i in (70, 71):
        assert got[i] == f"Site name\n\n{R.prose(0, 30)}\n\n{R.prose(50, 20)}\n\nImpressum und Daten"
    assert got[72] == got[73] == "" and op7.main_texts(pages.limit(0)).count() == 0


def test_what_a_host_repeats_inside_its_articles_goes(spark):
    page = lambda body: f"<html><body><article><h1>{body[:20]}</h1><p>{body}</p><p>Read more of us every day.</p></article></body></html>"
    rows = [(i, f"https://a.org/{i}", page(R.prose(i, 30))) for i in range(8)] + [(10 + i, f"https://b.org/{i}", page(R.prose(99, 30)) + f"<footer>{i}</footer>") for i in range(8)]
    got = {r.page_id: r.text for r in op7.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == f"{R.prose(i, 30)[:20].strip()}\n\n{R.prose(i, 30)}"
        assert R.prose(99, 30) in got[10 + i]  # copies of one article


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_brute_force(spark):
    draw = np.random.default_rng(11)
    parts = ["a@b.c", "_d@e-f.g.h", "x@y", "@", ".", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "007.8.9.0", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "+1 (555) 123-4567", "+49", "+", "12", "é😀", " ", "-", "  ", "(9)", "0"]
    texts = ["".join(draw.choice(parts, draw.integers(1, 14))) for _ in range(400)] + ["1" * 30_000, "a." * 30_000, "9 " * 20_000, "a@b" + ".c" * 20_000, "+1" + "2" * 30_000, "1.1.1." * 9_000, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in op9.spans(docs).select("doc_id", "base", "added").collect()}
    for i, t in enumerate(texts):
        want = brute_base(t)
        assert [tuple(x) for x in got[i].base] == want, t
        both = [tuple(x) for x in got[i].added]
        assert all(a[2] <= b[0] or b[2] <= a[0] for a in both for b in [*want, *both] if a != b)


def test_model_finds_unusual_forms_and_leaves_others(spark):
    texts = ["Please write to anna dot lee at mail dot com today", "reach us: info [at] firm [dot] org", "call (555) 123-4567 now", "server 10[.]0[.]0[.]1 down", "card 4111.1111.1111.1111 ok",
             "meet me at the dot club", "order 4111.1111.1111.1112 sent", "section 1[.]900[.]3[.]4", "plain words only", "invoice no 9807915762804490"]
    docs = R.documents(spark, list(enumerate(texts, 100)))
    rows = {r.doc_id: [tuple(x)[1] for x in r.added] for r in op9.spans(docs).collect()}
    assert [len(rows[100 + i]) for i in range(10)] == [1] * 5 + [0] * 5
    trees, least = op9.model(spark)
    assert len(trees) == op9.TREES and all(np.isfinite(least))
    assert op9.spans(R.empty(spark)).count() == 0


def test_query_digests(spark, tmp_path):
    R.documents(spark, [(100, "mail a@b.org, ip 1.2.3.4 & +1 555 123 4567")], clashing=False).write.parquet(f"{tmp_path}/documents.parquet")
    for r in op9.query(spark, str(tmp_path)).collect():
        text = {100: "mail a@b.org, ip 1.2.3.4 & +1 555 123 4567"}.get(r.doc_id, "")
        spans = ",".join(f"{op9.KINDS[k]}:{s}:{e}" for s, k, e in brute_base(text))
        if r.doc_id in (100, 3, 4):
            assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest() and r.spans == spans
