"""Main text of web pages by wrapper induction.

A page becomes a tree of block elements whose leaves are runs of text; inline markup belongs to the runs. The distinct trees of a host
are each aligned with the host's pivot tree by simple tree matching (a dynamic program over ordered children, on equal labels). A run of the pivot
whose aligned runs have its text on nearly every page is template, all others are slots; on each page the runs aligned with template
text go and the rest is content. Statistics cover every distinct page of a host and are plain counts, so a host with any share of
the pages is spread over all tasks.

Where a page says itself what is not its article (nav, header, footer, aside, form, scripts, roles, class and id words) that is left
out before alignment, and where it names its article (article, main) only that is read; template runs in its paragraphs,
headings, list items, quotations and tables go too, unless they are half of these or more, as in copies of one article.

White space inside a block becomes one space, blocks are trimmed and joined by an empty line, character references are decoded.
Defined results: null and empty html have an empty text; html that is never closed is read to its end; repeated rows are each extracted;
a page without a host is induced with the others that have none; an empty table gives no rows. Further columns may have any names.
"""

from __future__ import annotations

import html as html_codes
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm._common import read, written

#: A run is template if at least so many distinct pages align with it, of which this share has its text.
LEAST_PAGES, CONSTANT = 4, 0.9
#: Parts over which the pages of each host are dealt when they meet its pivot.
SALTS = 16

_words = lambda s: frozenset(s.split())
#: Elements of HTML by their part in a page, and words of classes, ids and roles that mark what is not the article.
BLOCKS = _words("address article aside blockquote body button center caption dd details dialog dl dt div fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul")
LEFT_OUT = _words("head title nav footer aside form button select textarea option fieldset legend menu search dialog template noscript iframe object svg canvas audio video map")
RAW = _words("script style noscript template iframe textarea title svg")
VOID = _words("area base br col embed hr img input link meta param source track wbr")
PROSE = _words("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th caption figcaption")
CLOSES = {"li": _words("li"), "dd": _words("dd dt"), "dt": _words("dd dt"), "tr": _words("tr td th"), "td": _words("td th"), "th": _words("td th"), "option": _words("option")}
MARKS = _words(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice "
    "pagination popup promo related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget"
)
ROLES = _words("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search toolbar")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _marked(attributes: str) -> tuple[bool, str]:
    """Whether a tag's attributes mark what is not the article; and its role."""
    role, marked = "", False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            marked |= not MARKS.isdisjoint(_SPLIT.split(_CAMEL.sub("-", value).lower()))
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            marked = True
    return marked or role in ROLES, role


class Page:
    """Blocks in preorder: ``parents``, ``labels`` and, of runs of text, ``texts``; ``prose``: runs in prose elements of a named article."""

    def __init__(self, source: str | None):
        self.parents: list[int] = []
        self.labels: list[str] = []
        self.texts: list[str] = []
        self.prose: list[bool] = []
        self.article: list[bool] = []
        self._parse(source or "")
        if any(a and t for a, t in zip(self.article, self.texts, strict=True)):
            self.texts = [t if a else "" for a, t in zip(self.article, self.texts, strict=True)]

    def _add(self, parent: int, label: str, text: str, prose: bool, article: bool) -> int:
        self.parents.append(parent)
        self.labels.append(label)
        self.texts.append(text)
        self.prose.append(prose)
        self.article.append(article)
        return len(self.parents) - 1

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int, bool, bool, bool]] = [("", -1, False, False, False)]  # tag, node, left out, in a named article, in prose
        run: list[str] = []

        def flush() -> None:
            if run:
                if text := " ".join(html_codes.unescape("".join(run)).split()):
                    _, node, _, article, prose = stack[-1]
                    self._add(node, "#text", text, prose and article, article)
                run.clear()

        at, end = 0, len(source)
        while at < end:
            found = _TOKEN.search(source, at)
            if not stack[-1][2] and (piece := source[at : found.start() if found else end]):
                run.append(piece)
            if not found:
                break
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                if any(x[0] == tag for x in stack):
                    if tag in BLOCKS:
                        flush()
                    while stack.pop()[0] != tag:
                        pass
                continue
            if tag == "br":
                if not stack[-1][2]:
                    run.append(" ")
                continue
            block = tag in BLOCKS
            marked, role = _marked(found[3]) if found[3].strip() else (False, "")
            out = tag in LEFT_OUT or marked and tag not in ("html", "body", "article", "main")
            if tag == "header":
                out = marked or not stack[-1][3]
            if block:
                if not stack[-1][2]:
                    flush()
                for other in CLOSES.get(tag, ()):
                    if stack[-1][0] == other:
                        stack.pop()
                while stack[-1][0] == "p":
                    stack.pop()
            if tag in RAW or tag in ("script", "style"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                stop = source.find(">", close.end()) + 1 if close else end
                at = stop or end
                continue
            if tag in VOID or found[3].endswith("/") and not block:
                continue
            _, node, left, article, prose = stack[-1]
            if block and not (left or out):
                article = article or tag in ("article", "main") or role == "main"
                prose = tag in PROSE or prose
                stack.append((tag, self._add(node, tag, "", False, article), False, article, prose))
            elif block or out:
                stack.append((tag, node, left or out, article, prose))
        flush()

    def hashes(self) -> list[int]:
        return [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63 if t else 0 for t in self.texts]

    def text(self, gone: set[int] = frozenset()) -> str:
        """The runs that are not template; template runs in prose of a named article stay where they are half of it or more, as in copies of one article."""
        size = lambda only: sum(len(t) for i, t in enumerate(self.texts) if self.prose[i] and (not only or i in gone))
        copied = bool(gone) and 2 * size(True) >= size(False)
        return "\n\n".join(t for i, t in enumerate(self.texts) if t and (i not in gone or self.prose[i] and copied))


class Tree:
    """Parents, label codes and text hashes, as stored."""

    def __init__(self, parents: list[int], labels: list[int], texts: list[int]):
        self.labels, self.texts = labels, texts
        self.children: dict[int, list[int]] = {}
        for i, p in enumerate(parents):
            self.children.setdefault(p, []).append(i)


def match(x: Tree, y: Tree) -> list[tuple[int, int]]:
    """Aligned nodes of two trees by simple tree matching."""
    memo: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    single: set[tuple[int, int]] = set()
    sys.setrecursionlimit(max(20_000, 4 * len(x.labels)))

    def weight(a: int, b: int) -> int:
        """The size of the largest ordered matching below a and b."""
        xs, ys = x.children.get(a, ()), y.children.get(b, ())
        if not xs or not ys:
            return 0
        if len(xs) == len(ys) == 1:
            i, j = xs[0], ys[0]
            if x.labels[i] != y.labels[j]:
                return 0
            single.add((a, b))
            return 1 + weight(i, j) + (x.texts[i] == y.texts[j] != 0)
        w = (np.array([x.labels[i] for i in xs])[:, None] == np.array([y.labels[j] for j in ys])).astype(np.int64)
        inner = np.array([i in x.children for i in xs])[:, None] & np.array([j in y.children for j in ys]) & (w > 0)
        for i, j in zip(*np.nonzero(inner), strict=True):
            w[i, j] += weight(xs[i], ys[j])
        tx, ty = np.array([x.texts[i] for i in xs]), np.array([y.texts[j] for j in ys])
        w += (w > 0) & (tx[:, None] == ty) & (ty != 0)
        best = np.zeros((len(xs) + 1, len(ys) + 1), np.int64)
        for i in range(len(xs)):
            best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + w[i]))
        memo[a, b] = w, best
        return int(best[-1, -1])

    weight(-1, -1)
    pairs, todo = [], [(-1, -1)]
    while todo:
        a, b = todo.pop()
        if (a, b) in single:
            pairs.append((x.children[a][0], y.children[b][0]))
            todo.append(pairs[-1])
            continue
        if (a, b) not in memo:
            continue
        (w, best), xs, ys = memo[a, b], x.children[a], y.children[b]
        i, j = len(xs), len(ys)
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((xs[i], ys[j]))
                todo.append((xs[i], ys[j]))
    return pairs


def _host(url: str | None) -> str:
    head, found, rest = (url or "").partition("://")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower() if found else ""


_TREE = "host string, fp binary, parents array<int>, labels array<long>, texts array<long>"


def _trees(batches):
    for batch in batches:
        out = {"host": [], "fp": [], "parents": [], "labels": [], "texts": []}
        seen = set()
        for url, fp, source in zip(batch.column("url").to_pylist(), batch.column("fp").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host = _host(url)
            if (host, fp) in seen:
                continue
            seen.add((host, fp))
            page = Page(source)
            for name, value in (("host", host), ("fp", fp), ("parents", page.parents), ("labels", [zlib.crc32(x.encode()) for x in page.labels]), ("texts", page.hashes())):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("host", pa.string()), ("fp", pa.binary()), ("parents", pa.list_(pa.int32())), ("labels", pa.list_(pa.int64())), ("texts", pa.list_(pa.int64()))]))


def _aligned(batches):
    """For each page its runs that are aligned with a run of the pivot, and whether the texts are equal."""
    last, pivot = None, None
    for batch in batches:
        rows = {"host": [], "fp": [], "runs": []}
        for row in batch.to_pylist():
            if (key := (row["host"], row["pivot"]["fp"])) != last:
                last, pivot = key, Tree(row["pivot"]["parents"], row["pivot"]["labels"], row["pivot"]["texts"])
            tree = Tree(row["parents"], row["labels"], row["texts"])
            runs = [{"run": i, "pivot_run": j, "same": tree.texts[i] == pivot.texts[j]} for i, j in match(tree, pivot) if tree.texts[i] and pivot.texts[j]]
            rows["host"].append(row["host"]), rows["fp"].append(row["fp"]), rows["runs"].append(runs)
        run = pa.struct([("run", pa.int32()), ("pivot_run", pa.int32()), ("same", pa.bool_())])
        yield pa.RecordBatch.from_pydict(rows, pa.schema([("host", pa.string()), ("fp", pa.binary()), ("runs", pa.list_(run))]))


def template_runs(pages: DataFrame) -> DataFrame:
    """``(host, fp, gone)``: the runs of a distinct page that are template, for pages that have some; fp is the md5 of the html."""
    trees = pages.select("url", F.unhex(F.md5(F.coalesce("html", F.lit("")))).alias("fp"), "html").mapInArrow(_trees, _TREE)
    trees = written(trees.dropDuplicates(["host", "fp"]), "page-trees")
    pivots = trees.groupBy("host").agg(F.min_by(F.struct("fp", "parents", "labels", "texts"), "fp").alias("pivot"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES).drop("n")
    salted = trees.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    aligned = salted.join(pivots, ["host", "salt"]).mapInArrow(_aligned, "host string, fp binary, runs array<struct<run:int,pivot_run:int,same:boolean>>")
    runs = written(aligned.select("host", "fp", F.inline("runs")), "page-runs")
    fixed = runs.groupBy("host", "pivot_run").agg(F.count("*").alias("n"), F.count_if("same").alias("equal"))
    fixed = fixed.filter((F.col("n") >= LEAST_PAGES) & (F.col("equal") >= CONSTANT * F.col("n"))).select("host", "pivot_run")
    return written(runs.filter("same").join(fixed, ["host", "pivot_run"]).groupBy("host", "fp").agg(F.collect_list("run").alias("gone")), "template-runs")


def _extract(batches):
    for batch in batches:
        texts = [Page(source).text(set(gone or ())) for source, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` for every row of ``pages(page_id, url, html, ...)``.

    The template runs are a written table, so the planner knows its size when it chooses how to join them with the pages.
    """
    gone = template_runs(pages)
    host = F.when(F.instr("url", "://") > 0, F.lower(F.regexp_extract(F.expr("substr(url, instr(url, '://') + 3)"), r"^[^/?#]*", 0))).otherwise("")
    own = pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("host"), F.unhex(F.md5(F.coalesce("html", F.lit("")))).alias("fp"))
    return own.join(gone, ["host", "fp"], "left").select("page_id", "url", "html", "gone").mapInArrow(_extract, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
