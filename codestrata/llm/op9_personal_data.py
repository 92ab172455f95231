"""Personal data in texts: candidates by pattern, scored by gradient-boosted trees; built-in functions only.

Well-formed e-mail addresses, IP addresses, card and phone numbers (the base) are always spans. High-recall patterns propose further,
overlapping spans: addresses spelt with "at" and "dot", defanged IP addresses, numbers with unusual separators, phone numbers without a
plus sign, and long runs of letters and digits, which are a secret (a kind of its own) where the text around them says so. In a run of digit groups every stretch of whole groups that has 12 to 19 digits and passes Luhn is a card candidate. Each gets
features of its form and of the text around it, boosted trees score it, and a threshold calibrated by kind on held-out rows selects it;
selected spans are taken best first, and none that meets one taken before or a base span.

The trees are trained on ``TRAINING_ROWS`` generated, labelled sentences, which is all the data that training sees; their features come from
the same expressions that score documents, and the trees become expressions too.

Positions are in code points. Repetitions are written possessively, so that they neither backtrack nor recurse on long texts;
the matches are those of the plain patterns. Defined results: null and empty texts have no spans; repeated rows are each searched.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm._common import read, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
#: Kinds of added spans: also keys, tokens and passwords, which have no base pattern.
ALL_KINDS = [*KINDS, "secret"]
TRAINING_ROWS, TREES, DEPTH, RATE, PRECISION = 2000, 32, 3, 0.3, 0.99
#: Code points of context on either side.
CONTEXT = 32

#: Base patterns by kind. A match starts at the start of its run or where the last match ended; from further inside a run none can.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Patterns that propose further spans.
PROPOSED = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[a-z0-9-]{1,63}+(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[a-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?i)(?<![0-9.])[0-9]{1,4}+(?:\x20?[\[(](?:\.|dot)[\])]\x20?[0-9]{1,4}+){3}",
    "card": r"[0-9](?:[\x20./_-]{0,2}+[0-9]){11,}+",
    "secret": r"(?i)(?<![a-z0-9+/_-])(?=[a-z+/_-]*+[0-9])[a-z0-9+/_-]{16,}+",
    "phone": r"(?<![0-9+])\(?[0-9]{2,5}+\)?[\x20./-]{1,2}+[0-9]{2,5}+(?:[\x20./-][0-9]{2,5}+){1,4}+(?![0-9])",
}
#: What begins at a digit group of a card run and has a number of digits, up to the end of a group; and its greatest length.
CARD, CARD_DIGITS, CARD_LENGTH = r"^[0-9](?:[\x20./_-]{0,2}+[0-9]){%d}(?![0-9])", range(12, 20), 19 + 2 * 18
#: Digits grouped as on cards: in fours, or 4-6-5, with one separator throughout, or in one group.
EVEN = r"^(?:[0-9]++|[0-9]{4}([\x20./_-]{1,2})(?:[0-9]{4}\1)*[0-9]{1,4}|[0-9]{4}([\x20./_-]{1,2})[0-9]{6}\2[0-9]{4,5})$"
#: Words near a span that speak for its kind, and words that speak for another sort of number.
CUES = {
    "email": "mail|e-mail|write|contact|reach|address|correo|courriel",
    "ip": "ip|host|server|address|login|from|client|connect",
    "card": "card|visa|master|amex|credit|debit|carte|karte|tarjeta|payment",
    "secret": "token|secret|key|apikey|password|passwd|pwd|auth|bearer|credential|credentials",
    "phone": "phone|tel|call|fax|mobile|cell|dial|ring|téléphone|telefon|teléfono",
}
OTHER = "order|invoice|isbn|issn|version|section|page|pages|serial|ref|no|code|total|score|date|build|figure|table"
FEATURES = ["kind", "digits", "length", "separators", "letters", "luhn", "octets", "brackets", "domain", "groups", "even", "cue", "other", "before", "after"]
_SPAN = "array<struct<s:int,e:int,v:string>>"
#: Matches of a block in running sums.
RUN = 64


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often a lambda below refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def found(text: Column, pattern: str) -> Column:
    """The matches of a pattern as an array of (start, end, match), in code points.

    Starts are running sums over blocks of ``RUN`` matches and then over the blocks, so that no long array is copied for each match.
    """
    pieces = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        s = acc["at"] + p["g"]
        e = s + F.length(p["v"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), p["v"].alias("v")))).alias("out"))

    def block(x: Column, b: Column) -> Column:
        own = F.transform(F.slice(x["matches"], b * RUN + 1, RUN), lambda v, i: F.struct(F.length(F.get(x["gaps"], b * RUN + i)).alias("g"), v.alias("v")))
        return F.aggregate(own, nothing, step)

    def begins(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(blocks, start, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def moved(x: Column) -> Column:
        shifted = lambda b, i: F.transform(b["out"], lambda c: F.struct((c["s"] + F.get(x["begins"], i)).alias("s"), (c["e"] + F.get(x["begins"], i)).alias("e"), c["v"].alias("v")))
        return F.flatten(F.transform(x["blocks"], shifted))

    def spans_of(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x["matches"]) - 1) / RUN).cast("int")), lambda b: block(x, b))
        placed = _let(blocks, lambda y: moved_of(y))
        return F.when(F.size(x["matches"]) == 0, F.array().cast(_SPAN)).otherwise(placed)

    def moved_of(blocks: Column) -> Column:
        return _let(F.struct(blocks.alias("blocks"), begins(blocks).alias("begins")), moved)

    return _let(pieces, spans_of)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _valid(kind: str):
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return {
        "email": lambda c: F.lit(True),
        "ip": lambda c: c["v"].rlike(rf"^{octet}(?:\.{octet}){{3}}$"),
        "card": lambda c: F.length(_digits(c["v"])).between(12, 19) & F.call_function("luhn_check", _digits(c["v"])),
        "phone": lambda c: F.length(_digits(c["v"])).between(9, 15),
    }[kind]


_NEEDS = {"email": "@", "phone": "+"}


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base_KIND`` arrays for its ``text``; a text without digits or @ is not searched."""
    none = F.array().cast(_SPAN)
    for kind, pattern in BASE.items():
        any_of = F.col("text").contains(_NEEDS[kind]) if kind in _NEEDS else F.col("text").rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][\x20-]?[0-9][\x20-]?[0-9]")
        docs = docs.withColumn(f"base_{kind}", F.when(any_of, F.filter(found(F.col("text"), pattern), _valid(kind))).otherwise(none))
    return docs


def cards(text: Column) -> Column:
    """The stretches of whole digit groups with 12 to 19 digits that pass Luhn, in the form of ``found``; they overlap."""

    def stretches(run: Column) -> Column:
        return F.flatten(F.flatten(F.transform(F.array(F.split(run["v"], "")), lambda chars: groups(run["s"], chars))))  # an array of one, so that the run is split once

    def groups(s: Column, chars: Column) -> Column:
        first = lambda c, i: F.when(c.between("0", "9") & ~F.coalesce(F.get(chars, i - 1).between("0", "9"), F.lit(False)), i)
        starts = F.filter(F.transform(chars, first), lambda i: i.isNotNull())
        return F.transform(starts, lambda i: begun(s + i, F.array_join(F.slice(chars, i + 1, CARD_LENGTH + 1), "")))

    def begun(s: Column, rest: Column) -> Column:
        own = F.array(*[F.regexp_extract(rest, CARD % (n - 1), 0) for n in CARD_DIGITS])
        own = F.filter(own, lambda v: (v != "") & F.call_function("luhn_check", _digits(v)))
        return F.transform(own, lambda v: F.struct(s.alias("s"), (s + F.length(v)).alias("e"), v.alias("v")))

    return F.flatten(F.transform(found(text, PROPOSED["card"]), stretches))


def _features(kind: int):
    """What makes of a match its span with its features."""
    return lambda c: _featured(c, kind)


def _featured(c: Column, kind: int) -> Column:
    name, v, text = ALL_KINDS[kind], c["v"], F.col("text")
    left = F.greatest(c["s"] - CONTEXT, F.lit(0))
    before, after = F.substr(text, left + 1, c["s"] - left), F.substr(text, c["e"] + 1, F.lit(CONTEXT))
    around = F.concat(before, F.lit(" | "), after)
    digits = _digits(v)
    numbers = {
        "kind": F.lit(kind),
        "digits": F.length(digits),
        "length": F.length(v),
        "separators": F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")),
        "letters": F.length(F.regexp_replace(v, "[^A-Za-z]", "")),
        "luhn": (F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)).cast("int"),
        "octets": F.regexp_replace(F.regexp_replace(v, r"(?i)dot|[^0-9]", "."), r"\.+", ".").rlike(r"^(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)){3}$").cast("int"),
        "brackets": v.rlike(r"[\[\]()]").cast("int"),
        "domain": v.rlike(r"(?i)[^a-z0-9](?:com|org|net|edu|gov|io|info|de|fr|es|it|uk|eu)$").cast("int"),
        "groups": F.regexp_count(v, F.lit("[0-9]+")),
        "even": v.rlike(EVEN).cast("int"),
        "cue": around.rlike(rf"(?i)(?<![a-z])(?:{CUES[name]})(?![a-z])").cast("int"),
        "other": before.rlike(rf"(?i)(?<![a-z])(?:{OTHER})(?![a-z])").cast("int"),
        "before": before.rlike(r"[A-Za-z0-9@/=._-]$").cast("int"),
        "after": after.rlike(r"^[A-Za-z0-9@/=_-]").cast("int"),
    }
    return F.struct(c["s"].alias("s"), c["e"].alias("e"), F.lit(kind).alias("k"), *[numbers[f].cast("double").alias(f) for f in FEATURES])


def candidates() -> Column:
    """The proposed spans of ``text`` with their features, for texts that have digits or a spelt-out address."""
    some = [F.transform(cards(F.col("text")) if name == "card" else found(F.col("text"), PROPOSED[name]), _features(k)) for k, name in enumerate(ALL_KINDS)]
    lower = F.lower("text")
    gates = [
        lower.contains(" dot ") | lower.contains("[dot") | lower.contains("(dot") | lower.contains(" dot)"),
        F.col("text").rlike(r"(?i)[0-9]\x20?[\[(](?:\.|dot)"),
        F.col("text").rlike(r"[0-9][\x20./_-]?[0-9][\x20./_-]?[0-9]"),
        F.col("text").rlike(r"[0-9]\)?[\x20./-]{1,2}[0-9]{2}"),
        F.col("text").rlike(r"(?i)[0-9][a-z0-9+/_-]{7}|[a-z0-9+/_-]{7}[0-9]"),
    ]
    kind = some[0]
    nothing = F.filter(kind, lambda c: F.lit(False))
    return F.concat(*[F.when(gate, c).otherwise(nothing) for gate, c in zip(gates, some, strict=True)])


def training_sentences(n: int = TRAINING_ROWS) -> list[tuple[str, int, int, int]]:
    """Sentences with one number or address each, whether it is personal data (half of them are), its start and end.

    Other numbers stand beside about half of the cards, so that the stretches that hold some of them are seen too.
    """
    draw = random.Random(9)
    digits = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(3, 9)))

    def luhn(number: str, good: bool) -> str:
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number)))
        return number + str((-total + (0 if good else draw.randint(1, 9))) % 10)

    def spelt(good: bool) -> str:
        at, dot = draw.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)")])
        end = draw.choice(["com", "org", "net", "de", "fr", "es", "io"]) if good else word()
        return f"{word()}{at}{word()}{dot}{end}" if good or draw.random() < 0.5 else f"{word()} at the dot {word()}"

    def address(good: bool) -> str:
        parts = [str(draw.randint(1, 255) if good else draw.randint(256, 999)) for _ in range(4)]
        return draw.choice(["[.]", "(.)", "[dot]"]).join(parts)

    def card(good: bool) -> str:
        number = luhn(digits(draw.choice([13, 14, 15, 15, 15])), good)
        mark = draw.choice([".", "/", "_", ". ", "", " ", "-"])
        return mark.join(number[i : i + 4] for i in range(0, len(number), 4))

    def phone(good: bool) -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return draw.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b} {c}"]) if good or draw.random() < 0.6 else "-".join(digits(draw.choice([2, 4])) for _ in range(3))

    def secret(good: bool) -> str:
        alphabet = draw.choice(["0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEF"])
        if good or draw.random() < 0.7:
            return "".join(draw.choice(alphabet) for _ in range(draw.choice([20, 24, 32, 40, 40, 64]))) + draw.choice("0123456789")
        return f"{word()}-{word()}-{word()}-{digits(2)}"

    makers = [spelt, address, card, phone]
    rows = []
    for i in range(n * len(KINDS) // len(ALL_KINDS)):
        kind, good = i % 4, i // 4 % 2 == 0
        cued = good and (kind == 3 or draw.random() < 0.6)
        cue = draw.choice(CUES[ALL_KINDS[kind]].split("|")) if cued else draw.choice(OTHER.split("|")) if not good and draw.random() < 0.5 else word()
        made, beside = makers[kind](good), random.Random(i)
        short = f"{beside.randint(1, 12):02}/{beside.randint(24, 35)}" if beside.random() < 0.5 else str(beside.randint(100, 999))
        left, right = ("", f" {short}") if kind == 2 and beside.random() < 0.3 else (f"{beside.randint(1, 99)} ", "") if kind == 2 and beside.random() < 0.3 else ("", "")
        head = f"{word()} {word()} {cue} {left}"
        rows.append((f"{head}{made}{right} {word()} {word()}.", int(good), len(head), len(head) + len(made)))
    for i in range(len(rows), n):
        good = i // 4 % 2 == 0
        cue = draw.choice(CUES["secret"].split("|")) if good else draw.choice(OTHER.split("|")) if draw.random() < 0.5 else word()
        left, right = draw.choice([(' = "', '"'), (": ", ""), ("=", ""), (" ", ""), (" = '", "'")])
        head, made = f"{word()} {word()} {cue}{left}", secret(good)
        rows.append((f"{head}{made}{right} {word()} {word()}.", int(good), len(head), len(head) + len(made)))
    return rows


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int):
    """A regression tree by exact greedy splits: a leaf's value, or (feature, threshold, left, right)."""
    g, h = gradient.sum(), hessian.sum()
    best = (1e-6, None, None)
    if depth:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, gs, hs = x[order, f], np.cumsum(gradient[order])[:-1], np.cumsum(hessian[order])[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[v[1:] == v[:-1]] = -1
            if len(gain) and gain.max() > best[0]:
                i = int(gain.argmax())
                best = (float(gain[i]), f, float((v[i] + v[i + 1]) / 2))
    if best[1] is None:
        return float(-RATE * g / (h + 1))
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[low], gradient[low], hessian[low], depth - 1), _grow(x[~low], gradient[~low], hessian[~low], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _value(tree[2], x), _value(tree[3], x))


def boost(x: np.ndarray, y: np.ndarray) -> list:
    """Gradient-boosted trees for the logistic loss."""
    trees, score = [], np.zeros(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(x, p - y, p * (1 - p), DEPTH))
        score += _value(trees[-1], x)
    return trees


def thresholds(x: np.ndarray, y: np.ndarray, score: np.ndarray) -> list[float]:
    """For each kind the least score at which held-out rows have the precision asked for; infinite if there is none."""
    out = []
    for kind in range(len(ALL_KINDS)):
        own = x[:, 0] == kind
        order = np.argsort(-score[own], kind="stable")
        s, good = score[own][order], y[own][order]
        precision = np.cumsum(good) / np.arange(1, len(s) + 1)
        ends = np.r_[s[1:] != s[:-1], True] & (precision >= PRECISION) if len(s) else np.zeros(0, bool)
        out.append(float(s[np.flatnonzero(ends)[-1]]) if ends.any() else float("inf"))
    return out


@lru_cache(maxsize=4)
def model(spark: SparkSession) -> tuple[list, list[float]]:
    """The trees and the thresholds; two thirds of the sentences train, one third calibrates."""
    rows = training_sentences()
    some = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("text")) for i, (t, *_) in enumerate(rows)]))
    frame = spark.range(1).select(some.alias("r")).select("r.*")
    scored = frame.select("i", F.explode(candidates()).alias("c")).select("i", "c.s", "c.e", *[f"c.{f}" for f in FEATURES]).collect()  # at most a few rows a sentence
    card = KINDS.index("card")
    true = lambda r: rows[r.i][1] and (r.kind != card or (r.s, r.e) == rows[r.i][2:])
    data = np.array([[r.i, true(r), *[r[f] for f in FEATURES]] for r in sorted(scored)], float)
    held = data[:, 0] // 8 % 3 == 2
    x, y = data[:, 2:], data[:, 1]
    trees = boost(x[~held], y[~held])
    score = sum(_value(t, x) for t in trees)
    ends = np.array([[r.s, r.e] for r in sorted(scored)])
    best: list[int] = []  # what would be taken of each kind: the threshold is for those
    for j in sorted(np.flatnonzero(held), key=lambda j: (-score[j], *ends[j])):
        if not any(data[o, 0] == data[j, 0] and x[o, 0] == x[j, 0] and ends[o, 0] < ends[j, 1] and ends[j, 0] < ends[o, 1] for o in best):
            best.append(j)
    return trees, thresholds(x[best], y[best], score[best])


def _tree_column(tree, c: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    return F.when(c[FEATURES[tree[0]]] <= tree[1], _tree_column(tree[2], c)).otherwise(_tree_column(tree[3], c))


def _meets(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def _of_kind(spans: str, kind: int) -> Column:
    return F.transform(spans, lambda c: F.struct(c["s"].alias("s"), F.lit(kind).alias("k"), c["e"].alias("e")))


def spans(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` as ``(doc_id, base_KIND..., base, added)``: base and added are arrays of (s, k, e), kinds by number."""
    trees, least = model(docs.sparkSession)
    rows = base_spans(docs.select("doc_id", text_or_empty().alias("text")))
    own = [_of_kind(f"base_{name}", k) for k, name in enumerate(KINDS)]
    rows = rows.withColumn("base", F.array_sort(F.concat(*own))).withColumn("proposed", candidates())
    rows = rows.withColumn("free", F.filter("proposed", lambda c: ~F.exists("base", lambda b: _meets(b, c))))
    score = lambda c: sum((_tree_column(t, c) for t in trees), F.lit(0.0))
    rows = rows.withColumn("scored", F.transform("free", lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), score(c).alias("score"))))
    limit = F.array(*[F.lit(x) for x in least])
    rows = rows.withColumn("passed", F.filter("scored", lambda c: c["score"] >= F.element_at(limit, c["k"] + 1)))
    ranked = F.array_sort(F.transform("passed", lambda c: F.struct((-c["score"]).alias("worse"), c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))
    span = lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    added = F.aggregate(ranked, none, lambda acc, c: F.when(F.exists(acc, lambda o: _meets(o, c)), acc).otherwise(F.concat(acc, F.array(span(c)))))
    return rows.select("doc_id", *[f"base_{k}" for k in KINDS], "base", added.alias("added"))


def _joined(column: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(column, lambda c: F.concat(F.element_at(names, c["k"] + 1), F.lit(":"), c["s"].cast("string"), F.lit(":"), c["e"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(read(spark, sf_dir, "documents"))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
