"""Quality rules as a bitmask ledger.

Every rule is evaluated once over the whole text. The ledger keeps the measurements and one failure bit a rule; versioned policies
are masks over those bits, so a changed policy, or an ablation, reads the ledger and no text. Ablations come from one aggregation
over the distinct bit patterns, of which there are at most 2 ** len(RULES).

Words are maximal runs of anything but ASCII white space. Defined results: a null, empty or blank text has no words, fails
``few_words`` and nothing else; repeated rows and ids are each measured.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm._common import read

SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Rule to the predicate under which it fails; a rule's bit is its place here, so rules are only ever added at the end.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 40 * n_lines",
    "short_words": "n_words > 0 and word_chars < 3 * n_words",
    "long_words": "n_words > 0 and word_chars > 10 * n_words",
}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(rule) for rule in self.rules)


#: Base rules only, then the rules of the base with those of form.
POLICIES = {
    p.version: p
    for p in (
        Policy("base", ("few_words", "repeated_words")),
        Policy("v1", ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words")),
    )
}
CURRENT = "v1"


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The MEASURES of one whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    repeated = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < n - 2:
            seen, twice = set(), set()
            for w in windows:
                (twice if w in seen else seen).add(w)
            until = 0
            for i, w in enumerate(windows):
                if w in twice:
                    repeated += i + 3 - max(i, until)
                    until = i + 3
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeated


def _measured(kept: list[int]):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            columns = list(zip(*map(measure, texts), strict=True)) if texts else [[] for _ in MEASURES]
            arrays = [batch.column(i) for i in kept] + [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, [*[batch.schema.names[i] for i in kept], *MEASURES])

    return run


def failed_bits() -> Column:
    return sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())), F.lit(0)).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """``(doc_id, measurements..., failed_bits)`` for every row of ``docs(doc_id, text, ...)``."""
    schema = ", ".join(["doc_id long", *[f"{m} long" for m in MEASURES]])
    return docs.select("doc_id", "text").mapInArrow(_measured([0]), schema).withColumn("failed_bits", failed_bits())


def passes(policy: Policy) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy over a ledger: rows that fail it, rows that only it rejects, and rows kept without it."""
    patterns = rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(rule).alias("rule"), F.lit(1 << list(RULES).index(rule)).alias("bit")) for rule in policy.rules]
    bits = F.col("failed_bits").bitwiseAND(F.lit(policy.mask))
    each = patterns.select("n", bits.alias("bits"), F.inline(F.array(*rules)))
    without = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(total(failed).alias("failed"), total(failed & without).alias("only"), total(without).alias("kept_without"))


def kept_documents(docs: DataFrame, policy: Policy | None = None) -> DataFrame:
    """The rows of ``docs`` that pass a policy, with their columns."""
    policy = policy or POLICIES[CURRENT]
    names = docs.columns
    fields = [f.name for f in docs.schema]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(fields)], F.col("text").alias("text"))
    schema = ", ".join([*[f"c{i} {docs.schema[i].dataType.simpleString()}" for i in range(len(fields))], *[f"{m} long" for m in MEASURES]])
    rows = inner.mapInArrow(_measured(list(range(len(fields)))), schema).withColumn("failed_bits", failed_bits())
    return rows.filter(passes(policy)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(POLICIES["base"])).alias("base_failed"), passes(POLICIES[CURRENT]).alias("kept"), "failed_bits", F.lit(CURRENT).alias("policy")
    )


_FAILS = list(RULES.values())
ORACLE_SQL = f"""
WITH words AS (
  SELECT rowid AS r, doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
tri AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) > 2)),
twice AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY r),
lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM words)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
f AS (SELECT *, ({" + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(_FAILS))})::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits & {POLICIES["base"].mask}) <> 0 AS base_failed, (failed_bits & {POLICIES[CURRENT].mask}) = 0 AS kept, failed_bits, '{CURRENT}' AS policy
FROM f
"""
