"""URL filter: longest-prefix rules, then a list of canonical URLs behind a blocked Bloom filter.

Every URL yields its lookup keys: its own canonical form, and the root of its host and of every parent domain of two labels or more.
A key hashes to one 512-bit block of the filter and to eight bits in it. The filter has a fixed number of blocks, so its size is
bounded whatever the list holds, and it is sent to every executor. Keys that it passes go on to an exact hash join with the list,
which removes its false positives; a fuller list makes more of those but changes no result.

Canonical form: lower-case host without ``www.`` and without a final dot, then the path without final slashes, then ``/``;
query and fragment do not count.

Defined results: a null URL or one without ``://`` has host and path ``''``, no rule and the verdict ``allow``; repeated rows are each judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm._common import read

#: Blocks of 512 bits (a power of two): 4 MiB, which is the bound on what is broadcast.
BLOCKS = 1 << 16
#: Bits that a key sets in its block.
PROBES = 8
#: (host, path, verdict); the rules are a short configured list.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: The production list of blocked canonical URLs; a host root blocks the whole host.
LISTED = [
    "ads-track.example.com/", "ads-track.example.net/", "ads-track.example.org/",
    "adult-x.example.com/", "adult-x.example.net/", "adult-x.example.org/",
    "casino-win.example.com/", "casino-win.example.net/", "casino-win.example.org/",
    "cheap-pills.example.com/", "cheap-pills.example.net/", "cheap-pills.example.org/",
    "free-bets.example.com/", "free-bets.example.net/", "free-bets.example.org/",
    "spam-farm.example.com/", "spam-farm.example.net/", "spam-farm.example.org/",
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: str) -> dict[str, Column]:
    at = F.expr(f"coalesce(instr({url}, '://'), 0)")
    rest = F.when(at > 0, F.expr(f"substr({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return {"host": F.translate(host, _UPPER, _LOWER), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}


def _keys() -> Column:
    """The lookup keys of ``host`` and ``path``; none without a host."""
    host = F.regexp_replace(F.regexp_replace("host", r"^www\.", ""), r"\.$", "")
    labels = F.split(host, r"\.")
    roots = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")))
    own = F.concat(host, F.regexp_replace("path", r"/+$", ""), F.lit("/"))
    return F.when(host != "", F.array_distinct(F.concat(F.array(own), roots)))


def _block(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BLOCKS)).cast("int")


def _masks(key: str) -> list[Column]:
    """The eight 64-bit words of a key's mask: one bit in each, taken from six bits of a second hash."""
    spread = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", spread, F.lit(6 * i)).bitwiseAND(F.lit(63)).cast("int")) for i in range(PROBES)]


def bloom_filter(listed: DataFrame) -> DataFrame:
    """``(block, w0..w7)`` of ``listed(key)``: at most BLOCKS rows."""
    masks = listed.select(_block("key").alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks("key"))])
    return masks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(PROBES)])


def listed_urls(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """The distinct ``(host, path)`` of ``urls`` that ``listed(key)`` holds, exactly."""
    listed = listed.filter("key is not null").distinct()
    keys = urls.select("host", "path").distinct().select("host", "path", F.explode(_keys()).alias("key"))
    tested = keys.withColumn("block", _block("key")).join(F.broadcast(bloom_filter(listed)), "block")
    for i, mask in enumerate(_masks("key")):
        tested = tested.filter(F.col(f"w{i}").bitwiseAND(mask) != 0)
    return tested.select("host", "path", "key").join(listed, "key", "left_semi").select("host", "path").distinct()


def _rule(rules: list[tuple[str, str, str]]) -> Column:
    """The rule that fits with the longest host and path, as a struct."""
    longest_first = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for host, path, verdict in reversed(longest_first):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id, url, ...)``."""
    urls = pages.select("page_id", *[c.alias(n) for n, c in parts("url").items()]).withColumn("fit", _rule(rules))
    hits = listed_urls(urls.filter("fit is null and host <> ''"), listed).withColumn("hit", F.lit(True))
    verdict = F.when(F.col("fit").isNotNull(), F.col("fit.verdict")).when(F.col("hit"), "block").otherwise("allow")
    return urls.join(hits, ["host", "path"], "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in LISTED])).alias("key"))
    return judge(read(spark, sf_dir, "pages"), RULES, listed)


ORACLE_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
listed(key) AS (VALUES {", ".join(f"('{x}')" for x in LISTED)}),
fit AS (
  SELECT host, path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM (SELECT DISTINCT host, path FROM u) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
plain AS (SELECT DISTINCT host, path, regexp_replace(regexp_replace(host, '^www\\.', ''), '\\.$', '') AS bare FROM u WHERE host <> ''),
hit AS (
  SELECT DISTINCT host, path FROM plain JOIN listed
  ON key = bare || regexp_replace(path, '/+$', '') || '/' OR bare || '/' = key OR ends_with(bare || '/', '.' || key))
SELECT u.page_id, u.host, u.path, fit.rule, CASE WHEN fit.rule IS NOT NULL THEN fit.v WHEN hit.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN fit USING (host, path) LEFT JOIN hit USING (host, path)
"""
