"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import join_split

# The rules of the query (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: A filter of at most this many bytes is sent to all executors; a larger one is joined by block.
FILTER_BYTES = 8 << 20
BLOCK_BITS, BITS_PER_KEY, HASHES = 64, 16, 4


def canonical(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path of a url.

    Host: after the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased. Path: from there up
    to `?`, `#` or end. Null urls and urls without `://`: both empty.
    """
    part = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    safe = F.coalesce(url, F.lit(""))
    return _lower(F.regexp_extract(safe, part, 1)), F.regexp_extract(safe, part, 2)


def _lower(host: F.Column) -> F.Column:
    """A-Z only, for pages and rules alike."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, bits): one 64-bit word per block, with HASHES bits set for each key in it; repeated keys change
    nothing, and an empty list gives no blocks."""
    return listed.select(
        _block("key", n_blocks).alias("block"), _mask("key").alias("mask")
    ).groupBy("block").agg(F.bit_or("mask").alias("bits"))


def _block(key: str, n_blocks: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n_blocks)).cast("long")


def _mask(key: str) -> F.Column:
    """HASHES bits of a second, independent hash, six bits of it for each."""
    h = f"xxhash64(17L, {key})"
    return F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned({h}, {6 * j}) & 63 AS int))" for j in range(HASHES)))


def url_filter(pages: DataFrame, listed: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """host, path, rule and verdict for every page.

    listed(verdict, host, path): a rule fits its host and all subdomains if the url's path starts
    with the rule's path; the longest wins (by the whole rule, then by host). Pages that no rule
    fits are allowed. Every suffix of a page's host at a dot, with every path prefix that is as
    long as some rule's path, is a key; keys that the Bloom filter passes go to an exact join.

    A null or odd url has an empty host and path, fits no rule and is allowed. Repeated rules count
    once (block wins over allow for the same key). Pages may repeat a page_id or an url: rows are
    told apart by page_id and url. An empty list allows everything. Extra columns don't matter.
    The list must have a bounded number of distinct path lengths (those of its rules).
    """
    host, path = canonical(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = listed.select(
        "verdict", _lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"),
    ).withColumn("key", F.concat_ws("", "rule_host", "rule_path")).withColumn(
        "host_length", F.length("rule_host")
    ).groupBy("key", "rule_host", "rule_path", "host_length").agg(F.max("verdict").alias("verdict"))
    facts = rules.agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths")
    ).first()
    n_blocks = max(1, math.ceil(facts["n"] * BITS_PER_KEY / BLOCK_BITS))
    lengths = facts["lengths"] or [0]

    # Only distinct (host, path heads) go further: one host may hold a third of all pages.
    longest = max(lengths)
    heads = parts.select("host", F.substring("path", 1, longest).alias("head"))
    todo = heads.filter("host <> ''").groupBy("host", "head").agg(F.count("*").alias("pages"))
    keys = todo.withColumn("labels", F.split("host", r"\.")).withColumn(
        "suffix", F.explode(F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))"))
    ).withColumn("length", F.explode(F.array(*[F.lit(x) for x in lengths]))).filter(
        F.length("head") >= F.col("length")
    ).select("host", "head", "pages", "suffix", F.expr("substring(head, 1, length)").alias("prefix")).withColumn(
        "key", F.concat("suffix", "prefix")
    ).withColumn("block", _block("key", n_blocks)).withColumn("mask", _mask("key"))

    words = bloom(rules, n_blocks)
    if n_blocks * 16 <= filter_bytes:
        words = F.broadcast(words)  # n_blocks rows of 16 bytes at most
    possible = keys.join(words, "block").filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    hits = possible.join(
        rules.select("key", "rule_host", "rule_path", "verdict"),
        (possible["key"] == rules["key"]) & (F.col("suffix") == F.col("rule_host")) & (F.col("prefix") == F.col("rule_path")),
    ).groupBy("host", "head", "pages").agg(
        F.max_by(
            F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"),
            F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host")),
        ).alias("best")
    )
    judged = join_split(parts.withColumn("head", F.substring("path", 1, longest)), hits, ["host", "head"], "pages", pages.count(), "left")
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict"),
    )


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS t(verdict, host, path)")
