"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesforge.llm import codebooks, exact_copies, jaccard, media, mixing, ordering, packing, passages, quality_rules, substrings, url_filter, weak_labels, whitening
from seriesforge.llm.common import documents, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document. Nulls, repeats and empty tables as in quality_rules()."""
    return quality_rules.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, posterior, scores and verdict of every document; toxicity learned from labels. Odd input as in classify()."""
    return weak_labels.classify(documents(spark, sf_dir), labels=table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the packed token sequences of all documents. Odd input as in pack()."""
    return packing.pack(documents(spark, sf_dir))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page. Odd input as in url_filter()."""
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.default_rules(spark))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed as repeats of 20-word windows. Odd input as in remove_passages()."""
    return passages.remove_passages(documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document. Odd input as in jaccard_components()."""
    return jaccard.jaccard_components(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the mix takes of every document. Odd input as in mix_documents()."""
    return mixing.mix_documents(documents(spark, sf_dir))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot, shard and digest of every token sequence, read back from the shards. Odd input as in in_training_order()."""
    return ordering.slot_digests(documents(spark, sf_dir))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed as repeats of 50-byte strings. Odd input as in remove_substrings()."""
    return substrings.remove_substrings(documents(spark, sf_dir))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from every document's FLAC stream. Odd input as in encode_media()."""
    return media.media_digests(documents(spark, sf_dir))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every embedding. Odd input as in whitened()."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every embedding by 8 codebooks of 16 entries. Odd input as in compressed()."""
    return codebooks.compressed(table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal texts stays, for every document. Odd input as in exact_dedup()."""
    return exact_copies.exact_dedup(spark, f"{sf_dir}/documents.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_quality_classifier, op3_packing, op4_url_filter, op5_substring_dedup, op6_jaccard_join, op7_mixing,
        op8_training_order, op9_suffix_array_dedup, op10_media_columns, op11_embedding_whitening, op12_vector_codes, op13_exact_dedup,
    )
}

_STOP = ", ".join(f"'{x}'" for x in quality_rules.STOP_WORDS)

OP1_SQL = rf"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM cut WHERE len(w) >= 3),
named AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM grams),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM named),
marked AS (SELECT DISTINCT doc_id, i + d.d AS p FROM often, (VALUES (0), (1), (2)) AS d(d) WHERE n >= 2),
repeated AS (SELECT doc_id, count(*) AS n FROM marked GROUP BY doc_id),
base AS (
  SELECT cut.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop_words, coalesce(r.n, 0) AS n_repeat_words
  FROM cut LEFT JOIN repeated r ON cut.doc_id = r.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 25 AND n_symbols / greatest(n_words, 1) <= 0.25
         AND n_stop_words / greatest(n_words, 1) >= 0.01 AND n_dup_lines / greatest(n_lines, 1) <= 0.6 AS kept
FROM base
"""

_RULES = ", ".join(str(x) for x in url_filter.RULES)

OP4_SQL = rf"""
WITH rules(verdict, host, path) AS (VALUES {_RULES}),
parts AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
low AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
best AS (
  SELECT l.page_id, l.host, l.path, arg_max({{'rule': r.host || r.path, 'verdict': r.verdict}}, length(r.host || r.path)) AS b
  FROM (SELECT DISTINCT * FROM low) l JOIN rules r
    ON ('.' || l.host) LIKE ('%.' || r.host) AND starts_with(l.path, r.path)
  GROUP BY ALL)
SELECT low.page_id, low.host, low.path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM low LEFT JOIN best ON low.page_id = best.page_id AND low.host = best.host AND low.path = best.path
"""

_BELOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13_SQL = f"""
WITH low AS (SELECT doc_id, {_BELOW} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM low
"""


def _codes_sql() -> str:
    """Lloyd's rounds, one after another. A part and an entry are lists of integers."""
    parts, entries, width, rounds = codebooks.PARTS, codebooks.ENTRIES, 8, codebooks.ROUNDS
    text = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({codebooks.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (
  SELECT vec_id, label, p, v[p * {width} + 1 : p * {width} + {width}] AS x FROM kept, range({parts}) AS r(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM kept ORDER BY vec_id LIMIT {entries}),
b0 AS (SELECT p, c, x AS e FROM part JOIN first USING (vec_id))"""
    for i in range(rounds + 1):
        text += f""",
d{i} AS (
  SELECT vec_id, p, c, list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM part JOIN b{i} USING (p)),
a{i} AS (SELECT vec_id, p, min(d) AS d, arg_min(c, d * {entries} + c) AS c FROM d{i} GROUP BY vec_id, p)"""
        if i < rounds:
            text += f""",
s{i} AS (
  SELECT p, c, i, sum(x[i])::BIGINT AS s, count(*) AS n
  FROM a{i} JOIN part USING (vec_id, p), range(1, {width} + 1) AS r(i) GROUP BY p, c, i),
m{i} AS (SELECT p, c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM s{i} GROUP BY p, c),
b{i + 1} AS (SELECT b{i}.p, b{i}.c, coalesce(m{i}.e, b{i}.e) AS e FROM b{i} LEFT JOIN m{i} ON b{i}.p = m{i}.p AND b{i}.c = m{i}.c)"""
    return text + f""",
code AS (
  SELECT vec_id, string_agg(printf('%02x', c), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT kept.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, c)) FROM b{rounds}) AS codebooks_sha256
FROM kept JOIN code USING (vec_id)
"""


ORACLES: dict[str, str] = {
    "op1_quality_rules": OP1_SQL, "op4_url_filter": OP4_SQL, "op12_vector_codes": _codes_sql(), "op13_exact_dedup": OP13_SQL,
}
