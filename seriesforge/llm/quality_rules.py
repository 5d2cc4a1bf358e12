"""Quality rules: a threshold table compiled into one projection, in the JVM only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm.common import SPACE, WORD

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is for that it was with on by as be this at "
    "de la le et les des en un du une que pour est dans qui au par sur pas "
    "der die und den von zu das sich mit auf für ist nicht im dem ein eine "
    "el y los las se del por con no su para es al"
).split()


@dataclass(frozen=True)
class Rule:
    """The ratio must lie in [low, high]; the ratio is an SQL expression over the base columns."""

    name: str
    ratio: str
    low: float = float("-inf")
    high: float = float("inf")


#: The thresholds. Ratios are taken against at least 1, so empty texts divide by no zero.
RULES = (
    Rule("mean_word_length", "word_chars / greatest(n_words, 1)", 2.0, 25.0),
    Rule("symbols_per_word", "n_symbols / greatest(n_words, 1)", high=0.25),
    Rule("stop_word_share", "n_stop_words / greatest(n_words, 1)", low=0.01),
    Rule("repeated_line_share", "n_dup_lines / greatest(n_lines, 1)", high=0.6),
)

#: Words in 3-word windows that occur twice or more. Each transform(array(x), ...) binds x to
#: a name, so that it is computed once and not once for every element. A window is a long: the
#: upper bits of its hash, and its position in as many lower bits as the text needs. Sorting
#: brings likely repeats side by side; only those are compared by their words.
REPEATED = """
IF(size(w) < 4, 0L, element_at(transform(array(cast(ceil(log2(size(w))) AS int)), b ->
  element_at(transform(array(sort_array(transform(sequence(0, greatest(size(w) - 3, 0)),
      i -> shiftleft(shiftrightunsigned(xxhash64(w[i], w[i + 1], w[i + 2]), b), b) | i))), s ->
    element_at(transform(array(transform(filter(s, (x, i) ->
        coalesce(shiftrightunsigned(get(s, i - 1) ^ x, b) = 0, false)
        OR coalesce(shiftrightunsigned(get(s, i + 1) ^ x, b) = 0, false)),
        x -> cast(x & (shiftleft(1L, b) - 1) AS int))), likely -> IF(size(likely) = 0, 0L,
      element_at(transform(array(sort_array(transform(likely,
          i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g, i AS i)))), s3 ->
        element_at(transform(array(sort_array(transform(filter(s3, (x, i) ->
            coalesce(get(s3, i - 1).g = x.g, false) OR coalesce(get(s3, i + 1).g = x.g, false)),
            x -> x.i))), p ->
          aggregate(p, struct(0L AS n, -3 AS last),
            (a, x) -> struct(a.n + least(3, x - a.last) AS n, x AS last), a -> a.n)), 1)), 1))), 1)), 1)), 1))
"""


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id with the base counts of every whole text; all other columns are left out.

    Null text counts as empty: all counts 0. Lines count once they hold a word.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select(
        F.col("doc_id"),
        text.alias("t"),
        F.array_remove(F.split(text, SPACE), "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    listed = ", ".join(f"'{x}'" for x in STOP_WORDS)
    return cut.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"size(filter(w, x -> x IN ({listed})))").cast("long").alias("n_stop_words"),
        F.expr(REPEATED).alias("n_repeat_words"),
    )


def compile_rules(rules: tuple[Rule, ...]) -> list[F.Column]:
    """One column per rule with its ratio, and `failed`, the names of the rules that don't hold."""
    ratios = [F.expr(r.ratio).alias(r.name) for r in rules]
    failed = [
        F.when(~F.expr(f"({r.ratio}) BETWEEN {_number(r.low)} AND {_number(r.high)}"), F.lit(r.name)) for r in rules
    ]
    return [*ratios, F.array_compact(F.array(*failed)).alias("failed")]


def _number(x: float) -> str:
    return f"double('{x}')"


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Judge every text: base counts, base_failed, ratios, failed rules and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows.
    Null and empty texts have no words and so fail. One row per row of docs, repeated rows
    included; an empty table gives none. Extra columns are not carried and can't clash.
    """
    judged = base_measures(docs).withColumn(
        "base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    ).select("*", *compile_rules(rules))
    return judged.withColumn("kept", F.expr("NOT base_failed AND size(failed) = 0"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are; repeated rows are judged each.

    The whole row travels with its verdict through one projection, so nothing is joined or shuffled.
    Null and empty texts go, as they hold no 50 words; rows with a null doc_id stay if their text is good.
    A filter on verdicts would be pushed below the projection that splits the text, and the split then
    made anew for every element of the window expression; the partition's number, which the filter also
    reads, keeps it above (Spark pushes nothing through a projection that is not deterministic).
    """
    if not docs.columns:
        return docs
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc_id"), docs["text"].alias("text"))
    judged = quality_rules(whole, rules).select("doc_id", "kept", F.spark_partition_id().alias("part"))
    return judged.filter("kept AND part >= 0").select([F.col("doc_id").getField(c).alias(c) for c in docs.columns])
