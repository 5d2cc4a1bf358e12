"""Long series in many tasks: rows are numbered and dealt into blocks that overlap by a halo.

A window over a series keeps it in one task. Where a few series are most of the data, number their rows
(numbered), deal them into blocks of so many rows with copies of the rows beside them (with_halo), let the operator work on
blocks, and drop the copies (in_blocks). Operators that look no further than the halo give the same rows as over the whole series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, order: list[str], slot: Column, out: str = "pos") -> DataFrame:
    """df with each row's place in its series, from 1, by the order columns.

    slot: a number that doesn't fall along the order (a time divided by a length). Rows are ranked inside a key's slots; only the
    slots' counts, a row each, are added up along the key. NULL slots come first; equal rows are in any order.
    """
    inside = Window.partitionBy(key, "_slot").orderBy(*order)
    dealt = df.withColumn("_slot", F.floor(slot)).withColumn("_rank", F.row_number().over(inside))
    per = dealt.groupBy(key, "_slot").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy(F.asc_nulls_first("_slot")).rowsBetween(Window.unboundedPreceding, -1))
    starts = per.select(F.col(key).alias("_k"), F.col("_slot").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before"))
    both = dealt.join(starts, dealt[key].eqNullSafe(starts["_k"]) & dealt["_slot"].eqNullSafe(starts["_s"]))
    return both.withColumn(out, (F.col("_rank") + F.col("_before")).cast("long")).drop("_slot", "_rank", "_before", "_k", "_s")


def with_halo(df: DataFrame, key: str, pos: str, rows: int, before: int, after: int) -> DataFrame:
    """df with block (key, number) of `rows` places each and own (whether the row is the block's, not a copy).

    A block also gets copies of the `before` rows in front of it and the `after` rows behind it, even where they lie
    blocks away.
    """
    low = F.greatest(F.lit(0), F.floor((F.col(pos) - 1 - after) / rows))
    high = F.floor((F.col(pos) - 1 + before) / rows)
    got = df.withColumn("_b", F.explode(F.sequence(low, high)))
    return got.withColumn("own", F.col("_b") == F.floor((F.col(pos) - 1) / rows)).withColumn(
        "block", F.struct(F.col(key).alias("key"), F.col("_b").alias("number"))).drop("_b")


def in_blocks(df: DataFrame, key: str, pos: str, operator: Callable[[DataFrame, str, str], DataFrame], halo: int, rows: int = 100_000) -> DataFrame:
    """operator(df, block, pos) on blocks of numbered() rows, as if on whole series.

    halo: how many rows to each side the operator looks at, where its ends are special, too. A block without rows of its own is
    only a halo past the series' end and goes.
    """
    got = operator(with_halo(df, key, pos, max(rows, halo), halo, halo), "block", pos)
    return got.filter("own").drop("own", "block")
