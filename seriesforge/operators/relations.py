"""Joins, filters, samples and set operations on rows of frames and candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.scalars import finite
from seriesforge.operators.series import over


def with_missing(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """df with the columns that it lacks, at their defaults."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns}) if defaults else df


def frame_range(df: DataFrame, frame: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of frames from first to last, both included; None is no bound."""
    low = F.lit(True) if first is None else F.col(frame) >= first
    return df.filter(low & (F.lit(True) if last is None else F.col(frame) <= last))


def active_segment(df: DataFrame, key: str, frame: str, active: Column, trim: int) -> DataFrame:
    """Rows from `trim` frames after a key's first active one to `trim` before its last; ValueError if none are left."""
    whole = Window.partitionBy(key)
    got = df.withColumn("_lo", F.min(F.when(active, F.col(frame))).over(whole) + trim).withColumn(
        "_hi", F.max(F.when(active, F.col(frame))).over(whole) - trim).filter(F.col(frame).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    if got.isEmpty():
        raise ValueError("no rows in the active segment")
    return got


def valid_landmarks(df: DataFrame, valid: str, landmark: str, count: int = 21) -> DataFrame:
    """Rows not marked 0 or false, of landmarks 0 .. count - 1. A missing mark counts as valid."""
    mark = F.coalesce(F.lower(F.trim(F.col(valid).cast("string"))), F.lit(""))
    return df.filter(~mark.isin("0", "false") & F.col(landmark).between(0, count - 1))


def complete_groups(df: DataFrame, keys: list[str], box: list[str], landmark: str, least: int = 10) -> DataFrame:
    """Rows of the groups whose box is finite and that have at least `least` landmarks."""
    whole = Window.partitionBy(*keys)
    good = F.lit(True)
    for c in box:
        good &= finite(F.col(c)).isNotNull()
    got = df.withColumn("_good", F.min(good.cast("int")).over(whole)).withColumn("_n", F.size(F.collect_set(landmark).over(whole)))
    return got.filter((F.col("_good") == 1) & (F.col("_n") >= least)).drop("_good", "_n")


def group_pairs(df: DataFrame, keys: list[str], candidate: str, payload: list[str], measure: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """keys, a, b and measure(a, b) for the pairs a < b of each group's candidates, from one exchange: groups are
    frames of a few candidates, listed and paired in place."""
    listed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(candidate).alias("c"), F.struct(*payload).alias("p")))).alias("_all"))
    pairs = listed.withColumn("_a", F.explode("_all")).withColumn("_b", F.explode(F.filter("_all", lambda x: x["c"] > F.col("_a.c"))))
    return pairs.select(*keys, F.col("_a.c").alias("a"), F.col("_b.c").alias("b"), measure(F.col("_a.p"), F.col("_b.p")).alias(out))


def common_keys(tables: list[DataFrame], key: str, place: str = "place", parts: int = 1024) -> DataFrame:
    """Inner join of tables on an integer key that each has once, with the key's place among the common ones, from 0.

    Places are counted in `parts` equal ranges of the key, side by side; only one count for each range meets in one task.
    """
    joined = tables[0]
    for t in tables[1:]:
        joined = joined.join(t, key)
    span = tables[0].agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, wide = span["lo"] or 0, ((span["hi"] or 0) - (span["lo"] or 0)) // parts + 1
    dealt = joined.withColumn("_part", F.floor((F.col(key) - lo) / wide))
    per = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(per.select("_part", before.alias("_before")))  # `parts` rows at most
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return dealt.withColumn("_rank", rank).join(offsets, "_part").withColumn(place, (F.col("_rank") + F.col("_before")).cast("int")).drop(
        "_part", "_rank", "_before")


def join_or_position(left: DataFrame, right: DataFrame, keys: list[str], place: str, payload: list[str]) -> DataFrame:
    """left with right's payload by its keys; rows without a match take right's row of the same place, if there is
    one. matched: key, position or none. right has each key and each place once."""
    by_key = right.select(*keys, F.struct(*payload).alias("_key"))
    by_place = right.select(F.col(place).alias("_place"), F.struct(*payload).alias("_pos"))
    got = left.join(by_key, keys, "left").join(by_place, F.col(place) == F.col("_place"), "left")
    how = F.when(F.col("_key").isNotNull(), "key").when(F.col("_pos").isNotNull(), "position").otherwise("none")
    return got.withColumns({c: F.coalesce(F.col(f"_key.{c}"), F.col(f"_pos.{c}")) for c in payload}).withColumn("matched", how).drop("_key", "_pos", "_place")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], payload: dict[str, object], status: str | None = None, missing: str = "missing") -> DataFrame:
    """left with right's payload by keys, its defaults where there is none; and status: ok or `missing`."""
    got = left.join(right.select(*keys, *payload, F.lit(True).alias("_here")), keys, "left")
    got = got.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in payload.items()})
    return (got.withColumn(status, F.when(F.col("_here"), "ok").otherwise(missing)) if status else got).drop("_here")


def joined_in_place(left: DataFrame, right: DataFrame, place: str) -> DataFrame:
    """left and right row by row, by a place column that counts both from 0; ValueError if their numbers of rows differ."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} rows against {b}")
    return left.join(right, place)


def in_phases(samples: DataFrame, phases: DataFrame, key: str, position: str, name: str, default: str = "unknown") -> DataFrame:
    """Each sample with the name of the phase (key, first, last, name) that holds it; phases of a key don't overlap. A
    sample takes the latest phase that begins at or before it, if it hasn't ended: one ordered pass, no range join."""
    starts = phases.select(key, F.col("first").alias(position), F.struct(F.col("last").alias("l"), F.col(name).alias("n")).alias("_phase"), F.lit(0).alias("_kind"))
    rows = samples.withColumn("_phase", F.lit(None).cast(starts.schema["_phase"].dataType)).withColumn("_kind", F.lit(1))
    both = rows.unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(position, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_now", F.last("_phase", ignorenulls=True).over(w)).filter("_kind = 1")
    return got.withColumn(name, F.when(F.col(position) <= F.col("_now.l"), F.col("_now.n")).otherwise(default)).drop("_phase", "_kind", "_now")


def painted_phases(samples: DataFrame, phases: DataFrame, key: str, position: str, name: str, order: str, default: str = "unknown") -> DataFrame:
    """Each sample with the name of the phase (key, first, last, name) that holds it; where several do, the one of the
    greatest `order`, as if painted one over another. Positions are whole numbers; phases that end before they begin hold nothing.

    Every phase is cut into blocks of powers of two (two for each length at most), and a sample asks for the block of
    each length that its key has around it: equi joins, whatever overlaps. Samples without a phase, key or position get the default.
    """
    lo, hi = F.col("first").cast("long"), F.col("last").cast("long") + 1
    ranges = phases.filter(lo < hi).select(key, lo.alias("_lo"), hi.alias("_hi"), F.struct(F.col(order).alias("o"), F.col(name).alias("n")).alias("_p"))
    levels = ranges.withColumn("_level", F.explode(F.sequence(F.lit(0), F.ceil(F.log2((F.col("_hi") - F.col("_lo")).cast("double"))).cast("int"))))
    ends = levels.withColumn("_a", F.ceil(F.col("_lo") / F.expr("shiftleft(1L, _level)"))).withColumn("_b", F.floor(F.col("_hi") / F.expr("shiftleft(1L, _level)")))
    odd = lambda c: F.pmod(F.col(c), F.lit(2)) == 1
    inside = F.col("_a") < F.col("_b")
    cut = ends.withColumn("_block", F.explode(F.array_compact(F.array(F.when(inside & odd("_a"), F.col("_a")), F.when(inside & odd("_b"), F.col("_b") - 1)))))
    blocks = cut.groupBy(key, "_level", "_block").agg(F.max("_p").alias("_p"))
    asked = samples.select(key, F.col(position).cast("long").alias("_at")).distinct().join(blocks.groupBy(key).agg(F.collect_set("_level").alias("_levels")), key)
    found = asked.withColumn("_level", F.explode("_levels")).withColumn("_block", F.expr("shiftright(_at, _level)")).join(
        blocks, [key, "_level", "_block"]).groupBy(F.col(key).alias("_k"), "_at").agg(F.max("_p").alias("_p"))
    got = samples.join(found, (samples[key] == found["_k"]) & (samples[position].cast("long") == found["_at"]), "left")
    return got.withColumn(name, F.coalesce(F.col("_p.n"), F.lit(default))).drop("_k", "_at", "_p")


def near_rows(df: DataFrame, key: str, position: str, on: Column, reach: int, out: str = "neighbour") -> DataFrame:
    """1 for rows that aren't on but have one that is within `reach` positions of the same key."""
    flag = F.coalesce(on, F.lit(False)).cast("int")
    near = F.max(flag).over(Window.partitionBy(key).orderBy(position).rangeBetween(-reach, reach))
    return df.withColumn(out, ((near == 1) & (flag == 0)).cast("int"))


def with_context(df: DataFrame, key: str, frame: str, reach: int) -> DataFrame:
    """The distinct frames within `reach` of df's, from 0 on, for each key."""
    lo = F.greatest(F.col(frame).cast("long") - reach, F.lit(0))
    return df.select(key, F.explode(F.sequence(lo, F.col(frame).cast("long") + reach)).alias(frame)).distinct()


def stage_change(one: DataFrame, two: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """keys, before, after and change of a metric that both stages have for a row."""
    a = one.select(*keys, finite(F.col(metric)).alias("before"))
    b = two.select(*keys, finite(F.col(metric)).alias("after"))
    return a.join(b, keys).withColumn("change", F.col("after") - F.col("before"))


def worst_groups(df: DataFrame, group: str, metric: str, n: int) -> DataFrame:
    """The n groups of the greatest finite metric; the smaller group wins ties."""
    worst = df.groupBy(group).agg(F.max(finite(F.col(metric))).alias("worst")).filter("worst IS NOT NULL")
    return worst.orderBy(F.desc("worst"), group).limit(n)


def worst_rows(df: DataFrame, metric: str, tie: str, n: int) -> DataFrame:
    """The n rows of the greatest finite metric."""
    return df.filter(finite(F.col(metric)).isNotNull()).orderBy(F.desc(metric), tie).limit(n)


def first_groups(df: DataFrame, group: str, n: int) -> DataFrame:
    """Rows of the n least groups."""
    return df.join(F.broadcast(df.select(group).distinct().orderBy(group).limit(n)), group)  # n rows


def top_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_place") <= n).drop("_place")


def even_sample(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """k rows of each series at evenly spaced places, rounded half to even; all rows if there are fewer."""
    got = df.withColumn("_p", F.row_number().over(over(key, order)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    spots = f"transform(sequence(0, {k - 1}), i -> cast(bround(i * (_n - 1) / {float(k - 1)}D, 0) AS int))" if k > 1 else "array(0)"
    return got.filter(F.expr(f"array_contains({spots}, _p)")).drop("_p", "_n")


def stride_sample(df: DataFrame, frame: str, stride: int) -> DataFrame:
    return df.filter(F.col(frame) % stride == 0)


def best_start(df: DataFrame, key: str, frame: str, score: Column) -> DataFrame:
    """The frame of the best score of each key; the earliest wins ties."""
    return df.groupBy(key).agg(F.max_by(frame, F.struct(score, -F.col(frame))).alias("best"), F.max(score).alias("score"))


def complement(samples: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    return samples.join(covered.select(*keys), keys, "left_anti")


def joined_rows(observed: DataFrame, filled: DataFrame, source: str = "source") -> DataFrame:
    """Both tables' rows with where they come from; columns that one lacks are NULL."""
    return observed.withColumn(source, F.lit("observed")).unionByName(filled.withColumn(source, F.lit("filled")), allowMissingColumns=True)
