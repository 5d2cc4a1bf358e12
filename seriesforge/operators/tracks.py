"""Tracks of labelled candidates: votes, summaries, filters, spikes, the best candidate and held rows.

Columns are named by the caller. Duplicate clusters and matching to the frame before are in matching.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.scalars import finite
from seriesforge.operators.series import over, vector_jump


def vote(df: DataFrame, track: str, label: str, weight: Column, order: str) -> DataFrame:
    """df with majority_label, majority_weight and relabelled (1 where the row's label differs) of its track.

    Labels are compared in lower case; the largest sum of weights wins, among equals the label seen first.
    """
    named = df.withColumn("_label", F.lower(label))
    sums = named.groupBy(track, "_label").agg(F.sum(weight).alias("_w"), F.min(order).alias("_first"))
    best = sums.groupBy(track).agg(F.max_by(F.struct("_label", "_w"), F.struct("_w", -F.col("_first"))).alias("_best"))
    got = named.join(best, track).withColumn("majority_label", F.col("_best._label")).withColumn("majority_weight", F.col("_best._w"))
    return got.withColumn("relabelled", (F.col("_label") != F.col("majority_label")).cast("int")).drop("_label", "_best")


def mirror_where(df: DataFrame, wrong: Column, columns: list[str]) -> DataFrame:
    """The sign of these columns turned where the row's side was wrong."""
    return df.withColumns({c: F.when(wrong, -F.col(c)).otherwise(F.col(c)) for c in columns})


def track_summary(df: DataFrame, track: str, frame: str, label: str | None = None) -> DataFrame:
    """rows, frames (distinct), first, last and duration (last - first + 1) of each track, or of each track and label."""
    return df.groupBy(*([track] if label is None else [track, label])).agg(
        F.count("*").alias("rows"), F.countDistinct(frame).alias("frames"), F.min(frame).alias("first"), F.max(frame).alias("last")
    ).withColumn("duration", (F.col("last") - F.col("first") + 1).cast("long"))


def dominant(summary: DataFrame, side: str, rows: str, track: str) -> DataFrame:
    """The track of most rows of each side; the smallest track wins ties."""
    return summary.groupBy(side).agg(F.max_by(track, F.struct(F.col(rows), -F.col(track))).alias("dominant"))


def filter_tracks(df: DataFrame, track: str, side: str, place: list[str], depth: str, area: str, least: int = 5, relative: float = 0.30,
                  distance: float = 0.5, ratio: float = 3.0) -> DataFrame:
    """Each track with filter_reason, NULL if it stays.

    short_track: fewer than `least` rows. Others are held against the dominant track of their side, if they are
    shorter than `relative` of it: position_outlier, if the medians of their places are further apart than
    `distance`; size_outlier, if their apparent sizes (median of area / depth squared, depth over 0.1) are further apart than
    `ratio`. Places and sizes that aren't finite decide nothing.
    """
    near = [f"_{c}" for c in place]
    usable = finite(F.col(place[0])).isNotNull()
    for c in place[1:]:
        usable &= finite(F.col(c)).isNotNull()
    size = F.when((finite(F.col(depth)) > 0.1) & (finite(F.col(area)) > 0), F.col(area) / (F.col(depth) * F.col(depth)))
    per = df.groupBy(track, side).agg(
        F.count("*").alias("_n"), F.percentile(size, 0.5).alias("_size"),
        *[F.percentile(F.when(usable, F.col(c)), 0.5).alias(n) for c, n in zip(place, near, strict=True)])
    lead = per.filter(F.col(side).isNotNull()).groupBy(side).agg(F.min_by(F.struct(track, "_n", "_size", *near), F.struct(-F.col("_n"), track)).alias("_lead"))
    main = lead.select(F.col(side).alias("_side"), F.col(f"_lead.{track}").alias("_main"), F.col("_lead._n").alias("_main_n"), F.col("_lead._size").alias("_main_size"),
                       *[F.col(f"_lead.{n}").alias(f"_main{n}") for n in near])
    both = per.join(main, per[side] == main["_side"], "left")
    gap = F.sqrt(sum(((F.col(n) - F.col(f"_main{n}")) * (F.col(n) - F.col(f"_main{n}")) for n in near[1:]),
                     (F.col(near[0]) - F.col(f"_main{near[0]}")) * (F.col(near[0]) - F.col(f"_main{near[0]}"))))
    rate = F.when(F.col("_main_size") > 1e-9, F.col("_size") / F.col("_main_size"))
    judged = (F.col(track) != F.col("_main")) & (F.col("_n") < F.col("_main_n") * relative)
    reason = F.when(F.col("_n") < least, "short_track").when(judged & (gap > distance), "position_outlier").when(
        judged & ((rate > ratio) | (rate < 1 / ratio)), "size_outlier")
    return both.select(track, side, F.col("_n").alias("rows"), reason.alias("filter_reason"))


def spikes(df: DataFrame, track: str, frame: str, place: list[str], gap: int = 3, floor: float = 0.08, factor: float = 3.0) -> DataFrame:
    """spike (0 or 1) and spike_distance: single rows that jump away and back.

    Both steps exceed max(floor, factor * median step of the track) and the way past the row is under three quarters of
    that; rows further than `gap` frames from a neighbour, and the ends, are none.
    """
    w, whole = over(track, frame), Window.partitionBy(track)
    v = [finite(F.col(c)) for c in place]
    got = df.withColumn("_dp", F.col(frame) - F.lag(frame).over(w)).withColumn("_prev", vector_jump(v, w)).withColumn(
        "_next", F.lead("_prev").over(w)).withColumn("_dn", F.lead("_dp").over(w))
    ahead, behind = [F.lead(c).over(w) for c in v], [F.lag(c).over(w) for c in v]
    skip = F.sqrt(sum(((a - b) * (a - b) for a, b in zip(ahead[1:], behind[1:], strict=True)), (ahead[0] - behind[0]) * (ahead[0] - behind[0])))
    got = got.withColumn("_skip", skip).withColumn("_median", F.percentile(F.when(F.col("_dp") <= gap, F.col("_prev")), 0.5).over(whole))
    limit = F.greatest(F.lit(floor), factor * F.col("_median"))
    on = (F.col("_dp") <= gap) & (F.col("_dn") <= gap) & (F.col("_prev") > limit) & (F.col("_next") > limit) & (F.col("_skip") < 0.75 * limit)
    spike = F.coalesce(F.col("_median").isNotNull() & on, F.lit(False))
    return got.withColumn("spike", spike.cast("int")).withColumn("spike_distance", F.when(spike, F.greatest("_prev", "_next"))).drop(
        "_dp", "_prev", "_next", "_dn", "_skip", "_median")


def best_candidate(df: DataFrame, frame: str, length: str, confidence: str, candidate: str) -> DataFrame:
    """One row for each frame: of the longest track, then the surest, then the first candidate."""
    w = Window.partitionBy(frame).orderBy(F.desc(length), F.desc(confidence), candidate)
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def held_rows(df: DataFrame, key: str, frame: str, good: Column, payload: list[str], most: int) -> DataFrame:
    """payload of the last good row at most `most` frames old, hold_age, reason (ok, held, stale or none_before) and
    rank 0: rows that aren't good show it under their own frame."""
    w = over(key, frame).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(good, F.struct(F.col(frame).alias("_f"), *payload)), ignorenulls=True).over(w)
    got = df.withColumn("_last", last).withColumn("hold_age", F.col(frame) - F.col("_last._f"))
    fresh = F.col("hold_age") <= most
    reason = F.when(F.col("hold_age").isNull(), "none_before").when(F.col("hold_age") == 0, "ok").when(fresh, "held").otherwise("stale")
    return got.withColumns({c: F.when(fresh, F.col(f"_last.{c}")) for c in payload}).withColumn("reason", reason).withColumn("rank", F.lit(0)).drop("_last")
