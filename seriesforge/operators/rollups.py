"""Roll-ups of stages and solvers, one grouped pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.scalars import finite
from seriesforge.operators.estimators import RELIABLE
from seriesforge.operators.series import stats


def track_quality(df: DataFrame, keys: list[str], frame: str, measures: list[str]) -> DataFrame:
    """rows, first and last frame of each track, and of the sizes of each measure the median, 95th percentile and maximum. What isn't finite is left out."""
    got = [F.count("*").alias("rows"), F.min(frame).alias("first"), F.max(frame).alias("last")]
    for m in measures:
        size = F.abs(finite(F.col(m)))
        got += [F.percentile(size, 0.5).alias(f"{m}_median"), F.percentile(size, 0.95).alias(f"{m}_p95"), F.max(size).alias(f"{m}_max")]
    return df.groupBy(*keys).agg(*got)


def detected_stats(df: DataFrame, keys: list[str], metric: str, infilled: str, size: str, most: float = 900.0) -> DataFrame:
    """stats() of a metric over the rows that were detected: not filled in, and not larger than `most` pixels. Rows without a size count as
    detected; without a mark as not filled in."""
    seen = ~F.coalesce(F.col(infilled).cast("int") > 0, F.lit(False)) & ~F.coalesce(finite(F.col(size)) > most, F.lit(False))
    return stats(df.filter(seen), keys, metric)


def solver_rollup(df: DataFrame, keys: list[str], success: str, normal: str, relaxed: str, errors: list[str]) -> DataFrame:
    """rows, solved, normal, relaxed (solved, but not the normal way), failed, and of each error the median and maximum over solved rows."""
    on = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    n = lambda c: F.sum(c.cast("long"))
    got = [F.count("*").alias("rows"), n(on(success)).alias("solved"), n(on(success) & on(normal)).alias("normal"), n(on(success) & ~on(normal) & on(relaxed)).alias("relaxed"),
           n(~on(success)).alias("failed")]
    for e in errors:
        v = F.when(on(success), finite(F.col(e)))
        got += [F.percentile(v, 0.5).alias(f"{e}_median"), F.max(v).alias(f"{e}_max")]
    return df.groupBy(*keys).agg(*got)


def solver_payload(df: DataFrame, key: str, frame: str, target: list[str], solved: list[str], status: str) -> DataFrame:
    """key and frames: the solver's rows of a session in order of frames, each with its target, what was reached (NULL where it failed) and the
    distance between them. A session is one row, for a viewer."""
    gap = F.sqrt(sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(target[1:], solved[1:], strict=True)),
                     (F.col(target[0]) - F.col(solved[0])) * (F.col(target[0]) - F.col(solved[0]))))
    ok = F.coalesce(F.col(status).cast("boolean"), F.lit(False))
    one = F.struct(F.col(frame).alias("frame"), F.struct(*target).alias("target"), F.when(ok, F.struct(*solved)).alias("reached"), F.when(ok, gap).alias("error"), ok.alias("ok"))
    return df.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("frames"))


def ordered_events(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """All tables' rows with event_type and type_order, the table's name and place; columns that one lacks are NULL. Sorting by keys and
    type_order gives the fixed order of types."""
    out = None
    for i, (name, t) in enumerate(tables.items()):
        own = t.withColumn("event_type", F.lit(name)).withColumn("type_order", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    rest = [c for c in out.columns if c not in (*keys, "type_order", "event_type")]
    return out.select(*keys, "type_order", "event_type", *rest)


def shape_summary(df: DataFrame, keys: list[str], shape: list[str]) -> DataFrame:
    """Of each key: the median of every shape number over the rows whose shape is finite throughout, and the mean and maximum of their population
    standard deviations."""
    good = finite(F.col(shape[0])).isNotNull()
    for c in shape[1:]:
        good &= finite(F.col(c)).isNotNull()
    per = df.groupBy(*keys).agg(*[F.percentile(F.when(good, F.col(c)), 0.5).alias(c) for c in shape], F.array(*[F.stddev_pop(F.when(good, F.col(c))) for c in shape]).alias("_s"))
    return per.withColumn("std_mean", F.aggregate("_s", F.lit(0.0), lambda a, x: a + x) / len(shape)).withColumn("std_max", F.array_max("_s")).drop("_s")


def apparent_size(df: DataFrame, keys: list[str], area: str, depth: str, least_depth: float = 0.1) -> DataFrame:
    """size: the median of area / depth squared, over rows deeper than least_depth with an area."""
    s = F.when((finite(F.col(depth)) > least_depth) & (finite(F.col(area)) > 0), F.col(area) / (F.col(depth) * F.col(depth)))
    return df.groupBy(*keys).agg(F.percentile(s, 0.5).alias("size"), F.count(s).alias("rows"))


def gated_translation(df: DataFrame, keys: list[str], joint: str, shift: list[str], status: str, least: int = 2) -> DataFrame:
    """The median shift of the reliable joints whose depth sample is ok, if there are `least` of them, else of all such joints; count, source (no_joint where
    there is none) and rejected: each other joint with the reason why it isn't used, as joint:reason, in order."""
    good = F.coalesce(F.col(status) == "ok", F.lit(False))
    for c in shift:
        good &= finite(F.col(c)).isNotNull()
    reliable = good & F.col(joint).isin(*RELIABLE)
    enough = F.sum(reliable.cast("int")) >= least
    why = F.when(F.coalesce(F.col(status), F.lit("no_sample")) != "ok", F.coalesce(F.col(status), F.lit("no_sample"))).otherwise("not_finite")
    dropped = F.array_sort(F.collect_list(F.when(~good, F.struct(F.col(joint).alias("j"), why.alias("w")))))
    got = df.groupBy(*keys).agg(
        *[F.when(enough, F.percentile(F.when(reliable, F.col(c)), 0.5)).otherwise(F.percentile(F.when(good, F.col(c)), 0.5)).alias(c) for c in shift],
        F.when(enough, F.sum(reliable.cast("long"))).otherwise(F.sum(good.cast("long"))).alias("count"),
        F.when(enough, "depth_reliable_joints").when(F.sum(good.cast("int")) > 0, "depth_all_joints").otherwise("no_joint").alias("source"), dropped.alias("_d"))
    return got.withColumn("rejected", F.array_join(F.transform("_d", lambda x: F.concat_ws(":", x["j"].cast("string"), x["w"])), ";")).drop("_d")
