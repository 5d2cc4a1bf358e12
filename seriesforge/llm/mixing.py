"""Mixing sources to target weights: blocks, multinomial draws and index permutations, in the JVM.

The words of a source stand in one row and are cut into blocks. The output is a row of slots, a
block each, cut into shards. How many slots a source gets in a shard is a multinomial draw, under the
condition that each source's slots add up to its target (else the noise of small mixes would be
many blocks): the slots of all sources, laid end to end, are scattered over the output by a keyed
permutation. The k-th slot of a source takes the block at index k mod n of a permutation of its n
blocks, a new one for each round k div n. Blocks and slots are joined by index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.llm.common import WORD, shuffle_width, stored


@dataclass(frozen=True)
class Mix:
    """weights: given to the sources in code point order, repeating; null comes last.

    block: words in a block. shard: slots in an output shard. most: how often a word may be taken.
    """

    weights: tuple[int, ...] = (1, 2, 3)
    block: int = 64
    shard: int = 256
    most: int = 3
    seed: int = 20240229
    rounds: int = 12


def running_sum(df: DataFrame, group: list[str], chunk: str, order: list[str], value: str, out: str, width: int) -> DataFrame:
    """Exclusive running sum of value within group, by chunk and then order, in two levels.

    Sums of the chunks run first; then each chunk adds its own offset. No task gets a whole group,
    only a chunk of it or the chunks' sums. Chunks are dealt evenly, whatever their groups.
    """
    dealt = df.repartition(width, chunk)
    per_chunk = df.groupBy(*group, chunk).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(*group, chunk, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(chunk, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(offsets, [*group, chunk]).withColumn(out, F.col("_inside") + F.col("_offset")).drop("_inside", "_offset")


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """skey, source, source_size, rank, weight and target of each source; one small task.

    Targets share the total by weight. A source stops at `most` times its size; the excess goes to
    the others by weight, until none is above. Sources in order of capacity / weight: the first j
    are full as long as each one's capacity is at most its share of what those before it leave.
    """
    w = Window.orderBy("skey")
    ranked = sizes.withColumn("rank", F.row_number().over(w) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(x)) for x in mix.weights]), F.col("rank") % len(mix.weights) + 1)
    ).withColumn("capacity", F.col("source_size") * float(mix.most))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy(F.col("capacity") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn(
        "share",
        (F.col("total") - F.coalesce(F.sum("capacity").over(upto), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))),
    ).withColumn("full", F.col("capacity") <= F.col("share") * F.col("weight"))
    # the first source that isn't full sets the share of all that aren't
    level = F.min(F.when(~F.col("full"), F.struct(F.col("capacity") / F.col("weight"), "skey", "share"))).over(every)
    return filled.withColumn("level", level["share"]).withColumn(
        "target",
        F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(
            F.least(F.col("capacity"), F.coalesce(F.col("level") * F.col("weight"), F.col("capacity")))
        ),
    ).select("skey", "source", "source_size", "weight", "target", "total")


def permuted(index: str, n: str, key: str, rounds: int) -> F.Column:
    """A pseudorandom permutation of 0 .. n - 1, by swap-or-not rounds: each round pairs x with
    (k - x) mod n and a hash of the larger one says whether they change places. Every round is its
    own inverse, for any n, so the whole is a bijection without cycle-walking."""
    return F.expr(
        f"aggregate(sequence(1, {rounds}), {index}, (x, r) -> "
        f"element_at(transform(array(pmod(pmod(xxhash64({key}, r), {n}) - x, {n})), "
        f"y -> IF(xxhash64({key}, r, greatest(x, y)) % 2 = 0, x, y)), 1))"
    )


def allotted(wanted: DataFrame, mix: Mix) -> DataFrame:
    """wanted with n (blocks of the source), slots (that it gets), before (slots of the sources before
    it) and total_slots; one small task.

    A source's slots are its target over the mean words of its blocks, the last of which may be
    short; the running sums are rounded, so that each source is within one slot of its share.
    """
    upto = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return wanted.withColumn("n", F.expr(f"cast(ceil(source_size / {mix.block}) AS long)")).withColumn(
        "share", F.expr("IF(source_size = 0, 0D, target * n / source_size)")
    ).withColumn("upto", F.sum("share").over(upto)).withColumn("before", F.expr("cast(floor(upto - share + 0.5D) AS long)")).withColumn(
        "slots", F.expr(f"least(cast(floor(upto + 0.5D) AS long) - before, {mix.most} * n)")
    ).withColumn("total_slots", F.max(F.expr("cast(floor(upto + 0.5D) AS long)")).over(every)).drop("share", "upto")


def mixed_slots(allotted_sources: DataFrame, mix: Mix, width: int) -> DataFrame:
    """(shard, slot, skey, block): which block of which source each slot of the output takes.

    The last shard may be partial. Sources are dealt out in chunks of slots, so a large one is many
    tasks' work.
    """
    chunks = allotted_sources.filter("slots > 0").selectExpr(
        "skey", "n", "slots", "before", "total_slots", "explode(sequence(0L, (slots - 1) div 8192)) AS chunk"
    ).repartition(width, "skey", "chunk")
    draws = chunks.selectExpr("*", "explode(sequence(chunk * 8192, least(slots, (chunk + 1) * 8192) - 1)) AS k")
    placed = draws.withColumn("place", F.expr("before + k")).withColumn("place_key", F.lit(mix.seed + 1).cast("long")).withColumn(
        "slot", permuted("place", "total_slots", "place_key", mix.rounds)
    ).withColumn("in_round", F.expr("k % n")).withColumn("key", F.xxhash64(F.lit(mix.seed), "skey", F.expr("k div n")))
    return placed.withColumn("block", permuted("in_round", "n", "key", mix.rounds)).select(
        F.expr(f"slot div {mix.shard}").alias("shard"), "slot", "skey", "block")


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_shard of every document.

    size is the number of words (null text: 0). Words of a source stand in one row, by a hash of
    doc_id and doc_id itself, cut into blocks; taken counts how often the mix takes a document's
    words, and first_shard is the first output shard that does (null if none). A null source is a
    source of its own, the last one. Repeated rows are documents of their own. An empty table gives
    none. Extra columns are left out. Same input, same result. Sources are rows of one small table
    (a name and sums each), which one task sorts for the weights.
    """
    source = docs["source"]
    sized = docs.select(
        "doc_id", source, F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source, F.lit(""))).alias("skey"),
        F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long").alias("size"),
    )
    width = shuffle_width(docs)
    sized = stored(sized, "sizes")
    rows = sized.count()
    sized = sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(max(width, rows // 65536))))
    wanted = targets(sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), mix)
    wanted = stored(allotted(wanted, mix), "targets")
    placed = stored(running_sum(sized, ["skey"], "chunk", ["doc_id", "size"], "size", "start", width), "placed")
    times = mixed_slots(wanted, mix, width).groupBy("skey", "block").agg(F.count("*").alias("times"), F.min("shard").alias("shard"))
    parts = placed.filter("size > 0").selectExpr(
        "doc_id", "skey", "start", "size",
        f"explode(sequence(start div {mix.block}, (start + size - 1) div {mix.block})) AS block",
    ).withColumn("words", F.expr(
        f"least(start + size, (block + 1) * {mix.block}) - greatest(start, block * {mix.block})"
    ))
    # Both sides grow with the corpus, which the optimizer can't see behind the exploded rows.
    taken = parts.hint("merge").join(times.hint("merge"), ["skey", "block"]).groupBy(
        F.col("skey").alias("t_skey"), F.col("doc_id").alias("t_doc_id"), F.col("start").alias("t_start")
    ).agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("shard").alias("first_shard"))
    found = placed.join(
        taken.hint("merge"),
        (F.col("skey") == F.col("t_skey")) & F.col("doc_id").eqNullSafe(F.col("t_doc_id"))
        & (F.col("start") == F.col("t_start")) & (F.col("size") > 0),
        "left",
    ).select("doc_id", "skey", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")
    return found.join(wanted.select("skey", "source_size", "target"), "skey").select(
        "doc_id", "size", "source_size", "target", "taken", "first_shard"
    )


def take_mix(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """docs as the mix takes them: each document as often as taken / size says.

    The fraction is settled by a hash of doc_id, so that a source's words come near its target.
    Documents without words, or of a null doc_id, are left out; rows of one doc_id count together
    (the most taken decides for each). Columns stay as they are, whatever their names.
    """
    shares = mix_documents(docs, mix).filter("taken > 0").select(
        F.col("doc_id"),
        F.expr(f"cast(floor(taken / size + (pmod(xxhash64({mix.seed}L, doc_id), 1048576L) + 0.5D) / 1048576) AS int)").alias("times"),
    ).filter("times > 0").groupBy("doc_id").agg(F.max("times").alias("times"))
    whole = docs.select(F.col("doc_id").alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    repeated = whole.join(shares, whole["id"] == shares["doc_id"]).select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return repeated.select([F.col("row").getField(c).alias(c) for c in docs.columns])
