"""Exact dedup: a stream of documents against keyed state that is kept on disk for good.

1. Documents stream in, file by file. A document's key is the SHA-256 of its normalised text (A-Z
   lower-cased, in UTF-8). State is a RocksDB store dealt by key, checkpointed in the shared folder, without watermark
   or expiry; of each key it retains the digest, how many documents have it, and of the one that
   stays (the largest doc_id) the identifier and the content locator: file and row number. Partial
   aggregation gathers the copies of a task's part of a batch before they are dealt out, so that a key with a
   third of all documents sends one row per task.
2. A key that more than one document has is a hit, and hits are checked on full bytes: the
   documents of such keys are grouped by their whole text, and a key that holds a text other than that
   at its locator is split by text.
3. Every document finds its key's entry. Keys of a thousandth of all rows or more, fewer than a thousand, are joined by broadcast.

A query that is stopped goes on from the checkpoint; batches that are run again overwrite what they had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import join_split, stored, work_folder

#: Bytes of input files for each partition of the state.
STATE_BYTES = 1 << 30
#: RocksDB memory of an executor.
STATE_MEMORY_MB = 256
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition, however small, takes some megabytes
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STATE_MEMORY_MB),
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """The text that counts: A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def located(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, normalised text, digest and locator of documents read from files, batch or stream."""
    low = normalised(F.col("text"))
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), low.alias("text"), digest(low).alias("digest"), at.alias("at"))


def stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files at path, a file or a folder."""
    parent, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{parent}/{{{name}}}")  # as a pattern; a lone file is no source of a stream


def observe(spark: SparkSession, path: str, folder: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> None:
    """Take up the files at path that the state in folder has not seen, and write the entries that changed.

    Called again with the same folder it goes on where it stopped; only new files count.
    """
    own = spark.newSession()  # the state's settings stay out of the caller's session
    for key, value in STATE.items():
        own.conf.set(key, value)
    size = int(str(spark.read.parquet(path)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    configured = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    own.conf.set("spark.sql.shuffle.partitions", str(max(configured, min(100_000, size // STATE_BYTES))))

    def write(entries: DataFrame, batch: int) -> None:
        entries.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/entries/batch={batch}")

    seen = located(stream(own, path, files_per_batch), digest)
    entries = seen.groupBy("digest").agg(F.max(F.struct("doc_id", "at")).alias("keep"), F.count("*").alias("n"))
    entries.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(
        availableNow=True).foreachBatch(write).start().awaitTermination()


ENTRIES = "digest binary, keep struct<doc_id: long, at: struct<file: string, row: long>>, n long, batch int"


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """digest, keep (doc_id and locator) and n of every key: the last that a batch wrote of it."""
    written = spark.read.schema(ENTRIES).parquet(f"{folder}/entries")
    return written.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("last")).select("digest", "last.*")


def by_content(rows: DataFrame) -> DataFrame:
    """digest, text, keep and n of every text among located() rows. Grouping compares whole texts."""
    return rows.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "at")).alias("keep"), F.count("*").alias("n"))


def collided(rows: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """The digests of hits whose documents don't all have the text at the locator, byte for byte.

    Hot hits are joined by broadcast, so that their equal texts are gathered before they are dealt out.
    """
    hits = found.filter("n > 1").select("digest", F.col("keep.at").alias("locator"), "n")
    texts = join_split(rows, hits, ["digest"], "n", total).groupBy("digest", "text").agg(F.max(F.col("at") == F.col("locator")).alias("is_kept"))
    return texts.filter("NOT is_kept").select("digest").distinct()


def verdicts(docs: DataFrame, found: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every document of docs, from the entries found."""
    rows = located(docs, digest)
    total = found.agg(F.sum("n")).first()[0] or 0
    odd = stored(collided(rows, found, total), "collided")
    own = stored(rows.select("doc_id", "digest", "at", (F.col("digest") if digest is sha256 else sha256(F.col("text"))).alias("sha")), "digests")
    if odd.isEmpty():
        judged = join_split(own, found.withColumn("size", F.col("n")), ["digest"], "n", total)
    else:
        split = rows.join(odd, "digest", "left_semi").withColumn("sha", sha256(F.col("text")))
        apart = join_split(split, by_content(split).withColumn("size", F.col("n")), ["digest", "text"], "n", total).drop("text")
        whole = join_split(own.join(odd, "digest", "left_anti"), found.withColumn("size", F.col("n")), ["digest"], "n", total)
        judged = whole.unionByName(apart)
    return judged.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("at") == F.col("keep.at")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """One row for each document in the Parquet files at path: doc_id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts one row
    stays: the largest doc_id's; rows without doc_id come before all others, and among rows of one doc_id the last by locator
    stays. keep_id is null only where no row of the group has a doc_id. An empty table gives no rows. Other columns don't
    matter. Work tables stay in the shared folder, since the result reads them.
    """
    folder = work_folder(spark, "exact-copies")
    docs = spark.read.parquet(path)
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    observe(spark, path, folder, digest, files_per_batch)
    return verdicts(docs, stored(entries(spark, folder), "entries"), digest)
