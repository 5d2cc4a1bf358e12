"""Shared pieces: loading, sizing of exchanges, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside; results have null again.
NO_ID = -(2**63)

#: Files of this many bytes (as the optimizer estimates it) go to one bucket of an exchange.
BUCKET_BYTES = 24 << 20
#: Text of this many bytes, as counted, goes to one bucket of texts that a task works on as a whole.
TEXT_BYTES = 16 << 20

#: Java and Python pattern of a word: a run without ASCII white space.
WORD, SPACE = "[^\\x20\\x09-\\x0D]+", "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shuffle_width(df: DataFrame) -> int:
    """Buckets for an exchange of df: as many as the session shuffles into, more if df is larger.

    The size is the optimizer's estimate from the files' sizes; no job runs. Inputs without one
    (it is then over an exabyte) are dealt as the session says.
    """
    spark = df.sparkSession
    configured = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    size = int(str(estimate))
    return configured if size >> 60 else max(configured, min(1_000_000, size // BUCKET_BYTES))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts. Files hold them compressed, to a half or a tenth, so their size doesn't tell."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def text_width(docs: DataFrame, size: int | None = None) -> int:
    """Buckets for texts that tasks work on bucket by bucket: as many as the session shuffles into, more if docs has more
    text (size, where it is known)."""
    configured = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(configured, min(1_000_000, (text_bytes(docs) if size is None else size) // TEXT_BYTES))


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir.

    Only where that setting is absent (single-machine tests) is a temporary folder taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base}/{name}-{uuid.uuid4().hex}"


#: Spark then removes a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folders of the innermost scratch() of this thread.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: computed once, and lineage is cut.

    The exchanges of the write are not needed any more once the table is there; their files go (a setting of the session, which stays).
    """
    spark, path = df.sparkSession, work_folder(df.sparkSession, name)
    spark.conf.set(CLEANUP, "true")
    df.write.option("compression", "zstd").parquet(path)
    if (own := _scratch.get()) is not None:
        own.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove the folders of stored() tables that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t.folder)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession, keep: set[str] | None = None):
    """Folders that stored() makes inside, on this thread, go at the end, but for those whose path is put in keep. A caller can
    wrap a whole query and the reading of its result: then nothing of it is left."""
    kept, own, outer = set() if keep is None else keep, [], _scratch.get()
    token = _scratch.set(own)
    try:
        yield kept
    finally:
        _scratch.reset(token)
        for path in own:
            if path not in kept:
                _remove(spark, path)
            elif outer is not None:
                outer.append(path)


def join_split(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, how: str = "inner", most: int = 1000) -> DataFrame:
    """left joined with right, which has each key once and, as weight, how many rows of left have it.

    Keys of more than total / most rows of left are joined by broadcast: there are fewer than `most` of them,
    whatever the input, and their rows needn't meet in one task. The rest is an ordinary join.
    """
    cut = max(1, total // most)
    hot = right.filter(F.col(weight) > cut)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.filter(F.col(weight) <= cut).drop(weight), on, how)
    return left.join(F.broadcast(hot.drop(weight)), on).unionByName(rest)


def bucketed(docs: DataFrame, width: int, *cols: str) -> DataFrame:
    """doc_id, the columns and a bucket by hash of doc_id, one partition or more per bucket.

    Rows without doc_id get NO_ID, the least one. The same call gives the same plan, so Spark reuses
    the exchange within one query.
    """
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        *cols,
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(width)).cast("int").alias("bucket"),
    ).repartition(width, "bucket")


def runs(texts, most: int = 6 << 20):
    """Ranges of an Arrow array of texts that hold at most so many bytes, or a single text."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low, before = 0, 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield low, high
        low, before = high, int(ends[high - 1])
