import hashlib

import pytest
from pyspark.sql import functions as F

from seriesforge.llm import exact_copies
from seriesforge.llm.common import work_folder

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, digest string, at string, keep int, n long"


@pytest.fixture(scope="module")
def rows():
    """Nulls, empties, case, accents, long texts, repeated rows and ids, and a text that a third of all rows have."""
    out = [(i, f"text number {i % 40}", "d", "a", 1, 2) for i in range(120)]
    out += [(1000 + i, "Hot TEXT" if i % 2 else "hot text", "d", "a", 1, 2) for i in range(90)]
    out += [(500, None, None, None, None, None), (501, "", "d", "a", 1, 2), (502, "Éa", "d", "a", 1, 2), (503, "éA", "d", "a", 1, 2), (504, "ÉA", "d", "a", 1, 2)]
    out += [(505, "long " * 40_000, "d", "a", 1, 2), (506, "LONG " * 40_000, "d", "a", 1, 2), (506, "LONG " * 40_000, "d", "a", 1, 2)]
    out += [(None, "text number 1", "d", "a", 1, 2), (None, "nobody", "d", "a", 1, 2), (None, "nobody", "d", "a", 1, 2), (7, "text number 3", "d", "a", 1, 2)]
    return out


def expected(rows):
    """(doc_id, keep_id, group_size, text_sha256) of every row, and how many rows each group has."""
    low = [(x[0], (x[1] or "").translate(UPPER)) for x in rows]
    groups = {}
    for i, t in low:
        groups.setdefault(t, []).append(i)
    return sorted((str(i), str(max((j for j in groups[t] if j is not None), default=None)), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in low)


def judged(df):
    got = df.collect()
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got)


@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_equals_plain_grouping(spark, rows, files_per_batch):
    path = work_folder(spark, "in")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(path)
    assert judged(exact_copies.exact_dedup(spark, path, files_per_batch=files_per_batch)) == expected(rows)


def test_bytes_decide_when_digests_collide(spark, rows):
    path = work_folder(spark, "in")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    weak = lambda text: F.substring(F.hex(exact_copies.sha256(text)), 1, 1).cast("binary")
    assert judged(exact_copies.exact_dedup(spark, path, digest=weak)) == expected(rows)


def test_state_goes_on_where_it_stopped(spark, rows):
    """Files that come later meet the state that earlier ones left; what was written before a failure is written anew."""
    path, folder = work_folder(spark, "in"), work_folder(spark, "state")
    df = spark.createDataFrame(rows, SCHEMA)
    df.filter("doc_id < 60").write.parquet(path)
    exact_copies.observe(spark, path, folder)
    assert {r["n"] for r in exact_copies.entries(spark, folder).collect()} == {1, 2, 3}
    df.filter("doc_id >= 60 OR doc_id IS NULL").write.mode("append").parquet(path)
    exact_copies.observe(spark, path, folder)
    exact_copies.observe(spark, path, folder)  # nothing new
    found = exact_copies.entries(spark, folder)
    assert found.agg(F.sum("n")).first()[0] == len(rows)
    assert judged(exact_copies.verdicts(spark.read.parquet(path), found)) == expected(rows)


def test_empty_table_and_lone_file(spark, rows):
    path = work_folder(spark, "in")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert exact_copies.exact_dedup(spark, path).count() == 0
    lone = work_folder(spark, "in")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(lone)
    (name,) = spark.read.parquet(lone).select("_metadata.file_path").distinct().first()
    assert judged(exact_copies.exact_dedup(spark, name)) == expected(rows)
