"""Files: NPZ tables, CSV with checked columns, JSON without NaN."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesforge.functions.scalars import finite


def _rows(data: bytes) -> tuple[dict[str, np.ndarray], int]:
    with np.load(io.BytesIO(data)) as z:
        arrays = {k: z[k] for k in z.files}
    n = len(arrays["frame_index"]) if "frame_index" in arrays else max((len(v) for v in arrays.values() if v.ndim), default=0)
    return arrays, n


def _column(a: np.ndarray, n: int):
    if a.ndim == 0:
        return a.item()
    if len(a) != n:
        return [a.ravel()] * n
    return list(a.reshape(n, -1)) if a.ndim > 1 else a


def read_npz(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One row per candidate of every NPZ file, read on the executors; schema picks the columns.

    Arrays whose first axis isn't the number of candidates are constants: every row of the file gets them, flat. Matrices
    become flat arrays. `candidate_index` counts rows if the file has none. A column that a file lacks is an error.
    """
    parsed = spark.createDataFrame([], schema).schema
    names = parsed.names

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                arrays, n = _rows(data)
                arrays.setdefault("candidate_index", np.arange(n, dtype=np.int32))
                if missing := [c for c in names if c not in arrays]:
                    raise ValueError(f"missing columns: {', '.join(missing)}")
                yield pd.DataFrame({c: _column(arrays[c], n) for c in names}, index=range(n))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, parsed)


def read_csv_checked(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, all columns text; ValueError if one of columns is missing."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def write_csv_fields(df: DataFrame, path: str, fields: list[str]) -> None:
    """CSV with these columns in this order; columns that df lacks are empty, others are left out."""
    cols = [F.col(c) if c in df.columns else F.lit("").alias(c) for c in fields]
    df.select(cols).write.csv(path, header=True, emptyValue="", nullValue="")


def read_csv_indexed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """`file`, `row_index` (from 0 in each file) and columns of small CSV files with a header, as text; ValueError if a
    column is missing. A file is read by one task."""
    names = ["file", "row_index", *columns]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                got = pd.read_csv(io.BytesIO(data), dtype=str, keep_default_na=False)
                if missing := [c for c in columns if c not in got.columns]:
                    raise ValueError(f"missing columns: {', '.join(missing)}")
                yield got[columns].assign(file=file, row_index=np.arange(len(got)))[names]

    schema = ", ".join(["file string", "row_index long", *[f"`{c}` string" for c in columns]])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, schema)


def write_csv_union(tables: list[DataFrame], path: str) -> None:
    """All tables' rows in one CSV, whose columns are those of the tables in the order they first appear."""
    fields = list(dict.fromkeys(c for t in tables for c in t.columns))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    write_csv_fields(out, path, fields)


def npz_files(df: DataFrame, file: str, columns: list[str]) -> DataFrame:
    """file and content: the rows of each file as a compressed NPZ of columns (numbers, text, or arrays of one length), in
    the order of candidate_index if there is one."""
    order = [c for c in ("frame_index", "candidate_index") if c in df.columns]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order) if order else pdf
        arrays = {c: np.stack(rows[c].to_list()) if len(rows) and isinstance(rows[c].iloc[0], (list, np.ndarray)) else rows[c].to_numpy() for c in columns}
        out = io.BytesIO()
        np.savez_compressed(out, **{k: v.astype(str) if v.dtype == object else v for k, v in arrays.items()})
        return pd.DataFrame({file: [pdf[file].iloc[0]], "content": [out.getvalue()]})

    return df.select(file, *dict.fromkeys([*order, *columns])).groupBy(file).applyInPandas(pack, f"{file} {dict(df.dtypes)[file]}, content binary")


def subset(df: DataFrame, keep: Column, frame: str, order: list[str], rank: str = "candidate_index") -> DataFrame:
    """The rows to keep, with their rank in the frame counted anew from 0."""
    return df.filter(keep).withColumn(rank, F.row_number().over(Window.partitionBy(frame).orderBy(*order)) - 1)


def empty_table(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """A table of this schema without rows, for inputs in which nothing was found."""
    return spark.createDataFrame([], schema)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Whole JSON documents, one or a list in each file."""
    reader = spark.read.option("multiLine", True)
    return (reader if schema is None else reader.schema(schema)).json(path)


def json_at(c: Column, dotted: str) -> Column:
    """The text at a dotted path of a JSON text; NULL if it isn't there."""
    return F.get_json_object(c, "$." + dotted)


def append_timing(spark: SparkSession, path: str, stage: str, status: str, seconds: float, exit_code: int, started_ns: int, ended_ns: int) -> None:
    """One line more in a folder of JSON lines: a file of its own, so that nobody writes to another's."""
    fields = "stage string, status string, duration_sec double, exit_code int, started_ns long, ended_ns long"
    spark.createDataFrame([(stage, status, float(seconds), exit_code, started_ns, ended_ns)], fields).coalesce(1).write.mode("append").json(path)


def timing_rollup(df: DataFrame, group: str, status: str, seconds: str) -> DataFrame:
    """runs, ok, failed, and the seconds of those that went well, for each group of timing lines."""
    good = F.col(status) == "ok"
    return df.groupBy(group).agg(F.count("*").alias("runs"), F.sum(good.cast("long")).alias("ok"), F.sum((~good).cast("long")).alias("failed"),
                                 F.coalesce(F.sum(F.when(good, F.col(seconds))), F.lit(0.0)).alias("seconds"))


def manifest(df: DataFrame, frame: str, order: str) -> DataFrame:
    """One row for each frame, the last by order."""
    w = Window.partitionBy(frame).orderBy(F.desc(order))
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modificationTime of files; their contents aren't read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def existing(df: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """Rows whose file is in a listing(): a whole path (with or without a scheme), or one below some folder of the listing."""
    plain = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    parts = F.split(F.regexp_replace(plain(F.col("path")), "^/+", ""), "/")
    # every ending of the listed paths at a "/", and the whole path
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    known = files.select(F.explode(F.concat(ends, F.array(plain(F.col("path"))))).alias("_name")).distinct()
    return df.join(known, plain(F.col(column)) == F.col("_name"), "left_semi")


def newest(files: DataFrame) -> str | None:
    """The path of the file of a listing() that was changed last; the greatest path among equals; None if there is none."""
    row = files.agg(F.max(F.struct("modificationTime", "path")).alias("m")).first()
    return row["m"]["path"] if row["m"] else None


def ready(files: DataFrame, least: int) -> DataFrame:
    """path and ready: whether the file has at least so many bytes."""
    return files.select("path", (F.col("length") >= least).alias("ready"))


def moved_path(c: Column, old: str, new: str) -> Column:
    """A path under old as one under new; others stay."""
    return F.when(F.startswith(c, F.lit(old.rstrip("/") + "/")), F.concat(F.lit(new.rstrip("/")), F.substring(c, len(old.rstrip("/")) + 1, 1 << 20))).otherwise(c)


def checked_matrix(c: Column, rows: int = 4, columns: int = 4) -> Column:
    """An array of arrays of that shape; an error in any other row but NULL ones."""
    fits = (F.size(c) == rows) & F.forall(c, lambda r: F.size(r) == columns)
    return F.when(c.isNull(), c).when(fits, c).otherwise(F.raise_error(F.lit(f"not a {rows} x {columns} matrix")))


def intrinsics(cell: Column, focal: Column, width: Column, height: Column, default: float) -> Column:
    """fx, fy, cx, cy from a JSON cell, else from the focal length and the image's centre, else the default; and
    their source."""
    given = [json_at(cell, k).try_cast("double") for k in ("fx", "fy", "cx", "cy")]
    whole = given[0].isNotNull() & given[1].isNotNull() & given[2].isNotNull() & given[3].isNotNull()
    pick = lambda v, source: F.struct(*[x.cast("double").alias(n) for n, x in zip(("fx", "fy", "cx", "cy"), v, strict=True)], F.lit(source).alias("source"))
    return F.when(whole, pick(given, "json")).when(focal > 0, pick([focal, focal, width / 2, height / 2], "focal")).otherwise(
        pick([F.lit(default), F.lit(default), width / 2, height / 2], "default"))


def session_intrinsics(df: DataFrame, key: str, cell: str, focal: str, width: str, height: str, default: float) -> DataFrame:
    """key and intrinsics() of each session: of its JSON cell (the first by text), else of the median of its rows' finite focal lengths."""
    per = df.groupBy(key).agg(F.min(cell).alias("_cell"), F.percentile(finite(F.col(focal)), 0.5).alias("_focal"), F.max(width).alias("_w"), F.max(height).alias("_h"))
    return per.select(key, intrinsics(F.col("_cell"), F.col("_focal"), F.col("_w"), F.col("_h"), default).alias("camera"))


def importable(names: list[str]) -> dict[str, bool]:
    """Which modules could be imported here; none is."""
    import importlib.util

    def there(name: str) -> bool:
        try:
            return importlib.util.find_spec(name) is not None
        except ModuleNotFoundError:  # a package above it is missing
            return False

    return {n: there(n) for n in names}


def nested_frames(df: DataFrame, frame: str, candidate: str, point: str, values: list[str]) -> DataFrame:
    """frame and candidates: each with its points in order, for viewers; one row a frame."""
    per = df.groupBy(frame, candidate).agg(F.array_sort(F.collect_list(F.struct(point, *values))).alias("points"))
    return per.groupBy(frame).agg(F.array_sort(F.collect_list(F.struct(candidate, "points"))).alias("candidates"))


def frame_options(df: DataFrame, frame: str, start: int = 0, end: int = -1, stride: int = 1, most: int = 0) -> DataFrame:
    """Rows of every stride-th frame from start to end (-1: no end), of the first `most` such frames (0: all)."""
    got = df.filter((F.col(frame) >= start) & ((F.col(frame) - start) % stride == 0))
    got = got if end < 0 else got.filter(F.col(frame) <= end)
    return got if not most else got.join(F.broadcast(got.select(frame).distinct().orderBy(frame).limit(most)), frame)


def _clean(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _clean(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_clean(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return c


def clean_json(df: DataFrame) -> DataFrame:
    """One `json` column; NaN and infinities are null, at any depth."""
    cols = [_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))
