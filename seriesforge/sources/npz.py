"""NPZ tables as a Spark data source: files are planned as partitions, frames filtered as they are read, and written files committed together.

    npz.register(spark)
    spark.read.format("npz").schema("frame_index int, joints_uv array<array<double>>").load(folder).filter("frame_index >= 10")
    df.write.format("npz").mode("append").save(folder)

The schema says which arrays are decompressed; Spark doesn't tell a Python source which of them a plan needs. The folder must be one that
all machines see.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
                                    IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage)
from pyspark.sql.pandas.types import to_arrow_schema

FRAME, CANDIDATE = "frame_index", "candidate_index"
#: Files go to one partition up to so many bytes; a written file ends after so many rows, and a batch read has so many.
PARTITION_BYTES, FILE_ROWS, BATCH_ROWS = 64 << 20, 100_000, 4096

_TESTS = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


@dataclass
class Files(InputPartition):
    paths: list[str]


class NpzReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str):
        self.schema, self.path = schema, path
        self.tests: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 (the interface's name)
        """Comparisons of the frame with numbers are done here; the others are Spark's."""
        for f in filters:
            if type(f) in (*_TESTS, In) and f.attribute == (FRAME,):
                self.tests.append((type(f), f.value))
            elif not (isinstance(f, IsNotNull) and f.attribute == (FRAME,)):  # it never is
                yield f

    def partitions(self) -> list[Files]:
        found = sorted(glob.glob(os.path.join(self.path, "*.npz")) if os.path.isdir(self.path) else glob.glob(self.path))
        out: list[Files] = []
        held = PARTITION_BYTES
        for p in found:
            size = os.path.getsize(p)
            if held + size > PARTITION_BYTES:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(p)
            held += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        for path in partition.paths:
            with np.load(path) as z:  # members are decompressed as they are asked for
                yield from self._batches(path, z, kinds)

    def _batches(self, path: str, z, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
        if missing := [c for c in kinds.names if c not in z.files and c != CANDIDATE]:
            raise ValueError(f"{path}: missing columns: {', '.join(missing)}")
        first = FRAME if FRAME in z.files else next(iter(z.files), None)
        n = len(z[first]) if first and z[first].ndim else 0
        keep = np.ones(n, bool)
        if self.tests:
            frames = z[FRAME]
            for kind, value in self.tests:
                keep &= np.isin(frames, list(value)) if kind is In else _TESTS[kind](frames, value)
        rows = np.flatnonzero(keep)
        if not len(rows):
            return
        arrays = {c: z[c] if c in z.files else np.arange(n, dtype=np.int32) for c in kinds.names}
        for a in range(0, len(rows), BATCH_ROWS):
            at = rows[a : a + BATCH_ROWS]
            yield pa.RecordBatch.from_arrays([self._column(arrays[f.name], at, n, f.type) for f in kinds], schema=kinds)

    @staticmethod
    def _column(a: np.ndarray, at: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
        """Rows of an array; one of another length, or a single value, is the same in every row."""
        if a.ndim == 0 or len(a) != n:
            return pa.array([a.tolist()] * len(at), kind)
        return pa.array(a[at].tolist() if a.ndim > 1 or a.dtype.kind in "US" else a[at]).cast(kind)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class NpzWriter(DataSourceArrowWriter):
    """Each task writes files beside their places; they take these when all tasks are done, and go if one fails."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def _hidden(self, name: str) -> str:
        return os.path.join(self.path, f".{self.run}-{name}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        names, held, count = [], [], 0

        def close() -> None:
            nonlocal held, count
            if held:
                table = pa.Table.from_batches(held)
                name = f"part-{uuid.uuid4().hex}.npz"
                with open(self._hidden(name), "wb") as f:
                    np.savez_compressed(f, **{c: array_of(table.column(c)) for c in table.column_names})
                names.append(name)
            held, count = [], 0

        for batch in iterator:
            held.append(batch)
            count += batch.num_rows
            if count >= FILE_ROWS:
                close()
        if count:
            close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        old = glob.glob(os.path.join(self.path, "*.npz")) if self.overwrite else []
        for m in messages:
            for name in m.names if m else ():
                os.replace(self._hidden(name), os.path.join(self.path, name))
        for p in old:
            os.remove(p)

    def abort(self, messages: list[Written | None]) -> None:
        for p in glob.glob(os.path.join(self.path, f".{self.run}-*.npz")):
            os.remove(p)


def array_of(column: pa.ChunkedArray) -> np.ndarray:
    """A column as an array: numbers, text, or nested lists of one shape (else an error). NULL numbers become NaN, NULL text ""."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_string(column.type):
        return np.array([x or "" for x in column.to_pylist()], dtype=str)
    if pa.types.is_list(column.type):
        return np.array(column.to_pylist(), dtype=float if pa.types.is_floating(_leaf(column.type)) else None)
    return column.to_numpy(zero_copy_only=False)


def _leaf(kind: pa.DataType) -> pa.DataType:
    return _leaf(kind.value_type) if pa.types.is_list(kind) else kind


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        raise ValueError("give the columns to read as the schema")

    def reader(self, schema: T.StructType) -> NpzReader:
        return NpzReader(schema, self.options["path"].removeprefix("file://"))

    def writer(self, schema: T.StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(self.options["path"].removeprefix("file://"), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format "npz" known to the session, and let Spark push filters down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpzSource)
