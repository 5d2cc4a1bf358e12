"""Vector code compression: product codes by Lloyd's rounds, with Elkan's bounds.

Vectors are integers, cut into equal parts; each part position has a codebook of 16 entries. Of every
vector a table in the shared folder persists, part by part, the entry it has, an upper bound of
the distance to it, and a lower bound of the distance to each entry. A round reads the table once
and writes the next: by the triangle inequality an entry c can't be nearer than the entry a that
a part has if the upper bound is less than its lower bound for c, or less than half the distance
of a and c. Only the entries that are left are measured. Pruning is strict and bounds are rounded
outwards, so that no tie is pruned; what is measured is compared as exact integers, and ties go to the lower index.
When entries move, upper bounds grow and lower bounds shrink by the movement.

Codebooks have a fixed size (parts x 16 entries) and are all that the driver and every task hold.
Sums of a round are added up by each task as it writes its rows, then by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seriesforge.llm.common import forget, join_split, stored
from seriesforge.llm.vectors import matrix, scaled, usable

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Distances, bounds and movements are told from each other only by more than this share; rounding stays far below.
SLACK = 1e-6


def state_type(label: T.DataType) -> T.StructType:
    """A row for each vector; and a row of sums for each task, with all else null."""
    out = T.StructType().add("vec_id", T.LongType()).add("label", label)
    for name in ("x", "code", "upper", "lower"):
        out = out.add(name, T.BinaryType())
    return out.add("error", T.LongType()).add("sums", T.ArrayType(T.LongType()))



@dataclass(frozen=True)
class Step:
    """Codebooks (part, entry, place) and how far each entry has moved since the bounds were made (part, entry)."""

    books: np.ndarray
    moved: np.ndarray
    first: bool
    last: bool


def outwards(x: np.ndarray, up: bool) -> np.ndarray:
    """x in 32 bits, not below (up) or not above what it was."""
    y = x.astype(np.float32)
    return np.nextafter(y, np.float32(np.inf if up else -np.inf))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def assign(x: np.ndarray, step: Step, part: int, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, upper bounds, lower bounds and exact squared distances of one part position.

    x: the part of each vector. In the first step every entry is measured; only the last one measures the
    distance of parts that no other entry can be as near to (0 stands for it before).
    """
    book = step.books[part]
    rows = np.arange(len(x))
    if step.first:
        exact = np.stack([squares(x, c) for c in book], 1)
        best = exact.argmin(1)  # the first of the least
        near = exact[rows, best]
        return best.astype(np.uint8), outwards(np.sqrt(near), True), outwards(np.sqrt(exact), False), near
    best = code.astype(np.int64)
    upper = upper.astype(np.float64) + step.moved[part][best]
    lower = np.maximum(lower.astype(np.float64) - step.moved[part], 0)
    half = np.sqrt(squares(book[:, None], book[None]).astype(np.float64)) / 2 * (1 - SLACK)

    def open_to(rows: np.ndarray) -> np.ndarray:
        """Which entries can be as near to these rows as the one that they have."""
        can = (upper[rows] * (1 + SLACK))[:, None] >= np.maximum(lower[rows], half[best[rows]])
        can[np.arange(len(rows)), best[rows]] = False
        return can

    near = np.zeros(len(x), np.int64)
    loose = rows if step.last else rows[open_to(rows).any(1)]  # the others keep their entry, unmeasured
    near[loose] = squares(x[loose], book[best[loose]])
    upper[loose] = np.sqrt(near[loose])
    lower[loose, best[loose]] = upper[loose] * (1 - SLACK)
    possible = open_to(loose)
    for c in range(len(book)):
        at = loose[possible[:, c]]
        if not len(at):
            continue
        d = squares(x[at], book[c])
        lower[at, c] = np.sqrt(d) * (1 - SLACK)
        better = (d < near[at]) | ((d == near[at]) & (c < best[at]))
        best[at[better]], near[at[better]] = c, d[better]
        upper[at[better]] = np.sqrt(d[better])
    return best.astype(np.uint8), outwards(upper * (1 + SLACK), True), outwards(lower, False), near


def _advance(batches: Iterator[pa.RecordBatch], step: Step, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    parts, entries, width = step.books.shape
    sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i4").astype(np.int64).reshape(n, parts, width)
        get = lambda c, kind, *shape: None if step.first else np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(n, *shape)
        code, upper, lower = get("code", np.uint8, parts), get("upper", "<f4", parts), get("lower", "<f4", parts, entries)
        found = [assign(x[:, p], step, p, *((None, None, None) if step.first else (code[:, p], upper[:, p], lower[:, p]))) for p in range(parts)]
        code, upper, lower, near = (np.stack([f[i] for f in found], 1) for i in range(4))
        for p in range(parts):
            np.add.at(sums[p], code[:, p], x[:, p])
            counts[p] += np.bincount(code[:, p], minlength=entries)
        raw = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), batch.column("x"), raw(code), raw(upper), raw(lower),
             pa.array(near.sum(1)), pa.nulls(n, pa.list_(pa.int64()))], schema=schema)
    if counts.any():
        total = np.concatenate((sums.ravel(), counts.ravel())).tolist()
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(1, schema.field(i).type) for i in range(7)], pa.array([total], pa.list_(pa.int64()))], schema=schema)


def _integers(batches: Iterator[pa.RecordBatch], scale: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = scaled(matrix(b.column("embedding")), scale).astype("<i4") if b.num_rows else []
        empty = [pa.nulls(b.num_rows, schema.field(i).type) for i in range(3, 8)]
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary()), *empty], schema=schema)


def moved(books: np.ndarray, table: DataFrame) -> np.ndarray:
    """The next codebooks: each entry the floor of its parts' mean. Entries without parts stay."""
    rows = table.filter("sums IS NOT NULL").select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()
    flat = np.zeros(books.size + books.shape[0] * books.shape[1], np.int64)
    for r in rows:
        flat[r["i"]] = r["s"]
    sums, counts = flat[: books.size].reshape(books.shape), flat[books.size :].reshape(books.shape[:2])
    used = counts > 0
    out = books.copy()
    out[used] = sums[used] // counts[used][:, None]  # rounds down, below zero too
    return out


@dataclass(frozen=True)
class Codes:
    """rows: vec_id, label, code (one byte a part), error; books: part, entry, place."""

    rows: DataFrame
    books: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def product_codes(table: DataFrame, label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes | None:
    """Codes and codebooks of the table's vectors; None if no vector is left.

    Rows whose vector is null, holds nulls or non-finite entries, or has a length other than the most frequent
    one that the parts divide, are dropped. Codebooks begin with the smallest vec_ids' parts; rows without
    vec_id come after all others, rows of one vec_id by their vector; with fewer rows than entries there are as many
    entries. Repeated rows count as often as they stand.
    """
    kinds = state_type(table.schema[label].dataType)
    schema = to_arrow_schema(kinds)
    kept = usable(table, F.col(label).alias("label"), parts=parts)
    least = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    if not least:
        return None
    books = scaled(np.array([r[0] for r in least], np.float64), scale).reshape(len(least), parts, -1).swapaxes(0, 1).copy()
    state = stored(kept.mapInArrow(lambda it: _integers(it, scale, schema), kinds), "codes")
    shift = np.zeros(books.shape[:2])
    for number in range(rounds + 1):
        step = Step(books, shift, number == 0, number == rounds)
        after = stored(state.filter("sums IS NULL").mapInArrow(lambda it, s=step: _advance(it, s, schema), kinds), "codes")
        forget(state)
        state = after
        if number < rounds:
            books = moved(step.books, state)
            shift = np.sqrt(squares(books, step.books).astype(np.float64)) * (1 + SLACK)
    return Codes(state.filter("sums IS NULL").select("vec_id", "label", "code", "error"), books)


def compressed(table: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row; see product_codes(). Empty tables give no rows."""
    made = product_codes(table)
    if made is None:
        return table.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = made.rows.select("vec_id", F.col("label").isNull().alias("no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"),
                            F.lower(F.hex("code")).alias("code"), "error")
    sums = rows.groupBy("no_label", "label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    total = made.rows.count()
    return join_split(rows, sums, ["no_label", "label"], "n", total).select(
        "vec_id", "code", "error", "label_error", F.lit(made.sha256()).alias("codebooks_sha256"))
