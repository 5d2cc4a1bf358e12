"""Training-order materialisation: a keyed permutation gives every sequence its global slot."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import arrays as A
from seriesforge.llm.common import forget, runs, shuffle_width, stored
from seriesforge.llm.tokens import Encoder, vocabulary

U64 = np.uint64


@dataclass(frozen=True)
class Order:
    """stride: token ids in a sequence. shard_slots: sequences in a shard. key: of the permutation."""

    path: str
    stride: int = 512
    shard_slots: int = 4096
    key: int = 0x5EED
    end_id: int = 1
    pad_id: int = 0
    rounds: int = 6


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed bijection of 0 .. n - 1: a balanced Feistel network over the next even number of
    bits, walked along its cycle while the value is n or more (under four steps on average)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = U64((1 << half) - 1)
    x = np.asarray(index, U64).copy()
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> U64(half), x[todo] & mask
        for r in range(rounds):
            f = A.mix(right + U64((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) % (1 << 64)))
            left, right = right, left ^ (f & mask)
        x[todo] = left << U64(half) | right
        todo = todo[x[todo] >= U64(n)]
    return x.astype(np.int64)


SEQUENCES = "bucket long, place long, doc_id long, start long, length long, ids binary"


def _kind(path: str) -> str:
    """How an id is stored: in two bytes if the vocabulary allows, else in four."""
    return "<u2" if Encoder.of(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def _sequences(batches: Iterator[pa.RecordBatch], spec: Order, kind: str) -> Iterator[pa.RecordBatch]:
    """Sequences of documents that come by bucket; place counts within the bucket."""
    A.calm_malloc()
    encoder, bucket, place = Encoder.of(spec.path), None, 0
    for batch in batches:
        texts, docs, buckets = batch.column("text"), batch.column("doc_id").to_pylist(), batch.column("bucket").to_pylist()
        for low, high in runs(texts, 2 << 20):
            ids, counts = encoder.encode(texts.slice(low, high - low).to_pylist())
            ends, rows = np.cumsum(counts), []
            for doc, b, n, end in zip(docs[low:high], buckets[low:high], counts.tolist(), ends.tolist(), strict=True):
                if b != bucket:
                    bucket, place = b, 0
                own = np.append(ids[end - n : end], np.uint32(spec.end_id)).astype(kind)
                for s in range(0, len(own), spec.stride):
                    piece = own[s : s + spec.stride]
                    rows.append((b, place, doc, s, len(piece), piece.tobytes()))
                    place += 1
            yield _batch(rows, SEQUENCES)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [x.rsplit(" ", 1) for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def in_training_order(docs: DataFrame, spec: Order | None = None) -> tuple[DataFrame, int]:
    """One row per sequence with its slot (doc_id, start, length, ids, slot), and how many there are.

    Each document's ids and an end id are cut every `stride`. Sequences are numbered in the order
    of (hash of doc_id and text, doc_id, text, start), whatever the files, splits and buckets; the
    number goes through the permutation. Hash ranges are buckets; of each one only its number of
    sequences reaches the driver (a long for each of at most a million buckets). Null and empty
    texts are an end id, null doc_ids stay, repeated rows count each. An empty table gives no rows;
    columns other than doc_id and text are not read.
    """
    spec = spec or Order(vocabulary())
    width, kind = shuffle_width(docs), _kind(spec.path)
    dealt = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").withColumn("h", F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).withColumn(
        "bucket", F.expr(f"cast(least(floor((h / 18446744073709551616D + 0.5D) * {width}), {width - 1}) AS long)")
    ).repartition(width, "bucket").sortWithinPartitions("bucket", "h", "doc_id", "text").select("bucket", "doc_id", "text")
    made = stored(dealt.mapInArrow(lambda it: _sequences(it, spec, kind), SEQUENCES), "sequences")
    counts = np.zeros(width + 1, np.int64)
    for r in made.groupBy("bucket").agg(F.count("*").alias("n")).collect():  # one row per bucket
        counts[r["bucket"] + 1] = r["n"]
    offsets = np.cumsum(counts)
    total = int(offsets[-1])
    shared = docs.sparkSession.sparkContext.broadcast(offsets)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = shared.value[b.column("bucket").to_numpy()] + b.column("place").to_numpy()
            slot = pa.array(feistel(index, total, spec.key, spec.rounds), pa.int64())
            yield b.select(["doc_id", "start", "length", "ids"]).append_column("slot", slot)

    ordered = made.mapInArrow(slots, "doc_id long, start long, length long, ids binary, slot long")
    ordered.folder = made.folder
    return ordered, total


SHARDS = "shard long, first_slot long, n_slots long, docs array<long>, starts array<long>, lengths array<long>, data binary"


def shards(ordered: DataFrame, total: int, spec: Order | None = None) -> DataFrame:
    """Shards of fixed-stride records: shard, first_slot, n_slots, docs, starts, lengths, data.

    total: the number of sequences, whose slots are 0 .. total - 1, each once. Record k of a shard
    is at byte stride * (bytes of an id) * k: little-endian unsigned ids of 16 bits (of 32 where the
    vocabulary needs them), padded; docs, starts and lengths tell what record k holds. A reader that
    stopped at slot s goes on at shard s div shard_slots and record s mod shard_slots. A partition is
    a range of slots, cut into shards as it streams by in slot order. No sequences, no shards.
    """
    spec = spec or Order(vocabulary())
    kind = _kind(spec.path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("slot", "doc_id", "start", "length", "ids")], strict=True):
                if held and row[0] // spec.shard_slots != held[0][0] // spec.shard_slots:
                    yield _shard(held, spec, kind)
                    held = []
                held.append(row)
        if held:
            yield _shard(held, spec, kind)

    n_shards = -(-total // spec.shard_slots)
    width = max(1, min(n_shards, shuffle_width(ordered)))
    part = F.expr(f"cast(((slot div {spec.shard_slots}) * {width}) div {max(1, n_shards)} AS int)")
    return ordered.repartitionById(width, part).sortWithinPartitions("slot").mapInArrow(write, SHARDS)


def _shard(rows: list[tuple], spec: Order, kind: str) -> pa.RecordBatch:
    out = np.full((len(rows), spec.stride), spec.pad_id, kind)
    for i, (*_, ids) in enumerate(rows):
        own = np.frombuffer(ids, kind)
        out[i, : len(own)] = own
    slot, doc, start, length, _ = zip(*rows, strict=True)
    return _batch([(slot[0] // spec.shard_slots, slot[0], len(rows), list(doc), list(start), list(length), out.tobytes())], SHARDS)


def resume(shards_table: DataFrame, slot: int, spec: Order) -> DataFrame:
    """slot and ids of every record from a slot on, in order; earlier shards aren't read.

    Past the last slot, or of no shards, there are no rows. A negative slot is the start.
    """
    left = shards_table.filter(F.col("shard") >= max(0, slot) // spec.shard_slots)
    size = int(_kind(spec.path)[-1]) * spec.stride
    return left.selectExpr("first_slot", "data", "explode(sequence(0, cast(n_slots AS int) - 1)) AS k").selectExpr(
        "first_slot + k AS slot", f"substring(data, k * {size} + 1, {size}) AS ids"
    ).filter(F.col("slot") >= slot).orderBy("slot")


DIGESTS = "doc_id long, start long, length long, slot long, shard long, byte_offset long, ids_crc32 long"


def _digests(batches: Iterator[pa.RecordBatch], spec: Order, kind: str) -> Iterator[pa.RecordBatch]:
    size = int(kind[-1]) * spec.stride
    for batch in batches:
        for x in batch.to_pylist():
            rows = []
            for k, (doc, start, length) in enumerate(zip(x["docs"], x["starts"], x["lengths"], strict=True)):
                own = np.frombuffer(x["data"], kind, length, k * size)
                rows.append((doc, start, length, x["first_slot"] + k, x["shard"], k * size, crc(own)))
            yield _batch(rows, DIGESTS)


def slot_digests(docs: DataFrame, spec: Order | None = None) -> DataFrame:
    """doc_id, start, length, slot, shard, byte_offset and ids_crc32 (of the ids as 32-bit values) of
    every sequence, read back from the written shards. Nulls, repeats and empty tables as in
    in_training_order."""
    spec = spec or Order(vocabulary())
    kind = _kind(spec.path)
    ordered, total = in_training_order(docs, spec)
    written = stored(shards(ordered, total, spec), "shards")
    forget(ordered)
    return written.mapInArrow(lambda it: _digests(it, spec, kind), DIGESTS)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
