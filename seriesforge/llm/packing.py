"""Packing: documents go to context-size tiers; long windows are filled from shorter tiers."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from seriesforge.llm.arrays import on_batches
from seriesforge.llm.common import runs
from seriesforge.llm.tokens import Encoder, vocabulary

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_length long, step_id long"
)


@dataclass(frozen=True)
class Packing:
    """tiers: window sizes, powers of two, ascending. end_id: closes every document.

    round_tokens: so many tokens are packed together, which bounds memory. step_tokens: what a
    group of sequences for one training step holds.
    """

    path: str
    tiers: tuple[int, ...] = (256, 512, 1024, 2048)
    end_id: int = 1
    round_tokens: int = 1 << 19
    step_tokens: int = 1 << 15


def pack_sizes(sizes: list[int], tiers: tuple[int, ...], last: bool = True) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length), and the pieces kept for later if not last.

    A document's full windows of the largest tier stand alone. What is left of it goes to the
    smallest tier that holds it. Tiers are packed from the longest: a window opens with the tier's
    next item, then the largest shorter items that fit fill the gap, and the next one is cut to
    close it. Only when nothing shorter is left does a window stay open; these last windows are
    cut at powers of two, so no sequence needs padding.
    """
    top = tiers[-1]
    done: list[list[tuple[int, int, int]]] = []
    pool: list[tuple[int, int, int]] = []  # (length, item, start), ascending
    for item, size in enumerate(sizes):
        full = size // top
        done += [[(item, k * top, top)] for k in range(full)]
        if size % top:
            pool.append((size % top, item, full * top))
    pool.sort()
    open_ends: list[tuple[int, int, int]] = []
    while pool:
        length, item, start = pool.pop()
        window = next(t for t in tiers if t >= length)
        pieces, gap = [(item, start, length)], window - length
        while gap and pool:
            at = bisect_right(pool, (gap, len(sizes), 0)) - 1
            if at >= 0:
                length, item, start = pool.pop(at)
                pieces.append((item, start, length))
                gap -= length
            else:  # all are longer than the gap: the shortest is cut
                length, item, start = pool.pop(0)
                pieces.append((item, start, gap))
                insort(pool, (length - gap, item, start + gap))
                gap = 0
        if gap:
            open_ends += pieces
        else:
            done.append(pieces)
    if not last:
        return done, open_ends
    done += cut_at_powers(open_ends, top)
    return done, []


def cut_at_powers(pieces: list[tuple[int, int, int]], top: int) -> list[list[tuple[int, int, int]]]:
    """The pieces, in order, as sequences whose lengths are powers of two."""
    left = sum(x[2] for x in pieces)
    queue, out = list(reversed(pieces)), []
    while left:
        room = min(top, 1 << (left.bit_length() - 1))
        left -= room
        sequence = []
        while room:
            item, start, length = queue.pop()
            take = min(length, room)
            sequence.append((item, start, take))
            if take < length:
                queue.append((item, start + take, length - take))
            room -= take
        out.append(sequence)
    return out


def step_groups(lengths: list[int], step_tokens: int) -> list[int]:
    """A group for each sequence; the groups hold nearly the same number of tokens."""
    groups = [(0, g) for g in range(max(1, -(-sum(lengths) // step_tokens)))]
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        load, g = heapq.heappop(groups)
        out[i] = g
        heapq.heappush(groups, (load + lengths[i], g))
    return out


def _packed(batches: Iterator[pa.RecordBatch], spec: Packing) -> Iterator[pa.RecordBatch]:
    encoder = Encoder.of(spec.path)
    base = TaskContext.get().partitionId() << 36
    made = steps = 0
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kept: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, its tokens, start, ids

    def flush(items: list[tuple[int | None, int, int, np.ndarray]], last: bool) -> tuple[list[list[tuple]], list]:
        """Sequences as lists of rows, but for their step, and the pieces kept for later."""
        nonlocal made
        sequences, rest = pack_sizes([len(x[3]) for x in items], spec.tiers, last)
        out = []
        for s in sequences:
            offset, rows, length = 0, [], sum(p[2] for p in s)
            for item, start, n in s:
                doc, total, first, ids = items[item]
                rows.append((doc, first + start, n, zlib.crc32(ids[start : start + n].data), total, base + made, offset, length))
                offset += n
            out.append(rows)
            made += 1
        return out, [(items[i][0], items[i][1], items[i][2] + s, items[i][3][s : s + n]) for i, s, n in rest]

    def stepped(sequences: list[list[tuple]]) -> pa.RecordBatch:
        nonlocal steps
        groups = step_groups([s[0][-1] for s in sequences], spec.step_tokens)
        rows = [(*row, base + steps + g) for s, g in zip(sequences, groups, strict=True) for row in s]
        steps += max(groups, default=-1) + 1
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    held, before = 0, []
    for batch in batches:
        docs, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for low, high in runs(texts):
            ids, counts = encoder.encode(texts.slice(low, high - low).to_pylist())
            ends = np.cumsum(counts)
            for doc, n, end in zip(docs[low:high], counts.tolist(), ends.tolist(), strict=True):
                own = np.append(ids[end - n : end], np.uint32(spec.end_id)).astype("<u4")
                kept.append((doc, n + 1, 0, own))
                held += n + 1
            if held >= spec.round_tokens:
                out, kept = flush(kept, False)
                held = sum(len(x[3]) for x in kept)
                if before:
                    yield stepped(before)
                before = out  # waits for the next round, as the last one may be too small for a step of its own
    yield stepped(before + flush(kept, True)[0])


def pack(docs: DataFrame, spec: Packing | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length, step_id.

    Each partition of docs is packed by itself as it streams by, so nothing is shuffled and memory
    doesn't grow with the input; a lost task is made anew from its own input. Null and empty texts
    are their end token alone. Repeated rows are packed as often as they occur. An empty table
    gives no rows; columns other than doc_id and text are not read. sequence_id and step_id are
    unique over partitions, but not gapless.
    """
    spec = spec or Packing(vocabulary())
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(on_batches(lambda it: _packed(it, spec)), SCHEMA)
