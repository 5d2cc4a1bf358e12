"""Prefix doubling over many short pieces of text, with the sorting dealt out by Spark.

A state row holds a part of the pieces of one bucket of documents, and for every position the rank of the
k bytes from there on. In a round, each part pairs the ranks of the positions p and p + offset,
which stand for k + offset bytes; Spark deals the pairs by their hash, each task sorts its share and
gives every pair that occurs twice a new rank, and the ranks go back to the parts. A pair that
occurs once is unique: its position gets no rank, and no longer pair is made of it. Offsets grow,
8, 16, 32 ..., until nothing is left or the length asked for is reached; then the least document of
each pair decides. The first ranks are the eight bytes themselves, so no hash stands for any text: hashes only
deal and order pairs, which are compared as they are.

Pairs take many times the room of their text. So a round stores the new ranks before they go back, and where there are many
pairs deals them in several turns, each those of some tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import arrays as A
from seriesforge.llm import recurrence as R
from seriesforge.llm.common import forget, stored

U64 = np.uint64
#: Bytes of text in a part, about; what a task works on at once follows it.
PART_BYTES = 1 << 19
#: Bytes of a pair on disk, about, and of the pairs that a turn deals at least.
PAIR_BYTES, TURN_BYTES = 10, 64 << 20
#: Of each piece: its document's place in the bucket and id, its first byte in the document, its bytes.
STATE = "part long, bucket int, row binary, doc binary, at binary, size binary, text binary, rank binary"
PAIRS = "kb int, part long, n long, a binary, b binary, many binary, docs binary"
RANKS = "kb int, part long, n long, ranks binary"
HIT = 3


@dataclass(frozen=True)
class Step:
    """From ranks of `have` bytes to ranks of have + offset bytes. first: have are the bytes themselves."""

    have: int
    offset: int
    first: bool
    last: bool

    @property
    def reach(self) -> int:
        return self.have + self.offset


def steps(length: int) -> list[Step]:
    if length < 16:
        raise ValueError("strings of 16 bytes or more")
    out, have = [], 8
    while have < length:
        offset = min(have, length - have)
        out.append(Step(have, offset, have == 8, have + offset == length))
        have += offset
    return out


def packed(x: np.ndarray) -> bytes:
    """Unsigned values in 4 or 8 bytes each, whichever they need; those of 8, bytes of text most often, compressed."""
    if not len(x) or int(x.max()) < 1 << 32:
        return b"\x04" + x.astype("<u4").tobytes()
    return b"\x08" + zstandard.ZstdCompressor(level=1).compress(x.astype("<u8").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    body = memoryview(data)[1:]
    return np.frombuffer(body if data[0] == 4 else zstandard.ZstdDecompressor().decompress(body), f"<u{data[0]}").astype(U64)


def state_row(bucket: int, number: int, row: np.ndarray, doc: np.ndarray, at: np.ndarray, size: np.ndarray, text: bytes) -> tuple:
    """The bucket's part of that number."""
    return bucket << 32 | number, bucket, *(x.astype("<i8").tobytes() for x in (row, doc, at, size)), text, None


@dataclass
class Pairs:
    """The pairs of a part: piece and place in it of each position; a, b; and, in the order of the
    pairs' hashes, where a new pair begins."""

    piece: np.ndarray
    place: np.ndarray
    position: np.ndarray
    a: np.ndarray
    b: np.ndarray
    order: np.ndarray
    new: np.ndarray
    to: np.ndarray  # of each distinct pair, in that order: the task that it is dealt to

    def heads(self) -> np.ndarray:
        return self.order[self.new]

    def group(self) -> np.ndarray:
        return np.cumsum(self.new) - 1


def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return A.mix(A.mix(a) ^ (b * U64(0x9E3779B97F4A7C15)))


def _task(h: np.ndarray, width: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(width) >> U64(32)).astype(np.int64)


def grouped(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal pairs stand together, in their order before; where new ones begin; their tasks."""
    h = _hash(a, b)
    # Sorted by the upper bits of the hash, with the place below them: so the order is stable, and values are sorted, not places.
    low = U64((1 << len(h).bit_length()) - 1)
    order = np.sort((h & ~low) | np.arange(len(h), dtype=U64)) & low
    order = order.astype(np.int64)
    for _ in range(2):
        s, x, y = h[order], a[order], b[order]
        equal = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
        if ((((s[1:] ^ s[:-1]) & ~low) == 0) == equal).all():
            break
        order = np.lexsort((b, a, h))  # two pairs of the same upper bits
    new = np.ones(len(a), bool)
    new[1:] = ~equal
    return order, new, _task(s[new], width)


def pairs_of(x: dict, step: Step, width: int, tasks: tuple[int, int] | None = None) -> Pairs:
    """The pairs of a part; of the tasks from .. to only, if they are given."""
    size = np.frombuffer(x["size"], "<i8")
    base = np.cumsum(size) - size
    free = np.maximum(size - step.reach + 1, 0)
    position = A.ranges(base, free)
    piece = np.repeat(np.arange(len(size)), free)
    if step.first:
        eight = np.ndarray((len(x["text"]) + 1,), "<u8", x["text"] + bytes(8), strides=(1,))
        a, b = eight[position], eight[position + step.offset]
    else:
        rank = unpacked(x["rank"])
        a, b = rank[position], rank[position + step.offset]
        on = (a > 0) & (b > 0)
        position, piece, a, b = position[on], piece[on], a[on], b[on]
    if tasks:
        to = _task(_hash(a, b), width)
        on = (to >= tasks[0]) & (to < tasks[1])
        position, piece, a, b = position[on], piece[on], a[on], b[on]
    if not len(a):
        return Pairs(piece, position, position, a, b, position, np.zeros(0, bool), position)
    order, new, to = grouped(a, b, width)
    return Pairs(piece, position - base[piece], position, a, b, order, new, to)


def _emit(batches: Iterator[pa.RecordBatch], step: Step, width: int, tasks: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            p = pairs_of(x, step, width, tasks)
            heads = p.heads()
            many = np.diff(np.append(np.flatnonzero(p.new), len(p.new))) > 1
            doc = np.frombuffer(x["doc"], "<i8")[p.piece[heads]] if step.last else None
            rows = [
                (int(p.to[lo]), x["part"], hi - lo, packed(p.a[heads[lo:hi]]), packed(p.b[heads[lo:hi]]), np.packbits(many[lo:hi]).tobytes(),
                 doc[lo:hi].tobytes() if step.last else None)
                for lo, hi in A.equal_runs(p.to)
            ]
            yield from R.table(rows, PAIRS).to_batches()


def rank_pairs(sent: pa.Table, step: Step, width: int) -> pa.Table:
    """For one share of the pairs: the new rank of each, 0 if it occurs once; in the last round, whether
    a smaller document has it."""
    rows = sent.sort_by("part").to_pylist()
    a, b = (np.concatenate([unpacked(x[c]) for x in rows]) for c in "ab")
    order, new, _ = grouped(a, b, width)
    opens, group = np.flatnonzero(new), np.cumsum(new) - 1
    found = np.empty(len(a), U64)
    if step.last:
        doc = np.concatenate([np.frombuffer(x["docs"], "<i8") for x in rows])
        found[order] = np.minimum.reduceat(doc[order], opens)[group] < doc[order]
    else:
        times = np.concatenate([1 + np.unpackbits(np.frombuffer(x["many"], np.uint8), count=x["n"]).astype(np.int64) for x in rows])
        shared = np.add.reduceat(times[order], opens) > 1
        rank = np.where(shared, (np.cumsum(shared) - 1) * width + rows[0]["kb"] + 1, 0).astype(U64)
        found[order] = rank[group]
    out, low = [], 0
    for x in rows:
        own = found[low : low + x["n"]]
        low += x["n"]
        if own.any():
            out.append((x["kb"], x["part"], x["n"], packed(own)))
    return R.table(out, RANKS)


def _answers(p: Pairs, ranks: pa.Table) -> np.ndarray:
    """What was told of each distinct pair, 0 if nothing."""
    out = np.zeros(len(p.to), U64)
    for x in ranks.to_pylist():
        low = int(np.searchsorted(p.to, x["kb"]))
        out[low : low + x["n"]] = unpacked(x["ranks"])
    return out


def _update(group: pa.Table, ranks: pa.Table, step: Step, width: int) -> pa.Table:
    rows = []
    for x in group.to_pylist():
        p = pairs_of(x, step, width)
        told = _answers(p, ranks)
        if told.any():
            rank = np.zeros(len(x["text"]), U64)
            rank[p.position[p.order]] = told[p.group()]
            rows.append((*[x[c] for c in ("part", "bucket", "row", "doc", "at", "size", "text")], packed(rank)))
    return R.table(rows, STATE)


def _hits(group: pa.Table, ranks: pa.Table, step: Step, width: int) -> pa.Table:
    """TOLD rows of kind HIT: place of the document in the bucket, first and last start of strings that a
    smaller document has, too."""
    rows = []
    for x in group.to_pylist():
        p = pairs_of(x, step, width)
        if not len(p.a):
            continue
        row, doc, at = (np.frombuffer(x[c], "<i8") for c in ("row", "doc", "at"))
        own = doc[p.piece[p.order]]
        on = np.zeros(len(p.a), bool)
        on[p.order] = (_answers(p, ranks) > 0)[p.group()] | (own > doc[p.piece[p.heads()]][p.group()])
        where = np.flatnonzero(on)  # positions ascend
        if len(where):
            r, s = row[p.piece[where]], at[p.piece[where]] + p.place[where]
            opened = np.ones(len(where), bool)
            opened[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)
            one = np.flatnonzero(opened)
            last = np.append(one[1:], len(where)) - 1
            rows.append((x["bucket"], HIT, len(one), *(v.astype("<i8").tobytes() for v in (r[one], s[one], s[last]))))
    return R.table(rows, R.TOLD)


def turns(text: int, most: int, width: int) -> int:
    """In how many turns the pairs of so many bytes of text are dealt, if a turn's take about `most` bytes."""
    return max(1, min(width, -(-PAIR_BYTES * text // max(most, TURN_BYTES))))


def repeated(state: DataFrame, length: int, width: int, most: int) -> DataFrame:
    """HIT rows for the strings of `length` bytes in the pieces of state that also start in a piece of a
    smaller document. state: a stored() table of STATE rows; it is
    forgotten. No pieces, or none that repeats, give no rows. most: bytes of disk, about, for the pairs dealt at a time.
    """
    tables, n = [state], turns(state.agg(F.sum(F.length("text"))).first()[0] or 0, most, width)
    for step in steps(length):
        tables = _round(tables, step, width, n if step.first else -(-n // 3), -(-n // 3))  # ranks are shorter than text
    return reduce(DataFrame.unionByName, tables)


def _round(tables: list[DataFrame], step: Step, width: int, n: int, back: int) -> list[DataFrame]:
    """Pairs are dealt in n turns, their ranks go back in `back` turns."""
    state, ranks = reduce(DataFrame.unionByName, tables), []
    for tasks in pairwise(i * width // n for i in range(n + 1)):
        share = tasks if n > 1 else None
        sent = state.mapInArrow(A.on_batches(lambda it, share=share: _emit(it, step, width, share)), PAIRS)
        ranks.append(stored(sent.groupBy("kb").applyInArrow(A.on_group(lambda g: rank_pairs(g, step, width)), RANKS), f"told-{step.reach}"))
    told, after = reduce(DataFrame.unionByName, ranks), []
    turn, schema = (_hits, R.TOLD) if step.last else (_update, STATE)
    for i in range(back):
        own, new = (t.filter(F.pmod(F.xxhash64("part"), F.lit(back)) == i) if back > 1 else t for t in (state, told))
        both = own.groupBy("part").cogroup(new.groupBy("part"))
        after.append(stored(both.applyInArrow(A.on_groups(lambda g, r: turn(g, r, step, width)), schema), f"rank-{step.reach}"))
    forget(*tables, *ranks)
    return after
