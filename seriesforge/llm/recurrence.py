"""Windows that occur again: a sample of positions finds the texts' repeats without moving the texts' every position.

A text is a row of units (bytes or words). Every window of W units is put under a key: the least
hash of its grams of k units. Consecutive windows with the same key form a run, about one for
(W - k + 2) / 2 windows; equal windows have equal keys wherever they are, so only runs of one key
can share windows. A run's passage is the text its windows cover.

1. Each bucket of documents sends its distinct keys; keys that occur once in one bucket only drop out.
2. The distinct passages of the other keys follow, each with its first document. Passages with an
   earlier equal passage are settled: all their windows occur earlier. A key with several passages
   is open: the first holder of each passage must show its windows. If the scheme asks for sides, only
   passages that share more than the key's gram are open: see sides_of().
3. Windows shown are compared by content, and the first document of each window is found.

Passages and windows are named by two 64-bit hashes of different make, and count as equal only if
both agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import arrays as A

U64 = np.uint64
SETTLED, OPEN = 1, 2
SALT = 0x5851F42D4C957F2D


@dataclass
class Runs:
    """Of a bucket's documents (by doc_id): each run's document, first and last window start in
    that document, key and passage name (two hashes). Windows and runs stand in document order."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    passage: np.ndarray
    check: np.ndarray
    sides: np.ndarray


@dataclass(frozen=True)
class Scheme:
    """cut(texts) yields (index of the first text, units, start and count of each text's units) of
    parts of a bucket's texts. sides: passages are told apart by sides_of(), too."""

    cut: Callable[[pa.Array], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]
    window: int
    gram: int
    salt: int = SALT
    sides: bool = False

    def keys(self, texts: pa.Array) -> np.ndarray:
        """The keys of a bucket's runs."""
        parts = [keys_of(values, start, count, self.window, self.gram) for _, values, start, count in self.cut(texts)]
        return np.concatenate(parts) if parts else np.zeros(0, U64)

    def runs(self, texts: pa.Array, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> Runs:
        """A bucket's runs; if wanted is given, those only of whose keys it holds, with their sides if the scheme has them."""
        parts, before = [], []
        for low, values, start, count in self.cut(texts):
            parts.append(runs_of(values, start, count, self.window, self.gram, self.salt, wanted, self.sides and wanted is not None))
            before.append(low)
        return join_runs(parts, before)


def _openings(values: np.ndarray, start: np.ndarray, count: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams; of every window the least of its grams; and where a run begins: a window inside one text whose least gram isn't that of the
    window before it."""
    gram = A.grams(values, k)
    least = A.sliding_least(gram, window - k + 1)
    if not len(least):
        return gram, least, np.zeros(0, bool)
    many = count >= window
    mark = np.zeros(len(least) + 1, np.int8)
    mark[start[many]] += 1
    mark[start[many] + count[many] - window + 1] -= 1  # may be where the next text starts
    opened = np.cumsum(mark[:-1], dtype=np.int8).view(bool)
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[start[many]] = True
    opened &= new
    return gram, least, opened


def keys_of(values: np.ndarray, start: np.ndarray, count: np.ndarray, window: int, k: int) -> np.ndarray:
    """The keys of all runs, without what else runs_of() finds."""
    _, least, opened = _openings(values, start, count, window, k)
    return A.mix(least[opened])


def runs_of(values: np.ndarray, start: np.ndarray, count: np.ndarray, window: int, k: int, salt: int = SALT,
            wanted: Callable[[np.ndarray], np.ndarray] | None = None, sides: bool = False) -> Runs:
    """values: the units of some texts (64-bit values, or bytes), one text after another; start and count of each text's units.

    Passages are named by their units (bytes: by their grams), and by their grams mixed with a salt. Of the runs, those whose keys are
    wanted are returned (all, if it isn't given).
    """
    gram, least, opened = _openings(values, start, count, window, k)
    first = np.flatnonzero(opened)
    if not len(first):
        return _no_runs()
    many = np.flatnonzero(count >= window)
    text = np.searchsorted(start[many], first, side="right") - 1
    doc = many[text]
    last = np.minimum(np.append(first[1:], len(least)) - 1, start[doc] + count[doc] - window)
    key = A.mix(least[first])
    del least
    if wanted is not None:
        on = wanted(key)
        doc, first, last, key = doc[on], first[on], last[on], key[on]
        if not len(first):
            return _no_runs()
    stop = last + window - k + 1
    passage = A.pieces(gram, first, stop) if values.dtype == np.uint8 else A.pieces(values, first, last + window)
    check = A.pieces(A.mix(gram + U64(salt)), first, stop)  # of spread grams, not of units
    place = [(x - start[doc]).astype(np.int32) for x in (first, last)]
    side = sides_of(gram, first, last, key, passage, window - k) if sides else np.zeros(0, U64)
    return Runs(doc.astype(np.int32), *place, key, passage, check, side)


def sides_of(gram: np.ndarray, first: np.ndarray, last: np.ndarray, key: np.ndarray, passage: np.ndarray, reach: int) -> np.ndarray:
    """Of each run two names of 32 bits, of its least gram with the gram reach / 2 units to its left, and to its right.

    Two passages of one key with a common window have one of the two in common, since reach / 2 of the window's other units or more stand on one
    side of the gram. A name is the passage's own where the passage doesn't go so far. 0, which fits
    every name, is the value of a run that has its least gram twice, as a window's gram could be either.
    """
    n = (last - first).astype(np.int64) + 1 + reach
    at = A.ranges(first, n)
    hit = np.flatnonzero(A.mix(gram[at]) == np.repeat(key, n))
    begin = np.cumsum(n) - n
    head = np.searchsorted(hit, begin)  # every run has its least gram
    anchor = at[hit[head]]
    own = A.mix(passage)
    far = reach // 2
    left = np.where(anchor - far >= first, A.mix(key + gram[np.maximum(anchor - far, 0)]), own)
    right = np.where(anchor + far <= last + reach, A.mix(key + gram[np.minimum(anchor + far, len(gram) - 1)]), own)
    once = np.diff(np.append(head, len(hit))) == 1
    return np.where(once, (left & U64(0xFFFFFFFF00000000)) | (right >> U64(32)), U64(0))


def _no_runs() -> Runs:
    e, h = np.zeros(0, np.int32), np.zeros(0, U64)
    return Runs(e, e, e, h, h, h, h)


def join_runs(parts: list[Runs], docs_before: list[int]) -> Runs:
    if not parts:
        return _no_runs()
    return Runs(
        np.concatenate([p.doc + np.int32(n) for p, n in zip(parts, docs_before, strict=True)]),
        *[np.concatenate([getattr(p, f) for p in parts]) for f in ("first", "last", "key", "passage", "check", "sides")],
    )


SENT = "kb int, bucket int, n long, keys binary, passages binary, checks binary, docs binary, rank binary, sides binary"


def send(bucket: int, docs: np.ndarray, doc: np.ndarray, passage: np.ndarray, check: np.ndarray, key: np.ndarray | None, width: int,
         sides: np.ndarray | None = None) -> pa.Table:
    """One row for each bucket of keys: distinct passages of this bucket, each with its first document.

    doc: index in docs, ascending. Keys are cut to some upper bits here; that may put unequal grams under
    one key, which costs work only. Without keys the passages go by themselves.
    """
    head = distinct(passage, check)
    passage, check = passage[head], check[head]
    sides = sides[head] if sides is not None and len(sides) else None
    keyed = key is not None
    key = key[head] >> A.key_shift(width) if keyed else passage
    to = (key % U64(width)).astype(np.int64)
    # by task, then key; a key's part above the tasks has fewer than 40 bits
    order = np.argsort(to.astype(U64) << U64(40) | key // U64(width)) if keyed else A.by_small(to, width)
    head, key, to, passage, check = head[order], key[order], to[order], passage[order], check[order]
    sides = sides[order] if sides is not None else None
    rows = []
    for a, b in A.equal_runs(to):
        own, rank = np.unique(docs[doc[head[a:b]]], return_inverse=True)
        small = np.uint16 if len(own) <= 1 << 16 else np.uint32
        rows.append((int(to[a]), bucket, b - a, A.pack_ascending(key[a:b] // U64(width)) if keyed else None, passage[a:b].tobytes(), check[a:b].tobytes(),
                     A.pack_ascending(own.astype(np.int64).view(U64) ^ U64(1 << 63)), rank.astype(small).tobytes(),
                     sides[a:b].tobytes() if sides is not None else None))
    return table(rows, SENT)


def distinct(name: np.ndarray, check: np.ndarray) -> np.ndarray:
    """The first place of each distinct (name, check)."""
    if not len(name):
        return np.zeros(0, np.int64)
    order, starts = A.same_pairs(name, check)
    return np.minimum.reduceat(order, starts)


def table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


TOLD = "bucket int, kind int, n long, passages binary, checks binary, docs binary"


def judge(sent: pa.Table) -> pa.Table:
    """For one bucket of keys: tell each bucket of documents which of its passages are settled
    (with the first document of each), and which it must show the windows of."""
    rows = sent.sort_by("bucket").to_pylist()
    n = [x["n"] for x in rows]
    bucket = np.repeat(np.array([x["bucket"] for x in rows]), n)
    keyed = rows[0]["keys"] is not None
    passage = np.concatenate([np.frombuffer(x["passages"], U64) for x in rows])
    check = np.concatenate([np.frombuffer(x["checks"], U64) for x in rows])
    doc = np.concatenate([_docs(x) for x in rows])
    order, starts = A.same_pairs(passage, check)
    bucket, passage, check, doc = bucket[order], passage[order], check[order], doc[order]
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    first = np.minimum.reduceat(doc, starts)[group]
    settled = first < doc
    shown = np.zeros(0, bool)
    if keyed:  # keys whose passages differ
        key = np.concatenate([A.unpack_ascending(x["keys"], x["n"]) for x in rows])[order]
        differ = A.twice(A.mix(key[starts]))
        if rows[0]["sides"] is not None:
            differ &= _alike(key[starts], np.concatenate([np.frombuffer(x["sides"], U64) for x in rows])[order][starts])
        shown = ~settled & differ[group]  # a document is in one bucket, which sends a passage once
    out = []
    for kind, on in ((SETTLED, settled), (OPEN, shown)):
        at = np.flatnonzero(on)
        at = at[np.argsort(bucket[at], kind="stable")]
        for a, b in A.equal_runs(bucket[at]):
            own = at[a:b]
            sort = np.argsort(passage[own])
            out.append((int(bucket[own[0]]), kind, b - a, passage[own][sort].tobytes(), check[own][sort].tobytes(), first[own][sort].tobytes()))
    return table(out, TOLD)


def _alike(key: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Which of some passages have a side in common with another of their key."""
    spread = A.mix(key)
    any_side = A.Among(np.sort(spread[sides == 0])).has(spread)
    return any_side | A.twice(A.mix(spread ^ (sides >> U64(32)))) | A.twice(A.mix(spread ^ (sides & U64(0xFFFFFFFF))))


def _docs(x: dict) -> np.ndarray:
    rank = np.frombuffer(x["rank"], np.uint16 if len(x["rank"]) == 2 * x["n"] else np.uint32)
    own = int(rank.max()) + 1 if len(rank) else 0
    return (A.unpack_ascending(x["docs"], own) ^ U64(1 << 63)).view(np.int64)[rank]


@dataclass
class Names:
    """Names told to a bucket, ascending, with the first document of each."""

    name: np.ndarray
    check: np.ndarray
    doc: np.ndarray

    def find(self, name: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each name its place here, and whether it is there."""
        at, there = np.zeros(len(name), np.int64), np.zeros(len(name), bool)
        on, found = A.Among(self.name).find(name)
        at[on] = found
        there[on] = self.check[found] == check[on]
        return at, there


def told(answers: pa.Table, kind: int) -> Names:
    """The passages of one kind told to a bucket."""
    rows = answers.filter(pc.equal(answers.column("kind"), kind)).select(["passages", "checks", "docs"]).to_pylist()
    if not rows:
        return Names(np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64))
    p, c = (np.concatenate([np.frombuffer(x[f], U64) for x in rows]) for f in ("passages", "checks"))
    d = np.concatenate([np.frombuffer(x["docs"], np.int64) for x in rows])
    order = np.argsort(p)
    return Names(p[order], c[order], d[order])


KEYS = "kb int, bucket int, n long, keys binary, twice binary"


def send_keys(bucket: int, keys: np.ndarray, width: int) -> pa.Table:
    """The distinct keys of a bucket, and which of them it has twice or more."""
    every = np.sort(keys >> A.key_shift(width))
    new = np.ones(len(every), bool)
    np.not_equal(every[1:], every[:-1], out=new[1:])
    at = np.flatnonzero(new)
    key, often = every[at], np.diff(np.append(at, len(every))) > 1
    to = (key % U64(width)).astype(np.int64)
    order = A.by_small(to, width)  # keys ascend already
    key, to, often = key[order], to[order], often[order]
    return table([(int(to[a]), bucket, b - a, A.pack_ascending(key[a:b] // U64(width)), np.packbits(often[a:b]).tobytes()) for a, b in A.equal_runs(to)], KEYS)


def judge_keys(sent: pa.Table) -> pa.Table:
    """Tell every bucket which of its keys other buckets have, too, or it has twice itself."""
    rows = sent.to_pylist()
    key = np.concatenate([A.unpack_ascending(x["keys"], x["n"]) for x in rows])
    shared = A.twice(A.mix(key))
    shared |= np.concatenate([np.unpackbits(np.frombuffer(x["twice"], np.uint8), count=x["n"]) for x in rows]).view(bool)
    out, at = [], 0
    for x in rows:
        own = key[at : at + x["n"]][shared[at : at + x["n"]]]
        at += x["n"]
        if len(own):
            out.append((x["kb"], x["bucket"], len(own), A.pack_ascending(own), None))
    return table(out, KEYS)


def _send_shared(group: pa.Table, replies: pa.Table, scheme: Scheme, width: int) -> pa.Table:
    if not group.num_rows:
        return table([], SENT)
    ids, texts = in_order(group)
    parts = [A.unpack_ascending(x["keys"], x["n"]) * U64(width) + U64(x["kb"]) for x in replies.to_pylist()]
    shared = A.Among(np.sort(np.concatenate(parts)) if parts else np.zeros(0, U64))
    r = scheme.runs(texts, lambda key: shared.find(key >> A.key_shift(width))[0])
    return send(group.column("bucket")[0].as_py(), ids, r.doc, r.passage, r.check, r.key, width, r.sides)


@dataclass
class Shown:
    """Windows by document and start, with their names."""

    doc: np.ndarray
    at: np.ndarray
    name: np.ndarray
    check: np.ndarray


def windows(values: np.ndarray, start: np.ndarray, r: Runs, which: np.ndarray, window: int) -> Shown:
    """Every window of some runs. A window's name is made of the names of its halves: those of the
    positions p and p + window / 2, at which a name stands for window / 2 units (rounded up)."""
    half = -(-window // 2)
    often = (r.last[which] - r.first[which] + 1).astype(np.int64)
    doc = np.repeat(r.doc[which], often)
    p = A.ranges(start[r.doc[which]] + r.first[which], often.astype(np.int64))
    one, two = A.grams(values, half), A.grams(A.mix(values + U64(SALT)), half)
    names = [A.mix(A.mix(n[p]) * U64(3) + n[p + window - half]) for n in (one, two)]
    return Shown(doc, p - start[doc], *names)


def open_windows(texts: pa.Array, ids: np.ndarray, answers: pa.Table, scheme: Scheme, inner: bool = False) -> Shown:
    """The windows that a bucket must show: those of open passages whose first holder is here.

    inner: also those of runs in which the least gram occurs twice; only they can hold a window twice.
    """
    wanted = told(answers, OPEN)
    out = []
    for low, values, start, count in scheme.cut(texts) if len(wanted.name) or inner else ():
        r = runs_of(values, start, count, scheme.window, scheme.gram, scheme.salt)
        at, there = wanted.find(r.passage, r.check)
        if len(wanted.name):
            there = there & (wanted.doc[at] == ids[r.doc + low])
        if inner:
            there |= _doubled(values, start, r, scheme)
        mine = np.flatnonzero(there)
        if len(mine):
            w = windows(values, start, r, mine, scheme.window)
            out.append((w.doc + low, w.at, w.name, w.check))
    if not out:
        return Shown(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64))
    return Shown(*(np.concatenate(c) for c in zip(*out, strict=True)))


def _doubled(values: np.ndarray, start: np.ndarray, r: Runs, scheme: Scheme) -> np.ndarray:
    """Runs in which the least gram occurs twice or more."""
    if not len(r.doc):
        return np.zeros(0, bool)
    g = A.mix(A.grams(values, scheme.gram))
    often = (r.last - r.first).astype(np.int64) + 1 + scheme.window - scheme.gram
    same = g[A.ranges(start[r.doc] + r.first, often)] == np.repeat(r.key, often)
    return np.add.reduceat(same.astype(np.int64), np.cumsum(often) - often) > 1


def _show(group: pa.Table, answers: pa.Table, scheme: Scheme, width: int) -> pa.Table:
    if not group.num_rows or not answers.num_rows:
        return table([], SENT)
    ids, texts = in_order(group)
    w = open_windows(texts, ids, answers, scheme)
    return send(group.column("bucket")[0].as_py(), ids, w.doc, w.name, w.check, None, width)


def passages_told(own: DataFrame, scheme: Scheme, width: int) -> DataFrame:
    """TOLD rows for every bucket, by steps 1 and 2. own is bucketed()."""

    def ask(group: pa.Table) -> pa.Table:
        return send_keys(group.column("bucket")[0].as_py(), scheme.keys(group.column("text").combine_chunks()), width)

    replies = own.groupBy("bucket").applyInArrow(A.on_group(ask), KEYS).groupBy("kb").applyInArrow(A.on_group(judge_keys), KEYS)
    return own.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(
        A.on_groups(lambda a, b: _send_shared(a, b, scheme, width)), SENT
    ).groupBy("kb").applyInArrow(A.on_group(judge), TOLD)


def answers(own: DataFrame, scheme: Scheme, width: int) -> DataFrame:
    """TOLD rows for every bucket, with step 1 (passages) and 2 (windows). own is bucketed()."""
    passages = passages_told(own, scheme, width)
    shown = own.groupBy("bucket").cogroup(passages.groupBy("bucket")).applyInArrow(
        A.on_groups(lambda a, b: _show(a, b, scheme, width)), SENT
    )
    # The first document of each window decides.
    ranked = shown.groupBy("kb").applyInArrow(A.on_group(judge), TOLD)
    return passages.withColumn("step", F.lit(1)).unionByName(ranked.withColumn("step", F.lit(2)))


def earlier(ids: np.ndarray, r: Runs, told_rows: pa.Table) -> np.ndarray:
    """Which runs of a bucket have a passage that a smaller document has, too, here or elsewhere."""
    out = told(told_rows, SETTLED).find(r.passage, r.check)[1]
    if not len(r.doc):
        return out
    on = np.flatnonzero(A.twice(r.passage))
    if not len(on):
        return out
    order, starts = A.same_pairs(r.passage[on], r.check[on])
    order = on[order]
    first = np.minimum.reduceat(r.doc[order], starts)  # documents stand by doc_id
    out[order] |= ids[r.doc[order]] > np.repeat(ids[first], np.diff(np.append(starts, len(order))))
    return out


def open_runs(ids: np.ndarray, r: Runs, told_rows: pa.Table) -> np.ndarray:
    """The runs of open passages of which the first holder is here."""
    wanted = told(told_rows, OPEN)
    at, there = wanted.find(r.passage, r.check)
    return there & (wanted.doc[at] == ids[r.doc]) if len(wanted.name) else there


def in_order(group: pa.Table) -> tuple[np.ndarray, pa.ChunkedArray]:
    """A bucket's documents by doc_id and text."""
    group = sort_group(group)
    return group.column("doc_id").to_numpy(), group.column("text").combine_chunks()


def sort_group(group: pa.Table) -> pa.Table:
    return group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
