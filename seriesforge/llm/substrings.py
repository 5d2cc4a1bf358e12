"""Suffix-array dedup: byte strings of a fixed length that also start in an earlier document.

1. Most positions can't start a repeated string; they are left out first (recurrence.py). Every
   window of 50 bytes has a key, the least hash of its grams of 28 bytes; equal windows have equal
   keys, so windows whose key no other document has go, and so do passages that an earlier document
   has whole (by two 64-bit hashes): all their windows are repeats. Passages that differ must share 39 bytes,
   the key's gram and 11 bytes to a side. No repeated window is lost.
2. The windows that are left, those of passages that share so much and differ, go through prefix
   doubling (doubling.py): rank pairs are dealt by Spark and sorted at offsets 8, 16 and 18, reranked, and dropped
   once unique. Past 50 bytes the least document of each string decides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import arrays as A
from seriesforge.llm import doubling as D
from seriesforge.llm import recurrence as R
from seriesforge.llm.common import NO_ID, bucketed, forget, runs, stored, text_bytes, text_width

LENGTH, GRAM = 50, 28
#: Bytes of text worked on at once: arrays of eight bytes for each of them stay in a core's own cache.
CUT_BYTES = 1 << 17
U64 = np.uint64


def _pieces(texts: pa.Array):
    """(index of the first text, bytes, start and count of each text) of parts of about CUT_BYTES."""
    for low, high in runs(texts, CUT_BYTES):
        raw = [(x or "").encode() for x in texts.slice(low, high - low).to_pylist()]
        count = np.array([len(x) for x in raw], np.int64)
        yield low, b"".join(raw), np.cumsum(count) - count, count


def scheme(length: int = LENGTH, gram: int = GRAM, key: bytes = b"") -> R.Scheme:
    def cut(texts: pa.Array):
        for low, data, start, count in _pieces(texts):
            yield low, np.frombuffer(data, np.uint8), start, count

    return R.Scheme(cut, length, gram, salt_of(key), sides=True)


def salt_of(key: bytes) -> int:
    """What spreads the grams of passages: the query's own."""
    return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _joined(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in document order, those that follow one another as one."""
    opened = np.ones(len(doc), bool)
    opened[1:] = (doc[1:] != doc[:-1]) | (first[1:] != last[:-1] + 1)
    one = np.flatnonzero(opened)
    return doc[one], first[one], last[np.append(one[1:], len(doc)) - 1] if len(doc) else last


#: The part of a row that holds the runs settled without the doubling: place of the document in the bucket, first and last start of each.
GONE = -1


def _pieces_of(group: pa.Table, answers: pa.Table, length: int, gram: int, key: bytes) -> pa.Table:
    """A bucket's parts for the doubling: the open passages first held here; neighbours are one piece. One more row, GONE, has the
    passages that are repeats whole."""
    if not group.num_rows:
        return R.table([], D.STATE)
    ids, texts = R.in_order(group)
    bucket = group.column("bucket")[0].as_py()
    every = scheme(length, gram, key).runs(texts)
    every.key = every.key[:0]  # no longer needed, and as large as the text
    gone = np.flatnonzero(R.earlier(ids, every, answers))
    settled = _joined(every.doc[gone], every.first[gone], every.last[gone])
    rows, found, text, held = [], [], [], 0

    def close() -> None:
        nonlocal found, text, held
        if found:
            rows.append(D.state_row(bucket, len(rows), *(np.concatenate(c) for c in zip(*found, strict=True)), b"".join(text)))
        found, text, held = [], [], 0

    on = np.flatnonzero(R.open_runs(ids, every, answers))
    docs, firsts, lasts = (x.astype(np.int64) for x in _joined(every.doc[on], every.first[on], every.last[on]))
    del every
    for low, data, start, count in _pieces(texts) if len(on) else ():
        a, b = np.searchsorted(docs, (low, low + len(count)))
        if a == b:
            continue
        doc, first, last = docs[a:b], firsts[a:b], lasts[a:b]
        size = last - first + length
        begin = start[doc - low] + first
        text += [data[a:b] for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)]
        found.append((doc, ids[doc], first, size))
        held += int(size.sum())
        if held >= D.PART_BYTES:
            close()
    close()
    if len(gone):
        rows.append((GONE, bucket, settled[0].astype("<i8").tobytes(), None, *(x.astype("<i8").tobytes() for x in settled[1:]), None, None))
    return R.table(rows, D.STATE)


def _hit(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document (its place in the bucket), first and last start of the strings found, by the passages or by the doubling."""
    rows = answers.filter(pc.equal(answers.column("kind"), D.HIT)).to_pylist()
    if not rows:
        e = np.zeros(0, np.int64)
        return e, e, e
    found = [np.concatenate([np.frombuffer(x[c], "<i8") for x in rows]) for c in ("passages", "checks", "docs")]
    order = np.argsort(found[0], kind="stable")  # the parts' rows come in any order
    return tuple(x[order] for x in found)


def without(raw: bytes, first: list[int], end: list[int]) -> tuple[bytes, int, int]:
    """What is left of raw without the ranges, which may overlap; the bytes removed, and in how many spans."""
    left, removed, spans, upto = [], 0, 0, -1
    for a, b in sorted(zip(first, end, strict=True)):
        if a > upto:
            left.append(raw[max(upto, 0) : a])
            spans += 1
            removed += b - a
            upto = b
        elif b > upto:
            removed += b - upto
            upto = b
    return b"".join((*left, raw[max(upto, 0) :])), removed, spans


def _remove(group: pa.Table, answers: pa.Table, length: int, schema: str | list[str]) -> pa.Table:
    """RESULT rows; or, if schema lists columns, the group's rows with what is left of text."""
    digest = isinstance(schema, str)
    rows: list[tuple] = []
    if not group.num_rows:
        return R.table(rows, RESULT) if digest else group.select(schema)
    group = R.sort_group(group)
    ids, texts = R.in_order(group)
    hit_doc, hit_first, hit_last = _hit(answers)
    lo = np.searchsorted(hit_doc, np.arange(len(ids) + 1)).tolist()
    first, end = hit_first.tolist(), (hit_last + length).tolist()
    left: list[str] = []
    for low, data, start, count in _pieces(texts):
        for i in range(len(count)):
            d = low + i
            raw = data[start[i] : start[i] + count[i]]
            on = slice(lo[d], lo[d + 1])
            removed = spans = 0
            if lo[d] < lo[d + 1]:
                raw, removed, spans = without(raw, first[on], end[on])
            if digest:
                rows.append((None if ids[d] == NO_ID else int(ids[d]), int(count[i]), removed, spans, hashlib.sha256(raw).hexdigest()))
            else:
                left.append(raw.decode(errors="ignore"))
    if digest:
        return R.table(rows, RESULT)
    at = group.schema.get_field_index("text")
    out = group.set_column(at, "text", pa.array(left, group.schema.field("text").type))
    return out.filter(pa.array([x != "" for x in left])).select(schema)


def _resolved(docs: DataFrame, length: int, gram: int, columns: list[str] | None) -> DataFrame:
    size, key = text_bytes(docs), A.secret()
    width = text_width(docs, size)
    more = [c for c in columns or [] if c not in ("doc_id", "text")]
    rest = [F.struct(*more).alias("_rest")] if more else []  # one column, so that no name clashes
    own = bucketed(docs, width, "text", *rest)
    plain = bucketed(docs, width, "text")  # the other columns stay at home until the end
    told = stored(R.passages_told(plain, scheme(length, gram, key), width), "passages")
    pieces = stored(plain.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(
        A.on_groups(lambda a, b: _pieces_of(a, b, length, gram, key)), D.STATE
    ), "pieces")
    gone = stored(pieces.where(F.col("part") == GONE).select(
        "bucket", F.lit(D.HIT).alias("kind"), (F.length("row") / 8).cast("long").alias("n"), F.col("row").alias("passages"), F.col("at").alias("checks"), F.col("size").alias("docs")
    ), "gone")
    forget(told)
    state = pieces.where(F.col("part") != GONE)
    state.folder = pieces.folder
    found = gone.unionByName(D.repeated(state, length, width, size))
    schema = ["doc_id", "text", "_rest"][: 2 + len(rest)] if columns else RESULT
    return own.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(
        A.on_groups(lambda a, b: _remove(a, b, length, schema)), own.select(schema).schema if columns else RESULT
    )


def remove_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    Removed is each byte covered by a string of `length` bytes that also starts in a document with
    a smaller doc_id; strings are judged on the input. Null and empty texts have no bytes. Rows of
    one doc_id are one document as to "smaller", and stay separate rows. Rows without doc_id stand
    before all others, as one document, and keep their null id. An empty table gives none. Columns other than doc_id and text don't matter.
    """
    return _resolved(docs, length, gram, None)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with the removed bytes taken out of text; the columns stay.

    What is left of a cut character is dropped with it. n_chars, if there, is counted anew.
    Documents of which nothing is left go, and so do null texts. Nulls in doc_id as in remove_substrings.
    """
    out = _resolved(docs, length, gram, docs.columns)
    named = {c: F.col("_rest").getField(c) for c in docs.columns} | {
        "doc_id": F.nullif("doc_id", F.lit(NO_ID)).cast(docs.schema["doc_id"].dataType), "text": F.col("text")}
    out = out.select(*[named[c].alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
