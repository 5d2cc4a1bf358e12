"""Media columns: texts as FLAC streams, read back as PCM blocks at seekable sample offsets."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seriesforge.llm import flac
from seriesforge.llm.arrays import calm_malloc
from seriesforge.llm.common import runs

UNIT = 64
#: Bytes that are encoded or decoded side by side.
PART = 3 << 20


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of 64, and the length before that."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def features(samples: np.ndarray) -> tuple[int, int, int, int, int]:
    """Least, greatest, sum, energy and sign changes of PCM samples."""
    x = samples.astype(np.int64)
    return int(x.min()), int(x.max()), int(x.sum()), int((x * x).sum()), int(((x[1:] < 0) != (x[:-1] < 0)).sum())


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


MEDIA = "doc_id long, n_bytes long, media binary"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    calm_malloc()
    for batch in batches:
        texts = batch.column("text")
        for low, high in runs(texts, PART):
            made = [payload(t) for t in texts.slice(low, high - low).to_pylist()]
            s = flac.encode([p for p, _ in made])
            bounds = s.start.tolist()
            media = [s.data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            docs = batch.column("doc_id").slice(low, high - low).to_pylist()
            yield _batch([(d, n, m) for d, (_, n), m in zip(docs, made, media, strict=True)], MEDIA)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of every document: its padded UTF-8 as a FLAC stream of 8-bit samples.

    Null and empty texts are 64 zero bytes. Equal texts give equal streams. Repeated rows and null
    doc_ids stay; an empty table gives none. Only doc_id and text are read. Nothing is shuffled;
    memory follows parts of about 3 MB or one text.
    """
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(_encoded, MEDIA)


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple[int, int, flac.Pcm, list[bytes]]]:
    """Parts of a batch of media: first row, end, what was read back, and the streams."""
    media = batch.column("media")
    for low, high in runs(media, PART):
        streams = media.slice(low, high - low).to_pylist()
        start = np.cumsum([0, *map(len, streams)])
        yield low, high, flac.decode(b"".join(streams), start), streams


DIGESTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    calm_malloc()
    for batch in batches:
        docs, sizes = batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist()
        for low, high, pcm, streams in _decoded(batch):
            count = lambda which: np.bincount(pcm.stream[which], minlength=high - low).tolist()  # noqa: E731, B023
            kinds = zip(count(pcm.kind == 0), count(pcm.kind == 1), count((pcm.kind >= 8) & (pcm.kind < 32)), count(pcm.kind >= 32), strict=True)
            rows = []
            for doc, n, media, p, of in zip(docs[low:high], sizes[low:high], streams, pcm.payloads(), kinds, strict=True):
                lo, hi, total, energy, turns = features(np.frombuffer(p, np.uint8).view(np.int8) ^ np.int8(-128))
                rows.append((
                    doc, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(),
                    f"frames={of[0]}/{of[1]}/{of[2]}/{of[3]};min={lo};max={hi};sum={total};energy={energy};turns={turns}",
                ))
            yield _batch(rows, DIGESTS)


def media_digests(docs: DataFrame) -> DataFrame:
    """One row per document: what is read back from its stored FLAC stream.

    The streams go as a column to the reader, which knows nothing else of them. feature: frames that are constant,
    verbatim, of a fixed and of a linear predictor, and least, greatest, sum, energy and sign changes of the
    samples. Nulls, repeats and empty tables as in encode_media. A stream that fails a check ends the task
    with ValueError.
    """
    return encode_media(docs).mapInArrow(_digests, DIGESTS)


BLOCKS = "doc_id long, block long, sample_offset long, byte_offset long, n_samples long, pcm binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    calm_malloc()
    for batch in batches:
        docs = batch.column("doc_id").to_pylist()
        for low, _, pcm, _ in _decoded(batch):
            at = (pcm.start[pcm.stream] + pcm.sample).tolist()
            rows = [
                (docs[low + i], k // flac.BLOCK, k, byte, n, pcm.data[a : a + n])
                for i, k, byte, n, a in zip(pcm.stream.tolist(), pcm.sample.tolist(), pcm.byte.tolist(), pcm.length.tolist(), at, strict=True)
            ]
            yield _batch(rows, BLOCKS)


def media_blocks(media: DataFrame) -> DataFrame:
    """PCM blocks of encode_media()'s streams: sample_offset and byte_offset of each are its seek point.

    A block can be read by itself: its frame starts at byte_offset in its stream and holds the
    samples from sample_offset on (flac.read_block reads it from the stream alone). Nulls, empty and
    repeated texts as in encode_media.
    """
    return media.select("doc_id", "media").mapInArrow(_blocks, BLOCKS)
