"""FLAC streams of 8-bit mono samples: an encoder and a decoder, in NumPy over many frames at once.

Frames of a whole batch of streams are worked on side by side: step t handles the t-th residual of
every frame, so Python's cost is per step and not per sample.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
RATE, BLOCK = 16_000, 4096

# Fixed values of the format: CRC polynomials, and the fixed predictors' coefficients by order.
CRC8, CRC16 = 0x07, 0x8005
#: A seek point: first sample of a frame, its byte after the metadata, and its number of samples.
POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(bits: int, poly: int) -> np.ndarray:
    c = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        c = np.where(c >> (bits - 1) & 1, (c << 1) ^ poly, c << 1) & ((1 << bits) - 1)
    return c


_T8, _T16 = _crc_table(8, CRC8), _crc_table(16, CRC16)


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> np.ndarray:
    """CRC-8 or CRC-16 of data[start:end] for many ranges at once."""
    table, shift = (_T8, 0) if bits == 8 else (_T16, 8)
    out = np.zeros(len(start), np.uint32)
    length = end - start
    order = np.argsort(-length, kind="stable")
    at, c, n = start[order], np.zeros(len(order), np.uint32), length[order]
    if len(n):
        counts = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), side="right")
        for t, m in enumerate(counts):
            byte = data[at[:m] + t]
            c[:m] = table[(c[:m] >> shift) ^ byte] ^ ((c[:m] << 8) & 0xFFFF if bits == 16 else 0)
    out[order] = c
    return out


class BitReader:
    """Reads up to 57 bits at any bit position of a byte array, for many positions at once."""

    def __init__(self, data: bytes):
        padded = np.frombuffer(data + bytes(16), np.uint8)
        self.words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(padded) - 7, 8), (1, 1))
        self.flat = np.ndarray((len(padded) - 7,), ">u8", padded.data, strides=(1,))

    def window(self, bit: np.ndarray) -> np.ndarray:
        """64-bit values whose upper 57 bits at least start at the given bits."""
        return self.flat[bit >> 3].astype(U64) << (bit & 7).astype(U64)

    def read(self, bit: np.ndarray, count: int | np.ndarray) -> np.ndarray:
        n = np.asarray(count, U64)
        return np.where(n == 0, U64(0), self.window(bit) >> np.where(n == 0, U64(0), U64(64) - n)).astype(np.int64)


def leading_zeros(w: np.ndarray) -> np.ndarray:
    """Of 64-bit values whose upper 53 bits aren't all zero; else 53 or more."""
    top = (w >> U64(11)).astype(np.float64)
    return 1023 + 52 - (top.view(np.int64) >> 52)


def utf8_number(n: int) -> bytes:
    """A frame number in the format's UTF-8-like code, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 5
    while n >= 1 << (room + 1 if not tail else room):
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        room = 6 - len(tail)
        if n < 1 << max(room, 0):
            break
    lead = (0xFF00 >> (len(tail) + 1)) & 0xFF
    return bytes([lead | n, *reversed(tail)])


def read_utf8_number(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    if first < 0x80:
        return first, 1
    size = next(i for i in range(8) if not first >> (7 - i) & 1)
    if size < 2:
        raise ValueError("bad frame number")
    n = first & (0x7F >> size)
    for b in data[at + 1 : at + size]:
        if b >> 6 != 2:
            raise ValueError("bad frame number")
        n = n << 6 | (b & 0x3F)
    return n, size


def fold(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def residuals(x: np.ndarray, coefficients: list[np.ndarray | int], shift: np.ndarray | int = 0) -> np.ndarray:
    """x minus its prediction from the samples before; coefficients by lag, for all samples or for each.

    Values with fewer than len(coefficients) samples of their frame before them mean nothing.
    """
    guess = np.zeros_like(x)
    for j, c in enumerate(coefficients, 1):
        guess[j:] += (c[j:] if isinstance(c, np.ndarray) else c) * x[:-j]
    return x - (guess >> shift)


#: Linear prediction: its order, and bits of a coefficient.
ORDER, PRECISION = 4, 10


def linear(x: np.ndarray, first: np.ndarray, inner: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (frame, lag) as integers and the shift of each frame, by the Levinson-Durbin recursion
    on the autocorrelation of its samples."""
    y = x.astype(np.float64)
    r = [np.add.reduceat(y * y, first)]
    for j in range(1, order + 1):
        product = np.zeros_like(y)
        product[j:] = y[j:] * y[:-j]
        product[inner < j] = 0
        r.append(np.add.reduceat(product, first))
    a = np.zeros((len(first), order))
    error = np.maximum(r[0], 1e-9) * (1 + 1e-9)
    for m in range(order):
        k = r[m + 1] - sum((a[:, j] * r[m - j] for j in range(m)), np.zeros(len(first)))
        k = np.clip(k / error, -0.9999, 0.9999)
        before = a[:, :m].copy()
        a[:, :m] = before - k[:, None] * before[:, ::-1]
        a[:, m] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = np.maximum(np.abs(a).max(1), 1e-3)
    shift = (PRECISION - 2 - np.floor(np.log2(most))).astype(np.int64).clip(0, 14)
    limit = 1 << (PRECISION - 1)
    return np.rint(a * (1 << shift)[:, None]).astype(np.int64).clip(-limit, limit - 1), shift


@dataclass
class Streams:
    """data: the streams, one after another; start: where each begins, and the end of the last."""

    data: bytes
    start: np.ndarray


def encode(payloads: list[bytes], block: int = BLOCK) -> Streams:
    """FLAC streams of payloads (each of one byte at least); samples are bytes minus 128.

    Each frame takes the cheapest of: constant, the fixed predictors of order 0 to 2 or a linear
    predictor of its own with the best Rice parameter, or verbatim. A seek table has every frame.
    """
    sizes = np.array([len(p) for p in payloads], np.int64)
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    per = -(-sizes // block)
    stream = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(len(stream)) - np.repeat(np.cumsum(per) - per, per)
    base = np.repeat(np.cumsum(sizes) - sizes, per)
    first = base + number * block
    length = np.minimum(block, np.repeat(sizes, per) - number * block)
    inner = np.arange(len(x)) - np.repeat(first, length)

    terms, shift = linear(x, first, inner)
    spread = lambda v: np.repeat(v.astype(np.int32), length)
    kinds = [(8 + o, FIXED[o], 0, 0) for o in range(3)]
    kinds.append((31 + ORDER, [spread(terms[:, j]) for j in range(ORDER)], spread(shift), 9 + PRECISION * ORDER))
    chosen = None
    for code, coefficients, down, extra in kinds:  # the predictor with the least estimated bits
        u = fold(residuals(x, coefficients, down))
        order = len(coefficients)
        for j in range(order):
            u[first[length > j] + j] = 0
        total = np.add.reduceat(u, first, dtype=np.int64)
        n = np.maximum(length - order, 1)
        cost = n * (np.log2(np.maximum(0.69 * total / n, 1)) + 1.5) + 8 * order + extra
        if chosen is None:
            chosen, least, kind, sums = u, cost, np.full(len(first), code), total
        else:
            better = (cost < least) & (length > order)
            chosen = np.where(np.repeat(better, length), u, chosen)
            least, kind, sums = np.where(better, cost, least), np.where(better, code, kind), np.where(better, total, sums)
    order = np.where(kind >= 32, kind - 31, kind - 8)
    head = 8 * order + 10 + np.where(kind >= 32, 9 + PRECISION * order, 0)
    likely = np.log2(sums / np.maximum(length - order, 1) * 0.69 + 1e-9).astype(np.int64).clip(0, 13)
    best, rice, coded = 8 * length, np.zeros(len(first), np.int64), np.zeros(len(first), bool)
    for k in (likely, likely + 1):
        bits = np.add.reduceat(chosen >> np.repeat(k.astype(np.int32), length), first, dtype=np.int64) + (length - order) * (k + 1) + head
        win = bits < best
        best, rice, coded = np.where(win, bits, best), np.where(win, k, rice), coded | win
    kind = np.where(coded, kind, 1)
    low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
    kind = np.where(low == high, 0, kind)
    best = np.where(kind == 0, 8, best)

    order = np.select([kind >= 32, kind >= 8], [kind - 31, kind - 8], 0)
    total = (8 + best + 7) // 8  # subframe header and body, in bytes
    heads = []
    for n, count in zip(number.tolist(), length.tolist(), strict=True):
        heads.append(b"\xff\xf8\x70\x02" + utf8_number(n) + (count - 1).to_bytes(2, "big"))
    head_size = np.array([len(h) + 1 for h in heads], np.int64)
    frame_size = head_size + total + 2
    stream_head = 46 + POINT.itemsize * per  # the signature, stream information and the seek table
    frames_of = np.bincount(stream, frame_size, len(sizes)).astype(np.int64)
    start = np.cumsum(stream_head + frames_of) - (stream_head + frames_of)
    before = np.cumsum(frame_size) - frame_size
    at = before + np.cumsum(stream_head)[stream]
    out = np.zeros(int((stream_head + frames_of).sum()), np.uint8)

    joined = np.frombuffer(b"".join(heads), np.uint8)
    own = head_size - 1
    out[np.repeat(at, own) + np.arange(len(joined)) - np.repeat(np.cumsum(own) - own, own)] = joined
    out[at + own] = crcs(out, at, at + own, 8)
    body = at + head_size
    out[body] = kind << 1
    same = kind == 0
    out[body[same] + 1] = x[first[same]] & 0xFF
    kind_of, order_of = np.repeat(kind, length), np.repeat(order, length)
    raw = (kind_of == 1) | ((kind_of >= 8) & (inner < order_of))  # whole bytes right after the header
    out[np.repeat(body + 1, length)[raw] + inner[raw]] = x[raw] & 0xFF

    bit = (body + 1 + order) * 8
    own = np.flatnonzero(kind >= 32)
    _put(out, bit[own], np.full(len(own), PRECISION - 1), 4)
    _put(out, bit[own] + 4, shift[own], 5)
    for j in range(ORDER):
        _put(out, bit[own] + 9 + j * PRECISION, terms[own, j] & ((1 << PRECISION) - 1), PRECISION)
    bit[own] += 9 + PRECISION * order[own]
    coded = kind >= 8
    _put(out, bit[coded] + 6, rice[coded], 4)  # method 0 and partition order 0: six zero bits
    coded_of = (kind_of >= 8) & (inner >= order_of)
    k_of = np.repeat(rice, length)[coded_of]
    u = chosen[coded_of].astype(np.int64)
    width = (u >> k_of) + 1 + k_of
    ends = np.cumsum(width)
    counts = np.where(coded, length - order, 0)
    opened = np.concatenate(([0], ends))[np.cumsum(counts) - counts]
    finish = ends - np.repeat(opened, counts) + np.repeat(bit + 10, counts)
    _put(out, finish - 1 - k_of, (1 << k_of) | (u & ((1 << k_of) - 1)), k_of + 1)

    foot = at + frame_size - 2
    check = crcs(out, at, foot, 16)
    out[foot], out[foot + 1] = check >> 8, check & 0xFF

    opens = np.cumsum(per) - per
    large, small = np.maximum.reduceat(frame_size, opens), np.minimum.reduceat(frame_size, opens)
    points = np.zeros(len(stream), POINT)
    points["sample"], points["offset"], points["count"] = number * block, at - at[np.repeat(opens, per)], length
    for i, p in enumerate(payloads):
        table = points[opens[i] : opens[i] + per[i]].tobytes()
        info = (
            b"fLaC\x00\x00\x00\x22" + block.to_bytes(2, "big") * 2 + int(small[i]).to_bytes(3, "big") + int(large[i]).to_bytes(3, "big")
            + (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big")
            + hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes(), usedforsecurity=False).digest()
            + b"\x83" + len(table).to_bytes(3, "big") + table
        )
        out[start[i] : start[i] + len(info)] = np.frombuffer(info, np.uint8)
    return Streams(out.tobytes(), np.append(start, len(out)))


def _put(out: np.ndarray, bit: np.ndarray, value: np.ndarray, width: int | np.ndarray) -> None:
    """Set the bits of values of up to 16 bits, at bits of out that are still zero."""
    if not len(bit):
        return
    v = value.astype(np.int64) << (24 - np.asarray(width) - (bit & 7))
    byte = bit >> 3
    low = int(byte.min())
    n = int(byte.max()) - low + 3
    for j, shift in enumerate((16, 8, 0)):
        bits = (v >> shift) & 0xFF
        some = np.flatnonzero(bits) if j == 2 else slice(None)
        part = np.bincount(byte[some] - (low - j), bits[some], n).astype(np.uint8)
        out[low : low + n] |= part[: len(out) - low]


@dataclass
class Pcm:
    """Samples read back, as bytes: data, and each stream's part of it. Of every frame: its stream, first
    sample, number of samples, byte in its stream and kind of predictor."""

    data: bytes
    start: np.ndarray
    stream: np.ndarray
    sample: np.ndarray
    length: np.ndarray
    byte: np.ndarray
    kind: np.ndarray

    def payloads(self) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.start[:-1].tolist(), self.start[1:].tolist(), strict=True)]


def contents(data: bytes, s: int, end: int) -> tuple[int, bytes, np.ndarray, int]:
    """Of the stream at data[s:end]: its number of samples, MD5, seek points and where its frames begin."""
    if data[s : s + 4] != b"fLaC" or data[s + 4] & 0x7F or data[s + 5 : s + 8] != b"\x00\x00\x22":
        raise ValueError("not a stream")
    total = int.from_bytes(data[s + 18 : s + 26], "big") & ((1 << 36) - 1)
    points, at, last = np.zeros(0, POINT), s + 42, data[s + 4] >> 7
    while not last:
        kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        last = data[at] >> 7
        if at + 4 + size > end:
            raise ValueError("metadata reach past the stream")
        if kind == 3:
            points = np.frombuffer(data, POINT, size // POINT.itemsize, at + 4)
        at += 4 + size
    if total and (not len(points) or points["sample"][0] or points["offset"][0]):
        raise ValueError("no seek table from the first frame on")
    return total, data[s + 26 : s + 42], points, at


def decode(data: bytes, start: np.ndarray) -> Pcm:
    """The samples of the streams data[start[i]:start[i + 1]], from these bytes alone.

    Frames are found by each stream's seek table; every frame's CRCs, numbers and lengths and every
    stream's MD5 are verified. Raises ValueError for anything amiss.
    """
    found = [contents(data, s, e) for s, e in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
    per = np.array([len(f[2]) for f in found], np.int64)
    stream = np.repeat(np.arange(len(found)), per)
    points = np.concatenate([f[2] for f in found]) if found else np.zeros(0, POINT)
    begin = np.repeat(np.array([f[3] for f in found], np.int64), per) + points["offset"].astype(np.int64)
    last = np.append(stream[1:] != stream[:-1], True) if len(stream) else np.zeros(0, bool)
    end = np.where(last, start[1:][stream], np.append(begin[1:], len(data))) if len(stream) else begin
    x, length, number, kind = frames(data, begin, end)
    sample = points["sample"].astype(np.int64)
    want = np.array([f[0] for f in found], np.int64)
    opens = np.repeat(np.cumsum(per) - per, per)
    before = np.cumsum(length) - length
    if (length != points["count"]).any() or (number != np.arange(len(stream)) - opens).any() or (before - before[opens] != sample).any():
        raise ValueError("frames aren't where the seek table has them")
    if (np.bincount(stream, length, len(found)).astype(np.int64) != want).any():
        raise ValueError("samples are missing")
    upto = np.concatenate(([0], np.cumsum(want)))
    for i, (_, md5, _, _) in enumerate(found):
        if hashlib.md5((x[upto[i] : upto[i + 1]] ^ 0x80).tobytes(), usedforsecurity=False).digest() != md5:
            raise ValueError("a stream's MD5 is wrong")
    return Pcm(x.tobytes(), upto, stream, sample, length, begin - start[:-1][stream], kind)


def read_block(stream: bytes, sample: int) -> tuple[int, bytes]:
    """Of one stream: the first sample of the frame that holds a sample, and that frame's samples. Only
    that frame is read."""
    total, _, points, at = contents(stream, 0, len(stream))
    if not 0 <= sample < total:
        raise ValueError("no such sample")
    f = int(np.searchsorted(points["sample"].astype(np.int64), sample, side="right")) - 1
    bounds = np.append(points["offset"].astype(np.int64) + at, len(stream))
    return int(points["sample"][f]), frames(stream, bounds[f : f + 1], bounds[f + 1 : f + 2])[0].tobytes()


def frames(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Samples (as bytes) of the frames at data[begin:end], one after another; each one's number of samples,
    number and kind."""
    a = np.frombuffer(data, np.uint8)
    n_frames = len(begin)
    if n_frames and ((end <= begin + 8).any() or begin.min() < 0 or end.max() > len(data)):
        raise ValueError("a frame is cut off")
    length, body, number = np.zeros(n_frames, np.int64), np.zeros(n_frames, np.int64), np.zeros(n_frames, np.int64)
    for f, s in enumerate(begin.tolist()):
        if data[s : s + 2] != b"\xff\xf8" or data[s + 2] >> 4 != 7 or data[s + 3] != 2:
            raise ValueError("not a frame of this kind")
        n, size = read_utf8_number(data, s + 4)
        length[f] = int.from_bytes(data[s + 4 + size : s + 6 + size], "big") + 1
        body[f], number[f] = s + 7 + size, n
    if (crcs(a, begin, body - 1, 8) != a[body - 1]).any():
        raise ValueError("a frame header's CRC-8 is wrong")
    foot = end - 2
    if (crcs(a, begin, foot, 16) != (a[foot].astype(np.uint32) << 8 | a[foot + 1])).any():
        raise ValueError("a frame's CRC-16 is wrong")

    reader = BitReader(data)
    kind = a[body].astype(np.int64) >> 1
    order = np.select([kind >= 32, (kind >= 8) & (kind <= 12)], [kind - 31, kind - 8], 0)
    if not ((kind < 2) | ((kind >= 8) & (kind <= 12)) | (kind >= 32)).all():
        raise ValueError("unknown kind of subframe")
    offset = np.cumsum(length) - length
    x = np.zeros(int(length.sum()), np.int64)
    inner = np.arange(len(x)) - np.repeat(offset, length)
    kind_of, order_of = np.repeat(kind, length), np.repeat(order, length)
    raw = (kind_of == 1) | ((kind_of >= 8) & (inner < order_of))
    x[raw] = a[np.repeat(body + 1, length)[raw] + inner[raw]].view(np.int8)
    same = kind_of == 0
    x[same] = a[np.repeat(body + 1, length)[same]].view(np.int8)

    bit = (body + 1 + order) * 8
    own = np.flatnonzero(kind >= 32)
    most = int(order[own].max()) if len(own) else 0
    terms, shift = np.zeros((n_frames, most), np.int64), np.zeros(n_frames, np.int64)
    if len(own):
        precision = reader.read(bit[own], 4) + 1
        shift[own] = reader.read(bit[own] + 4, 5)
        for j in range(most):
            has = order[own] > j
            v = reader.read(bit[own] + 9 + j * precision, precision)
            terms[own, j] = np.where(has, v - ((v >> (precision - 1) & 1) << precision), 0)
        bit[own] += 9 + precision * order[own]
    coded = np.flatnonzero(kind >= 8)
    if len(coded):
        if (reader.read(bit[coded], 2) != 0).any():
            raise ValueError("unknown Rice method")
        depth = reader.read(bit[coded] + 2, 4)
        _rice(reader, x, coded, bit[coded] + 6, depth, length, order, offset)
    _restore(x, kind, order, offset, length, shift, terms)
    if len(x) and (x.min() < -128 or x.max() > 127):
        raise ValueError("a sample is out of range")
    return (x + 128).astype(np.uint8), length, number, kind


def _rice(reader: BitReader, x: np.ndarray, coded: np.ndarray, bit: np.ndarray, depth: np.ndarray, length: np.ndarray, order: np.ndarray, offset: np.ndarray) -> None:
    """Fill x with the residuals of the coded frames, step by step over all of them."""
    parts = 1 << depth
    per = length[coded] >> depth
    by = np.argsort(-(length[coded] - order[coded]), kind="stable")
    frame, parts, per = coded[by], parts[by], per[by]
    todo = length[frame] - order[frame]
    pos = bit[by].copy()
    k = np.zeros(len(frame), np.int64)
    raw = np.zeros(len(frame), np.int64)  # bits of each residual in an escaped partition, else 0
    until = np.zeros(len(frame), np.int64)  # residuals up to the partition's end
    part = np.zeros(len(frame), np.int64)
    to = offset[frame] + order[frame]
    counts = np.searchsorted(-todo, -np.arange(1, int(todo[0]) + 1), side="right") if len(todo) else []
    change, any_raw = 0, False
    for t, n in enumerate(counts):
        if t >= change:
            while len(new := np.flatnonzero((until[:n] == t) & (part[:n] < parts[:n]))):
                k[new] = reader.read(pos[new], 4)
                pos[new] += 4
                escaped = new[k[new] == 15]
                raw[new] = 0
                if len(escaped):
                    raw[escaped] = reader.read(pos[escaped], 5) + 64  # 64 marks an escape, width 0 included
                    pos[escaped] += 5
                until[new] += per[new] - np.where(part[new] == 0, order[frame[new]], 0)
                part[new] += 1
            any_raw = bool(raw.any())
            change = int(until[:n].min())
        p = pos[:n]
        w = reader.window(p)
        zeros = leading_zeros(w)
        kk = k[:n]
        long = np.flatnonzero(zeros + kk >= 48)
        if len(long) and any_raw:
            long = long[raw[:n][long] == 0]
        if len(long):
            zeros, w = zeros.copy(), w.copy()
            for i in long.tolist():  # a long run of zeros: count it by itself
                q = 0
                while (z := int(leading_zeros(reader.window(p[i : i + 1] + q))[0])) >= 50:
                    q += 48
                zeros[i] = q + z
                w[i] = reader.window(p[i : i + 1] + q + z + 1)[0] >> U64(1 if q + z < 63 else 0)
            u = np.where(kk == 0, zeros, 0)
            low = reader.read(p + zeros + 1, kk)
            u = zeros << kk | low
        else:
            rest = (w << zeros.astype(U64)) << U64(1)
            u = zeros << kk | ((rest >> U64(1)) >> (U64(63) - kk.astype(U64))).astype(np.int64)
        value = (u >> 1) ^ -(u & 1)
        step = zeros + 1 + kk
        if any_raw and (esc := np.flatnonzero(raw[:n])).size:
            width = raw[esc] - 64
            v = reader.read(p[esc], width)
            value[esc] = np.where(width == 0, 0, v - ((v >> np.maximum(width - 1, 0) & 1) << width))
            step[esc] = width
        x[to[:n] + t] = value
        pos[:n] += step


def _restore(x: np.ndarray, kind: np.ndarray, order: np.ndarray, offset: np.ndarray, length: np.ndarray, shift: np.ndarray, terms: np.ndarray) -> None:
    """Residuals to samples: fixed predictors by repeated sums, linear ones step by step."""
    for o in range(1, 5):
        frames = np.flatnonzero(kind == 8 + o)
        if not len(frames):
            continue
        n = length[frames]
        index = np.repeat(offset[frames] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        v, first = x[index], np.cumsum(n) - n
        start = np.zeros(len(v), np.int64)
        warm = [v[first + j].copy() for j in range(o)]
        level = [np.array(warm)]
        for _ in range(o - 1):
            level.append(np.diff(level[-1], axis=0))
        inner = np.arange(len(v)) - np.repeat(first, n)
        v[inner < o] = 0
        for d in range(o - 1, -1, -1):  # v holds differences of order d + 1 from place d + 1 on
            v[first + d] = level[d][0]
            total = np.cumsum(v)
            start = np.repeat(np.where(first > 0, total[first - 1], 0), n)
            v = total - start
            v[inner < d] = 0
        x[index] = v
    own = np.flatnonzero(kind >= 32)
    if len(own):
        own = own[np.argsort(-length[own], kind="stable")]  # the frames left at each step stand first
        counts = np.searchsorted(-length[own], -np.arange(int(length[own[0]])), side="left")
        depth, base, down = order[own], offset[own], shift[own]
        c = [np.ascontiguousarray(terms[own, j]) for j in range(terms.shape[1])]
        for t in range(1, len(counts)):
            n = int(counts[t])
            at = base[:n] + t
            guess = np.zeros(n, np.int64)
            for j in range(min(len(c), t)):
                guess += c[j][:n] * x[at - 1 - j]
            ready = depth[:n] <= t
            x[at] += np.where(ready, guess >> down[:n], 0)
