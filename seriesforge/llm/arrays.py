"""NumPy kernels over whole batches of texts: words, hashes, winnowing. No Spark here."""

from __future__ import annotations

import hashlib
import secrets
from functools import lru_cache

import numpy as np

U64 = np.uint64
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over the whole value."""
    h = h ^ (h >> U64(33))
    h *= _M1
    h ^= h >> U64(33)
    h *= _M2
    h ^= h >> U64(33)
    return h


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. n - 1, modulo 2 ** 64."""
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 1 << 16), _BASE, U64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers[:n]


#: Words of more bytes than this are hashed one by one.
LONG_WORD = 512
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)


def secret() -> bytes:
    """A key for one query's hashes. The driver draws it and the tasks get it with their functions, so that all of them agree."""
    return secrets.token_bytes(32)


@lru_cache(maxsize=16)
def coefficients(key: bytes) -> np.ndarray:
    """Random 64-bit multipliers drawn from a key: two for each 32 bits of a word, and two for its length."""
    n = LONG_WORD // 4 + 1
    raw = b"".join(hashlib.blake2b(i.to_bytes(4, "little"), key=key).digest() for i in range(-(-2 * n * 8 // 64)))
    return np.frombuffer(raw, U64)[: 2 * n].reshape(2, n)


def words(data: bytes | np.ndarray, lower: bool = False, key: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 data, and a 64-bit hash of each word's bytes.

    The hash is two sums of random multiples of the word's 32-bit pieces and its length, modulo 2 ** 64, of which the upper
    halves are kept: under a secret() key any two words share it with a chance of 2 ** -64, whoever chose
    them. Words of over LONG_WORD bytes get a keyed cryptographic hash. Without a key the multipliers are fixed.
    """
    a = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[a], [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.zeros(0, U64)
    padded = np.zeros(len(a) + 8, np.uint8)
    padded[: len(a)] = _LOWER[a] if lower else a
    eight = np.ndarray((len(a) + 1,), "<u8", padded.data, strides=(1,))
    width = end - start
    shorter = (LONG_WORD + 1 - np.minimum(width, LONG_WORD + 1)).astype(np.uint16)  # 16 bits are sorted by counting
    order = np.argsort(shorter, kind="stable")
    at, left = start[order], width[order]
    first = int(np.count_nonzero(width > LONG_WORD))
    long = [int.from_bytes(hashlib.blake2b(padded[i : i + n].tobytes(), digest_size=8, key=key).digest(), "little") for i, n in zip(at[:first].tolist(), left[:first].tolist(), strict=True)]
    at, left = at[first:], left[first:]
    one, two = coefficients(key)
    size = left.astype(U64)
    x, y = size * one[-1], size * two[-1]
    n, j = len(at), 0
    while n:
        lane = eight[at[:n] + j] & _KEEP[np.minimum(left[:n] - j, 8)]
        low, high = lane & U64(0xFFFFFFFF), lane >> U64(32)
        k = j // 4
        x[:n] += low * one[k] + high * one[k + 1]
        y[:n] += low * two[k] + high * two[k + 1]
        j += 8
        n = int(np.searchsorted(-left, -j, side="left"))
    h = np.empty(len(start), U64)
    h[order[:first]] = np.array(long, U64)
    h[order[first:]] = (x & U64(0xFFFFFFFF00000000)) | (y >> U64(32))
    return start, end, h


def grams(v: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of k consecutive values, in log2(k) passes; none if there are fewer.

    A gram of 2m values is one of m, times a power, plus the next of m. Bytes are taken up four at a time, each four as one value,
    if k is a multiple of 4.
    """
    n = len(v) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    step = 1
    if v.dtype == np.uint8 and k % 4:
        v = v.astype(U64) + U64(1)
    elif v.dtype == np.uint8:
        v, k, step = np.ndarray((len(v) - 3,), "<u4", np.ascontiguousarray(v).data, strides=(1,)).astype(U64), k // 4, 4
    p = powers(k + 1)
    part, size, out, done = v, 1, None, 0
    while True:
        if k & size:  # this part joins the gram on its right
            if out is None:
                out = part[:n].copy() if done + size < k else part[:n]
            else:
                out *= p[size]
                out += part[done * step : done * step + n]
            done += size
        if done == k:
            return out
        longer = part[: -size * step] * p[size]
        longer += part[size * step :]
        part = longer
        size *= 2


def sliding_least(g: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values; none if there are fewer."""
    if len(g) < w:
        return np.zeros(0, g.dtype)
    size = 1
    while size < w:
        step = min(size, w - size)
        g = np.minimum(g[:-step], g[step:])
        size += step
    return g


def pieces(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spread hashes of values[start:end] for many ranges, by prefix sums; the length counts too.

    (S[e] - S[s]) / BASE**s, where S sums value * BASE**i.
    """
    p = powers(len(values) + 1)
    total = np.concatenate((np.zeros(1, U64), np.cumsum(values * p[: len(values)], dtype=U64)))
    return mix((total[end] - total[start]) * inverse_powers(len(values) + 1)[start] + (end - start).astype(U64) * _M2)


_inverse = pow(_BASE, -1, 1 << 64)
_inverses = np.ones(1, U64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        p = np.full(max(n, 1 << 16), _inverse, U64)
        p[0] = 1
        _inverses = np.multiply.accumulate(p)
    return _inverses[:n]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... count[i] values each, one after another."""
    if not len(start):
        return np.zeros(0, np.int64)
    total = np.cumsum(count)
    return np.arange(int(total[-1])) + np.repeat(start - (total - count), count)


@lru_cache(maxsize=1)
def _libc():
    import ctypes

    try:
        libc = ctypes.CDLL(None)
        return libc if hasattr(libc, "mallopt") and hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


def calm_malloc() -> None:
    """Keep freed arrays of up to 16 MB in the process instead of giving their pages back (glibc; else nothing)."""
    if libc := _libc():
        libc.mallopt(-3, 1 << 24)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 3 << 26)  # M_TRIM_THRESHOLD: about what a part of a text needs


def give_back() -> None:
    """Freed memory goes back to the system: a worker that waits for its next task holds none."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def on_group(f):
    """f for a group's Arrow table, keeping freed memory while it runs and giving it back at its end."""

    def run(group):
        calm_malloc()
        try:
            return f(group)
        finally:
            give_back()

    return run


def on_groups(f):
    """As on_group(), for the tables of two sides."""

    def run(left, right):
        calm_malloc()
        try:
            return f(left, right)
        finally:
            give_back()

    return run


def on_batches(f):
    """As on_group(), for an iterator of record batches."""

    def run(batches):
        calm_malloc()
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def pack_ascending(x: np.ndarray) -> bytes:
    """Ascending 64-bit values as the first one and their differences, in 2, 4 or 8 bytes each."""
    d = np.diff(x)
    most = int(d.max()) if len(d) else 0
    size = 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([size]) + x[:1].astype(U64).tobytes() + d.astype(f"u{size}").tobytes()


def unpack_ascending(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, U64)
    d = np.frombuffer(data, f"u{data[0]}", offset=9)[: n - 1].astype(U64)
    return np.cumsum(np.concatenate((np.frombuffer(data, U64, 1, 1), d)), dtype=U64)


def by_small(x: np.ndarray, most: int) -> np.ndarray:
    """The stable order of numbers below `most`; up to 16 bits are sorted by counting."""
    return np.argsort(x.astype(np.uint16) if most <= 1 << 16 else x, kind="stable")


def same_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs (a, b) stand together, and where in it the next pair begins.

    Pairs are sorted by one value made of both, which is as good as both where no two unequal pairs share it; else by both.
    """
    order = np.argsort(mix(a) ^ b)
    x, y = a[order], b[order]
    new = np.ones(len(order), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    one = mix(x) ^ y
    if bool((new[1:] & (one[1:] == one[:-1])).any()):
        order = np.lexsort((b, a))
        new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    return order, np.flatnonzero(new)


def places(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each x its place in sorted_values, and whether it is there."""
    if not len(sorted_values):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return at, sorted_values[at] == x


class Among:
    """Ascending values to look others up in. A table of the low bits of spread values spares most of the others a search."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.low = U64((1 << min(23, max(10, (8 * len(values)).bit_length()))) - 1)
        self.table = np.zeros(int(self.low) + 1, bool)
        self.table[values & self.low] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of x are there, by their places in x, and their places in the values."""
        on = np.flatnonzero(self.table[x & self.low])
        at, there = places(self.values, x[on])
        return on[there], at[there]

    def has(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        out[self.find(x)[0]] = True
        return out


def twice(x: np.ndarray) -> np.ndarray:
    """Which of some spread values occur twice or more in x."""
    s = np.sort(x)
    return Among(s[1:][s[1:] == s[:-1]]).has(x)


def equal_runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the runs of equal values in x."""
    if not len(x):
        return []
    edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))).tolist()
    return list(zip(edge[:-1], edge[1:], strict=True))


def key_shift(width: int) -> np.uint64:
    """Keys sent between `width` buckets keep so many upper bits that about one in thirty meets
    another by chance, whatever the width."""
    return U64(64 - min(64, 26 + width.bit_length()))
