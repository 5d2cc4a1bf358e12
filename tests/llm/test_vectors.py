import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.llm import codebooks, queries, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int, n long, error long, embedding_2 string"


def made(spark, rows):
    return spark.createDataFrame([(i, v, y, "c", 1, 2, 3, "e") for i, v, y in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, non-finite entries, other lengths, repeated rows and ids, equal vectors, null ids and labels, ties of distance."""
    rng = random.Random(5)
    draw = lambda: [rng.gauss(0, 1) for _ in range(16)]
    rows = [(i, draw(), rng.choice([0, 1, None])) for i in range(70)]
    rows += [(100 + i, list(rows[3][1]), 2) for i in range(40)]  # copies
    rows += [(200 + i, [rng.choice([-1.0, 0.0, 1.0]) / 4096 for _ in range(16)], None) for i in range(60)]  # small integers: many ties
    rows += [rows[5], rows[5], (5, draw(), 1), (None, draw(), 1), (None, None, 1)]
    rows += [(300, None, 1), (301, [], 1), (302, [1.0] * 15 + [None], 1), (303, [float("nan")] * 16, 1), (304, [float("inf")] * 16, 1), (305, [1.0] * 8, 1)]
    return made(spark, rows)


def good(df):
    """(vec_id, vector as doubles, label) of the rows that count, by the contract."""
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    return [r for r in rows if r[1] is not None and len(r[1]) == 16 and all(x is not None and math.isfinite(x) for x in r[1])]


def plain_codes(rows, entries=16, parts=8, rounds=6):
    """Lloyd's rounds without bounds, in Python's integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = [[math.floor(4096 * x) for x in r[1]] for r in rows]
    width = len(v[0]) // parts
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for x in v]
    books = [[cut[i][p] for i in range(min(entries, len(rows)))] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, p: min(range(len(books[p])), key=lambda c: (dist(x, books[p][c]), c))
    for _ in range(rounds):
        codes = [[nearest(x[p], p) for p in range(parts)] for x in cut]
        for p in range(parts):
            for c in range(len(books[p])):
                if own := [x[p] for x, code in zip(cut, codes, strict=True) if code[p] == c]:
                    books[p][c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    codes = [[nearest(x[p], p) for p in range(parts)] for x in cut]
    error = [sum(dist(x[p], books[p][code[p]]) for p in range(parts)) for x, code in zip(cut, codes, strict=True)]
    label = {}
    for r, e in zip(rows, error, strict=True):
        label[r[2]] = label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in code), e, label[r[2]], digest) for r, code, e in zip(rows, codes, error, strict=True)]


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


@pytest.mark.parametrize("partitions", [1, 7])
def test_codes_equal_plain_rounds(odd, partitions):
    got = codebooks.compressed(odd.repartition(partitions)).collect()
    assert in_order(got) == in_order(plain_codes(good(odd)))


def test_codes_of_few_rows(spark, odd):
    few = made(spark, [(2, [0.5] * 16, 1), (1, [-0.25] * 16, None), (3, [0.5] * 16, 1)])
    assert in_order(codebooks.compressed(few).collect()) == in_order(plain_codes(good(few)))
    assert codebooks.compressed(odd.limit(0)).count() == 0
    assert codebooks.compressed(odd.filter("embedding IS NULL")).count() == 0
    with pytest.raises(Exception, match="not supported"):
        codebooks.compressed(made(spark, [(1, [3e30] * 16, 1)])).count()


def test_bounds_prune_and_lose_nothing():
    """On clustered parts most distances are pruned, and the codes are those of full search."""
    rng = np.random.default_rng(3)
    centre = rng.integers(-9000, 9000, (16, 8))
    x = centre[rng.integers(0, 16, 4000)] + rng.integers(-300, 300, (4000, 8))
    books = centre[None] + rng.integers(-200, 200, (1, 16, 8))
    zero = np.zeros((1, 16))
    code, upper, lower, near = codebooks.assign(x, codebooks.Step(books, zero, True, False), 0, None, None, None)
    measured, plain = [], codebooks.squares
    for last in (False, True):
        moved = books + rng.integers(-20, 20, books.shape)
        shift = np.sqrt(plain(moved, books).astype(float)) * (1 + codebooks.SLACK)
        codebooks.squares = lambda a, b: (measured.append(len(a)) if a.ndim == 2 else None, plain(a, b))[1]
        try:
            code, upper, lower, near = codebooks.assign(x, codebooks.Step(moved, shift, False, last), 0, code, upper, lower)
        finally:
            codebooks.squares = plain
        exact = np.stack([plain(x, c) for c in moved[0]], 1)
        assert (code == exact.argmin(1)).all()
        assert (upper >= np.sqrt(exact[np.arange(len(x)), code])).all() and (lower <= np.sqrt(exact)).all()
        books = moved
    assert (near == exact.min(1)).all()
    assert sum(measured) < 2 * 0.25 * 16 * len(x)


def test_codes_sql_on_given_table(spark, sf):
    got = queries.QUERIES["op12_vector_codes"](spark, sf)
    want = plain_codes_64(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert in_order(got.collect()) == in_order(want)


def plain_codes_64(df):
    return plain_codes([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])


def plain_whitening(rows, components=16):
    x = [[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in rows]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    c = np.array([[(n * a - b) / n for a, b in zip(v, s, strict=True)] for v in fit])
    cov = c.T @ c / n
    e, w = np.linalg.eigh(cov)
    order = np.argsort(-e)[:components]
    dev = [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    mine = np.array([[(n * a - b) / n for a, b in zip(v, s, strict=True)] for v in x])
    return n, dev, mine @ w[:, order] / np.sqrt(e[order]), e[order] / np.trace(cov)


def test_whitening_equals_plain_model(odd):
    rows = good(odd)
    n, dev, white, explained = plain_whitening(rows)
    got = whitening.whitened(odd).collect()
    assert len(got) == 16 * len(rows) and {r["n"] for r in got} == {n}
    assert {r["identity_error"] for r in got} and max(r["identity_error"] for r in got) < 1e-6
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    sign = {}
    for (vec, _, _), d, w in zip(rows, dev, white, strict=True):
        own = by[vec, d]
        for k in range(1, 17):
            assert abs(own[k][0]["explained"] / explained[k - 1] - 1) < 1e-4
            if abs(w[k - 1]) > 1e-3:
                s = sign.setdefault(k, np.sign(own[k][0]["whitened"] * w[k - 1]))
                assert abs(s * own[k][0]["whitened"] - w[k - 1]) < 1e-5 * (1 + abs(w[k - 1]))


def test_whitening_with_few_directions(spark, odd):
    rng = np.random.default_rng(1)
    flat = (rng.normal(size=(90, 3)) @ rng.normal(size=(3, 16))).tolist()
    got = whitening.whitened(made(spark, [(i, [round(x * 64) / 64 if j < 2 else 0.5 for j, x in enumerate(v)], 0) for i, v in enumerate(flat)]))
    assert sorted({r["component"] for r in got.collect()}) == [1, 2]
    assert got.agg(F.max("identity_error")).first()[0] < 1e-9
    assert whitening.whitened(made(spark, [(1, [0.5] * 16, 1), (2, [0.5] * 16, 1)])).count() == 0
    assert whitening.whitened(odd.limit(0)).count() == 0


def test_deviation_past_64_bits(spark):
    far = made(spark, [(i, [(-1.0) ** i * 4e6] * 16, 0) for i in range(40)] + [(50 + i, [float(i + j) for j in range(16)], 0) for i in range(400)])
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(far).filter("component = 1").collect()}
    assert got[0] is None and got[60] is not None


def test_scaled_rounds_down():
    assert vectors.scaled(np.array([[-0.0001, 0.5, -1.0]]), 4096).tolist() == [[-1, 2048, -4096]]
