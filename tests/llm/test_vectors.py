"""Whitening and vector codes against brute force, with odd rows of every kind."""

import hashlib
import math
import random

import numpy as np
import pytest

from civicloom.llm import eigen, vector_codes, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, v int, q int, row string, kept int, dim int, part int, key string, _label string"


def table(spark, rows):
    """Vectors beside columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, y, "x", 1, 2, "r", 3, 4, 5, "k", "l") for i, v, y in rows], SCHEMA)


def odd_rows(seed=3, dims=(8,), n=300):
    rnd = random.Random(seed)
    rows = []
    for dim in dims:
        centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
        for _ in range(n + dim):
            c = rnd.choice(centres)
            rows.append([float(np.float32(x + rnd.gauss(0, 0.2))) for x in c])
    rows = [(i * 3 % 1009, v, rnd.choice([None, 1, 2])) for i, v in enumerate(rows)]
    rows += [rows[5]] * 40 + [(None, rows[7][1], 1), (5000, rows[8][1], None), (5000, rows[9][1], None)]
    bad = [(1, None, 1), (2, [math.nan] * 8, 1), (3, [1.0, None] + [0.0] * 6, None), (4, [math.inf] * 8, 2), (None, None, None)]
    rows += bad
    rnd.shuffle(rows)
    return rows


def good(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def key(r):
    return str(tuple(r))


def test_eigenpairs():
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    close = turn @ np.diag([7.0] * 5 + [3 + 1e-7, 3, 3 - 1e-7, *rng.random(32)]) @ turn.T
    some = [(lambda a: a @ a.T)(rng.standard_normal((d, 2 * d))) for d in (1, 2, 3, 9, 64)]
    for a in [*some, (close + close.T) / 2, np.eye(12), np.ones((9, 9)), np.zeros((9, 9)), np.array([[3.0, -3, 0], [-3, 3, 0], [0, 0, 0]]), np.diag([5.0, 5, 1, 1, 0, 0, 0, 0, 0])]:
        k = min(8, len(a))
        values, vectors = eigen.leading(a, k)
        size = max(np.abs(a).max(), 1e-200)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:k]).max() <= 1e-13 * size * len(a)
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * size * len(a)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() <= 1e-13


def test_sturm_counts():
    rng = np.random.default_rng(1)
    diagonal, off = rng.standard_normal(30), rng.standard_normal(29)
    full = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    at = np.linspace(-4, 4, 50)
    assert eigen.below(diagonal, off, at).tolist() == [(np.linalg.eigvalsh(full) < x).sum() for x in at]


@pytest.mark.parametrize("dims", [(8,), (8, 3, 12)])
def test_whitening(spark, dims):
    rows = odd_rows(dims=dims) + [(77, [], 1)]
    got = whitening.report(table(spark, rows)).toPandas()
    want = 0
    for dim in dims:
        own = [r for r in good(rows) if len(r[1]) == dim]
        x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in r[1]] for r in own])
        n, sums = len(x), x.sum(axis=0)
        c = x - sums / n
        v = c.T @ c / n
        e, u = np.linalg.eigh(v)
        k = min(8, dim)
        e, u = e[::-1][:k], u[:, ::-1][:, :k]
        exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
        part = got[got.n == n]
        want += n * k
        assert len(part) == n * k and set(part.component) == set(range(1, k + 1))
        assert np.allclose(sorted(set(part.explained), reverse=True), e / np.trace(v), rtol=1e-10)
        assert part.identity_error.max() < 1e-9
        assert sorted(part[part.component == 1].deviation.astype(int)) == sorted(exact)
        white = (c @ u) / np.sqrt(e)
        for j in range(k):
            found = sorted(zip(part[part.component == j + 1].deviation.astype(int), part[part.component == j + 1].whitened.abs()))
            assert np.allclose([w for _, w in found], [w for _, w in sorted(zip(exact, np.abs(white[:, j])))], atol=1e-8)
    assert len(got) == want


def test_whitening_of_nothing(spark):
    assert whitening.report(table(spark, [])).count() == 0
    assert whitening.report(table(spark, [(1, None, 1), (2, [math.nan], 1)])).count() == 0
    # one row and constant rows have no spread to scale by
    assert whitening.report(table(spark, [(1, [1.0, 2.0], 1)] * 3)).count() == 0
    line = whitening.report(table(spark, [(i, [float(i), float(-i), 1.0], 1) for i in range(50)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 50 and abs(line[0].explained - 1) < 1e-12


def test_exact_deviations():
    rng = np.random.default_rng(2)
    for size in (10, 1 << 27, 1 << 50, 1 << 58):
        x, s = rng.integers(-size, size, (20, 7)), rng.integers(-size, size, 7)
        assert whitening.deviations(x, 3, s) == [sum((3 * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]


def brute_codes(rows, rounds=4, entries=256):
    """Codes of one length by the contract, in plain Python."""
    rows = sorted(good(rows), key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * x) for x in r[1]]))
    dim = len(rows[0][1])
    edges = [i * dim // 4 for i in range(5)]
    q = np.array([[math.floor(1024 * x) for x in r[1]] for r in rows], dtype=object).reshape(len(rows), dim)
    codes, errors, books = [], 0, []
    for s, e in zip(edges, edges[1:]):
        x = q[:, s:e].astype(np.int64)
        book = x[:entries].copy()

        def near():
            d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
            return d.argmin(axis=1), d.min(axis=1)

        for _ in range(rounds):
            best = near()[0]
            for k in range(len(book)):
                if (best == k).any():
                    book[k] = [math.floor(t / int((best == k).sum())) for t in x[best == k].sum(axis=0).tolist()]
        best, d = near()
        codes.append([f"{b:02x}" for b in best])
        errors = errors + d
        books += book.ravel().tolist()
    sha = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return [(r[0], "".join(c), int(d), r[2], sha) for r, c, d in zip(rows, zip(*codes), errors)]


@pytest.mark.parametrize("dims", [(8,), (8, 6, 2, 24)])
def test_vector_codes(spark, dims):
    rows = odd_rows(seed=4, dims=dims, n=400)
    want = [r for dim in dims for r in brute_codes([r for r in good(rows) if len(r[1]) == dim])]
    by_label: dict = {}
    for _, _, d, y, _ in want:
        by_label[y] = by_label.get(y, 0) + d
    got = vector_codes.report(table(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, c, d, by_label[y], s) for i, c, d, y, s in want), key=str)


def test_vector_codes_of_few_rows(spark):
    assert vector_codes.report(table(spark, [])).count() == 0
    assert vector_codes.report(table(spark, [(1, None, 1), (2, [None], 2)])).count() == 0
    got = vector_codes.report(table(spark, [(7, [1.0, 2.0, 3.0, 4.0], None), (8, [], 1)])).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == [(7, "00000000", 0, 0), (8, "00000000", 0, 0)]


def test_shortlists_keep_the_nearest():
    rng = np.random.default_rng(5)
    for wide in (1, 3, 16):
        x = rng.integers(-50, 50, (64, 8, wide))
        book = rng.integers(-50, 50, (40, wide))
        kept = vector_codes.shortlists(x.min(axis=1), x.max(axis=1), book)
        d = ((x[:, :, None] - book) ** 2).sum(axis=3)
        tied = d == d.min(axis=2, keepdims=True)
        assert (kept | ~tied.any(axis=1)).all()
    assert vector_codes.nearest(np.array([[1 << 26] * 4]), np.array([[-(1 << 26)] * 4, [0] * 4, [1] * 4]))[1].tolist() == [4 * ((1 << 26) - 1) ** 2]


def test_hilbert_neighbours():
    """Consecutive places differ by one step along one axis."""
    for axes, bits in ((2, 4), (3, 3), (5, 2), (6, 1)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
        keys = vector_codes.hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
