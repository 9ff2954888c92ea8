"""Whitening of embeddings.

Entries become integers, so that sums per dimension and deviations are exact in any
order of adding. A second pass adds up products of entries that are already
centred, one matrix a task; the sum is small (dimension squared) and its leading
eigenpairs are found on the driver (see `eigen`). The projection is broadcast
(dimension times components) and applied to every row; a pass before that measures
how far the whitened rows' covariance is from the identity.

Rows whose vector is null or holds null or non-finite entries are left out; those
with a null id stay. Equal rows get equal results. Vectors of another length
are whitened among themselves: a table has few lengths, as an embedder has one.
An empty vector has no components. Components whose eigenvalue is zero to rounding
(as for a single row or constant vectors) can't be scaled and are left out. Entries
beyond 2^21 in absolute value are held there, so that integers stay exact.
`deviation` is null where it doesn't fit into a long; `deviation_digits` always
has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicloom.llm.eigen import leading
from civicloom.llm.words import batch, freed

COMPONENTS = 8
SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 21
#: Eigenvalues below this share of the largest are zero but for rounding.
RANK = 1e-12
_ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """What rows of one length need: n, sums per dimension, components as columns over the root of their eigenvalues."""

    n: int
    sums: np.ndarray
    scaled: np.ndarray
    explained: np.ndarray

    def rows(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.scaled


def usable(vector: str) -> F.Column:
    v = F.col(vector)
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(flat: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * np.clip(flat, -LARGEST, LARGEST)).astype(np.int64)


def by_length(b: pa.RecordBatch, vector: str = "v", rows: int = _ROWS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers in the batch, entries as a matrix of integers) of usable vectors, few rows at a time."""
    column = b.column(vector)
    counts = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(counts) - counts
    flat = column.flatten().to_numpy(zero_copy_only=False)
    for dim in np.unique(counts).tolist():
        own = np.flatnonzero(counts == dim)
        for i in range(0, len(own), rows):
            at = own[i : i + rows]
            yield dim, at, integers(flat[first[at][:, None] + np.arange(dim)])


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, rounded once."""
    return (n * x - sums) / n


def _added(df: DataFrame, keys: list[str], values: str) -> list:
    """Arrays added up by position: rows of keys, pos, total."""
    long = df.select(*keys, F.posexplode(values).alias("pos", "value"))
    return long.groupBy(*keys, "pos").agg(F.sum("value").alias("total")).orderBy(*keys, "pos").collect()


def _per_task(rows: DataFrame, schema: str, start, add, done):
    """One partial result a task and length of vector."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[int, object] = {}
        for b in batches:
            for dim, _, x in by_length(b):
                held[dim] = add(held[dim] if dim in held else start(dim), dim, x)
        for dim, state in held.items():
            yield done(dim, state)

    return rows.mapInArrow(freed(run), schema)


def sums(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """length: (rows, sums per dimension of the shifted integers)."""
    schema = pa.schema([("dim", pa.int32()), ("sums", pa.list_(pa.int64()))])

    def add(state, dim, x):
        state[0] += len(x)
        state[1:] += (x + SHIFT).sum(axis=0)
        return state

    parts = _per_task(rows, "dim int, sums array<bigint>", lambda dim: np.zeros(dim + 1, np.int64), add, lambda dim, s: batch(schema, [dim], [s]))
    found: dict[int, list[int]] = {}
    for r in _added(parts, ["dim"], "sums"):
        found.setdefault(r["dim"], []).append(int(r["total"]))
    return {dim: (s[0], np.array(s[1:], np.int64)) for dim, s in found.items()}


def covariances(rows: DataFrame, of: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """length: covariance, divisor n, of entries centred before multiplying."""
    schema = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("products", pa.list_(pa.float64()))])

    def add(state, dim, x):
        c = centred(x + SHIFT, *of[dim])
        return state + c.T @ c

    def done(dim, s):  # the upper triangle
        return batch(schema, np.full(dim, dim, np.int32), np.arange(dim, dtype=np.int32), pa.array([s[i, i:] for i in range(dim)], pa.list_(pa.float64())))

    parts = _per_task(rows, "dim int, i int, products array<double>", lambda dim: np.zeros((dim, dim)), add, done)
    found = {dim: np.zeros((dim, dim)) for dim in of}
    for r in _added(parts, ["dim", "i"], "products"):
        i, j = r["i"], r["i"] + r["pos"]
        found[r["dim"]][i, j] = found[r["dim"]][j, i] = r["total"] / of[r["dim"]][0]
    return found


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening for each length of the usable vectors `v`."""
    totals = sums(rows)
    models = {}
    for dim, v in covariances(rows, totals).items():
        n, s = totals[dim]
        values, vectors = leading(v, min(components, dim)) if dim else (np.zeros(0), np.zeros((0, 0)))
        good = values > RANK * max(values.max(initial=0), 0)
        models[dim] = Whitening(n, s, vectors[:, good] / np.sqrt(values[good]), values[good] / np.trace(v) if good.any() else values[good])
    return models


def identity_errors(rows: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """length: largest absolute entry of the whitened rows' covariance minus the identity."""
    schema = pa.schema([("dim", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def add(state, dim, x):
        w = models[dim].rows(x + SHIFT)
        return state + np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    def start(dim):
        k = models[dim].scaled.shape[1]
        return np.zeros(k + k * k)

    found: dict[int, list[float]] = {}
    for r in _added(_per_task(rows, "dim int, sums array<double>", start, add, lambda dim, s: batch(schema, [dim], [s])), ["dim"], "sums"):
        found.setdefault(r["dim"], []).append(r["total"])
    out = {}
    for dim, s in found.items():
        k = models[dim].scaled.shape[1]
        mean, square = np.array(s[:k]) / models[dim].n, np.array(s[k:]).reshape(k, k) / models[dim].n
        out[dim] = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max(initial=0))
    return out


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> list[int]:
    """The exact sum of (n x - s)^2 of each row. Square sums of two limbs of 28 bits each fit 64 bits."""
    a = np.abs(n * x - s)
    if a.max(initial=0) >= 1 << 56:
        return [sum(int(v) ** 2 for v in row) for row in a]
    high, low = a >> 28, a & ((1 << 28) - 1)
    parts = [(high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1)]
    return [(h << 56) + (m << 29) + t for h, m, t in zip(*[p.tolist() for p in parts])]


_OUT = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()), ("deviation_digits", pa.string())]
)
_OUT_DDL = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_digits string"


def project(rows: DataFrame, models: dict[int, Whitening], errors: dict[int, float]) -> DataFrame:
    """One row per usable vector and component."""
    shared = rows.sparkSession.sparkContext.broadcast((models, errors))

    def run(batches: Iterator[pa.RecordBatch]):
        known, error = shared.value
        for b in batches:
            for dim, at, x in by_length(b):
                m = known[dim]
                k = m.scaled.shape[1]
                if not k:
                    continue
                exact = deviations(x + SHIFT, m.n, m.sums)
                yield batch(
                    _OUT,
                    b.column("id").take(pa.array(np.repeat(at, k))),
                    np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)),
                    np.full(len(at) * k, m.n),
                    pa.array([e if e < 1 << 63 else None for e in exact for _ in range(k)], pa.int64()),
                    m.rows(x + SHIFT).ravel(),
                    np.tile(m.explained, len(at)),
                    np.full(len(at) * k, error[dim]),
                    pa.array([d for d in map(str, exact) for _ in range(k)]),
                )

    return rows.mapInArrow(freed(run), _OUT_DDL)


def report(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable("v"))
    models = fit(rows, components)
    return project(rows, models, identity_errors(rows, models))
