"""Near-duplicate embeddings by iterative quantisation.

Balanced binary codes come from rotations learned by iterative quantisation on a
bounded sample. Each of several tables takes its own bits of the codes (multi-index
Hamming lookup); vectors of one label that agree on a table's bits meet there and
are reranked with their original vectors, cosine in double precision. Bits per
table grow with the logarithm of the rows, so that buckets stay small, and the
number of tables follows from the bits and the share of bits that differ between
sample vectors at exactly the threshold, so that a link is missed with a
probability of MISS at most as estimated there; recall is measured against brute
force in the tests.

Equal vectors of a label are one row with a count. A bucket is cut into blocks of
about BLOCK vectors; every two blocks meet in a task of their own, and only sums
and links to a block's smallest member leave it, never all pairs. A pair is
counted in the first table where it meets.

Vectors that are null, zero, or hold null or non-finite components, and those
without a label, link with nothing. Vectors of different dimension do not link.
Repeated ids are vectors of their own and get the same component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicloom.llm.components import components
from civicloom.llm.words import batch, freed
from civicloom.operators.skew import settle

THRESHOLD = 0.98
#: Vectors that the rotations are learned on, at most.
SAMPLE = 8192
MISS = 0.01
BLOCK, BUCKET = 1024, 64


def _itq(x: np.ndarray, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal axes, turned so that signs lose least."""
    mean = x.mean(axis=0)
    axes = np.linalg.eigh((x - mean).T @ (x - mean))[1][:, ::-1]
    v = (x - mean) @ axes
    turn = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return mean, axes @ turn


@dataclass(frozen=True)
class Codes:
    """Binary codes of unit vectors of one dimension: `tables` keys of `bits` bits."""

    mean: np.ndarray
    turns: np.ndarray
    bits: int
    tables: int

    def of(self, x: np.ndarray) -> np.ndarray:
        signs = ((x - self.mean) @ self.turns >= 0)[:, : self.bits * self.tables]
        weight = np.left_shift(np.int64(1), np.arange(self.bits, dtype=np.int64))
        return signs.reshape(len(x), self.tables, self.bits) @ weight


def learn(x: np.ndarray, rows: int, threshold: float = THRESHOLD, miss: float = MISS, rounds: int = 30) -> Codes:
    """Codes for `rows` vectors out of the sample `x` of unit vectors."""
    rng = np.random.default_rng(7)
    d = x.shape[1]
    mean, turn = _itq(x, rounds, rng)
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    length = np.linalg.norm(side, axis=1, keepdims=True)
    near = threshold * x + math.sqrt(1 - threshold**2) * side / np.where(length > 0, length, 1)
    flips = float((((x - mean) @ turn >= 0) != ((near - mean) @ turn >= 0)).mean())
    bits = int(np.clip(math.ceil(math.log2(max(rows / BUCKET, 1))), 4, 40))
    agree = max((1 - min(flips, 0.5)) ** bits, 1e-3)
    tables = max(1, math.ceil(math.log(miss) / math.log(1 - min(agree, 0.999))))
    turns = [turn]
    while len(turns) * d < bits * tables:
        turns.append(_itq(x, rounds, rng)[1])
    return Codes(mean, np.concatenate(turns, axis=1), bits, tables)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_ENTRIES = pa.schema(
    [("table", pa.int32()), ("code", pa.int64()), ("label", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("codes", pa.list_(pa.int64())), ("vec", pa.list_(pa.float32()))]
)
_FOUND = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _block_links(left: dict, right: dict | None, table: int, threshold: float) -> pa.RecordBatch | None:
    """Links within one block or between two, of pairs that no earlier table brings together."""
    other = left if right is None else right
    sims = left["x"] @ other["x"].T >= threshold
    if right is None:
        np.fill_diagonal(sims, False)
    i, j = np.nonzero(sims)
    if not len(i):
        return None
    new = ~(left["codes"][i, :table] == other["codes"][j, :table]).any(axis=1)
    i, j = i[new], j[new]
    if not len(i):
        return None
    ids = left["id"] if right is None else np.concatenate([left["id"], right["id"]])
    n = left["n"] if right is None else np.concatenate([left["n"], right["n"]])
    shift = 0 if right is None else len(left["id"])
    a, b = (i, j) if right is None else (np.concatenate([i, j + shift]), np.concatenate([j + shift, i]))
    links = np.bincount(a, weights=n[b].astype(float), minlength=len(ids)).astype(np.int64)
    root = np.arange(len(ids))
    while True:  # the smallest member reachable inside
        low = root.copy()
        np.minimum.at(low, a, root[b])
        low = low[low]
        if (low == root).all():
            break
        root = low
    met = np.flatnonzero(links)
    return batch(_FOUND, ids[met], ids[root[met]], links[met])


def near_links(rows: DataFrame, codes: Codes, dim: int, threshold: float) -> DataFrame:
    """(id, root, links) per block and vector of distinct vectors (id, label, vec, n)."""

    def entries(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            code = codes.of(_units(_matrix(b.column("vec"), dim)))
            own = pa.ListArray.from_arrays(np.arange(0, code.size + 1, codes.tables).astype(np.int32), code.ravel())
            for t in range(codes.tables):
                yield batch(_ENTRIES, np.full(b.num_rows, t, np.int32), code[:, t], b.column("label"), b.column("id"), b.column("n"), own, b.column("vec"))

    bucket = ["table", "code", "label"]
    keys = rows.mapInArrow(freed(entries), "table int, code bigint, label bigint, id bigint, n bigint, codes array<bigint>, vec array<float>")
    keys = settle(keys)
    sizes = keys.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    blocks = F.ceil(F.col("size") / BLOCK)
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = keys.join(sizes, bucket).withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    dealt = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "size")
    parted = dealt.repartition(*bucket, "lo", "hi").sortWithinPartitions(*bucket, "lo", "hi", "block", "id")

    def linked(batches):
        held: list[pa.RecordBatch] = []
        last = None

        def done():
            t = pa.Table.from_batches(held)
            block = t["block"].to_numpy()
            lo, hi = last[3], last[4]
            parts = []
            for k in (lo, hi):
                at = np.flatnonzero(block == k)
                if not len(at):
                    return None
                p = t.slice(int(at[0]), len(at)).combine_chunks()
                parts.append(
                    {
                        "id": p["id"].to_numpy(),
                        "n": p["n"].to_numpy(),
                        "codes": p["codes"].combine_chunks().flatten().to_numpy().reshape(len(at), -1),
                        "x": _units(_matrix(p["vec"].combine_chunks(), dim)),
                    }
                )
            return _block_links(parts[0], None if lo == hi else parts[1], last[0], threshold)

        for b in batches:
            keys_ = [b.column(c).to_numpy() for c in (*bucket, "lo", "hi")]
            change = np.zeros(b.num_rows, bool)
            for k in keys_:
                change[1:] |= k[1:] != k[:-1]
            starts = np.flatnonzero(np.concatenate([[b.num_rows > 0], change[1:]]))
            for s, e in zip(starts, np.append(starts[1:], b.num_rows)):
                key = tuple(int(k[s]) for k in keys_)
                if key != last and held:
                    if (out := done()) is not None:
                        yield out
                    held = []
                last = key
                held.append(b.slice(s, e - s))
        if held and (out := done()) is not None:
            yield out

    return parted.mapInArrow(freed(linked), "id bigint, root bigint, links bigint")


def dedup(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    v = F.col("vec")
    usable = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<float>").alias("vec"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(usable, F.lit(False))
    good = rows.where(usable)
    # equal vectors are one, named by the smallest id
    distinct = settle(good.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("vec")))
    found = None
    for r in distinct.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("rows")).orderBy("dim").collect():
        dim = r["dim"]
        own = distinct.where(F.col("dim") == dim)
        sample = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
        codes = learn(_units(_matrix(sample, dim)), r["rows"], threshold)
        part = near_links(own.select("id", "label", "n", "vec"), codes, dim, threshold)
        found = part if found is None else found.unionByName(part)
    out = rows.select("id", "label", "vec").withColumn("usable", usable)
    if found is None:
        return out.select(F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = settle(found)
    links = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "name")
    names = good.join(distinct.select("label", "vec", F.col("id").alias("name"), F.col("n").alias("n")), ["label", "vec"]).select("id", "name", "n")
    names = settle(names.groupBy("id", "name").agg(F.first("n").alias("n")))
    # a repeated id ties the classes of its vectors together
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(names.select(F.col("id").alias("a"), F.col("name").alias("b"))))
    classes = distinct.select("label", "vec", F.col("id").alias("name"), "n")
    keyed = out.join(classes, ["label", "vec"], "left")
    keyed = keyed.withColumn("name", F.when(F.col("usable"), F.col("name"))).drop("vec", "label")
    keyed = keyed.join(links, "name", "left").join(groups.withColumnRenamed("id", "own"), F.col("id") == F.col("own"), "left")
    count = F.when(F.col("usable"), F.coalesce(F.col("n"), F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0))
    component = F.coalesce("component", "id")
    return keyed.select(
        F.col("id").alias("vec_id"),
        count.cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
