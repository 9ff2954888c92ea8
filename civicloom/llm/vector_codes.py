"""Compression of vectors into four byte codes each (product quantisation).

Vectors are cut into four equal consecutive parts, every part position has a
codebook of its own, and the codebooks are refined in rounds of assignment and
mean. All arithmetic is on integers, so results do not depend on partitioning.

The parts of each position are sorted along a Hilbert curve and cut into flat
blocks of BLOCK parts; a block holds its members, the smallest and largest value of
each component (a box) and the members' sums. A round compares boxes with entries
first: an entry whose least distance to the box exceeds another entry's greatest one
can't be the nearest of any member. Where one entry is left, the block's sums go to
it as they are; else a small kernel compares the members with the entries left.
The blocks are written once to the shared folder and read in every round; a task sends
one row of sums for each entry that it met.

Rows whose vector is null or holds null or non-finite components are left out;
those with a null id stay and come last where ids are ordered. Equal ids are rows of
their own, ordered by vector. Vectors of another length have codebooks of their
own. Where the length isn't a multiple of four, part i starts at component
i * length / 4, rounded down. Fewer than 256 rows make as many entries. Integers
beyond 2^26 (components beyond 65,536) are held there, so that squares stay exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicloom.llm.whitening import usable
from civicloom.llm.words import batch, freed, lists
from civicloom.operators.skew import settle

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE, LARGEST = 1024, 1 << 26
BLOCK = 64
#: Bits of a Hilbert key, at most.
_BITS = 62


def integers(flat: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * np.clip(flat, -LARGEST, LARGEST)), -LARGEST, LARGEST).astype(np.int64)


def borders(dim: int) -> list[int]:
    return [i * dim // PARTS for i in range(PARTS + 1)]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of coordinates (0 to 2^bits - 1) on a Hilbert curve through all axes.

    Gray-code rotation bit plane by bit plane, for all rows at once."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    if not axes:
        return np.zeros(len(cells), np.int64)
    plane = 1 << (bits - 1)
    while plane > 1:
        mask = plane - 1
        for i in range(axes):
            high = (x[i] & plane) != 0
            turned = (x[0] ^ x[i]) & mask
            x[0] = np.where(high, x[0] ^ mask, x[0] ^ turned)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ turned)
        plane >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros(len(cells), np.int64)
    plane = 1 << (bits - 1)
    while plane > 1:
        flip ^= np.where((x[-1] & plane) != 0, plane - 1, 0)
        plane >>= 1
    x ^= flip
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _keys(part: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Hilbert keys of parts, cells in units of each component's spread."""
    axes = min(part.shape[1], _BITS)
    bits = max(1, min(8, _BITS // max(axes, 1)))
    half = 1 << (bits - 1)
    cells = np.floor((part[:, :axes] - mean[:axes]) / np.where(spread[:axes] > 0, spread[:axes], 1) * max(half / 2, 1)) + half
    return hilbert(np.clip(cells, 0, 2 * half - 1), bits)


def _matrices(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the integers in column q."""
    column = b.column("q")
    counts = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(counts) - counts
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    for dim in np.unique(counts).tolist():
        at = np.flatnonzero(counts == dim)
        yield dim, at, flat[first[at][:, None] + np.arange(dim)]


def _spreads(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length: mean and standard deviation per component, only to lay out the curve."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, _, x in _matrices(b):
                x = x.astype(float)
                held[dim] = held.get(dim, 0) + np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
        for dim, s in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([s], pa.list_(pa.float64()))], ["dim", "sums"])

    long = rows.mapInArrow(freed(run), "dim int, sums array<double>").select("dim", F.posexplode("sums").alias("pos", "v"))
    found: dict[int, list[float]] = {}
    for r in long.groupBy("dim", "pos").agg(F.sum("v").alias("v")).orderBy("dim", "pos").collect():
        found.setdefault(r["dim"], []).append(r["v"])
    out = {}
    for dim, s in found.items():
        mean, square = np.array(s[1 : dim + 1]) / s[0], np.array(s[dim + 1 :]) / s[0]
        out[dim] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
    return out


_PARTS = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("key", pa.int64()), ("row", pa.int64()), ("q", pa.list_(pa.int32()))])
_BLOCKS = pa.schema(
    [("dim", pa.int32()), ("part", pa.int32()), ("rows", pa.list_(pa.int64())), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())), ("sums", pa.list_(pa.int64())), ("members", pa.list_(pa.int32()))]
)
_BLOCKS_DDL = "dim int, part int, rows array<bigint>, low array<int>, high array<int>, sums array<bigint>, members array<int>"


def blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Flat blocks of the parts of (row, q), each position sorted along its curve. Ties
    on the curve are dealt out by row, so equal vectors need not share a task."""
    spreads = _spreads(rows)

    def cut(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            row = b.column("row").to_numpy()
            for dim, at, x in _matrices(b):
                mean, spread = spreads[dim]
                edges = borders(dim)
                for p, (s, e) in enumerate(zip(edges, edges[1:])):
                    part = x[:, s:e]
                    n = len(part)
                    yield batch(_PARTS, np.full(n, dim, np.int32), np.full(n, p, np.int32), _keys(part, mean[s:e], spread[s:e]), row[at], lists(part.ravel(), np.full(n, e - s), pa.int32()))

    def gather(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            kind = b.column("dim").to_numpy().astype(np.int64) * PARTS + b.column("part").to_numpy()
            starts = np.flatnonzero(np.concatenate([[b.num_rows > 0], kind[1:] != kind[:-1]])).tolist()
            for s, e in zip(starts, [*starts[1:], b.num_rows]):
                if held and kind[s] != last:
                    yield _flat(held, size)
                    held = []
                last = kind[s]
                held.append(b.slice(s, e - s))
                n = sum(h.num_rows for h in held)
                if n >= 64 * size:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    yield _flat([whole.slice(0, n // size * size)], size)
                    held = [whole.slice(n // size * size)] if n % size else []
        if held:
            yield _flat(held, size)

    order = ["dim", "part", "key", "row"]
    parts = rows.mapInArrow(freed(cut), "dim int, part int, key bigint, row bigint, q array<int>")
    return parts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(freed(gather), _BLOCKS_DDL)


def _flat(pieces: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
    """Blocks of `size` members each (the last may be smaller)."""
    t = pa.Table.from_batches(pieces).combine_chunks()
    n, dim, part = t.num_rows, t["dim"][0].as_py(), t["part"][0].as_py()
    q = t["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    at = np.arange(0, n, size)
    count = np.diff(np.append(at, n))
    wide = np.full(len(at), q.shape[1])
    return batch(
        _BLOCKS,
        np.full(len(at), dim, np.int32),
        np.full(len(at), part, np.int32),
        lists(t["row"].to_numpy(), count, pa.int64()),
        lists(np.minimum.reduceat(q, at).ravel(), wide, pa.int32()),
        lists(np.maximum.reduceat(q, at).ravel(), wide, pa.int32()),
        lists(np.add.reduceat(q.astype(np.int64), at).ravel(), wide, pa.int64()),
        lists(q.ravel(), count * q.shape[1], pa.int32()),
    )


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """blocks x entries: whether an entry may be nearest to a point of the box. Equal distances stay."""
    near = np.zeros((len(low), len(entries)), np.int64)
    far = np.zeros_like(near)
    for c in range(entries.shape[1]):
        under, over = low[:, c, None] - entries[:, c], entries[:, c] - high[:, c, None]
        near += np.maximum(np.maximum(under, over), 0) ** 2
        far += np.maximum(np.abs(entries[:, c] - low[:, c, None]), np.abs(over)) ** 2
    return near <= far.min(axis=1, initial=np.iinfo(np.int64).max)[:, None]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row; ties to the lower index."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    # products of doubles are exact below 2^53, and faster
    kind = np.float64 if 4 * x.shape[1] * int(most) ** 2 < 1 << 53 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    d = (b * b).sum(axis=1) - 2 * (a @ b.T)
    best = d.argmin(axis=1)
    return best, (d[np.arange(len(x)), best] + (a * a).sum(axis=1)).astype(np.int64)


def _boxes(b: pa.RecordBatch) -> Iterator[tuple]:
    """(dim, part, block numbers, low, high, sums) of blocks of one kind, some at a time."""
    kind = b.column("dim").to_numpy().astype(np.int64) * PARTS + b.column("part").to_numpy()
    for k in np.unique(kind).tolist():
        dim, p = divmod(k, PARTS)
        edges = borders(dim)
        wide = edges[p + 1] - edges[p]
        own = np.flatnonzero(kind == k)
        for i in range(0, len(own), 256):
            at = own[i : i + 256]
            some = b.take(pa.array(at))
            yield dim, p, at, *[some.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(at), wide) for c in ("low", "high", "sums")]


def _evaluated(b: pa.RecordBatch, books: dict[tuple[int, int], np.ndarray], single: bool):
    """(dim, part, block, shortlist, sums, members or None) of every block; members are left out
    where one entry is left, if `single` allows that."""
    members, rows = b.column("members"), b.column("rows")
    first = members.offsets.to_numpy()
    flat = members.values.to_numpy(zero_copy_only=False)
    counts = rows.value_lengths().to_numpy(zero_copy_only=False)
    for dim, p, at, low, high, sums in _boxes(b):
        book = books[dim, p]
        possible = shortlists(low, high, book)
        for i, k in enumerate(at.tolist()):
            some = np.flatnonzero(possible[i])
            alone = single and len(some) == 1
            yield dim, p, k, some, sums[i], int(counts[k]), None if alone else flat[first[k] : first[k + 1]].reshape(counts[k], -1)


_SUMS = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("sums", pa.list_(pa.int64()))])


def _round(parted: DataFrame, books: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """The codebooks after one round."""
    shared = parted.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]):
        known = shared.value
        held: dict[tuple[int, int, int], np.ndarray] = {}

        def add(dim, p, entry, n, sums):
            key = (dim, p, entry)
            if key not in held:
                held[key] = np.zeros(len(sums) + 1, np.int64)
            held[key][0] += n
            held[key][1:] += sums

        for b in batches:
            for dim, p, _, some, sums, n, x in _evaluated(b, known, True):
                if x is None:
                    add(dim, p, int(some[0]), n, sums)
                    continue
                best = nearest(x, known[dim, p][some])[0]
                for e in np.unique(best).tolist():
                    own = x[best == e]
                    add(dim, p, int(some[e]), len(own), own.sum(axis=0, dtype=np.int64))
        if held:
            yield batch(_SUMS, *[np.array(k, np.int32) for k in zip(*held)], lists(np.concatenate([*held.values()]), np.array([len(s) for s in held.values()]), pa.int64()))

    parts = parted.mapInArrow(freed(run), "dim int, part int, entry int, sums array<bigint>")
    long = parts.select("dim", "part", "entry", F.posexplode("sums").alias("pos", "v"))
    new = {k: v.copy() for k, v in books.items()}
    totals = long.groupBy("dim", "part", "entry", "pos").agg(F.sum("v").alias("v")).toArrow()
    dim, p, e, pos, v = [totals[c].to_numpy() for c in ("dim", "part", "entry", "pos", "v")]
    for (d, k), book in new.items():
        own = (dim == d) & (p == k)
        s = np.zeros((len(book), book.shape[1] + 1), np.int64)
        s[e[own], pos[own]] = v[own]
        met = s[:, 0] > 0
        book[met] = s[met, 1:] // s[met, :1]
    return new


def first_books(rows: DataFrame, entries: int = ENTRIES) -> dict[tuple[int, int], np.ndarray]:
    """(length, part): the parts of the first ids. One length at a time; a table has few."""
    books = {}
    for d in [r["dim"] for r in rows.select(F.size("q").alias("dim")).distinct().collect()]:
        least = rows.where(F.size("q") == d).orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).select("q").collect()
        x = np.array([r["q"] for r in least], np.int64).reshape(len(least), d)
        edges = borders(d)
        books |= {(d, p): x[:, s:e] for p, (s, e) in enumerate(zip(edges, edges[1:]))}
    return books


def learn(rows: DataFrame, parted: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> dict[tuple[int, int], np.ndarray]:
    """Codebooks by (length, part) of (id, row, q) and their blocks."""
    books = first_books(rows, entries)
    for _ in range(rounds):
        books = _round(parted, books)
    return books


_CODES = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()), ("error", pa.int64())])


def assign(parted: DataFrame, books: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """(row, part, entry, error) of every part."""
    shared = parted.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = b.column("rows")
            found = []
            for dim, p, k, some, _, n, x in _evaluated(b, shared.value, False):
                best, error = nearest(x, shared.value[dim, p][some])
                found.append((rows[k].values.to_numpy(), np.full(n, p, np.int32), some[best].astype(np.int32), error))
            if found:
                yield batch(_CODES, *[np.concatenate(c) for c in zip(*found)])

    return parted.mapInArrow(freed(run), "row bigint, part int, entry int, error bigint")


def digest(books: dict[tuple[int, int], np.ndarray], dim: int) -> str:
    return hashlib.sha256(",".join(str(v) for p in range(PARTS) for v in books[dim, p].ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, dict[tuple[int, int], np.ndarray]]:
    """((vec_id, dim, code, error, then `keep` as given) of every usable vector, codebooks)."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.struct(*[F.col(f"`{k}`").alias(k) for k in keep] or [F.lit(None).alias("_")]).alias("kept"), v.alias("v")).where(usable("v"))

    def whole(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            column = b.column("v")
            q = pa.array(integers(column.flatten().to_numpy(zero_copy_only=False)), pa.int32())
            counts = column.value_lengths().to_numpy(zero_copy_only=False)
            q = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), q)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("row", "id", "kept")], q], ["row", "id", "kept", "q"])

    kind = rows.schema["kept"].dataType.simpleString()
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(freed(whole), f"row bigint, id bigint, kept {kind}, q array<int>"))
    parted = settle(blocks(rows.select("row", "q")))
    books = learn(rows, parted, rounds, entries)
    codes = assign(parted, books)
    digits = [F.max(F.when(F.col("part") == p, F.col("entry"))) for p in range(PARTS)]
    codes = codes.groupBy("row").agg(F.format_string("%02x" * PARTS, *digits).alias("code"), F.sum("error").alias("error"))
    out = rows.select("row", "id", "kept", F.size("q").alias("dim")).join(codes, "row")
    return out.select(F.col("id").alias("vec_id"), "dim", "code", "error", *[F.col("kept").getField(k).alias(k) for k in keep]), books


def report(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    found, books = compress(vectors.withColumn("_label", F.col(label)), key, vector, ("_label",))
    found = settle(found)
    totals = found.groupBy(F.col("_label").alias("_own")).agg(F.sum("error").alias("label_error"))
    dims = sorted({d for d, _ in books})
    sha = F.lit(None).cast("string")
    for d in dims:
        sha = F.when(F.col("dim") == d, F.lit(digest(books, d))).otherwise(sha)
    return found.join(totals, F.col("_label").eqNullSafe(F.col("_own")), "left").select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))
