"""Words of whole Arrow batches at once.

A batch's texts are one byte buffer; word borders, ids and window hashes are
worked out over that buffer with numpy, so no Python code runs for a single word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BASE = 0x9E3779B97F4A7C15 | 1


def _table(separators: Iterator[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words `[^\x20\x09-\x0D]+`: everything but ASCII white space.
SPACED = _table([0x20, *range(0x09, 0x0E)])
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, letters, all beyond ASCII.
ALPHANUMERIC = _table([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes and each text's borders in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of one batch; those of text i are first[i]:first[i+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def array(self) -> pa.Array:
        """The words as an Arrow binary array."""
        lengths = self.ends - self.starts
        borders = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=borders[1:])
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.starts] += 1
        inside[self.ends] -= 1
        body = self.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(borders), pa.py_buffer(body)])

    def ids(self) -> tuple[np.ndarray, pa.Array]:
        """Each word's number among the distinct words, and these."""
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; each distinct word is hashed once."""
        ids, distinct = self.ids()
        digest = xxhash.xxh3_64_intdigest
        return np.array([digest(w, seed) for w in distinct.to_pylist()] or [0], dtype=np.uint64)[ids]

    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> Words:
    """Maximal runs of bytes for which `word` holds, within each text."""
    mask = word[data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    starts, ends = mask.copy(), mask.copy()
    starts[1:] &= ~mask[:-1]
    ends[:-1] &= ~mask[1:]
    starts[inner] = mask[inner]
    ends[inner - 1] = mask[inner - 1]
    starts = np.flatnonzero(starts)
    return Words(data, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of values[i:i+size] for each i; values are 64-bit hashes."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up = powers(len(values), BASE)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * powers(n, pow(BASE, -1, 1 << 64)))


_powers: dict[int, np.ndarray] = {}
#: Powers that a worker keeps, at most.
_KEPT_POWERS = 1 << 23


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[:1] = 1
        known = np.multiply.accumulate(known)
        if len(known) <= _KEPT_POWERS:
            _powers[base] = known
    return known[:n]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0]+lengths[0]-1, starts[1], ... as one array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begins = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(begins - starts, lengths)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array: `counts` values each."""
    borders = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=borders[1:])
    return pa.ListArray.from_arrays(pa.array(borders), pa.array(values, type=kind))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def slices(b: pa.RecordBatch, text: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch cut so that a part has at most `rows` rows and `size` bytes of text (or is one row)."""
    sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, s in enumerate(sizes.tolist()):
        if i > start and (i - start >= rows or total + s > size):
            yield b.slice(start, i - start)
            start, total = i, 0
        total += s
    if start < b.num_rows:
        yield b.slice(start)


def release() -> None:
    """Gives memory that is not used any more back to the system: workers live on
    between tasks, beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def freed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same work over batches; the worker keeps no memory between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(_releasing(batches)):
            yield out
            del out
        release()

    return run


def _releasing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b
        del b
        release()
