"""Substring dedup by merging Burrows-Wheeler transforms.

Every byte covered by a string of LENGTH bytes that also starts anywhere else is
removed. Windows of LENGTH bytes choose anchors (see anchors.py); runs of windows
with equal anchors and equal bytes are counted by a pre-aggregated group-by, which
decides all runs that occur twice. What is left are anchors seen in differing
surroundings. Their distinct texts are dealt into buckets by anchor, and in a
bucket into shards; each shard's transform is built on its own and written.

Transforms of a bucket are then merged by iterative interleave refinement: all
suffixes begin in one block by their first byte; a block that was split sends its
rows one step back through the transforms (last-to-first), where they split the
blocks of longer prefixes. A block split in round h gives the common prefix of the
rows at its border: h bytes. No suffix is sorted again, a round touches only rows
whose block has just been split, and after LENGTH rounds the blocks that still
hold two rows are exactly the repeated intervals of LENGTH bytes.

Null and empty texts have no bytes. Equal rows count as different places, so both
lose what they share. Texts of any length are read in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicloom.llm import anchors
from civicloom.llm.automata import RUNS, _RUNS, _flags_to_runs, covered
from civicloom.llm.words import batch, freed, mix, ragged, release, slices, text_bytes, window_hashes
from civicloom.operators.skew import settle

LENGTH, GRAM = 400, 160
SLICE_ROWS, SLICE_BYTES = 1024, 1 << 19
#: Bytes of a bucket, about, and shards in it.
BUCKET_BYTES, SHARDS = 1 << 19, 2

_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _pieces(column: pa.Array, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, borders, text numbers, place of each in its text); texts beyond
    SLICE_BYTES are cut into parts that overlap by a window less one."""
    data, offsets = text_bytes(column)
    size = np.diff(offsets)
    long = size > SLICE_BYTES
    if not long.any():
        yield data, offsets, np.arange(len(size)), np.zeros(len(size), np.int64)
        return
    for i in range(len(size)):
        body = data[offsets[i] : offsets[i + 1]]
        for at in range(0, max(len(body) - window + 1, 1), SLICE_BYTES):
            part = body[at : at + SLICE_BYTES + window - 1]
            yield part, np.array([0, len(part)]), np.array([i]), np.array([at])


def find_runs(rows: DataFrame, window: int, gram: int) -> DataFrame:
    def grams(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for p in slices(b, 0, SLICE_ROWS, SLICE_BYTES):
            for data, _, _, _ in _pieces(p.column(0), gram):
                yield window_hashes(_VALUES[data], gram)

    rank = rows.sparkSession.sparkContext.broadcast(anchors.ranks(anchors.frequencies(rows.select("text"), grams)))

    def found(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for p in slices(b, 2, SLICE_ROWS, SLICE_BYTES):
                for data, borders, text, place in _pieces(p.column(2), window):
                    values = _VALUES[data]
                    r = anchors.runs(window_hashes(values, gram), borders, gram, window, rank.value)
                    if len(r.key):
                        body = anchors.range_hash(anchors.sums(values), r.start, r.start + r.count + window - 1)
                        at, again = anchors.folded(r, body)
                        of = text[r.text[at]]
                        start = (r.start - borders[r.text] + place[r.text])[at].astype(np.int32)
                        row, doc = (p.column(c).to_numpy()[of] for c in (0, 1))
                        yield batch(_RUNS, r.key[at].view(np.int64), body[at].view(np.int64), row, doc, start, r.count[at].astype(np.int32), again)

    return rows.mapInArrow(freed(found), RUNS)


def suffix_order(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffixes of several texts in order; the suffix at an end (one per text) is
    the text's own sentinel, before all bytes. `ends` are the texts' last places.

    Prefix doubling from eight bytes on, over the suffixes not yet told apart."""
    n = len(data)
    place = np.arange(n)
    stop = ends[np.searchsorted(ends, place)]
    left = stop - place
    packed = np.zeros(n, np.uint64)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    for k in range(7):  # nine bits a byte: zero is the end of the text
        packed = (packed << np.uint64(9)) | np.where(left > k, padded[k : k + n], 0)
    order = np.argsort(packed, kind="stable")
    new = np.ones(n, bool)
    new[1:] = packed[order][1:] != packed[order][:-1]
    # equal sentinels of different texts: told apart by place, as the stable sort has left them
    ended = left[order] < 7
    new |= ended
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = begin
    step = 7
    while True:
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order
        s = order[open_]
        ahead = s + step
        over = ahead > stop[s]
        key = np.where(over, ahead - stop[s] - n, rank[np.minimum(ahead, n - 1)])
        again = np.argsort(begin[open_] * (2 * n) + (key + n), kind="stable")
        order[open_] = s[again]
        block, key, over = begin[open_], key[again], over[again]
        split_ = np.ones(len(open_), bool)
        split_[1:] = (block[1:] != block[:-1]) | (key[1:] != key[:-1]) | over[1:]
        new[open_] = split_
        begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[open_]] = begin[open_]
        step *= 2


def transform(texts: list[bytes]) -> np.ndarray:
    """A shard's transform: the byte before each suffix, one more than its value; 0 before a text's first.

    The sentinels' rows come first, in the order of the texts."""
    size = np.array([len(t) + 1 for t in texts])
    data = np.zeros(int(size.sum()), np.uint16)
    ends = np.cumsum(size) - 1
    inside = np.ones(len(data), bool)
    inside[ends] = False
    data[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    order = suffix_order(np.where(inside, data - 1, 0).astype(np.uint8), ends)
    # the byte before a text's first is the sentinel of the text before: 0 as well
    return np.where(order > 0, data[order - 1], 0).astype(np.uint16)


def places(last: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Text and place in it of each row, by walking back from all sentinels at once."""
    text, place = np.empty(len(last), np.int64), np.empty(len(last), np.int64)
    back = np.empty(len(last), np.int64)
    back[np.argsort(last, kind="stable")] = np.arange(len(last))
    size = np.array(sizes, np.int64)
    on = np.arange(len(size))
    row = on.copy()
    step = 0
    while len(on):
        text[row], place[row] = on, size[on] - step
        step += 1
        left = size[on] >= step
        on, row = on[left], back[row[left]]
    return text, place


def merge(shards: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(block of each row, common prefix at each border) after `length` rounds.

    Rows are numbered through the shards. Rows of one block share `length` bytes or
    more; prefix[b] is what rows on both sides of the merged place b share (-1: at
    least `length`)."""
    n = sum(map(len, shards))
    back = np.full(n, -1, np.int64)
    first = np.zeros(n, np.uint16)
    base = 0
    for last in shards:
        by_symbol = np.argsort(last, kind="stable")
        # row j of the first column is the occurrence by_symbol[j] of its symbol in the last column
        back[base + by_symbol] = base + np.arange(len(last))
        first[base : base + len(last)] = last[by_symbol]
        back[base + np.flatnonzero(last == 0)] = -1
        base += len(last)
    # sentinels sort first and are all different: each is a block
    sentinel = first == 0
    order = np.argsort(first, kind="stable")
    block = np.empty(n, np.int64)
    start = np.ones(n, bool)
    start[1:] = first[order][1:] != first[order][:-1]
    start[: int(sentinel.sum())] = True
    block[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    prefix = np.where(start, 0, -1)
    size = np.bincount(block, minlength=n)
    live = order
    for depth in range(1, length):
        # rows one step before those whose block has just been split
        step = back[live]
        ok = step >= 0
        rows, after = step[ok], block[live[ok]]
        open_ = size[block[rows]] > 1
        rows, after = rows[open_], after[open_]
        if not len(rows):
            break
        # they come in merged order; dealt out by their first byte they are in merged order again
        at = np.argsort(first[rows], kind="stable")
        rows, after = rows[at], after[at]
        own = block[rows]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = own[1:] != own[:-1]
        cut = fresh.copy()
        cut[1:] |= after[1:] != after[:-1]
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))
        part = np.maximum.accumulate(np.where(cut, np.arange(len(rows)), 0))
        now = own + part - head
        block[rows] = now
        inner = cut & ~fresh
        prefix[now[inner]] = depth
        # blocks that were split: their sizes, and their rows for the next round
        heads = np.flatnonzero(fresh)
        pieces = np.add.reduceat(cut.astype(np.int64), heads)
        live = rows[np.repeat(pieces > 1, np.diff(np.append(heads, len(rows))))]
        begins = np.flatnonzero(cut)
        size[now[begins]] = np.diff(np.append(begins, len(rows)))
    return block, prefix


def repeated_starts(texts: list[bytes], length: int, shards: int = SHARDS) -> list[np.ndarray]:
    """For each text the places where a string of `length` bytes starts that also starts elsewhere in them."""
    parts = [list(range(k, len(texts), shards)) for k in range(min(shards, len(texts)))]
    made = [transform([texts[i] for i in p]) for p in parts]
    return _starts(made, parts, [len(t) for t in texts], length)


def _starts(made: list[np.ndarray], parts: list[list[int]], sizes: list[int], length: int) -> list[np.ndarray]:
    block, _ = merge(made, length)
    where = [places(last, [sizes[i] for i in p]) for last, p in zip(made, parts)]
    text = np.concatenate([np.array(p, np.int64)[w[0]] for p, w in zip(parts, where)])
    place = np.concatenate([w[1] for w in where])
    size = np.array(sizes, np.int64)
    many = np.bincount(block, minlength=len(block))[block] > 1
    hit = many & (place + length <= size[text])
    order = np.lexsort((place[hit], text[hit]))
    text, place = text[hit][order], place[hit][order]
    return np.split(place, np.searchsorted(text, np.arange(1, len(sizes))))


_TEXTS = pa.schema([("key", pa.int64()), ("body", pa.int64()), ("n", pa.int32()), ("bytes", pa.binary())])
_MADE = pa.schema(
    [("bucket", pa.int64()), ("shard", pa.int32()), ("keys", pa.list_(pa.int64())), ("bodies", pa.list_(pa.int64())), ("windows", pa.list_(pa.int32()))]
    + [("last", pa.binary())]
)
_MADE_DDL = "bucket bigint, shard int, keys array<bigint>, bodies array<bigint>, windows array<int>, last binary"
_FOUND = pa.schema([("key", pa.int64()), ("body", pa.int64()), ("at", pa.int32()), ("windows", pa.int32())])


def shard_transforms(texts: DataFrame, buckets: int, shards: int = SHARDS) -> DataFrame:
    """One row per shard: its transform, and which texts it is made of."""

    def build(table: pa.Table) -> pa.Table:
        t = table.sort_by([("key", "ascending"), ("body", "ascending")])
        last = transform(t["bytes"].to_pylist())
        release()
        row = batch(
            _MADE, t["bucket"][:1].combine_chunks(), t["shard"][:1].combine_chunks(),
            *[pa.array([t[c].to_pylist()], f) for c, f in (("key", pa.list_(pa.int64())), ("body", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())))],
            [last.tobytes()],
        )
        return pa.Table.from_batches([row])

    dealt = texts.withColumns({"bucket": F.pmod(F.xxhash64("key"), F.lit(buckets)), "shard": F.pmod(F.xxhash64("body"), F.lit(shards)).cast("int")})
    return dealt.groupBy("bucket", "shard").applyInArrow(build, _MADE_DDL)


def repeated_windows(made: DataFrame, window: int) -> DataFrame:
    """(key, body, at, windows): which windows of a run are repeated, as runs of their numbers."""

    def merged(table: pa.Table) -> pa.Table:
        t = table.sort_by("shard").to_pylist()
        parts, shards, keys, bodies, sizes, windows = [], [], [], [], [], []
        for r in t:
            parts.append(list(range(len(keys), len(keys) + len(r["keys"]))))
            keys += r["keys"]
            bodies += r["bodies"]
            windows += r["windows"]
            sizes += [n + window - 1 for n in r["windows"]]
            shards.append(np.frombuffer(r["last"], np.uint16))
        out = []
        for i, at in enumerate(_starts(shards, parts, sizes, window)):
            flags = np.zeros(windows[i], bool)
            flags[at] = True
            out += [(keys[i], bodies[i], s, n) for s, n in zip(*map(np.ndarray.tolist, _flags_to_runs(flags)))]
        release()
        return pa.Table.from_batches([batch(_FOUND, *[[o[c] for o in out] for c in range(4)])])

    return made.groupBy("bucket").applyInArrow(merged, "key bigint, body bigint, at int, windows int")


def removable(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(row, start, n): starts of repeated windows, as runs."""
    runs = settle(find_runs(rows, window, gram))
    again, one = anchors.repeated_runs(runs)
    copies = again.join(one.where(F.col("times") > 1).select("key", "body"), ["key", "body"]).select("row", "start", (F.col("n") * F.col("again")).alias("n"))
    mixed = one.where("mixed")

    def bodies(batches):
        for b in batches:
            for p in slices(b, 0, SLICE_ROWS, SLICE_BYTES):
                data, offsets = text_bytes(p.column(0))
                for i, places in enumerate(p.column(1)):
                    body = data[offsets[i] : offsets[i + 1]]
                    got = places.as_py()
                    texts = [body[x["start"] : x["start"] + x["n"] + window - 1].tobytes() for x in got]
                    yield batch(_TEXTS, [x["key"] for x in got], [x["body"] for x in got], [x["n"] for x in got], texts)

    total = mixed.agg(F.sum(F.col("n") + window)).first()[0] or 0
    need = anchors.only_with(rows, anchors.wanted(mixed)).select("text", "places")
    texts = need.mapInArrow(freed(bodies), "key bigint, body bigint, n int, bytes binary")
    made = shard_transforms(texts, int(total // BUCKET_BYTES) + 1)
    # a run that occurs twice is removed as a whole already
    found = repeated_windows(made, window).join(one.where(F.col("times") == 1).select("key", "body"), ["key", "body"])
    single = again.join(found, ["key", "body"]).select("row", (F.col("start") + F.col("at")).alias("start"), F.col("windows").alias("n"))
    return copies.unionByName(single)


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the kept bytes of every document."""
    rows = docs.select(F.xxhash64(key, text).alias("row"), F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    cover = settle(removable(rows, window, gram).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("cover")))

    def cut(batches):
        for b in batches:
            for p in slices(b, 1, SLICE_ROWS, SLICE_BYTES):
                data, offsets = text_bytes(p.column(1))
                gone = covered(p.column(2), offsets, window)
                kept = data[~gone]
                inside = np.zeros(len(gone) + 1, np.int64)
                np.cumsum(gone, out=inside[1:])
                removed = inside[offsets[1:]] - inside[offsets[:-1]]
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                first = offsets[:-1][np.diff(offsets) > 0]
                begins[first] = gone[first]
                spans = np.zeros(len(gone) + 1, np.int64)
                np.cumsum(begins, out=spans[1:])
                size = np.diff(offsets)
                ends = np.cumsum(size - removed)
                raw = kept.tobytes()
                yield batch(_REPORT, p.column(0), size, removed, spans[offsets[1:]] - spans[offsets[:-1]], [raw[e - n : e] for e, n in zip(ends.tolist(), (size - removed).tolist())])

    joined = anchors.all_with(rows, cover).select("doc", "text", "cover")
    return joined.mapInArrow(freed(cut), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def report(docs: DataFrame) -> DataFrame:
    """One row per document with the digest of the bytes that are kept."""
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
