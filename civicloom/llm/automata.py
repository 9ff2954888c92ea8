"""Substring dedup with suffix automata of reference shards.

A word is removed when it lies in a window of WINDOW words whose sequence also
starts in a document with a smaller id. Feeding every document through automata
of the whole corpus would grow with its square, so shards are cut by content:

1. Windows choose anchors (see anchors.py); runs of windows with equal anchors and
   equal text are collapsed to the one of the smallest document id by a pre-aggregated
   group-by, so a passage in a third of all documents is one reference row.
2. An anchor all of whose runs read alike is decided by these counts. The
   remaining anchors, seen in differing surroundings, are the reference shards: for
   each, one suffix automaton over the words of its distinct runs, built in order
   of document ids, so that a state knows the first document it occurred in.
3. The documents' runs are streamed through their shard's automaton; matching
   statistics, cut at WINDOW words, give each window's first document.
4. Covered words are removed in one pass over the documents.

Null texts have no words; texts shorter than a window keep everything. Rows are
told apart by id and text: equal rows get equal results, and an equal id is not a
smaller one. A null id counts as larger than all others. Words are compared by 64-bit
hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicloom.llm import anchors
from civicloom.llm.words import SPACED, Words, batch, freed, lists, ragged, slices, split, text_bytes, window_hashes
from civicloom.operators.skew import settle

WINDOW, GRAM = 50, 12
SLICE_ROWS, SLICE_BYTES = 2048, 2 << 20
LAST = (1 << 63) - 1

_RUNS = pa.schema([("key", pa.int64()), ("body", pa.int64()), ("row", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("again", pa.int32())])
RUNS = "key bigint, body bigint, row bigint, doc bigint, start int, n int, again int"


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, doc, text): rows with equal id and text share their number."""
    return docs.select(F.xxhash64(key, text).alias("row"), F.coalesce(F.col(key).cast("bigint"), F.lit(LAST)).alias("doc"), F.col(text).alias("text"))


def hashed(column: pa.Array) -> tuple[Words, np.ndarray]:
    words = split(*text_bytes(column), SPACED)
    return words, words.hashes() if len(words.starts) else np.zeros(0, np.uint64)


def find_runs(rows: DataFrame, window: int, gram: int) -> DataFrame:
    def grams(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        return (window_hashes(hashed(p.column(0))[1], gram) for p in slices(b, 0, SLICE_ROWS, SLICE_BYTES))

    rank = rows.sparkSession.sparkContext.broadcast(anchors.ranks(anchors.frequencies(rows.select("text"), grams)))

    def found(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for p in slices(b, 2, SLICE_ROWS, SLICE_BYTES):
                words, h = hashed(p.column(2))
                r = anchors.runs(window_hashes(h, gram), words.first, gram, window, rank.value)
                if len(r.key):
                    body = anchors.range_hash(anchors.sums(h), r.start, r.start + r.count + window - 1)
                    at, again = anchors.folded(r, body)
                    row, doc = (p.column(c).to_numpy()[r.text[at]] for c in (0, 1))
                    start = (r.start - words.first[r.text]).astype(np.int32)
                    yield batch(_RUNS, r.key[at].view(np.int64), body[at].view(np.int64), row, doc, start[at], r.count[at].astype(np.int32), again)

    return rows.mapInArrow(freed(found), RUNS)


class Automaton:
    """A suffix automaton over sequences that are added in order of their documents."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _state(self, to: dict[int, int], link: int, length: int, first: int) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the shorter sequences that end there. It occurred first where q did."""
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.first[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int], doc: int) -> None:
        at = 0
        for c in words:
            q = self.next[at].get(c)
            if q is not None:
                at = q if self.length[q] == self.length[at] + 1 else self._split(at, c, q)
                continue
            new = self._state({}, 0, self.length[at] + 1, doc)
            p = at
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            at = new

    def firsts(self, words: list[int], window: int) -> list[int]:
        """For each window of `words` (all known to the automaton) the document it first occurred in."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        at = matched = 0
        out = []
        for i, c in enumerate(words):
            while c not in nxt[at]:
                at = link[at]
                matched = length[at]
            at = nxt[at][c]
            matched = min(matched + 1, window)
            while length[link[at]] >= matched:
                at = link[at]
            if i + 1 >= window:
                out.append(first[at])
        return out


_BODIES = pa.schema([("key", pa.int64()), ("body", pa.int64()), ("doc", pa.int64()), ("words", pa.list_(pa.int64()))])
_HITS = pa.schema([("row", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
_EARLIER = pa.schema([("key", pa.int64()), ("body", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])


def _flags_to_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def by_key(batches: Iterator[pa.RecordBatch], column: str = "key") -> Iterator[list[dict]]:
    """Rows of sorted batches, key by key."""
    rows: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if rows and rows[-1][column] != r[column]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def removable(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(row, start, n): windows to remove the words of, as runs of their starts."""
    runs = settle(find_runs(rows, window, gram))
    again, one = anchors.repeated_runs(runs)
    # later copies of a run
    many = one.where(F.col("times") > 1).select("key", "body", F.col("doc").alias("first_doc"))
    copies = again.join(many, ["key", "body"]).where(F.col("doc") > F.col("first_doc")).select("row", "start", (F.col("n") * F.col("again")).alias("n"))

    def bodies(batches):
        for b in batches:
            for p in slices(b, 2, SLICE_ROWS, SLICE_BYTES):
                words, h = hashed(p.column(2))
                places = p.column(3)
                count = places.value_lengths().to_numpy()
                key, body, start, n = (places.flatten().field(c).to_numpy() for c in range(4))
                of = np.repeat(np.arange(len(count)), count)
                size = n + window - 1
                flat = h[ragged(words.first[of] + start, size)].view(np.int64)
                yield batch(_BODIES, key, body, p.column(1).to_numpy()[of], lists(flat, size, pa.int64()))

    texts = anchors.only_with(rows, anchors.wanted(one.where("mixed"))).select("row", "doc", "text", "places")
    shards = texts.mapInArrow(freed(bodies), "key bigint, body bigint, doc bigint, words array<bigint>")

    def earlier(batches):
        for group in by_key(batches):
            found = Automaton()
            for r in group:
                found.add(r["words"], r["doc"])
            for r in group:
                at, n = _flags_to_runs(np.array(found.firsts(r["words"], window)) < r["doc"])
                if len(at):
                    yield batch(_EARLIER, [r["key"]] * len(at), [r["body"]] * len(at), at.astype(np.int32), n.astype(np.int32))

    parted = shards.repartition("key").sortWithinPartitions("key", "doc", "body")
    known = parted.mapInArrow(freed(earlier), "key bigint, body bigint, at int, n int")
    earliest = one.where("mixed").select("key", "body", F.col("doc").alias("first_doc"))
    firsts = again.join(known.withColumnRenamed("n", "windows").join(earliest, ["key", "body"]), ["key", "body"])
    firsts = firsts.where(F.col("doc") == F.col("first_doc")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("again") - 1)))
    firsts = firsts.select("row", (F.col("start") + F.col("at") + F.col("turn") * F.col("n")).alias("start"), F.col("windows").alias("n"))
    return copies.unionByName(firsts)


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the kept words of every document, joined by single spaces."""
    rows = keyed(docs, key, text)
    cover = settle(removable(rows, window, gram).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("cover")))

    def cut(batches):
        for b in batches:
            for p in slices(b, 1, SLICE_ROWS, SLICE_BYTES):
                words = split(*text_bytes(p.column(1)), SPACED)
                gone = covered(p.column(2), words.first, window)
                kept = ~gone
                count = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) if p.num_rows else np.zeros(0)
                total = np.diff(words.first)
                count[total == 0] = 0
                array = words.array().filter(pa.array(kept)).cast(pa.string())
                left = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(total - count)]).astype(np.int32), array)
                yield batch(_REPORT, p.column(0), total.astype(np.int64), count, pc.binary_join(left, " "))

    joined = anchors.all_with(rows, cover).select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc"), "text", "cover")
    return joined.mapInArrow(freed(cut), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def covered(cover: pa.Array, first: np.ndarray, window: int) -> np.ndarray:
    """Which units lie in a window that starts in one of the runs (start, n) of their text."""
    steps = np.zeros(int(first[-1]) + 1, np.int32)
    count = pc.fill_null(cover.value_lengths(), 0).to_numpy(zero_copy_only=False)
    if count.sum():
        of = np.repeat(np.arange(len(count)), count)
        flat = cover.flatten()
        start, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        begin = first[of] + start
        np.add.at(steps, begin, 1)
        np.add.at(steps, begin + n + window - 1, -1)
    return np.cumsum(steps[:-1]) > 0


def report(docs: DataFrame) -> DataFrame:
    """One row per document with the digest of what is kept."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
