"""Toxicity of documents, scored on restored text.

Disguised words are restored first (see `channel`): its language model counts the
characters of all documents. The score rests on a lexicon of words and beginnings
of words whose weights say how much likelier they are in toxic documents, and on a
logistic curve over a document's hits.

The lexicon and the curve are fitted on a bounded sample of labelled documents: at
most SAMPLE, taken by hash, none of the held-out fold. Their restored texts are
written to the shared folder. Of the other folds one is for the curve, the rest for
the lexicon, so the curve isn't fitted on words that the lexicon knows by heart.
The lexicon holds at most LEXICON entries, those in most toxic documents.

A null or empty text has no words, and a score too: what the curve says of none. A
document labelled more than once counts as toxic if any label says so; null labels
are no labels. Without labelled rows of both kinds nothing is known to be toxic and
every score is 0. Repeated rows get equal scores; equal ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicloom.llm import channel
from civicloom.llm.words import BASE, batch, freed, mix, powers, slices, split, text_bytes
from civicloom.operators.skew import settle

SAMPLE, LEXICON = 12_000, 50_000
#: Toxic documents that a word or beginning must be in.
SUPPORT = 3
#: Beginnings of words, in bytes.
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD, FOLDS, CURVE_FOLD = 0.5, 5, 4
SLICE_ROWS, SLICE_BYTES = 4096, 2 << 20
#: Words of evidence that a word is like any other, and weights that count as a hit.
_PRIOR, _HIT, _STRONG = 4.0, 1.0, 2.5
_WORD = np.zeros(256, bool)
_WORD[0x61:0x7B] = True
_WORD[0x80:] = True


def held_out(key: F.Column) -> F.Column:
    return F.crc32(key.cast("string")) % FOLDS == 0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words x features, first word of each text): a 64-bit hash of each word and of its beginnings, longest first, 0 where there is none."""
    words = split(data, offsets, _WORD)
    up = powers(len(data) + 1, BASE)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    back = powers(len(data) + 1, pow(BASE, -1, 1 << 64))
    size = words.ends - words.starts
    out = np.zeros((len(size), 1 + len(BEGINNINGS)), np.uint64)
    for k, cut in enumerate((0, *sorted(BEGINNINGS, reverse=True))):
        own = np.flatnonzero(size >= cut)
        s = words.starts[own]
        e = words.ends[own] if not cut else s + cut
        out[own, k] = mix((sums[e] - sums[s]) * back[s] + np.uint64(cut)) | np.uint64(1)
    return out.view(np.int64), words.first


@dataclass(frozen=True)
class Model:
    """Sorted hashes with their weights, the weight of all other words, and the curve."""

    keys: np.ndarray
    weights: np.ndarray
    rest: float
    curve: np.ndarray

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """What the curve takes of each restored text."""
        hashes, first = features(data, offsets)
        weight, found = np.full(len(hashes), self.rest), np.zeros(len(hashes), bool)
        for column in hashes.T if len(self.keys) else ():
            at = np.minimum(np.searchsorted(self.keys, column), len(self.keys) - 1)
            hit = ~found & (self.keys[at] == column) & (column != 0)
            weight[hit] = self.weights[at[hit]]
            found |= hit
        n = np.diff(first)

        def total(values):
            sums = np.concatenate([[0.0], np.cumsum(values)])
            return sums[first[1:]] - sums[first[:-1]]

        hits, strong = total(np.where(weight >= _HIT, weight, 0.0)), total(weight >= _STRONG)
        rate = hits / np.maximum(n, 1)
        odds = total(weight)
        return np.stack([np.log1p(hits), np.log1p(strong), np.minimum(np.sqrt(rate), 1.5), np.sign(odds) * np.log1p(np.abs(odds)), np.log1p(n) / 5, np.ones(len(n))], axis=1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(data, offsets) @ self.curve, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    weak = np.full(x.shape[1], penalty)
    weak[-1] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + weak * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(weak)
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
    return w


def _sample(docs: DataFrame, labels: DataFrame, logp: np.ndarray, key: str, text: str, label: str) -> DataFrame:
    """(fold, y, t) of the labelled sample, texts restored."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.orderBy(F.xxhash64("k"), "k").limit(SAMPLE)  # bounded, so broadcast
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(known), "k")
    rows = rows.select((F.crc32(F.col("k").cast("string")) % FOLDS).cast("int").alias("fold"), "y", "t")
    shared = docs.sparkSession.sparkContext.broadcast(logp)

    def read(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for part in slices(b, 2, SLICE_ROWS, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), channel.restored(part.column(2), shared.value)], ["fold", "y", "t"])

    return settle(rows.mapInArrow(freed(read), "fold int, y int, t string"))


def _counts(rows: DataFrame, keys: np.ndarray | None) -> DataFrame:
    """(feature, words, docs) over rows; keys: only these."""
    schema = pa.schema([("feature", pa.int64()), ("words", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for part in slices(b, 0, SLICE_ROWS, SLICE_BYTES):
                hashes, first = features(*text_bytes(part.column(0)))
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                flat, text = hashes.ravel(), np.repeat(text, hashes.shape[1])
                own = flat != 0
                if keys is not None:
                    own &= np.isin(flat, keys)
                flat, text = flat[own], text[own]
                order = np.lexsort((text, flat))
                flat, text = flat[order], text[order]
                new = np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)]
                fresh = new.copy()
                fresh[1:] |= text[1:] != text[:-1]
                at = np.flatnonzero(new)
                if len(at):
                    yield batch(schema, flat[at], np.diff(np.append(at, len(flat))), np.add.reduceat(fresh.astype(np.int64), at))

    found = rows.select("t").mapInArrow(freed(run), "feature bigint, words bigint, docs bigint")
    return found.groupBy("feature").agg(F.sum("words").alias("words"), F.sum("docs").alias("docs"))


def fit(docs: DataFrame, labels: DataFrame, logp: np.ndarray, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """A model from labelled documents outside the held-out fold; None without both kinds."""
    sample = _sample(docs, labels, logp, key, text, label)
    kinds = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return None
    learn = sample.where(F.col("fold") != CURVE_FOLD)
    toxic = _counts(learn.where("y = 1"), None).where(F.col("docs") >= SUPPORT).orderBy(F.desc("docs"), "feature").limit(LEXICON).toArrow()
    keys = np.sort(toxic["feature"].to_numpy())
    clean = _counts(learn.where("y = 0"), keys).toArrow()
    t, c = np.zeros(len(keys)), np.zeros(len(keys))
    t[np.searchsorted(keys, toxic["feature"].to_numpy())] = toxic["words"].to_numpy()
    c[np.searchsorted(keys, clean["feature"].to_numpy())] = clean["words"].to_numpy()

    def words(part: pa.Array, y: pa.Array, model: Model):
        data, offsets = text_bytes(part)
        return model.evidence(data, offsets), y.to_numpy(zero_copy_only=False), np.diff(split(data, offsets, _WORD).first)

    def gathered(model: Model, rows: DataFrame, done):
        """Small arrays, one a slice, computed by tasks."""

        def run(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                for part in slices(b, 1, SLICE_ROWS, SLICE_BYTES):
                    yield pa.RecordBatch.from_arrays([pa.array(done(*words(part.column(1), part.column(0), model)), pa.list_(pa.float64()))], ["x"])

        return rows.select("y", "t").mapInArrow(freed(run), "x array<double>")

    none = Model(keys[:0], t[:0], 0.0, np.zeros(6))
    sizes = gathered(none, learn, lambda _, y, n: [[n[y == 0].sum(), n[y == 1].sum()]]).select(F.sum(F.col("x")[0]), F.sum(F.col("x")[1])).first()
    all_clean, all_toxic = (float(v or 0) for v in sizes)
    base = max(all_toxic, 1) / max(all_clean + all_toxic, 1)
    share = (t + _PRIOR * base) / (t + c + _PRIOR)
    weights = np.log(share / (1 - share)) - np.log(base / max(1 - base, 1e-9))
    # words outside the lexicon say a little: toxic texts have fewer of them. So do words inside that tell nothing
    telling = weights >= _HIT
    told = min(t[telling].sum() / (1 + len(BEGINNINGS)) / max(all_toxic, 1), 0.5)
    rest = float(np.log1p(-told))
    model = Model(keys, np.where(telling, weights, rest), rest, np.zeros(6))
    rows = gathered(model, sample.where(F.col("fold") == CURVE_FOLD), lambda x, y, _: np.column_stack([y, x]).tolist()).toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, 7)
    if len(set(x[:, 0].tolist())) < 2:
        return None
    return Model(model.keys, model.weights, rest, fit_curve(x[:, 1:], x[:, 0]))


def score(docs: DataFrame, model: Model | None, logp: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_restored) of every document; n_restored: chunks that read otherwise than written."""
    shared = docs.sparkSession.sparkContext.broadcast((model, logp))
    schema = pa.schema([("score", pa.float64()), ("n_restored", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        model, logp = shared.value
        for b in batches:
            for part in slices(b, 1, SLICE_ROWS, SLICE_BYTES):
                data, offsets = text_bytes(pc.utf8_lower(part.column(1)))
                data, offsets, changed = channel.restore(data, offsets, logp)
                found = model.scores(data, offsets) if model is not None else np.zeros(part.num_rows)
                out = batch(schema, found, changed)
                yield pa.RecordBatch.from_arrays([part.column(0), *out.columns], ["doc_id", "score", "n_restored"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(freed(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, n_restored bigint")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: fold, score, prediction, restored chunks."""
    logp = channel.model(channel.counts(docs))
    scored = score(docs, fit(docs, labels, logp), logp)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_restored")
