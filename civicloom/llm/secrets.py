"""Secrets by grammar inference.

Every whole text gives base matches (fixed patterns) and candidate tokens. From a
bounded sample of labelled credentials a prefix tree over character classes is
built for each kind; statistically compatible states are merged (Hoeffding bounds
on the frequencies of all continuations), which leaves small probabilistic
automata. All candidates are then scored by format likelihood; one that scores
like the credentials of a kind becomes a span of kind `format`.

Base kinds, leftmost and non-overlapping per kind: assign (value of 6+
characters; the span is the whole match), access (20+ characters), hex (24+).
They stay whatever their score.

Null and empty texts have no spans; without labelled credentials there is no
automaton and only base spans remain. Equal rows give equal results.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicloom.operators.skew import settle

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "format")
#: Distinct credential formats learned from for each kind, and the longest of them.
SAMPLE, LONGEST = 400, 128
#: Share of a kind's credentials that may score below its threshold.
MISSED = 0.05

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
#: Character classes: digit, hexadecimal lower case, other lower case, upper case; all else stands for itself.
_CLASS = str.maketrans(
    {**{c: "0" for c in "0123456789"}, **{c: "a" for c in "abcdef"}, **{chr(c): "z" for c in range(ord("g"), ord("z") + 1)}, **{chr(c): "A" for c in range(ord("A"), ord("Z") + 1)}}
)
FOUND = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("value", "string"))
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(text: str) -> list[tuple[str, int, int, str]]:
    """Base matches and candidate tokens (kind `token`) of one text."""
    out = [("assign", m.start(), m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    out += [("token", m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0])]
    return out


@F.arrow_udf(FOUND)
def candidates(text: pa.Array) -> pa.Array:
    parts = [pa.array([find(t) if t else [] for t in text.slice(s, 256).to_pylist()], type=_FOUND) for s in range(0, len(text), 256)]
    return pa.concat_arrays(parts) if parts else pa.array([], type=_FOUND)


class Automaton:
    """A probabilistic automaton: per state the counts of symbols and of ends."""

    def __init__(self):
        self.to: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]

    def add(self, word: str, times: int) -> None:
        at = 0
        for c in word:
            if c not in self.to[at]:
                self.to[at][c] = len(self.to)
                self.to.append({})
                self.count.append({})
                self.ends.append(0)
            self.count[at][c] = self.count[at].get(c, 0) + times
            at = self.to[at][c]
        self.ends[at] += times

    def total(self, at: int) -> int:
        return self.ends[at] + sum(self.count[at].values())

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether the two states may be one: at no pair of states that the same
        symbols lead to do the frequencies of an end or a symbol differ by more
        than the Hoeffding bound."""
        todo, bound = [(a, b)], math.sqrt(0.5 * math.log(2 / alpha))
        seen = set()
        while todo:
            x, y = pair = todo.pop()
            if pair in seen:
                continue
            seen.add(pair)
            n, m = self.total(x), self.total(y)
            if not n or not m:
                continue
            most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[x] / n - self.ends[y] / m) > most:
                return False
            for c in self.count[x].keys() | self.count[y].keys():
                if abs(self.count[x].get(c, 0) / n - self.count[y].get(c, 0) / m) > most:
                    return False
                if c in self.to[x] and c in self.to[y]:
                    todo.append((self.to[x][c], self.to[y][c]))
        return True

    def fold(self, into: int, tree: int) -> None:
        """Adds the tree's counts to the states that the same symbols lead to."""
        todo = [(into, tree)]
        while todo:
            x, y = todo.pop()
            self.ends[x] += self.ends[y]
            for c, n in self.count[y].items():
                self.count[x][c] = self.count[x].get(c, 0) + n
                if c in self.to[x]:
                    todo.append((self.to[x][c], self.to[y][c]))
                else:
                    self.to[x][c] = self.to[y][c]

    def merged(self, alpha: float) -> Automaton:
        """Merges states from the root outwards, the most frequent first."""
        kept, edge = [0], {t: (0, c) for c, t in self.to[0].items()}
        while edge:
            at = max(edge, key=lambda t: (self.total(t), -t))
            parent, symbol = edge.pop(at)
            into = next((k for k in kept if self.compatible(k, at, alpha)), None)
            if into is None:
                kept.append(at)
            else:
                self.to[parent][symbol] = into
                self.fold(into, at)
            done = set(kept)
            edge = {t: (k, c) for k in kept for c, t in self.to[k].items() if t not in done}
        number = {k: i for i, k in enumerate(kept)}
        out = Automaton()
        out.to = [{c: number[t] for c, t in self.to[k].items()} for k in kept]
        out.count = [dict(self.count[k]) for k in kept]
        out.ends = [self.ends[k] for k in kept]
        return out

    def score(self, word: str) -> float:
        """Mean log-likelihood per symbol, the end included; one smoothed miss ends the walk as unlikely."""
        at, sum_ = 0, 0.0
        for i, c in enumerate(word):
            n = self.total(at)
            if c not in self.to[at]:
                return (sum_ + (len(word) - i + 1) * math.log(1e-4)) / (len(word) + 1)
            sum_ += math.log((self.count[at][c] + 0.01) / (n + 1))
            at = self.to[at][c]
        return (sum_ + math.log((self.ends[at] + 0.01) / (self.total(at) + 1))) / (len(word) + 1)


def symbols(value: str) -> str:
    return value.translate(_CLASS)


def fit(examples: DataFrame, alpha: float = 0.05) -> dict[str, tuple[Automaton, float]]:
    """Automata and thresholds from labelled credentials (kind, value).

    Formats are counted on the cluster; SAMPLE of them for each kind, taken by
    hash, at most LONGEST long, come to the driver."""
    as_format = F.translate("value", "".join(map(chr, _CLASS)), "".join(_CLASS.values()))
    counted = examples.where(F.length("value") <= LONGEST).groupBy("kind", as_format.alias("format")).count()
    models = {}
    for kind in sorted(BASE_KINDS):
        rows = counted.where(F.col("kind") == kind).orderBy(F.xxhash64("format"), "format").limit(SAMPLE).collect()
        if not rows:
            continue
        tree = Automaton()
        for r in rows:
            tree.add(r["format"], r["count"])
        model = tree.merged(alpha)
        scores = np.array([model.score(r["format"]) for r in rows])
        weights = np.array([r["count"] for r in rows], dtype=float)
        order = np.argsort(scores)
        share = np.cumsum(weights[order]) / weights.sum()
        models[kind] = (model, float(scores[order][np.searchsorted(share, MISSED)]))
    return models


def scorer(models: dict[str, tuple[Automaton, float]]):
    """(kind, start, end) spans out of candidates: base ones, and tokens that
    score like a credential and meet no base span."""

    def choose(found: list[dict]) -> list[tuple[str, int, int]]:
        base = [(f["kind"], f["start"], f["end"]) for f in found if f["kind"] != "token"]
        out = list(base)
        for f in found:
            if f["kind"] == "token" and not any(s < f["end"] and f["start"] < e for _, s, e in base):
                word = symbols(f["value"])
                if any(m.score(word) >= least for m, least in models.values()):
                    out.append(("format", f["start"], f["end"]))
        return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))

    @F.arrow_udf(SPANS)
    def score(found: pa.Array) -> pa.Array:
        return pa.array([choose(f) if f else [] for f in found.to_pylist()], type=_SPANS)

    return score


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, secrets) with the spans of every document. The texts are read once;
    their candidates are written, learned from and scored."""
    found = settle(docs.select(F.col(key), candidates(F.col(text)).alias("found")))
    labelled = found.select(F.explode("found").alias("f")).select("f.kind", "f.value").where(F.col("kind") != "token")
    return found.select(key, scorer(fit(labelled))(F.col("found")).alias("secrets"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans."""
    from civicloom.llm.pii import joined, of_kind

    found = scan(docs)
    counts = [F.size(of_kind(F.col("secrets"), k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(of_kind(F.col("secrets"), *BASE_KINDS)), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        F.size(of_kind(F.col("secrets"), "format")).cast("long").alias("n_format"),
    )
