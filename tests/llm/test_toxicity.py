"""Restoring disguised words against every possible reading; scores on held-out documents."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from civicloom.llm import channel, toxicity
from civicloom.llm.words import text_bytes

SCHEMA = "doc_id bigint, text string, k string, t int, y string, fold int, score string"
TOXIC = "idiot worthless moron clown scum trash loser".split()


def plain_words(seed=1, n=300):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(["an", "er", "th", "on", "ti", "is", "li", "vo", "be", "ra"]) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def corpus(seed=2, n=900):
    """(id, text, toxic): toxic documents hold a few of the words."""
    rnd, words = random.Random(seed), plain_words()
    out = []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        bad = rnd.random() < 0.2
        for _ in range(rnd.randint(2, 4) if bad else 0):
            text.insert(rnd.randrange(len(text)), rnd.choice(TOXIC))
        out.append((i, " ".join(text), int(bad)))
    return out


def fitted():
    texts = [t for _, t, _ in corpus()]
    data, offsets = text_bytes(pa.array(texts))
    return channel.model(np.bincount(channel.grams(channel.symbols(data, offsets)), minlength=channel.CELLS))


def disguise(word, rnd):
    way = rnd.randrange(4)
    if way == 0:
        return "".join({"i": "1", "o": "0", "s": "$", "a": "@", "e": "3"}.get(c, c) for c in word)
    if way == 1:
        return " ".join(word)
    if way == 2:
        at = rnd.randrange(len(word))
        return word[:at] + word[at] * 4 + word[at + 1 :]
    return ".".join(word)


def test_counts_of_words(spark):
    texts = [None, "", "Ab a1 ÀB-日x", "ab  ab\nab", "ends", "z" * 10, "é", "3,5 µ"]
    want = Counter()
    for t in texts:
        s = [channel._base(c) for c in (t or "").lower()]
        for word, _ in itertools.groupby(s, key=bool):
            if word:
                run = list(_)
                for i, c in enumerate([*run, 0]):
                    before = ([0, 0, 0] + run[:i])[-3:]
                    want[((before[0] * 32 + before[1]) * 32 + before[2]) * 32 + c] += 1
    docs = spark.createDataFrame([(i, t, "k", 1, "y", 2, "s") for i, t in enumerate(texts)], SCHEMA)
    got = channel.counts(docs)
    assert {i: int(n) for i, n in enumerate(got) if n} == dict(want)
    p = np.exp(channel.model(got).astype(float))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5) and p.min() > 0


def best_score(chunk, logp):
    """The likeliest reading of all, by trying each."""
    options = []
    for i, c in enumerate(chunk):
        kind = channel._class(c)
        own = [(r[0], r[2]) for r in channel._READINGS[kind]]
        if i and chunk[i - 1] == c:
            own.append((-1, channel._REPEAT if channel._ALPHA[kind] else channel._MARK_REPEAT))
        options.append(own)
    best = -1e9
    for path in itertools.product(*options):
        score, context = 0.0, 0
        for symbol, cost in path:
            score += cost
            if symbol == -1 or symbol == 0 and context == 0:
                continue
            score += float(logp[context, symbol])
            context = 0 if symbol == 0 else ((context << 5) | symbol) & 0x7FFF
        best = max(best, score + (float(logp[context, 0]) if context else 0))
    return best


def reading_score(chunk, read, logp):
    """The likeliest way in which a chunk can be read as `read`."""
    states = {(0, ""): 0.0}
    for i, c in enumerate(chunk):
        kind = channel._class(c)
        own = list(channel._READINGS[kind])
        if i and chunk[i - 1] == c:
            own.append((-1, "", channel._REPEAT if channel._ALPHA[kind] else channel._MARK_REPEAT))
        new: dict = {}
        for (context, text), score in states.items():
            for symbol, out, cost in own:
                s, ctx, said = score + cost, context, text + (c if out is None else out)
                if not (symbol == -1 or symbol == 0 and context == 0):
                    s += float(logp[context, symbol])
                    ctx = 0 if symbol == 0 else ((context << 5) | symbol) & 0x7FFF
                new[ctx, said] = max(new.get((ctx, said), -1e9), s)
        states = new
    return max(s + (float(logp[ctx, 0]) if ctx else 0) for (ctx, said), s in states.items() if " ".join(said.split()) == read)


def test_decoding_is_exact():
    logp, rnd = fitted(), random.Random(4)
    chunks = ["".join(rnd.choice("abio1!0$s 5.-é4日") for _ in range(rnd.randint(1, 7))).strip() or "a" for _ in range(120)]
    chunks = list(dict.fromkeys([*chunks, "1d10t", "aaa", "!!!", "a", "i d i o"]))
    for chunk, read in zip(chunks, channel.decode(chunks, logp)):
        assert abs(best_score(chunk, logp) - reading_score(chunk, read, logp)) < 1e-3, (chunk, read)
    assert channel.decode([], logp) == []
    # decoded alone or beside others, a chunk reads the same
    assert channel.decode(chunks, logp) == [channel.decode([c], logp)[0] for c in chunks]


def test_restored_texts():
    logp, rnd = fitted(), random.Random(6)
    hidden = [(w, disguise(w, rnd)) for w in TOXIC * 6]
    texts = [None, "", " ", "An THISERA on. Ver,", *[f"Therer {d} on anis" for _, d in hidden], "x" * 3000, "a1" * 2000, "i d", "Ä Ö Ü", "1 2 3"]
    got = channel.restored(pa.array(texts, pa.string()), logp).to_pylist()
    assert got[:4] == ["", "", " ", "an thisera on. ver,"]
    right = sum(w in t.split() for (w, _), t in zip(hidden, got[4:]))
    assert right >= 0.9 * len(hidden), [(d, t) for (_, d), t in zip(hidden, got[4:])]
    assert all(t.startswith("therer ") and t.endswith(" on anis") for t in got[4 : 4 + len(hidden)])
    assert got[-3:] == ["i d", "ä ö ü", "1 2 3"]
    # cuts between batches change nothing
    assert [channel.restored(pa.array([t], pa.string()), logp).to_pylist()[0] for t in texts] == got


def test_pieces_overlap():
    text = "".join(random.Random(1).choice("abc1") for _ in range(3000))
    pieces = channel._pieces(text)
    assert all(any(text[i : i + channel.LAP] in p for p in pieces) for i in range(len(text) - channel.LAP + 1))
    assert channel._pieces("ab1") == ["ab1"]


def test_features_of_words():
    texts = ["abcdefgh abcd abc x", "", "abcdxy, abcd"]
    hashes, first = toxicity.features(*text_bytes(pa.array(texts)))
    assert first.tolist() == [0, 4, 4, 6]
    words = ["abcdefgh", "abcd", "abc", "x", "abcdxy", "abcd"]
    names = {}
    for word, row in zip(words, hashes.tolist()):
        for cut, h in zip((0, 7, 6, 5, 4), row):
            assert (h != 0) == (len(word) >= cut)
            if h:
                assert names.setdefault((cut, word[:cut] if cut else word), h) == h
    assert len(set(names.values())) == len(names)


def test_scores_of_held_out_documents(spark):
    rnd = random.Random(9)
    rows = corpus(n=1500)
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    # disguised words in half of the held-out documents
    texts = [(i, " ".join(disguise(w, rnd) if i in held and i % 2 and w in TOXIC else w for w in t.split()), y) for i, t, y in rows]
    odd = [(5001, None), (5002, ""), (5003, "idiot " * 20_000), (5004, "1d10t"), (None, "moron clown"), (5002, "")]
    docs = spark.createDataFrame([(i, t, "k", 1, "y", 2, "s") for i, t in [*[(i, t) for i, t, _ in texts], *odd]], SCHEMA)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in texts] + [(None, 1, 1), (5001, None, 1), (7, rows[7][2], 1)], "doc_id bigint, toxic int, quality int")
    got = toxicity.report(docs, labels).collect()
    assert len(got) == len(texts) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].held_out == (i in held) for i, _, _ in rows)
    wrong = [i for i, _, y in rows if i in held and by_id[i].predicted != y]
    assert len(wrong) <= 0.03 * len(held), wrong
    assert by_id[5003].predicted == 1 and by_id[5001].score == by_id[5002].score and by_id[5001].predicted == 0
    assert by_id[5004].n_restored == 1 and by_id[5002].n_restored == 0


@pytest.mark.parametrize("toxic", [[], [0, 0, 0], [1, 1], [None]])
def test_scores_without_labels_of_both_kinds(spark, toxic):
    docs = spark.createDataFrame([(i, "idiot text", "k", 1, "y", 2, "s") for i in range(4)], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)], "doc_id bigint, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.report(docs, labels).collect()} == {(0.0, 0)}
    assert toxicity.report(docs.limit(0), labels).count() == 0


def test_case_and_accents():
    data, offsets = text_bytes(pc.utf8_lower(pa.array(["ÀB", "Éa"])))
    assert channel.symbols(data, offsets).tolist() == [0, 1, 2, 0, 5, 1, 0]
