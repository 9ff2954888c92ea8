"""Restoring disguised words: a noisy channel over a character language model.

What was written is read as a lattice: each character may stand for itself, for a
letter it looks like (1d10t), for a border, or for nothing (a separator within a
spaced-out word, a repeated letter). Viterbi finds the likeliest reading under a
model of words of four characters' depth whose counts come from all documents. It is
exact: readings are merged only where the last three characters agree.

Only chunks that could be disguised have more than one reading: tokens with a
look-alike among letters, with a letter three times in a row, with single letters set
apart by punctuation, and three or more single letters in a row set apart by
blanks. Everything else stays as it is, lower-cased. All chunks of a batch are
decoded side by side, equal ones once. An unbroken chunk of more than PIECE
characters is read in pieces that overlap by LAP, so a word at a cut is whole in one
of them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicloom.llm.words import batch, freed, slices, text_bytes

#: Symbols of the language model: 0 is a border, 1 to 26 letters, then any other letter and any digit.
OTHER, DIGIT, SYMBOLS = 27, 28, 32
CELLS = SYMBOLS**4
PIECE, LAP = 512, 64
SLICE_ROWS, SLICE_BYTES = 4096, 2 << 20

# Letters that a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou",
    "€": "e", "£": "l", "¡": "i", "¢": "c",
}

# Log-probabilities of the channel.
_ALIKE, _ANY_VOWEL, _AS_DIGIT = -1.5, -3.0, -1.0
_REPEAT, _MARK_REPEAT = -1.0, -0.3
_MARK_BORDER, _MARK_NOTHING = -1.5, -3.0
_POINT_BORDER, _POINT_NOTHING = -0.7, -1.0
_BLANK_BORDER, _BLANK_NOTHING = -1.0, -1.0


def _base(char: str) -> int:
    """The model's symbol of a lower-case character: a letter without its marks, another letter, a digit, or a border."""
    plain = unicodedata.normalize("NFD", char)[0]
    if "a" <= plain <= "z":
        return ord(plain) - 96
    if char.isdigit():
        return DIGIT
    return OTHER if char.isalpha() else 0


_BYTE = np.array([ord(c) - 96 if "a" <= c <= "z" else DIGIT if "0" <= c <= "9" else 0 for c in map(chr, range(128))] + [255] * 64 + [OTHER] * 64, np.uint8)
#: Symbols of U+00C0 to U+00FF by their second byte (first byte C3).
_LATIN = np.array([_base(chr(0xC0 + i)) for i in range(64)], np.uint8)


def symbols(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lower-cased texts as symbols: one border between words, and one at either end."""
    s = _BYTE[data]
    pair = np.flatnonzero(data[:-1] == 0xC3)
    s[pair] = _LATIN[data[pair + 1] & 0x3F]
    starts = offsets[:-1][(offsets[:-1] < len(data))]
    s = np.insert(s, starts, 0)
    s = s[s != 255]
    s = np.concatenate([[0], s, [0]]).astype(np.uint8)
    return s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]


def grams(s: np.ndarray) -> np.ndarray:
    """A cell for each symbol after the first: the three symbols before it, as far as they belong to the same word, and itself."""
    s = s.astype(np.int64)
    one, two, three = s[:-1], np.concatenate([[0], s[:-2]]), np.concatenate([[0, 0], s[:-3]])[: len(s) - 1]
    two = np.where(one == 0, 0, two)
    three = np.where(two == 0, 0, three)
    return ((three * SYMBOLS + two) * SYMBOLS + one) * SYMBOLS + s[1:]


def counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each cell occurs in all documents: one row a cell and task is shuffled, and at most CELLS come to the driver."""
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for part in slices(b, 0, SLICE_ROWS, SLICE_BYTES):
                data, offsets = text_bytes(pc.utf8_lower(part.column(0)))
                if len(data):
                    total += np.bincount(grams(symbols(data, offsets)), minlength=CELLS)
        met = np.flatnonzero(total)
        yield batch(schema, met.astype(np.int32), total[met])

    cells = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(freed(run), "cell int, n bigint")
    got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(CELLS, np.int64)
    total[got["cell"].to_numpy()] = got["n"].to_numpy()
    return total


def model(total: np.ndarray) -> np.ndarray:
    """Log-probabilities [three symbols before, symbol]: counts of all depths, each
    resting on the shallower one as far as it has seen many different followers."""
    c = total.reshape(SYMBOLS, SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for own in (c.sum(axis=(0, 1, 2)), c.sum(axis=(0, 1)), c.sum(axis=0), c):
        rest = np.maximum((own > 0).sum(axis=-1, keepdims=True), 1)
        p = (own + rest * p) / (own.sum(axis=-1, keepdims=True) + rest)
    return np.log(p).reshape(-1, SYMBOLS).astype(np.float32)


def _options() -> tuple[dict[str, int], list[list[tuple[int, str | None, float]]]]:
    """Classes of characters, and for each its readings: (symbol or -1 for nothing, what is read or None for the character itself, log-probability)."""
    classes: dict[str, int] = {}
    readings: list[list[tuple[int, str | None, float]]] = []

    def add(chars, found):
        for c in chars:
            classes[c] = len(readings)
        readings.append(found)

    for i in range(26):
        add(chr(97 + i), [(i + 1, None, 0.0)])
    for c, letters in LOOKALIKES.items():
        found = [(ord(x) - 96, x, _ANY_VOWEL if c == "*" else _ALIKE) for x in letters]
        add(c, found + ([(DIGIT, None, _AS_DIGIT)] if c.isdigit() else [(0, " ", _MARK_BORDER), (-1, "", _MARK_NOTHING)]))
    add(" ", [(0, " ", _BLANK_BORDER), (-1, "", _BLANK_NOTHING)])
    add(["point"], [(0, " ", _POINT_BORDER), (-1, "", _POINT_NOTHING)])
    add(["other"], [(OTHER, None, 0.0)])
    return classes, readings


_CLASSES, _READINGS = _options()
_WIDEST = max(map(len, _READINGS))
_SYMBOL = np.array([[r[0] for r in x] + [-2] * (_WIDEST - len(x)) for x in _READINGS])
_COST = np.array([[r[2] for r in x] + [0.0] * (_WIDEST - len(x)) for x in _READINGS], np.float32)
_ALPHA = np.array([all(r[0] > 0 for r in x) for x in _READINGS])


def _class(char: str) -> int:
    if char in _CLASSES:
        return _CLASSES[char]
    s = _base(char)
    return _CLASSES[chr(96 + s)] if 0 < s <= 26 else _CLASSES["other"] if s else _CLASSES["point"]


def decode(chunks: list[str], logp: np.ndarray) -> list[str]:
    """The likeliest reading of each lower-cased chunk."""
    known: dict[str, int] = {}
    sizes = np.array([len(c) for c in chunks])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    kinds = np.full((len(chunks), longest), -1, np.int16)
    same = np.zeros((len(chunks), longest), bool)
    for i, k in enumerate(order):
        text = chunks[k]
        for c in set(text):
            if c not in known:
                known[c] = _class(c)
        kinds[i, : len(text)] = [known[c] for c in text]
        same[i, 1 : len(text)] = [a == b for a, b in zip(text, text[1:])]
    item, context, score = np.arange(len(chunks)), np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.float32)
    ended = np.full(len(chunks), -1)
    trail: list[tuple[np.ndarray, np.ndarray]] = []
    for t in range(longest + 1):
        # chunks of this length end: border, then the best reading
        done = sizes[item] == t
        if done.any():
            at = np.flatnonzero(done)
            final = score[at] + np.where(context[at] > 0, logp[context[at], 0], 0)
            best = np.lexsort((-final, item[at]))
            first = np.concatenate([[True], item[at][best][1:] != item[at][best][:-1]])
            ended[item[at][best][first]] = at[best][first]
        if t == longest:
            break
        live = np.flatnonzero(~done)
        kind = kinds[item[live], t]
        symbol = _SYMBOL[kind]
        cost = _COST[kind]
        # one reading more: nothing, where the character before was the same
        again = same[item[live], t]
        symbol = np.concatenate([symbol, np.where(again, -1, -2)[:, None]], axis=1)
        cost = np.concatenate([cost, np.where(_ALPHA[kind], _REPEAT, _MARK_REPEAT).astype(np.float32)[:, None]], axis=1)
        parent, reading = np.nonzero(symbol > -2)
        emitted, gained = symbol[parent, reading], cost[parent, reading]
        parent = live[parent]
        before = context[parent]
        silent = (emitted == -1) | ((emitted == 0) & (before == 0))
        gained = score[parent] + gained + np.where(silent, 0, logp[before, np.maximum(emitted, 0)])
        after = np.where(emitted == 0, 0, np.where(silent, before, ((before << 5) | np.maximum(emitted, 0)) & 0x7FFF))
        key = (item[parent] << 15) | after
        best = np.lexsort((reading, -gained, key))
        best = best[np.concatenate([[True], key[best][1:] != key[best][:-1]])]
        trail.append((parent[best], reading[best]))
        item, context, score = item[parent[best]], after[best], gained[best]
    picked = np.full((len(chunks), longest), -1, np.int16)
    state = ended.copy()
    for t in range(longest - 1, -1, -1):
        own = np.flatnonzero(sizes > t)
        parents, readings = trail[t]
        picked[own, t] = readings[state[own]]
        state[own] = parents[state[own]]
    out = [""] * len(chunks)
    for i, k in enumerate(order):
        read = []
        for c, kind, r in zip(chunks[k], kinds[i].tolist(), picked[i].tolist()):
            if r < len(_READINGS[kind]):
                read.append(c if _READINGS[kind][r][1] is None else _READINGS[kind][r][1])
        out[k] = " ".join("".join(read).split())
    return out


def _flags(*chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    for c in "".join(chars):
        table[ord(c)] = True
    return table


_LETTER = _flags("abcdefghijklmnopqrstuvwxyz")
_WIDE = _LETTER.copy()
_WIDE[0x80:] = True
_BLANK = _flags(" \t\n\r\x0b\x0c")
_ALIKE_BYTE = _flags("".join(c for c in LOOKALIKES if ord(c) < 128))
#: Look-alikes that say nothing at the end of a token.
_CLOSING = _flags("!*+|(<")


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the chunks of lower-cased texts that have more than one reading."""
    n = len(data)
    solid = ~_BLANK[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before, behind = cut[:-1].copy(), cut[1:].copy()
    before[1:] |= ~solid[:-1]
    behind[:-1] |= ~solid[1:]
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & behind) + 1
    if not len(starts):
        return starts, ends
    letter, wide, alike = _LETTER[data], _WIDE[data], _ALIKE_BYTE[data]

    def number(mask):
        sums = np.zeros(n + 1, np.int32)
        np.cumsum(mask, out=sums[1:])
        return sums[ends] - sums[starts]

    token = np.cumsum(np.bincount(starts, minlength=n)) - 1
    # the last byte of each token that is not a closing mark
    open_ = np.flatnonzero(solid & ~_CLOSING[data])
    last = starts.copy()
    np.maximum.at(last, token[open_], open_)
    inner = alike & (np.arange(n) <= last[np.maximum(token, 0)])
    # a byte three times in a row, within the token
    thrice = np.zeros(n, bool)
    thrice[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    # single letters with one mark between them
    apart = np.zeros(n, bool)
    apart[2:] = (wide | alike)[2:] & solid[1:-1] & ~wide[1:-1] & ~((data[1:-1] >= 0x30) & (data[1:-1] <= 0x39)) & (wide | alike)[:-2]
    alone = np.zeros(n, bool)
    alone[2:-2] = apart[2:-2] & apart[4:]
    odd = (number(wide) > 0) & (number(inner) > 0) | (number(thrice) > 0) | (number(alone) > 0)
    # three or more single characters in a row, one or two blanks between them
    size = ends - starts
    single = (size == 1) & (letter[starts] | alike[starts])
    next_ = np.zeros(len(starts), bool)
    gap = starts[1:] - ends[:-1]
    same = np.searchsorted(offsets, starts[1:], side="right") == np.searchsorted(offsets, starts[:-1], side="right")
    next_[:-1] = single[:-1] & same & (gap >= 1) & (gap <= 2) & (data[np.minimum(ends[:-1], n - 1)] == 0x20)
    # the last one may carry a mark
    tail = (size == 2) & letter[starts] & ~wide[np.minimum(starts + 1, n - 1)]
    linked = np.zeros(len(starts), bool)
    linked[:-1] = next_[:-1] & (single[1:] | tail[1:])
    group = np.cumsum(~np.concatenate([[False], linked[:-1]])) - 1
    members = np.bincount(group)
    firsts = np.flatnonzero(~np.concatenate([[False], linked[:-1]]))
    lasts = np.append(firsts[1:], len(starts)) - 1
    spaced = (members >= 3) & (np.bincount(group, weights=letter[starts]) > 0)
    # groups of fewer than three are their tokens
    few = np.flatnonzero(~spaced[group] & odd)
    s = np.concatenate([starts[firsts[spaced]], starts[few]])
    e = np.concatenate([ends[lasts[spaced]], ends[few]])
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def _pieces(text: str) -> list[str]:
    return [text[i : i + PIECE] for i in range(0, max(len(text) - LAP, 1), PIECE - LAP)]


def restore(data: np.ndarray, offsets: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts with their chunks read: bytes, borders, and how many chunks of each text read otherwise than written."""
    s, e = chunks(data, offsets)
    changed = np.zeros(len(offsets) - 1, np.int64)
    if not len(s):
        return data, offsets, changed
    raw = data.tobytes()
    written = [raw[i:j].decode("utf-8", "replace") for i, j in zip(s.tolist(), e.tolist())]
    distinct = {w: _pieces(w) for w in dict.fromkeys(written)}
    flat = list(dict.fromkeys(p for pieces in distinct.values() for p in pieces))
    read = dict(zip(flat, decode(flat, logp)))
    whole = {w: " ".join(read[p] for p in pieces) for w, pieces in distinct.items()}
    text = np.searchsorted(offsets, s, side="right") - 1
    out, lengths, at = [], np.diff(offsets), 0
    for i, j, w, k in zip(s.tolist(), e.tolist(), written, text.tolist()):
        new = whole[w]
        if plain(w) != new:
            changed[k] += 1
        new = new.encode()
        out += [raw[at:i], new]
        lengths[k] += len(new) - (j - i)
        at = j
    out.append(raw[at:])
    return np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum(lengths)]), changed


def plain(text: str) -> str:
    """A chunk without marks, as it would read if nothing were disguised."""
    return " ".join("".join(c if _base(c) else " " for c in text).split())


def restored(texts: pa.Array, logp: np.ndarray) -> pa.Array:
    """Whole texts, lower-cased, with disguised words restored."""
    out = []
    for part in slices(pa.RecordBatch.from_arrays([texts], ["t"]), 0, SLICE_ROWS, SLICE_BYTES):
        data, offsets = text_bytes(pc.utf8_lower(part.column(0)))
        data, offsets, _ = restore(data, offsets, logp)
        out.append(pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]))
    return pa.concat_arrays(out).cast(pa.string()) if out else pa.array([], pa.string())
