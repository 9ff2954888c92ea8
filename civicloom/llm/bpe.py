"""Byte-level BPE encoding and decoding, exact for texts of any length.

A text is cut where the tokenizer's own splitting always cuts: before a run of
white space that follows something else. Each distinct piece of a batch is encoded
once. A piece longer than LEAF characters is long unsplit text; the tokenizer
alone would work on it in one go, so it is encoded by tree concatenation: it is
halved down to leaves, the leaves are encoded in parallel by other tasks, and
neighbours are joined level by level. A join re-encodes a window of text around
the seam, taken wider and wider until its tokens agree exactly with the left
side's at its start and with the right side's at its end. (A sequence in which
every two neighbouring tokens are what the tokenizer gives for their text is the
encoding of the whole, and agreement makes all neighbours such pairs.)

Null and empty texts have no tokens and decode to the empty text. Repeated rows
are encoded alike. The vocabulary's path is a parameter and must be readable where
tasks run.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicloom.llm.words import batch, freed, lists, ragged, slices, text_bytes
from civicloom.operators.skew import settle

#: Bytes of unsplit text that one task encodes in one go.
LEAF = 4096
#: Characters on each side of a seam that the first window has, and tokens that must agree on each side.
SEAM, AGREE = 64, 8

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes after which white space may go on with white space before it.
_UNSURE = np.zeros(256, dtype=bool)
_UNSURE[:0x20], _UNSURE[0x80:] = True, True
#: Texts encoded at a time, and distinct pieces whose ids a worker remembers.
SLICE_ROWS, SLICE_BYTES, REMEMBERED = 4096, 2 << 20, 150_000
_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _loaded[path] = found
    return _loaded[path]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces: of every non-empty text, and of every run of ASCII white
    space after a character that is surely not white space."""
    space = _SPACE[data]
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[:1] = False
    at = np.flatnonzero(start)
    at = at[_UNSURE[data[at - 1]]]
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    # control characters and anything that may end a white-space character beyond ASCII stay with what follows
    odd = (one < 0x20) | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three >= 0xE1) & (three <= 0xE3))
    start[at[odd]] = False
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(start)


def pieces_of(column: pa.Array):
    """(distinct pieces as text, each piece's number, pieces per text)."""
    data, offsets = text_bytes(column)
    starts = cuts(data, offsets)
    per_text = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return [], np.zeros(0, np.int64), per_text
    borders = np.append(starts, len(data)).astype(np.int64)
    body = pa.py_buffer(np.ascontiguousarray(data))
    coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(borders), body]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), per_text


def encode_column(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and each text's number of ids."""
    distinct, number, per_text = pieces_of(column)
    if not len(number):
        return np.zeros(0, np.int64), np.zeros(len(column), np.int64)
    count, flat = _remembered(distinct, path)
    begin = np.cumsum(count) - count
    n = count[number]
    out = flat[ragged(begin[number], n)]
    total = np.zeros(len(number) + 1, np.int64)
    np.cumsum(n, out=total[1:])
    last = np.cumsum(per_text)
    return out, total[last] - total[last - per_text]


def _remembered(distinct: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """As `_encode_pieces`, for the pieces not seen before; a full memory starts anew."""
    known, count, flat = _loaded.get((path, "seen"), (distinct[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)))
    at = pc.index_in(distinct, value_set=known)
    fresh = distinct.filter(at.is_null())
    if len(fresh):
        if len(known) + len(fresh) > REMEMBERED:
            known, count, flat, fresh, at = known[:0], count[:0], flat[:0], distinct, pa.nulls(len(distinct), pa.int32())
        more, ids = _encode_pieces(fresh, path)
        place = pc.fill_null(at, -1).to_numpy().copy()
        place[place < 0] = np.arange(len(known), len(known) + len(fresh))
        known, count, flat = pa.concat_arrays([known, fresh]), np.concatenate([count, more]), np.concatenate([flat, ids])
        _loaded[path, "seen"] = known, count, flat
    else:
        place = at.to_numpy()
    begin, n = (np.cumsum(count) - count)[place], count[place]
    return n, flat[ragged(begin, n)]


def _encode_pieces(distinct: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each piece, and all ids.

    Pieces that begin with white space and end with a printable ASCII character are
    still cut apart when written one after the other. Thousands of them are encoded
    as one text; the ids' byte lengths tell where each piece ends. The others are
    encoded one by one."""
    t, sizes = tokenizer(path), np.diff(vocabulary(path)[1])
    data, borders = text_bytes(distinct)
    n = len(distinct)
    first, last = data[borders[:-1]], data[borders[1:] - 1]
    easy = np.flatnonzero(_SPACE[first] & (last > 0x20) & (last < 0x7F))
    hard = np.setdiff1d(np.arange(n), easy)
    ids, owner = [], []
    if len(easy):
        group = np.cumsum(np.diff(borders)[easy]) // (1 << 15)
        for part in np.split(easy, np.flatnonzero(np.diff(group)) + 1):
            lengths = np.diff(borders)[part]
            text = data[ragged(borders[part], lengths)].tobytes().decode("utf-8")
            got = np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            ends = np.cumsum(lengths)
            ids.append(got)
            owner.append(part[np.searchsorted(ends, np.cumsum(sizes[got]), side="left")])
    for i in range(0, len(hard), 4096):
        part = hard[i : i + 4096]
        got = [e.ids for e in t.encode_batch_fast(distinct.take(pa.array(part)).to_pylist(), add_special_tokens=False)]
        ids.append(np.array([x for g in got for x in g], np.int64))
        owner.append(np.repeat(part, [len(g) for g in got]))
    owner, flat = np.concatenate(owner), np.concatenate(ids)
    return np.bincount(owner, minlength=n), flat[np.argsort(owner, kind="stable")]


def encode_text(text: str, path: str) -> list[int]:
    return tokenizer(path).encode(text, add_special_tokens=False).ids


def leaves(text: str, special: list[str], size: int = LEAF) -> list[str]:
    """The text halved until no part is longer than `size`; special tokens stay whole."""
    borders = [m.span() for s in special for m in re.finditer(re.escape(s), text)]
    todo, out = [(0, len(text))], []
    while todo:
        a, b = todo.pop()
        half = (a + b) // 2
        for s, e in borders:
            if s < half < e:
                half = s if s > a else e
        if b - a <= size or not a < half < b:
            out.append(text[a:b])
        else:
            todo += [(half, b), (a, half)]
    return out


def _starts(lengths: list[int]) -> list[int]:
    out, at = [0], 0
    for n in lengths:
        at += n
        out.append(at)
    return out


class Part:
    """A part of a text: its bytes, ids, and where each token begins in the bytes."""

    def __init__(self, text: bytes, ids: list[int], lengths: list[int]):
        self.text, self.ids, self.lengths = text, ids, lengths


def join(left: Part, right: Part, encode, length_of) -> Part:
    """The two parts' tokens as those of their concatenation.

    The window begins at a token border of the left part and ends at one of the
    right part (both also character borders). It is accepted once AGREE tokens at
    both its ends equal the parts' own; with a whole part in the window that side
    needs no agreement."""
    if not left.text or not right.text:
        return right if not left.text else left
    width = SEAM
    lefts, rights = _starts(left.lengths), _starts(right.lengths)
    while True:
        i = len(left.ids)
        while i > 0 and (len(left.text) - lefts[i] < width or left.text[lefts[i] : lefts[i] + 1] and left.text[lefts[i]] & 0xC0 == 0x80):
            i -= 1
        j = 0
        while j < len(right.ids) and (rights[j] < width or rights[j] < len(right.text) and right.text[rights[j]] & 0xC0 == 0x80):
            j += 1
        window = (left.text[lefts[i] :] + right.text[: rights[j]]).decode("utf-8")
        ids = encode(window)
        head, tail = left.ids[i : i + AGREE], right.ids[max(0, j - AGREE) : j]
        ok_left = i == 0 or (len(head) == AGREE and ids[:AGREE] == head)
        ok_right = j == len(right.ids) or (len(tail) == AGREE and ids[-AGREE:] == tail)
        if ok_left and ok_right:
            return Part(left.text + right.text, left.ids[:i] + ids + right.ids[j:], left.lengths[:i] + [length_of(x) for x in ids] + right.lengths[j:])
        width *= 2


def tree(parts: list[Part], encode, length_of) -> Part:
    """Neighbours joined level by level."""
    while len(parts) > 1:
        parts = [join(parts[k], parts[k + 1], encode, length_of) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable
    bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(0x100 + i): b for i, b in enumerate(hidden)}}


def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes one after the other, and their borders by id."""
    if (path, "bytes") not in _loaded:
        t, byte_of = tokenizer(path), _alphabet()
        special = set(t.get_added_tokens_decoder())
        tokens = []
        for i in range(max(t.get_vocab().values()) + 1):
            token = t.id_to_token(i) or ""
            plain = i in special or any(c not in byte_of for c in token)
            tokens.append(token.encode("utf-8") if plain else bytes(byte_of[c] for c in token))
        borders = np.zeros(len(tokens) + 1, np.int64)
        np.cumsum([len(x) for x in tokens], out=borders[1:])
        _loaded[path, "bytes"] = np.frombuffer(b"".join(tokens), np.uint8), borders
    return _loaded[path, "bytes"]


def _specials(path: str) -> list[str]:
    return [a.content for a in tokenizer(path).get_added_tokens_decoder().values()]


_LEAVES = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("leaf", pa.int32()), ("part", pa.string())])
_LEAF_IDS = pa.schema([*_LEAVES, ("ids", pa.list_(pa.int32()))])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _is_long(column: pa.Array, size: int) -> np.ndarray:
    """Texts with a piece of more than `size` bytes."""
    data, offsets = text_bytes(column)
    starts = cuts(data, offsets)
    wide = np.flatnonzero(np.diff(np.append(starts, len(data))) > size)
    found = np.zeros(len(column), bool)
    found[np.searchsorted(offsets, starts[wide], side="right") - 1] = True
    return found


def _plain(path: str, leaf: int):
    def encoded(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for p in slices(b, 1, SLICE_ROWS, SLICE_BYTES):
                p = p.filter(pa.array(~_is_long(p.column(1), leaf)))
                ids, counts = encode_column(p.column(1), path)
                yield batch(_IDS, p.column(0).cast(pa.int64()), lists(ids.astype(np.int32), counts, pa.int32()))

    return encoded


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids) for every document.

    Documents without long unsplit text are encoded where they are read. Those with
    it go as leaves to tasks of their own and come back as ids of whole texts."""
    rows = docs.select(F.col(key), F.col(text))
    return rows.mapInArrow(freed(_plain(path, leaf)), "doc_id bigint, ids array<int>").unionByName(_encode_long(rows, path, leaf))


def _groups(text: str, specials: list[str], leaf: int) -> Iterator[tuple[int, int, str]]:
    """(piece, leaf, part): long pieces as leaves, what lies between them in groups of pieces."""
    distinct, number, _ = pieces_of(pa.array([text]))
    group, size, piece = [], 0, 0
    for p in [distinct[n].as_py() for n in number.tolist()]:
        long = len(p.encode("utf-8")) > leaf
        if group and (long or size >= leaf):
            yield piece, 0, "".join(group)
            group, size, piece = [], 0, piece + 1
        if long:
            for i, part in enumerate(leaves(p, specials, leaf)):
                yield piece, i, part
            piece += 1
        else:
            group.append(p)
            size += len(p)
    if group:
        yield piece, 0, "".join(group)


def _encode_long(rows: DataFrame, path: str, leaf: int, then=iter, out: str = "doc_id bigint, ids array<int>") -> DataFrame:
    """`then` is done with (doc_id, ids) where a text is put together: one Python step, not two in a row."""

    def split_up(batches):
        for b in (p for b in batches for p in slices(b, 1, SLICE_ROWS, SLICE_BYTES)):
            b = b.filter(pa.array(_is_long(b.column(1), leaf)))
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = list(_groups(text, _specials(path), leaf))
                # each row is a text of its own, also where keys repeat; the number is written with the leaves
                row = int.from_bytes(os.urandom(8), "little", signed=True)
                yield batch(_LEAVES, [key] * len(parts), [row] * len(parts), *map(list, zip(*parts)))

    def encode_leaves(batches):
        for b in batches:
            got = tokenizer(path).encode_batch_fast(b.column("part").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([e.ids for e in got], type=pa.list_(pa.int32()))], schema=_LEAF_IDS)

    def assemble(table: pa.Table) -> pa.Table:
        sizes = np.diff(vocabulary(path)[1])
        whole: list[int] = []
        parts: list[Part] = []
        found = table.sort_by([("piece", "ascending"), ("leaf", "ascending")]).to_pylist()
        for i, r in enumerate(found):
            parts.append(Part(r["part"].encode("utf-8"), r["ids"], sizes[r["ids"]].tolist()))
            if i + 1 == len(found) or found[i + 1]["piece"] != r["piece"]:
                whole += tree(parts, lambda w: encode_text(w, path), lambda x: int(sizes[x])).ids
                parts = []
        return pa.Table.from_batches(then([batch(_IDS, [found[0]["key"]], [whole])]))

    parts = settle(rows.mapInArrow(freed(split_up), "key bigint, row bigint, piece int, leaf int, part string"))
    done = parts.repartition("row", "piece", "leaf").mapInArrow(freed(encode_leaves), "key bigint, row bigint, piece int, leaf int, part string, ids array<int>")
    return done.groupBy("key", "row").applyInArrow(assemble, out)


def decode_column(ids: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, and their borders."""
    body, borders = vocabulary(path)
    ids = pc.fill_null(ids.cast(pa.large_list(pa.int64())), [])
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    count = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
    sizes = borders[flat + 1] - borders[flat]
    ends = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    texts = np.zeros(len(count) + 1, np.int64)
    texts[1:] = ends[np.cumsum(count)]
    return body[ragged(borders[flat], sizes)], texts


def _texts(ids: pa.Array, path: str) -> list[str]:
    data, borders = decode_column(ids, path)
    raw = data.tobytes()
    return [raw[s:e].decode("utf-8", "replace") for s, e in zip(borders[:-1].tolist(), borders[1:].tolist())]


def decode(frame: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) out of (doc_id, ids); bytes that are no UTF-8 become U+FFFD."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def texts(batches):
        for b in batches:
            yield batch(schema, b.column(0).cast(pa.int64()), _texts(b.column(1), path))

    return frame.select(F.col(key), F.col(ids)).mapInArrow(freed(texts), "doc_id bigint, text string")


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digest(path: str):
    def digests(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids = b.column(1)
            count = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            ends = (np.cumsum(count) * 4).tolist()
            of_ids = [hashlib.sha256(flat[e - 4 * n : e]).hexdigest() for n, e in zip(count.tolist(), ends)]
            of_text = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in _texts(ids, path)]
            yield batch(_REPORT, b.column(0), count.astype(np.int64), of_ids, of_text)

    return digests


def _in_one_pass(docs: DataFrame, path: str, key: str, text: str, leaf: int, then, out: str) -> DataFrame:
    rows, plain = docs.select(F.col(key), F.col(text)), _plain(path, leaf)
    short = rows.mapInArrow(freed(lambda batches: then(plain(batches))), out)
    return short.unionByName(_encode_long(rows, path, leaf, then, out))


def report(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: number of ids, digests of the ids and of the decoded text.
    Encoding, decoding and digests of a batch happen in one Python pass."""
    out = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _in_one_pass(docs, path, "doc_id", "text", LEAF, _digest(path), out)


_BOTH = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids, text): ids, and the text that they decode to."""

    def both(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            count = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            yield batch(_BOTH, b.column(0), count.astype(np.int64), b.column(1), _texts(b.column(1), path))

    return _in_one_pass(docs, path, key, text, leaf, both, "doc_id bigint, n_tokens bigint, ids array<int>, text string")
