"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, plus signs,
schemes and identifier cues. From each anchor a small deterministic parser
expands to the borders of an address, number or account and validates it. No
pattern is searched over the whole text.

The base kinds equal these patterns, leftmost and non-overlapping per kind; a
match that fails its test is dropped and not retried:
email, ip (parts at most 255), card (14 to 19 digits, Luhn), phone (10 to 15 digits).
The method adds `account` (IBAN with its check sum, or 6 to 20 digits after an
account cue), `address` (house number and street before or after a street cue)
and `login` (a URL that carries user information).

Null and empty texts have no spans. Rows are handled one by one, so repeated rows
and ties give equal results; other columns pass through untouched.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "address", "login")
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[\x20:#=]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\x20(?:no|nr|number|num)\b)?[.\x20:#=]{0,4}([0-9](?:[\x20-]?[0-9]){5,19})(?![0-9])", re.IGNORECASE | re.ASCII)
_BEFORE_STREET = re.compile(r"[0-9]{1,5}[A-Za-z]?(?:\x20[A-Z][a-z'-]{1,20}){1,3}\x20\Z", re.ASCII)
_HOUSE = re.compile(r"\x20[0-9]{1,5}[A-Za-z]?\b", re.ASCII)
_LOGIN = re.compile(r"://([^\s/@?#]+)@[A-Za-z0-9.-]+")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,10}\Z", re.ASCII)

ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")
STREET_CUES = ("Street", "Avenue", "Road", "Lane", "Boulevard", "Drive")
STREET_FIRST_CUES = ("Rue", "Calle", "Avenida", "Straße", "Strasse")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for cue in ACCOUNT_CUES:
        for form in {cue, cue.capitalize(), cue.upper()}:
            found.add_word(form, ("account", len(form)))
    for cue in STREET_CUES:
        found.add_word(cue, ("street", len(cue)))
    for cue in STREET_FIRST_CUES:
        found.add_word(cue, ("street first", len(cue)))
    found.make_automaton()
    return found


_ANCHORS = _automaton()


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    plain = text.replace(" ", "")
    turned = plain[4:] + plain[:4]
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one text by start, then kind."""
    out: list[tuple[str, int, int]] = []
    # where the next match of each kind may begin
    email = ip = card = phone = account = 0
    for last, (anchor, size) in _ANCHORS.iter(text):
        at = last - size + 1
        if anchor == "digit":
            if at >= ip:
                if m := _IP.match(text, at):
                    ip = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                        out.append(("ip", at, ip))
                else:
                    ip = _DIGITS.match(text, at).end()
            if at >= card:
                if m := _CARD.match(text, at):
                    card = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and _luhn(digits):
                        out.append(("card", at, card))
                else:
                    card = at + 1
        elif anchor == "at":
            if m := _DOMAIN.match(text, at):
                start = at
                while start > email and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at:
                    email = m.end()
                    out.append(("email", start, email))
        elif anchor == "plus":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append(("phone", at, phone))
        elif anchor == "account":
            if at >= account:
                if (m := _IBAN.match(text, last + 1)) and _iban_ok(m[1]) or (m := _ACCOUNT.match(text, last + 1)):
                    account = m.end(1)
                    out.append(("account", m.start(1), account))
        elif anchor == "street":
            before = max(0, at - 72)
            if m := _BEFORE_STREET.search(text[before:at]):
                out.append(("address", before + m.start(), last + 1))
        elif anchor == "street first":
            around = re.compile(r"(?:\x20(?:de|del|la|du|des))?(?:\x20[A-Z][a-z'-]{1,20}){1,3}").match(text, last + 1)
            if around and (house := _HOUSE.match(text, around.end())):
                out.append(("address", at, house.end()))
        elif m := _LOGIN.match(text, at):
            if scheme := _SCHEME.search(text[max(0, at - 11) : at]):
                out.append(("login", at - len(scheme[0]), m.end()))
    order = {k: i for i, k in enumerate(KINDS)}
    out.sort(key=lambda s: (s[1], order[s[0]], s[2]))
    return out


@F.arrow_udf(SPANS)
def spans(text: pa.Array) -> pa.Array:
    parts = [pa.array([find(t) if t else [] for t in text.slice(s, 256).to_pylist()], type=_SPANS) for s in range(0, len(text), 256)]
    return pa.concat_arrays(parts) if parts else pa.array([], type=_SPANS)


def detect(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """`docs` with a column of (kind, start, end) spans in code points, end exclusive."""
    return docs.withColumn(into, spans(F.col(text)))


def joined(spans_column: Column) -> Column:
    """kind:start:end, comma-joined."""
    one = F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def of_kind(spans_column: Column, *kinds: str) -> Column:
    return F.filter(spans_column, lambda s: s["kind"].isin(*kinds))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans."""
    found = detect(docs.select("doc_id", "text"))
    counts = [F.size(of_kind(F.col("pii"), k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(of_kind(F.col("pii"), *BASE_KINDS)), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
    )
