"""Text expressions.

Everything here is a JVM-side Column expression; nothing is a Python UDF.
The accent table is derived from the Unicode database by rule, so it is not
written out anywhere.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The money and duration shapes printed by the documents.
FEE_PATTERN = r"(?i)(?:₱|P(?:hp?)?\.?)\s?\d[\d,]*(?:\.\d{1,2})?|\b\d[\d,]*\.\d{2}\b"
FEE_SCOPE_PATTERN = r"₱\s?[\d,]+|\bPHP\s?[\d,]+|\bPhp\s?[\d,]+|\b\d{1,3}(?:,\d{3})*\.\d{2}\b"
FIGURE_PATTERN = (
    r"₱\s?[\d,]+(?:\.\d{2})?|\bPHP\s?[\d,]+(?:\.\d{2})?|\bPhp\.?\s?[\d,]+(?:\.\d{2})?"
    r"|\bP\s?[\d,]+\.\d{2}|\b\d{1,3}(?:,\d{3})*\.\d{2}\b"
)
DURATION_PATTERN = (
    r"(?i)\b\d+(?:\.\d+)?\s*(?:working\s+days?|calendar\s+days?|minutes?|mins?"
    r"|hours?|hrs?|days?|weeks?|months?)\b"
)
# Named entities a published page uses.
ENTITIES = {
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "nbsp": " ",
    "rsquo": "’",
    "lsquo": "‘",
    "rdquo": "”",
    "ldquo": "“",
    "ndash": "–",
    "mdash": "—",
    "amp": "&",
}


def _plain(char: str) -> str:
    """The canonical decomposition without its combining marks."""
    return "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")


def _is_syllable(point: int) -> bool:
    return 0xAC00 <= point <= 0xD7A3


@functools.lru_cache(maxsize=1)
def _decompositions() -> dict[str, str]:
    """Every character that is not its own plain form, but for marks and Hangul
    syllables, which follow an arithmetic rule."""
    found = {}
    for point in range(0xC0, 0x110000):
        if _is_syllable(point) or 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        if unicodedata.decomposition(char) and unicodedata.category(char) != "Mn" and _plain(char) not in ("", char):
            found[char] = _plain(char)
    return found


@functools.lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(accented, plain): every character whose plain form is exactly one other character."""
    single = {c: p for c, p in _decompositions().items() if len(p) == 1}
    return "".join(single), "".join(single.values())


def fold_literal(value: str) -> str:
    """The same fold for a query literal known when the plan is built."""
    return _plain(value).lower()


def _spelled_out(col: Column, several: dict[str, str]) -> Column:
    """Characters that stand for several plain ones as these: by a table, and Hangul
    syllables by the arithmetic of their code points. The expression's size doesn't
    depend on the table's."""
    table = F.map_from_arrays(F.lit(list(several)), F.lit(list(several.values())))

    def letter(first: int, count: int, index: Column) -> Column:
        return F.substring(F.lit("".join(chr(first + i) for i in range(count))), index + 1, F.lit(1))

    def parts(char: Column) -> Column:
        at = F.ascii(char) - 0xAC00
        lead = letter(0x1100, 19, F.floor(at / 588).cast("int"))
        vowel = letter(0x1161, 21, F.floor(at % 588 / 28).cast("int"))
        tail = F.when(at % 28 > 0, letter(0x11A8, 27, (at % 28 - 1).cast("int"))).otherwise(F.lit(""))
        syllable = F.when(char.between("\uac00", "\ud7a3"), F.concat(lead, vowel, tail))
        return F.coalesce(syllable, F.try_element_at(table, char), char)

    return F.array_join(F.transform(F.split(col, ""), parts), "")


def fold(col: Column) -> Column:
    """Accent- and case-insensitive form. ASCII text skips the tables; characters of
    several plain ones are looked for first."""
    src, dst = accent_table()
    several = {c: p for c, p in _decompositions().items() if len(p) > 1}
    # One range that holds all of them: a class that lists them is tried in turn for every character.
    least = min(map(ord, several))
    wide = F.when(col.rlike(rf"[\x{{{least:x}}}-\x{{10ffff}}]"), _spelled_out(col, several)).otherwise(col)
    plain = F.regexp_replace(F.translate(wide, src, dst), r"\p{Mn}+", "")
    return F.lower(F.when(col.rlike(r"[^\x00-\x7F]"), plain).otherwise(col))


@functools.lru_cache(maxsize=1)
def _folding_to() -> dict[str, str]:
    """For each folded character the characters that fold to it one for one."""
    found: dict[str, str] = {}
    single = dict(zip(*accent_table()))
    for point in range(0x110000):
        char = chr(point)
        folded = single.get(char, char).lower()
        if folded != char and len(folded) == 1:
            found[folded] = found.get(folded, "") + char
    return found


def folding_to(char: str) -> str:
    """A pattern for the characters that fold to `char`, which is folded itself. One range keeps
    those beyond ASCII: a class that lists them is tried in turn for every other character."""
    alike = [char, *_folding_to().get(char, "")]
    near, far = ("".join(f"\\x{{{ord(c):x}}}" for c in alike if c.isascii() == plain) for plain in (True, False))
    return "[" + near + (f"[\\x{{80}}-\\x{{10ffff}}&&[{far}]]" if far else "") + "]"


def fold_chars(col: Column) -> Column:
    """Length-preserving fold: one character in, one character out."""
    src, dst = accent_table()
    return F.lower(F.when(col.rlike(r"[^\x00-\x7F]"), F.translate(col, src, dst)).otherwise(col))


def tidy(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def tokens(col: Column) -> Column:
    """Lower-cased letter/digit runs. Blank text has no tokens."""
    words = F.split(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", " "), " ")
    return F.filter(words, lambda w: w != "")


def squash(col: Column) -> Column:
    """Letters and digits only, lower-cased, for containment tests."""
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", "")


def squash_header(col: Column) -> Column:
    return F.upper(F.regexp_replace(col, r"\s+", ""))


def _kebab(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def slugify(col: Column) -> Column:
    return _kebab(fold(col))


def stem(col: Column) -> Column:
    """Document name without its .pdf suffix, kebab-cased, accents not folded."""
    return _kebab(F.lower(F.regexp_replace(col, r"(?i)\.pdf$", "")))


def title_slug(col: Column) -> Column:
    return _kebab(F.regexp_replace(F.lower(col), "[’']", ""))


def fees(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(FEE_PATTERN), F.lit(0))


def figures(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(FIGURE_PATTERN), F.lit(0))


def durations(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(DURATION_PATTERN), F.lit(0))


def has_fee(col: Column) -> Column:
    return col.rlike(FEE_PATTERN)


def has_duration(col: Column) -> Column:
    return col.rlike(DURATION_PATTERN)


def inline_field(col: Column, label: str, loose: bool = False) -> Column:
    """Value after a label at the start of a line; null where there is none.

    The label is closed by a colon, a question mark or a wide gap - or, `loose`,
    by nothing, for text whose gaps are already single spaces. The value may
    stand on the next line of the text given, and never opens with the label's
    own punctuation."""
    words = r"\s+".join(re.escape(w) for w in label.split())
    closed = r"[:?]?\s*" if loose else r"(?:[:?]\s*|\s{2,})"
    found = F.regexp_extract(col, rf"(?im)^\s*{words}\s*{closed}([^:?\s].*?)\s*$", 1)
    return F.when(found != "", found)


def list_marker(col: Column) -> Column:
    """STRUCT<kind, marker, text>. Sub-numbers are tested before numbers."""
    sub = r"^\s*(\d{1,2})\.(\d{1,2})\s*\.?\s*(\S[\s\S]*)$"
    num = r"^\s*(\d{1,2})\s*[.)]\s*(\S[\s\S]*)$"
    bullet = r"^\s*(?:([•·▪◦])\s*|(\*)\s+)(\S[\s\S]*)$"
    dash = r"^\s*[-–—]\s+(\S[\s\S]*)$"

    def part(kind, marker, text):
        return F.struct(F.lit(kind).alias("kind"), marker.alias("marker"), text.alias("text"))

    return (
        F.when(
            col.rlike(sub),
            part(
                "sub",
                F.concat(F.regexp_extract(col, sub, 1), F.lit("."), F.regexp_extract(col, sub, 2)),
                F.regexp_extract(col, sub, 3),
            ),
        )
        .when(
            col.rlike(num),
            part("number", F.regexp_extract(col, num, 1), F.regexp_extract(col, num, 2)),
        )
        .when(
            col.rlike(bullet),
            part(
                "bullet",
                F.concat(F.regexp_extract(col, bullet, 1), F.regexp_extract(col, bullet, 2)),
                F.regexp_extract(col, bullet, 3),
            ),
        )
        .when(col.rlike(dash), part("dash", F.lit("-"), F.regexp_extract(col, dash, 1)))
        .otherwise(part("none", F.lit(None).cast("string"), col))
    )


def escape_cell(col: Column) -> Column:
    body = F.coalesce(col, F.lit(""))
    return F.trim(F.regexp_replace(F.replace(body, F.lit("|"), F.lit("\\|")), r"\n+", " "))


def decode_entities(col: Column) -> Column:
    """Numeric entities first, then named ones; unknown names stay as they are.

    Text without an ampersand is returned untouched. Each numeric entity is
    replaced by splitting at it and joining with its character.
    """
    pieces = F.split(col, r"&#\d+;")
    codes = F.regexp_extract_all(col, F.lit(r"&#(\d+);"), F.lit(1))

    def char(code: Column) -> Column:
        """The character by way of its UTF-32 bytes; what is no character stays as printed."""
        point = code.try_cast("long")
        known = point.isNotNull() & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(F.when(known, point)), 8, "0")), "UTF-32")).otherwise(F.concat(F.lit("&#"), code, F.lit(";")))

    chars = F.transform(codes, char)
    numeric = F.when(
        col.rlike(r"&#\d+;"),
        F.array_join(F.zip_with(pieces, chars, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), ""),
    ).otherwise(col)
    out = numeric
    for name, char in ENTITIES.items():
        out = F.regexp_replace(out, f"(?i)&{name};", char.replace("\\", "\\\\").replace("$", "\\$"))
    return F.when(col.contains("&"), out).otherwise(col)


def tel(col: Column) -> Column:
    digits = F.regexp_replace(col, r"[^\d]", "")
    return F.concat(F.lit("tel:"), F.when(F.trim(col).startswith("+"), "+").otherwise(""), digits)


def has_word_char(col: Column) -> Column:
    return col.rlike(r"[\p{L}\p{N}]")
