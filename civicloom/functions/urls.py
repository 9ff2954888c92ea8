"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_of(url: Column) -> Column:
    """Path of a URL; an address without one has the root path."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path_of(url), "/$", ""), "/"), -1)


def _decode_once(col: Column) -> Column:
    # A plus sign is literal in a path; the decoder would turn it into a space.
    # It also turns broken UTF-8 into the replacement character, which is an
    # error here unless the input spells that character itself.
    out = F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B")))
    broken = out.contains("\ufffd") & ~col.contains("\ufffd") & ~F.upper(col).contains("%EF%BF%BD")
    return F.when(~broken, out)


def decode_param(col: Column) -> Column:
    """Decode until stable, at most three passes; malformed input stops there."""
    out = col
    for _ in range(3):
        out = F.coalesce(_decode_once(out), out)
    return out


def is_malformed(col: Column) -> Column:
    """True when one of up to three decode passes meets a bad escape."""
    bad = F.lit(False)
    out = col
    for _ in range(3):
        step = _decode_once(out)
        bad = bad | (out.isNotNull() & step.isNull())
        out = F.coalesce(step, out)
    return bad


def clean_query(col: Column) -> Column:
    """Percent signs dropped, trimmed; blank is null (no search)."""
    out = F.trim(F.replace(F.coalesce(col, F.lit("")), F.lit("%"), F.lit("")))
    return F.when(out != "", out)


def locale_or_default(col: Column, allowed: list[str], default: str) -> Column:
    return F.when(col.isin(*allowed), col).otherwise(F.lit(default))
