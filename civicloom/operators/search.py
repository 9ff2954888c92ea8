"""Accent-insensitive all-terms search, ranking, facets and highlighting."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicloom.functions import text as T


def terms_of(query: str | None) -> list[str]:
    """Folded terms of a query: percent signs dropped, split on whitespace."""
    return T.fold_literal((query or "").replace("%", "")).split()


def _bind(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times in `body`."""
    return F.transform(F.array(value), body)[0]


def contains_all(folded: Column, terms: Sequence[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [folded.contains(t) for t in terms], F.lit(True))


def search(
    df: DataFrame,
    query: str | None,
    text_cols: Sequence[str],
    title_col: str,
    category_col: str,
) -> DataFrame:
    """Rows in which every folded term is a substring of the folded text columns
    and category, with `title_hit`: all terms occur in the title alone. A blank
    query finds nothing."""
    terms = terms_of(query)
    if not terms:
        return df.where(F.lit(False)).withColumn("title_hit", F.lit(False))
    hay = T.fold(F.concat_ws(" ", *[F.col(c) for c in dict.fromkeys([*text_cols, category_col])]))
    hits = df.where(_bind(hay, lambda h: contains_all(h, terms)))
    return hits.withColumn(
        "title_hit", _bind(T.fold(F.col(title_col)), lambda h: F.coalesce(contains_all(h, terms), F.lit(False)))
    )


def ranked(hits: DataFrame, category_col: str, pos_col: str) -> DataFrame:
    """Title hits first, otherwise category and position order."""
    return hits.orderBy(F.desc("title_hit"), category_col, pos_col)


def facets(hits: DataFrame, category_col: str) -> DataFrame:
    """Hits per category; count descending, then label."""
    return (
        hits.groupBy(F.col(category_col).alias("category"))
        .agg(F.count(F.lit(1)).alias("hits"))
        .orderBy(F.desc("hits"), "category")
    )


def narrow(hits: DataFrame, category_col: str, category: str | None) -> DataFrame:
    """Hits of one category; an unknown category leaves the result whole.

    The guard is one aggregated row, attached without moving the hits."""
    if not category:
        return hits
    known = hits.agg(F.max(F.col(category_col) == category).alias("_known"))
    guard = F.coalesce(known.scalar(), F.lit(False))
    return hits.where(~guard | (F.col(category_col) == category))


def batch(df: DataFrame, queries: Sequence[str], text_cols, title_col: str, category_col: str) -> DataFrame:
    """One row per (query, matching row). The folded text is computed once per
    row and tested against every query; nothing is paired up or shuffled."""
    wanted = [(q, terms_of(q)) for q in queries]
    hay = T.fold(F.concat_ws(" ", *[F.col(c) for c in dict.fromkeys([*text_cols, category_col])]))

    def matching(h):
        return F.filter(
            F.array(*[F.when(contains_all(h, t), F.lit(q)) for q, t in wanted if t]),
            lambda q: q.isNotNull(),
        )

    return df.withColumn("query", F.explode(_bind(hay, matching)))


def mark_terms(query: str | None) -> list[str]:
    """Terms folded character by character, as they stand in composed text."""
    composed = unicodedata.normalize("NFC", (query or "").replace("%", ""))
    single = dict(zip(*T.accent_table()))
    return "".join(single.get(c, c) for c in composed if unicodedata.category(c) != "Mn").lower().split()


def border(terms: Sequence[str]) -> tuple[str, str]:
    """(a zero-width pattern for the borders between text that some term covers and
    text that none does, one for a covered character to the right).

    A place is inside an occurrence when a term's first k characters stand before it
    and the others after it, so overlapping and touching occurrences need no merging. Such
    a place is no border; any other has covered text to its right where an occurrence starts
    and to its left where one ends. The rare start or end is looked for first."""
    spelled = [[T.folding_to(c) for c in t] for t in dict.fromkeys(terms)]
    inside = [f"(?<={''.join(t[:k])})(?={''.join(t[k:])})" for t in spelled for k in range(1, len(t))]
    starts = [f"(?={''.join(t)})" for t in spelled]
    ends = [f"(?<={''.join(t)})" for t in spelled]
    any_ = lambda places: f"(?:{'|'.join(places)})"
    within = f"(?!{any_(inside)})" if inside else ""
    cut = f"(?:{any_(starts)}(?!{any_(ends)})|{any_(ends)}(?!{any_(starts)})){within}"
    return cut, any_(starts + inside)


def segments(text: Column, query: str | None) -> Column:
    """ARRAY<STRUCT<text, matched>> whose texts concatenate to the input; null stays null.

    The text is split at the borders of covered text, where matched and unmatched
    pieces take turns."""
    terms = mark_terms(query)
    if not terms:
        return F.when(text.isNotNull(), F.array(F.struct(text.alias("text"), F.lit(False).alias("matched"))))
    cut, covered = border(terms)
    starts = text.rlike(rf"\A{covered}")
    pieces = F.transform(
        F.split(text, cut), lambda piece, i: F.struct(piece.alias("text"), ((i % 2 == 0) == starts).alias("matched"))
    )
    # an occurrence that ends the text leaves an empty piece after it
    return F.filter(pieces, lambda s, i: (s["text"] != "") | (i == 0))


def highlight(hits: DataFrame, col: str, query: str | None) -> DataFrame:
    return hits.withColumn("segments", segments(F.col(col), query))


def suggestions(popular: DataFrame, col: str, current: str) -> DataFrame:
    """Popular queries other than the current one, case-insensitively."""
    return popular.where(F.lower(col) != F.lit(current.lower()))


def nav_index(parents: DataFrame, children: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Flat (section, level, label) list of a two-level tree: a parent, then
    its children. Stacked, not collected per parent."""
    top = parents.select(F.col(key).alias("section"), F.lit(0).alias("level"), F.col("label"))
    sub = children.select(F.col(parent_key).alias("section"), F.lit(1).alias("level"), F.col("label"))
    return top.unionByName(sub)
