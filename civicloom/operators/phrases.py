"""A vocabulary table against texts, and what a translation must keep.

A term is looked up by its rarest word: only places of that word meet the term,
then the words around are compared within the document's own row. Words are runs of
letters and digits, as written; nothing runs outside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicloom.functions import text as T
from civicloom.operators.skew import lookup_join, settle


def words(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def anchors(vocabulary: DataFrame, term: str, frequency: DataFrame) -> DataFrame:
    """_term, _words, _word, _skip: each distinct term with its rarest word (first of equals) and how many words stand before it.

    frequency: _word, _n. A word that no text has counts as 0, so its term is never looked for further."""
    split = vocabulary.select(F.col(term).alias("_term"), words(F.col(term)).alias("_words")).where(F.size("_words") > 0).distinct()
    each = lookup_join(split.select("_term", "_words", F.posexplode("_words").alias("_skip", "_word")), frequency, ["_word"], "left")
    rarest = F.min_by(F.struct("_word", "_skip"), F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_skip").alias("s")))
    return each.groupBy("_term", "_words").agg(rarest.alias("_at")).select("_term", "_words", "_at.*")


def phrase_matches(docs: DataFrame, path: str, text: str, vocabulary: DataFrame, term: str) -> DataFrame:
    """path, term, at: every place (number of its first word, from 0) where a document has all words of a term in a row.

    First only (path, place, word) of words that some term has are counted and met
    with the anchors; a word's places are split among tasks by measured size. Texts are
    fetched for documents that have an anchor's word. `path` tells documents apart; a null text has no words."""
    known = vocabulary.select(F.explode(words(F.col(term))).alias("_word")).distinct()
    places = lookup_join(docs.select(path, F.posexplode(words(F.col(text))).alias("_pos", "_word")), known, ["_word"], "left_semi")
    places = settle(places)
    found = anchors(vocabulary, term, places.groupBy("_word").agg(F.count(F.lit(1)).alias("_n")))
    met = lookup_join(places, found, ["_word"], "inner").where(F.col("_pos") >= F.col("_skip"))
    # as many entries as the document has places of anchors
    tried = met.groupBy(path).agg(F.collect_list(F.struct("_term", "_words", (F.col("_pos") - F.col("_skip")).alias("_at"))).alias("_tried"))
    rows = docs.select(path, words(F.col(text)).alias("_own")).join(tried, path)
    same = F.filter("_tried", lambda c: F.slice(F.col("_own"), c["_at"] + 1, F.size(c["_words"])) == c["_words"])
    return rows.select(path, F.explode(same).alias("m")).select(path, F.col("m._term").alias(term), F.col("m._at").alias("at"))


def translated_terms(source: DataFrame, target: DataFrame, path: str, text: str, vocabulary: DataFrame, term: str) -> DataFrame:
    """path, rule, term: official terms of a text that its translation lacks (`lost`), and terms of the
    translation that the text doesn't have (`added`). Both tables have one row per path; a text without a twin is not judged."""

    def of(df, other):
        own = df.join(other.select(path), path, "left_semi")
        return phrase_matches(own, path, text, vocabulary, term).select(path, term).distinct()

    here, there = of(source, target).withColumn("_side", F.lit(1)), of(target, source).withColumn("_side", F.lit(2))
    sides = here.unionByName(there).groupBy(path, term).agg(F.min("_side").alias("_least"), F.max("_side").alias("_most"))
    alone = sides.where(F.col("_least") == F.col("_most"))
    return alone.select(path, F.when(F.col("_most") == 1, "lost").otherwise("added").alias("rule"), term)


def required_terms(pages: DataFrame, path: str, text: str, required: dict[str, Column], opening: Sequence[str] = ("opening",), chars: int = 24) -> DataFrame:
    """path, rule, term: wording that a page must have as it stands and hasn't. required: rule -> wording; of the
    rules in `opening` only the first `chars` characters, white space evened out. A page is read as it is printed, and with its white space evened out."""
    cells = []
    for rule, wording in required.items():
        asked = F.substring(T.tidy(wording), 1, chars) if rule in opening else wording
        kept = F.col(text).contains(asked) | F.col("_flat").contains(asked)
        cells.append(F.when((F.trim(asked) != "") & ~F.coalesce(kept, F.lit(False)), F.struct(F.lit(rule).alias("rule"), asked.alias("term"))))
    flat = pages.withColumn("_flat", T.tidy(F.col(text)))
    return flat.select(path, F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))
