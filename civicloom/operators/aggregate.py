"""Counts, ratios and reports. Everything is a partial-then-final aggregate;
nothing gathers the rows of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicloom.operators.corpus import percent
from civicloom.operators.skew import first_n, lookup_join


def category_summary(df: DataFrame, category: str, order: str, name: str, n: int = 3) -> DataFrame:
    """Per category: how many entries, and its first n names in order."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("entries"))
    head = first_n(df.select(category, order, name), [category], [order], n)
    names = head.groupBy(category).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", name))), lambda x: x[name]).alias("examples")
    )
    return counts.join(names, category).orderBy(category)


def coverage(df: DataFrame, groups: Sequence[str], done: Column) -> DataFrame:
    """done, total and rounded percent; nothing at all is 0 %."""
    n = df.groupBy(*groups).agg(F.count_if(done).alias("transcribed"), F.count(F.lit(1)).alias("total"))
    return n.withColumn("percent", percent(F.col("transcribed"), F.col("total")))


def office_counts(records: DataFrame, directory: DataFrame, category: str, office: str) -> DataFrame:
    """Records per (category, office) for offices of the directory only. The
    records are counted before they meet it."""
    n = records.groupBy(category, office).agg(F.count(F.lit(1)).alias("n"))
    return n.join(directory.select(office).distinct(), office, "left_semi")


def spanning(df: DataFrame, key: str, category: str) -> DataFrame:
    """Keys found in more than one category, one row per (key, category)."""
    pairs = df.where(F.col(key).isNotNull()).groupBy(key, category).agg(F.count(F.lit(1)).alias("n"))
    wide = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("categories")).where(F.col("categories") > 1)
    return lookup_join(pairs, wide, [key], "inner")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("claims")).where(F.col("claims") > 1)


def service_counts(df: DataFrame, document: str, section: str, sections: Sequence[str]) -> DataFrame:
    """Per document: one column per section, unknown sections, and the total."""
    known = [F.count_if(F.col(section) == s).alias(s) for s in sections]
    unknown = F.count_if(F.col(section).isNull() | ~F.col(section).isin(*sections)).alias("unknown")
    return df.groupBy(document).agg(*known, unknown, F.count(F.lit(1)).alias("total"))


def field_gaps(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """field, absent - one pass for all fields, then the one row is unpivoted."""
    one = df.agg(*[F.count_if(c).alias(n) for n, c in fields.items()])
    return one.unpivot([], list(fields), "field", "absent")


def rollup_report(df: DataFrame, document: str, measures: dict[str, Column]) -> DataFrame:
    """Per-document measures and a grand total (is_total)."""
    return (
        df.rollup(document)
        .agg(F.grouping(document).cast("int").alias("is_total"), *[m.alias(n) for n, m in measures.items()])
    )


def distinct_offices(df: DataFrame, branch: str, file: Column) -> DataFrame:
    """Distinct files per branch after the External/Internal suffix is dropped."""
    office = F.regexp_replace(file, r"(?i)-(External|Internal)-Services", "")
    return df.groupBy(branch).agg(F.countDistinct(office).alias("offices"))


def stated_vs_counted(counted: DataFrame, stated: DataFrame) -> DataFrame:
    """measure, stated, counted for every measure of two one-row frames that
    disagrees (null-safe)."""
    names = counted.columns
    a = counted.unpivot([], names, "measure", "counted")
    b = stated.select(*names).unpivot([], names, "measure", "stated")
    j = a.join(b, "measure")
    return j.where(~F.col("stated").eqNullSafe(F.col("counted")))


def tripwire(df: DataFrame, groups: Sequence[str], measure: Column) -> DataFrame:
    """Groups in which every single row measured zero: a broken selector looks
    like that, an empty site does not."""
    n = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count_if(measure == 0).alias("zeros"))
    return n.withColumn("warn", (F.col("n") > 0) & (F.col("zeros") == F.col("n")))


def term_occurrences(df: DataFrame, text: Column, terms: Sequence[str]) -> DataFrame:
    """term, occurrences, documents - counted row by row, summed once."""
    folded = F.lower(text)
    cells = F.array(
        *[
            F.struct(F.lit(t).alias("term"), F.regexp_count(folded, F.lit(rf"\b{t}\b")).cast("long").alias("k"))
            for t in terms
        ]
    )
    return (
        df.select(F.inline(cells))
        .groupBy("term")
        .agg(F.sum("k").alias("occurrences"), F.count_if(F.col("k") > 0).alias("documents"))
    )


def share(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Group sums as a percent of the whole, formatted with one decimal."""
    whole = df.agg(F.sum(value)).scalar()
    part = df.groupBy(*groups).agg(F.sum(value).alias("part"))
    return part.withColumn("whole", whole).select(
        *groups, F.format_number(F.col("part") * 100 / F.col("whole"), 1).alias("share")
    )


def handover_counts(pages: DataFrame, cited: DataFrame, key: str, by: Sequence[str], manifest: str, has_entry: Column) -> DataFrame:
    """by, pages, manifests, entries, with_source_and_date: what is handed over. cited: keys of pages
    that carry a source and a check date, however often."""
    seen = cited.select(key, F.lit(True).alias("_seen")).distinct()
    return lookup_join(pages.withColumn("_entry", has_entry).select(key, *by, manifest, "_entry"), seen, [key], "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("pages"),
        F.countDistinct(manifest).alias("manifests"),
        F.count_if("_entry").alias("entries"),
        F.count("_seen").alias("with_source_and_date"),
    )


def gap_states(gaps: DataFrame, state: str, channel: str, checked: str) -> DataFrame:
    """state, channel, gaps, last_checked: the gap register by where each gap stands."""
    return gaps.groupBy(F.col(state).alias("state"), F.col(channel).alias("channel")).agg(
        F.count(F.lit(1)).alias("gaps"), F.date_format(F.max(checked), "yyyy-MM-dd").alias("last_checked")
    )
