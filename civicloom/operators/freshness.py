"""Staleness of checked facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicloom.functions.dates import days_between, freshness
from civicloom.operators.skew import lookup_join


def states(pages: DataFrame, classes: DataFrame, as_of: Column, forced: list[str] | None = None) -> DataFrame:
    """pages (data_class, last_checked_at, ...) with cadence, age and state.
    The state of an undeclared class is null; `undeclared` lists those rows."""
    dim = classes.select(F.col("name").alias("data_class"), F.col("cadence_days").alias("cadence"))
    out = lookup_join(pages, dim, ["data_class"], "left")
    is_forced = F.col("data_class").isin(*forced) if forced else F.lit(False)
    return out.withColumn("age", days_between(F.col("last_checked_at"), as_of)).withColumn(
        "state", freshness(F.col("last_checked_at"), as_of, F.col("cadence"), is_forced)
    )


def undeclared(stated: DataFrame) -> DataFrame:
    return stated.where(F.col("cadence").isNull())


def by_class(stated: DataFrame, classes: DataFrame) -> DataFrame:
    """Every declared class with its pages and overdue pages, zeros kept. The
    pages are counted before they meet the dimension."""
    n = stated.groupBy("data_class").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("state").isin("stale", "due")).alias("overdue")
    )
    dim = classes.select(F.col("name").alias("data_class"), F.col("cadence_days").alias("cadence"))
    return dim.join(n, "data_class", "left").fillna(0, ["pages", "overdue"])


def overdue(stated: DataFrame, key: str) -> DataFrame:
    return stated.where(F.col("state").isin("stale", "due")).orderBy(F.desc("age"), key)


def checked_at(pages: DataFrame) -> DataFrame:
    """Latest check date of the tree; null (not today) for an empty one."""
    return pages.agg(F.max("last_checked_at").alias("checked_at"))


def future_dates(pages: DataFrame, key: str, date_cols: list[str], as_of: Column) -> DataFrame:
    """key, field, value for every date later than as-of."""
    found = F.filter(
        F.array(
            *[
                F.when(F.col(c) > as_of, F.struct(F.lit(c).alias("field"), F.col(c).alias("value")))
                for c in date_cols
            ]
        ),
        lambda v: v.isNotNull(),
    )
    return pages.select(key, F.explode(found).alias("v")).select(key, "v.field", "v.value")


def baseline_advance(pages: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Check dates that moved past the baseline without a review, and keys the
    baseline does not hold. pages: key, last_checked_at, review_role."""
    base = baseline.select(key, F.col("last_checked_at").alias("recorded"))
    out = pages.join(base, key, "left")
    kind = F.when(F.col("recorded").isNull(), "not-in-baseline").when(
        (F.col("last_checked_at") > F.col("recorded")) & F.col("review_role").isNull(), "advanced-unreviewed"
    )
    return out.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        key, "kind", "recorded", "last_checked_at"
    )


def expired(pages: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Rows at the weakest level not re-checked within `days`."""
    return pages.where(
        (F.col("verification") == "V0") & (days_between(F.col("last_checked_at"), as_of) >= days)
    )


def report(stated: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Report lines as (section, rank, key, line): class table, then overdue
    pages oldest first, then future dates. Sorting by the first three columns
    gives the printed order; no line number is forced through one task."""
    head = by_class(stated, classes).select(
        F.lit(1).alias("section"),
        F.lit(0).alias("rank"),
        F.col("data_class").alias("key"),
        F.format_string(
            "| `%s` | %s days | %s | %s |",
            F.col("data_class"),
            F.col("cadence").cast("string"),
            F.col("pages").cast("string"),
            F.col("overdue").cast("string"),
        ).alias("line"),
    )
    late = stated.where(F.col("state").isin("stale", "due")).select(
        F.lit(2).alias("section"),
        (-F.col("age")).alias("rank"),
        F.col(key).cast("string").alias("key"),
        F.format_string(
            "| `%s` | `%s` | %s | %s days | **%s** |",
            F.col(key).cast("string"),
            F.col("data_class"),
            F.col("last_checked_at").cast("string"),
            F.col("age").cast("string"),
            F.col("state"),
        ).alias("line"),
    )
    ahead = stated.where(F.col("state") == "undated").select(
        F.lit(3).alias("section"),
        F.lit(0).alias("rank"),
        F.col(key).cast("string").alias("key"),
        F.format_string("- `%s` — %s", F.col(key).cast("string"), F.col("last_checked_at").cast("string")).alias(
            "line"
        ),
    )
    return head.unionByName(late).unionByName(ahead)
