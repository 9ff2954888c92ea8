"""Comparing two tables by key.

The two sides are stacked and aggregated by key instead of joined: map-side
partial counts shrink a hot key to one row per task before the only shuffle,
and both directions come out of the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicloom.operators.skew import lookup_join


def key_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, in_left, in_right - how often each key occurs on each side."""
    a = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    return a.unionByName(b).groupBy(*keys).agg(F.sum("l").alias("in_left"), F.sum("r").alias("in_right"))


def _kinds(**when: Column) -> Column:
    return F.explode(
        F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in when.items()]), lambda k: k.isNotNull())
    )


def reconcile(authority: DataFrame, records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, kind: missing (authority only), extra (records only), duplicate
    (more than one record)."""
    n = key_counts(authority, records, keys)
    return n.select(
        *keys,
        _kinds(
            missing=(F.col("in_left") > 0) & (F.col("in_right") == 0),
            extra=(F.col("in_left") == 0) & (F.col("in_right") > 0),
            duplicate=F.col("in_right") > 1,
        ).alias("kind"),
    )


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct left keys that the right side lacks."""
    n = key_counts(left, right, keys)
    return n.where((F.col("in_left") > 0) & (F.col("in_right") == 0)).select(*keys)


def two_sided(
    a: DataFrame,
    b: DataFrame,
    key: Sequence[str],
    value: str | None = None,
    exempt: DataFrame | None = None,
) -> DataFrame:
    """key, side, reason.

    Keys on one side only; with `value`, also keys whose value is the same on
    both sides without an exemption, and exemptions that are no longer needed.
    """
    key = list(key)
    val = F.col(value) if value else F.lit(None).cast("string")
    none = F.lit(None).cast("string")

    def tagged(df, side, v):
        return df.select(*key, F.lit(side).alias("side"), v.alias("v"))

    stacked = tagged(a, "a", val).unionByName(tagged(b, "b", val))
    if exempt is not None:
        stacked = stacked.unionByName(tagged(exempt, "x", none))
    n = stacked.groupBy(*key).agg(
        F.count_if(F.col("side") == "a").alias("na"),
        F.count_if(F.col("side") == "b").alias("nb"),
        F.count_if(F.col("side") == "x").alias("nx"),
        F.max(F.when(F.col("side") == "a", F.col("v"))).alias("va"),
        F.max(F.when(F.col("side") == "b", F.col("v"))).alias("vb"),
    )
    both = (F.col("na") > 0) & (F.col("nb") > 0)
    same = both & F.col("va").eqNullSafe(F.col("vb")) & F.col("va").isNotNull()

    def row(cond, side, reason):
        return F.when(cond, F.struct(F.lit(side).alias("side"), F.lit(reason).alias("reason")))

    found = [
        row((F.col("na") > 0) & (F.col("nb") == 0), "left", "only-left"),
        row((F.col("na") == 0) & (F.col("nb") > 0), "right", "only-right"),
    ]
    if value:
        found.append(row(same & (F.col("nx") == 0), "both", "identical"))
        found.append(row((F.col("nx") > 0) & ~same, "exempt", "not-needed"))
    return n.select(
        *key, F.explode(F.filter(F.array(*found), lambda r: r.isNotNull())).alias("f")
    ).select(*key, "f.side", "f.reason")


def drift(
    records: DataFrame,
    authority: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    carry: Sequence[str] = (),
) -> DataFrame:
    """keys, carried columns, field, got, expected - one row per field that
    differs (null-safe). Records unknown to the authority are left to
    `reconcile`."""
    keys = list(keys)
    frozen = authority.select(*keys, *[F.col(f).alias("_x_" + f) for f in fields])
    joined = lookup_join(records, frozen, keys, "inner")
    found = F.filter(
        F.array(
            *[
                F.when(
                    ~F.col(f).eqNullSafe(F.col("_x_" + f)),
                    F.struct(
                        F.lit(f).alias("field"),
                        F.col(f).cast("string").alias("got"),
                        F.col("_x_" + f).cast("string").alias("expected"),
                    ),
                )
                for f in fields
            ]
        ),
        lambda v: v.isNotNull(),
    )
    return joined.select(*keys, *carry, F.explode(found).alias("d")).select(*keys, *carry, "d.*")


def exact_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with multiplicity) on one side only, with the side's name."""
    cols = a.columns
    n = key_counts(a, b.select(*cols), cols)
    extra = F.col("in_left") - F.col("in_right")
    return (
        n.where(extra != 0)
        .withColumn("side", F.when(extra > 0, "left").otherwise("right"))
        .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.abs(extra))))
        .select(*cols, "side")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key: the values of its first row in `order` (map-side reduced)."""
    packed = F.struct(*[F.col(v) for v in values])
    return (
        df.groupBy(*keys)
        .agg(F.min_by(packed, F.struct(*[F.col(o) for o in order])).alias("p"))
        .select(*keys, "p.*")
    )


def locale_fallback(
    manifest: DataFrame, bodies: DataFrame, keys: Sequence[str], locale: str, default: str = "en"
) -> DataFrame:
    """Manifest rows with the body of the asked locale, else of the default one.

    used_fallback marks the second case; an entry without a default body is an
    error row; a body without a manifest entry yields nothing. Bodies are first
    reduced to one row per key, so one join serves both locales.
    """
    keys = list(keys)
    per_key = bodies.where(F.col("locale").isin(locale, default)).groupBy(*keys).agg(
        F.min(F.when(F.col("locale") == locale, F.col("body"))).alias("_asked"),
        F.min(F.when(F.col("locale") == default, F.col("body"))).alias("_default"),
    )
    out = manifest.join(per_key, keys, "left")
    return out.select(
        *manifest.columns,
        F.coalesce("_asked", "_default").alias("body"),
        (F.col("_asked").isNull() & F.col("_default").isNotNull()).alias("used_fallback"),
        F.when(F.col("_default").isNull(), F.lit("no-default-body")).alias("error"),
    )


def revision_state(cited: DataFrame, archive: DataFrame, file: str = "file") -> DataFrame:
    """Cited documents against the archive: unarchived / checksum-moved /
    title-differs. Needs file, sha256, title on both sides."""
    now = archive.select(file, F.col("sha256").alias("_sha"), F.col("title").alias("_title"), F.lit(True).alias("_in"))
    out = lookup_join(cited, now, [file], "left")
    state = F.filter(
        F.array(
            F.when(F.col("_in").isNull(), "unarchived"),
            F.when(F.col("_sha") != F.col("sha256"), "checksum-moved"),
            F.when(F.col("_title") != F.col("title"), "title-differs"),
        ),
        lambda s: s.isNotNull(),
    )
    return out.select(*cited.columns, F.explode(state).alias("state"))


def changed_documents(history: DataFrame, current: DataFrame) -> DataFrame:
    """file, from_sha, to_sha where the latest recorded version is not the
    current one. history has file, seq, sha256; current has file, sha256."""
    latest = history.groupBy("file").agg(F.max_by("sha256", "seq").alias("from_sha"))
    return (
        latest.join(current.select("file", F.col("sha256").alias("to_sha")), "file")
        .where(F.col("from_sha") != F.col("to_sha"))
        .select("file", "from_sha", "to_sha")
    )


def superseded(derived: DataFrame, current: DataFrame) -> DataFrame:
    """Derived pages whose cited checksum is not the archive's current one;
    pages citing an unknown file are not listed."""
    now = current.select("file", F.col("sha256").alias("current_sha"))
    return lookup_join(derived, now, ["file"], "inner").where(F.col("sha256") != F.col("current_sha"))


def unseen_versions(documents: DataFrame, history: DataFrame) -> DataFrame:
    """(file, sha256) pairs the history does not hold yet; an older checksum
    that was recorded once is not recorded again."""
    seen = history.select("file", "sha256").distinct()
    return documents.join(seen, ["file", "sha256"], "left_anti")
