"""Joins and checks over published corpora: translations, figures, offices,
titles and catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from civicloom.functions import text as T
from civicloom.operators import reconcile as R
from civicloom.operators.skew import lookup_join

# Words that appear in nearly every office name.
COMMON_WORDS = [
    "office",
    "offices",
    "of",
    "the",
    "municipal",
    "services",
    "service",
    "external",
    "internal",
    "division",
    "pdf",
]


def distinctive_words(col: Column) -> Column:
    words = F.split(F.lower(col), "[^a-z]+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(COMMON_WORDS)))


def locale_coverage(bodies: DataFrame, keys: Sequence[str], locale: str, original: str) -> DataFrame:
    """Originals without a translation, translations without an original, and
    the share of originals that have one (rounded percent, 0 of nothing is 0)."""
    is_original = F.col(locale) == original
    n = bodies.groupBy(*keys).agg(F.max(is_original).alias("en"), F.max(~is_original).alias("tr"))
    totals = n.agg(
        F.count_if(F.col("en") & F.col("tr")).alias("both"), F.count_if(F.col("en")).alias("all")
    ).select(percent(F.col("both"), F.col("all")).alias("percent"))
    return (
        n.where(F.col("en") != F.col("tr"))
        .select(*keys, F.when(F.col("en"), "untranslated").otherwise("orphan").alias("kind"))
        .withColumn("percent", totals.scalar())
    )


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.floor(part * 100 / whole + 0.5).cast("long"))


def by_office(records: DataFrame, directory: DataFrame, office: str, name: str, key: str) -> DataFrame:
    """Records under the directory's office name, ordered by it; an office the
    directory lacks is an error row, a record without an office is skipped."""
    named = lookup_join(records.where(F.col(office).isNotNull()), directory.select(office, name), [office])
    return named.select(
        key, F.coalesce(name, F.lit("unlisted office")).alias("office"), F.col(name).isNull().alias("error")
    ).orderBy("office", key)


def title_provenance(vocabulary: DataFrame, enumerated: DataFrame, key: str) -> DataFrame:
    """key, kind: altered / not-a-reading / no-note / unknown-source."""
    j = vocabulary.join(enumerated, key, "left")
    read = F.col("title_source") == "read-from-pdf"
    same = F.col("title").eqNullSafe(F.col("published"))
    kinds = F.filter(
        F.array(
            F.when(~read & ~same, "altered"),
            F.when(read & same, "not-a-reading"),
            F.when(read & (F.col("note").isNull() | (F.trim("note") == "")), "no-note"),
            F.when(~F.col("title_source").isin("extracted", "not-in-layout", "read-from-pdf"), "unknown-source"),
        ),
        lambda k: k.isNotNull(),
    )
    return j.select(key, F.explode(kinds).alias("kind"))


def groups_whole(groups: DataFrame, members: DataFrame, entries: DataFrame) -> DataFrame:
    """grp, member, kind. groups(grp); members(grp, member), distinct;
    entries(member, answers). A missing member, a member that does not point
    back, a group of fewer than two, an entry answering no known group."""
    known = lookup_join(members, groups.select("grp").distinct(), ["grp"], "left_semi")
    entry = entries.select("member", "answers", F.lit(True).alias("_in"))
    linked = lookup_join(known, entry, ["member"])
    broken = linked.withColumn(
        "kind",
        F.when(F.col("_in").isNull(), "member-missing").when(
            ~F.col("answers").eqNullSafe(F.col("grp")), "wrong-back-pointer"
        ),
    ).where(F.col("kind").isNotNull())
    counts = R.key_counts(groups.select("grp").distinct(), known.select("grp"), ["grp"])
    small = counts.where((F.col("in_left") > 0) & (F.col("in_right") < 2)).select(
        "grp", F.lit(None).cast(members.schema["member"].dataType).alias("member"), F.lit("too-few-members").alias("kind")
    )
    stray = (
        entries.where(F.col("answers").isNotNull())
        .select(F.col("answers").alias("grp"), "member")
        .join(groups.select("grp").distinct(), "grp", "left_anti")
        .select("grp", "member", F.lit("unknown-group").alias("kind"))
    )
    return broken.select("grp", "member", "kind").unionByName(small).unionByName(stray)


def leaf_paths(schema: ST.StructType, prefix: str) -> list[tuple[str, str, ST.DataType]]:
    """(dotted path, column expression, type) of every leaf; arrays are leaves."""
    out = []
    for f in schema.fields:
        name, expr = f"{prefix}.{f.name}" if prefix else f.name, f.name
        if isinstance(f.dataType, ST.StructType):
            out += [(f"{name}.{p}", f"{expr}.{e}", d) for p, e, d in leaf_paths(f.dataType, "")]
        else:
            out.append((name, expr, f.dataType))
    return out


def flatten(df: DataFrame, root: str, key: str, empty_lists: bool = False) -> DataFrame:
    """Long (path, value, is_null) table of the leaves of every row; the path is
    root.<key>.<field>. The leaf list is known from the schema, so this is one
    row-local pass."""
    leaves = leaf_paths(ST.StructType([f for f in df.schema.fields if f.name != key]), "")
    cells = []
    for path, expr, kind in leaves:
        col = F.col(expr)
        if isinstance(kind, ST.ArrayType):
            missing = (col.isNull() | (F.size(col) == 0)) if empty_lists else col.isNull()
            value = F.to_json(col)
        else:
            missing, value = col.isNull(), col.cast("string")
        cells.append(F.struct(F.lit(path).alias("path"), value.alias("value"), missing.alias("is_null")))
    return df.select(F.col(key).cast("string").alias("_k"), F.inline(F.array(*cells))).select(
        F.concat(F.lit(root + "."), F.col("_k"), F.lit("."), F.col("path")).alias("path"), "value", "is_null"
    )


def null_paths(df: DataFrame, root: str, key: str, empty_lists: bool = False) -> DataFrame:
    return flatten(df, root, key, empty_lists).where("is_null").select("path")


def fact_sources(facts: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """key, kind: no-source / source-without-value / untracked-source."""
    stacked = facts.select(key, F.lit(True).alias("tracked"), "filled", F.lit(False).alias("sourced")).unionByName(
        sources.select(key, F.lit(False).alias("tracked"), F.lit(False).alias("filled"), F.lit(True).alias("sourced"))
    )
    n = stacked.groupBy(key).agg(
        F.max("tracked").alias("tracked"), F.max("filled").alias("filled"), F.max("sourced").alias("sourced")
    )
    kind = (
        F.when(~F.col("tracked"), "untracked-source")
        .when(F.col("filled") & ~F.col("sourced"), "no-source")
        .when(~F.col("filled") & F.col("sourced"), "source-without-value")
    )
    return n.select(key, kind.alias("kind")).where(F.col("kind").isNotNull())


def missing_in_locales(used: DataFrame, catalogue: DataFrame, code: str, locales: Sequence[str]) -> DataFrame:
    """(code, locale) pairs a catalogue lacks."""
    wanted = used.select(code).distinct().withColumn("locale", F.explode(F.array(*[F.lit(x) for x in locales])))
    return R.unmatched(wanted, catalogue, [code, "locale"])


def distinct_matches(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def twin_figures(
    bodies: DataFrame, keys: Sequence[str], locale: str, body: str, original: str, pattern: str = T.FIGURE_PATTERN
) -> DataFrame:
    """Figures of a translation that its original does not carry, for keys that
    have both. Aggregated by (key, figure); no bodies are joined."""
    keys = list(keys)
    is_original = F.col(locale) == original
    figures = bodies.select(
        *keys, is_original.alias("_en"), F.explode(distinct_matches(F.col(body), pattern)).alias("figure")
    )
    both = (
        bodies.groupBy(*keys)
        .agg(F.max(is_original).alias("a"), F.max(~is_original).alias("b"))
        .where(F.col("a") & F.col("b"))
        .select(*keys)
    )
    lone = figures.groupBy(*keys, "figure").agg(F.max("_en").alias("_en")).where(~F.col("_en")).drop("_en")
    return lookup_join(lone, both, keys, "inner")


def untraceable_figures(
    pages: DataFrame, source: DataFrame, keys: Sequence[str], body: str, source_text: str,
    pattern: str = T.FIGURE_PATTERN,
) -> DataFrame:
    """keys, figure: figures of a page that its source text does not hold,
    whitespace ignored; without a source text none is traceable. Pages without a
    figure never reach the join."""
    found = pages.select(*keys, distinct_matches(F.col(body), pattern).alias("_f")).where(F.size("_f") > 0)
    flat = source.select(*keys, F.regexp_replace(source_text, r"\s+", "").alias("_flat"))
    joined = found.join(flat, list(keys), "left")
    lost = F.filter("_f", lambda x: ~F.coalesce(F.col("_flat"), F.lit("")).contains(F.regexp_replace(x, r"\s+", "")))
    return joined.select(*keys, F.explode(lost).alias("figure"))


def hotlines(agencies: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """key, number, gap: dialable numbers of agencies whose list was obtained
    and is not empty; every other agency shows its gap instead. Numbers stay
    rows; an agency's list is never gathered."""
    ready = agencies.where(F.col("status") == "obtained").select(key)
    listed = lookup_join(numbers, ready, [key], "inner").select(
        key, T.tel(F.col("number")).alias("number"), F.lit(None).cast("string").alias("gap")
    )
    n = R.key_counts(agencies.select(key), listed.select(key), [key])
    silent = n.where((F.col("in_left") > 0) & (F.col("in_right") == 0)).select(
        key, F.lit(None).cast("string").alias("number"), F.lit("not-obtained").alias("gap")
    )
    return listed.unionByName(silent)


def confidence_present(services: DataFrame, extracted: DataFrame, key: str, confidence: str, levels: Sequence[str] = ("high", "needs-human")) -> DataFrame:
    """key, kind of services that no extraction covers (`no-extraction`) or whose extraction
    states no known level (`unknown-confidence`)."""
    stated = extracted.select(key, F.col(confidence).alias("_level"), F.lit(True).alias("_any"))
    kind = F.when(F.col("_any").isNull() | F.col("_level").isNull(), "no-extraction").when(~F.col("_level").isin(*levels), "unknown-confidence")
    return services.select(key).join(stated, key, "left").select(key, kind.alias("kind")).where(F.col("kind").isNotNull())
