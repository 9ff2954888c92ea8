"""Sources: landed files and landed text columns as typed rows.

Schemas are always given, never inferred; a record that does not parse becomes
a null struct rather than a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from civicloom.functions import dates

ENTRY = (
    "slug string, name string, description string, dataClass string, verification string, "
    "lastCheckedAt string, source struct<url:string,retrievedAt:string>"
)
MANIFEST = f"pages array<struct<{ENTRY.replace(' string', ':string').replace('source struct', 'source:struct')}>>"
FORECAST = (
    "utc_offset_seconds int, current struct<time:string,temperature_2m:double,relative_humidity_2m:double,"
    "wind_speed_10m:double,weather_code:int>, hourly struct<time:array<string>,temperature_2m:array<double>,"
    "weather_code:array<int>>, daily struct<precipitation_probability_max:array<double>>"
)


def scan_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Every manifest (JSON) below `root`: one row per entry with its folder."""
    raw = (
        spark.read.schema(MANIFEST).option("recursiveFileLookup", True).option("multiLine", True)
        .option("pathGlobFilter", "index.json").json(root).withColumn("path", F.col("_metadata.file_path"))
    )
    return entries_of(raw.select("path", "pages"))


def manifest_rows(raw: DataFrame, text: str, path: str) -> DataFrame:
    """The same from manifests landed as a text column."""
    parsed = raw.select(F.col(path).alias("path"), F.from_json(F.col(text), MANIFEST).alias("m"))
    return entries_of(parsed.select("path", F.col("m.pages").alias("pages")))


def entries_of(manifests: DataFrame) -> DataFrame:
    """One row per entry. A manifest that does not parse is a row with an `error`
    that names its file; `validate.strict` stops a job on such rows."""
    folder = F.split("path", "/")
    rows = manifests.select(
        F.element_at(folder, -3).alias("section"),
        F.element_at(folder, -2).alias("category"),
        F.when(F.col("pages").isNull(), F.concat(F.lit("not a manifest: "), "path")).alias("error"),
        F.posexplode_outer("pages").alias("pos", "e"),
    )
    return rows.where(F.col("pos").isNotNull() | F.col("error").isNotNull()).select("section", "category", "pos", "e.*", "error")


def unreadable(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("error").isNotNull()).select("section", "category", "error")


def scan_bodies(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    raw = (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
        .withColumn("path", F.col("_metadata.file_path")).withColumnRenamed("value", "body")
    )
    return body_rows(raw)


def body_rows(raw: DataFrame) -> DataFrame:
    """path, body -> with slug and locale from the file name suffix."""
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(
        "path",
        F.regexp_replace(name, r"(\.fil)?\.md$", "").alias("slug"),
        F.when(name.endswith(".fil.md"), "fil").otherwise("en").alias("locale"),
        "body",
    )


def scan_blobs(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return blob_rows(raw, "path", "content")


def blob_rows(raw: DataFrame, path: str, content: str) -> DataFrame:
    return raw.select(
        F.col(path).alias("file"), F.octet_length(content).alias("bytes"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256")
    )


def categories(entries: DataFrame, section: str) -> DataFrame:
    return entries.where(F.col("section") == section).select("category").distinct().orderBy("category")


def section_tree(entries: DataFrame) -> DataFrame:
    """Entries under their category with the category's size, in order. Empty
    categories have no entry and so no row."""
    n = entries.groupBy("section", "category").agg(F.count(F.lit(1)).alias("entries"))
    from civicloom.operators.skew import lookup_join

    return lookup_join(entries, n, ["section", "category"], "inner").orderBy("section", "category", "slug")


def forecast(payload: Column) -> Column:
    """Parsed payload, or null for anything that is not exactly the contract."""
    parsed = F.from_json(payload, FORECAST, {"mode": "PERMISSIVE"})
    required = [
        "utc_offset_seconds", "current.time", "current.temperature_2m", "current.relative_humidity_2m",
        "current.wind_speed_10m", "current.weather_code", "hourly.time", "hourly.temperature_2m",
        "hourly.weather_code", "daily.precipitation_probability_max",
    ]

    def field(p, dotted):
        for part in dotted.split("."):
            p = p[part]
        return p

    def complete(p):
        ok = F.lit(True)
        for name in required:
            ok = ok & field(p, name).isNotNull()
        return F.when(ok, p)

    return F.transform(F.array(parsed), complete)[0]


def outlook(parsed: Column, hours: int = 3) -> Column:
    """The first readings strictly later than now. Ragged arrays leave holes,
    which are skipped without using up a place."""
    hourly = parsed["hourly"]
    zipped = F.arrays_zip(
        hourly["time"].alias("at"), hourly["temperature_2m"].alias("t"), hourly["weather_code"].alias("c")
    )
    later = F.filter(
        zipped,
        lambda r: r["at"].isNotNull() & r["t"].isNotNull() & r["c"].isNotNull() & (r["at"] > parsed["current"]["time"]),
    )
    return F.transform(
        F.slice(later, 1, hours),
        lambda r: F.struct(
            dates.qualify_instant(r["at"], parsed["utc_offset_seconds"]).alias("at"),
            dates.round_half_up(r["t"]).alias("temperature"),
            dates.code_label(r["c"], dates.CONDITIONS).alias("condition"),
        ),
    )


def counter(text: Column) -> Column:
    """A stored non-negative whole number, or null - never zero - for anything else."""
    value = F.when(F.trim(text).rlike(r"^\d+$"), F.trim(text).try_cast("bigint"))
    return F.when(value >= 0, value)


def site_map(pages: DataFrame, domain: str, path: str, checked: str, locales: list[str]) -> DataFrame:
    """One row per path and locale: url, last_modified (the check date) and the
    map of its alternates."""
    at = lambda loc: F.concat(F.lit(f"{domain}/"), loc, F.col(path))
    alternates = F.map_from_entries(F.array(*[F.struct(F.lit(x), at(F.lit(x))) for x in locales]))
    return pages.withColumn("locale", F.explode(F.array(*[F.lit(x) for x in locales]))).select(
        at(F.col("locale")).alias("url"), F.col(checked).alias("last_modified"), alternates.alias("alternates")
    )


def schema_of(ddl: str) -> ST.StructType:
    return ST.StructType.fromDDL(ddl)
