"""Sinks. Each has a pure frame builder and a writer that returns a one-row
summary; writers go to the path they are given, which on a cluster is shared
storage. Inventories, per-document tables and version histories change by whole
runs (see `commits`), so a job that is run again neither doubles nor loses rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicloom.operators import reconcile as R
from civicloom.sources import commits
from civicloom.sources.commits import summary_of


def write_inventory(df: DataFrame, path: str, run: str, measures: dict[str, Column] | None = None) -> DataFrame:
    """The inventory of a run takes the place of the one before. Rows and header change
    together; the header is computed from what was stored, so it cannot disagree with it."""
    return commits.commit(df, path, run, "replace", measures)


def write_per_document(df: DataFrame, path: str, document: str, run: str) -> DataFrame:
    """One folder per document. A document's rows are dealt to a few tasks by a hash of
    the row, so that its folder has few files and a huge document more than one task;
    the size of a file is bounded as well."""
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(4))
    return commits.commit(df.repartition(document, spread), path, run, "replace", {"documents": F.countDistinct(document)}, [document])


def append_versions(documents: DataFrame, path: str, run: str) -> DataFrame:
    """Append versions (file, sha256 and whatever else is known of them) that the
    history does not hold: file, versions. History is never rewritten. A version that comes twice in one run is added once."""
    once = documents.dropDuplicates(["file", "sha256"])
    history = commits.load(documents.sparkSession, path, documents.schema)
    commits.commit(R.unseen_versions(once, history).select(*documents.columns), path, run, "append")
    return commits.load(documents.sparkSession, path, documents.schema).groupBy("file").agg(F.count(F.lit(1)).alias("versions"))


def baseline_frame(pages: DataFrame, key: str) -> DataFrame:
    return pages.select(key, "last_checked_at").orderBy(key)


def write_baseline(pages: DataFrame, path: str, key: str, mode: str = "overwrite") -> DataFrame:
    baseline_frame(pages, key).write.mode(mode).parquet(path)
    return summary_of(pages.sparkSession.read.parquet(path))


def write_report(lines: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Report lines (section, rank, key, line) as ordered text files."""
    lines.orderBy("section", "rank", "key").select("line").write.mode(mode).text(path)
    return summary_of(pages_of(lines.sparkSession, path))


def pages_of(spark, path: str) -> DataFrame:
    return spark.read.text(path)
