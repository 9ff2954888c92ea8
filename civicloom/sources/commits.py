"""Tables that change only by whole runs.

`path/data/run=<run>` holds what a run has staged, `path/commits/run=<run>` one row that
says the run counts: its place, how it changes the table (`replace` or `append`),
its rows and its header. Readers list the commit rows and read the data of the runs
that count, so a run is seen whole or not at all: the commit row is one small file,
and moving it into place is what commits.

A run has a name, and a name is committed once. Run again after its commit it writes
nothing and returns what it committed; run again after a failure it replaces what it
had staged. One writer at a time; readers may read meanwhile. The list of commits
comes to the driver: it grows with the number of runs, not with the data.
"""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RECORD = "seq long, run string, kind string, rows long, header string"


class Incomplete(RuntimeError):
    """Staged rows are not what was to be written."""


def _present(spark: SparkSession, schema, *paths: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(*paths)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return None


def commits(spark: SparkSession, path: str) -> list[Row]:
    """The committed runs in order. Only a path that is not there counts as none."""
    try:
        found = spark.read.schema(RECORD).option("recursiveFileLookup", "true").parquet(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return found.orderBy("seq", "run").collect()


def visible(spark: SparkSession, path: str) -> list[str]:
    """Runs whose rows the table has: the last that replaced it and those that added since."""
    done = commits(spark, path)
    first = max((i for i, c in enumerate(done) if c.kind == "replace"), default=0)
    return [c.run for c in done[first:] if c.rows]


def load(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table's rows; a table without a commit is empty."""
    runs, none = visible(spark, path), spark.createDataFrame([], schema)
    # columns that name folders come last when they are read
    return spark.read.schema(schema).parquet(*[f"{path}/data/run={r}" for r in runs]).select(*none.columns) if runs else none


def header(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The header of the last commit, one row; none if there is no commit."""
    last = commits(spark, path)[-1:]
    return spark.createDataFrame([(c.header,) for c in last], "header string").select(F.from_json("header", schema).alias("h")).select("h.*")


def summary_of(df: DataFrame, measures: dict[str, Column] | None = None) -> DataFrame:
    """The header of an inventory: one row of counts."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), *[c.alias(n) for n, c in (measures or {}).items()])


def commit(df: DataFrame, path: str, run: str, kind: str = "replace", measures: dict[str, Column] | None = None, by: list[str] | None = None) -> DataFrame:
    """Writes `df` as one run and returns its header, computed from the rows as they were stored.

    by: columns whose values name folders. The rows stored are counted and compared with those written before the run is committed."""
    if kind not in ("replace", "append"):
        raise ValueError(f"unknown kind {kind}")
    if not re.fullmatch(r"[A-Za-z0-9._-]+", run):
        raise ValueError(f"not a run's name: {run!r}")
    spark = df.sparkSession
    done = commits(spark, path)
    staged = f"{path}/data/run={run}"
    shape = summary_of(df.limit(0), measures).schema
    told = next((c.header for c in done if c.run == run), None)
    if told is None:
        seen = Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("maxRecordsPerFile", 1_000_000)
        (writer.partitionBy(*by) if by else writer).parquet(staged)
        back = _present(spark, df.schema, staged)
        head = summary_of(df.limit(0) if back is None else back, measures)
        # stages that ran again may be counted twice by the observation: only a fresh count can say that rows are missing
        stored = json.loads(head.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("h")).first()["h"])
        if stored["row_count"] != seen.get["n"] and stored["row_count"] != df.count():
            raise Incomplete(f"{staged} has {stored['row_count']} rows of {df.count()}")
        told = json.dumps(stored)
        record = [(len(done) + 1, run, kind, stored["row_count"], told)]
        spark.createDataFrame(record, RECORD).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/run={run}")
    return spark.createDataFrame([(told,)], "header string").select(F.from_json("header", shape).alias("h")).select("h.*")
