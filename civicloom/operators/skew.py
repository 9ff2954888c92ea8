"""Joins and numberings that stay parallel when one key holds a large share of
the rows.

Nothing here collects a group: a hot key is cut into pieces, each piece is
handled on its own, and only the much smaller per-piece summaries meet.
"""

from __future__ import annotations

import contextvars
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join many rows to a lookup that has one row per key, whatever share of
    the many rows one key holds.

    The join is left to adaptive execution, which is on by default: a lookup whose
    measured size is below the session's threshold is broadcast, otherwise a
    shuffle partition that turns out too large is split into several tasks. (Where a
    later step would like the join's partitioning, a session may allow the split with
    spark.sql.adaptive.forceOptimizeSkewedJoin; no setting is changed here.)"""
    return left.join(right, list(on), how)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Only a local
    session without one gets a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    folder = tempfile.mkdtemp(prefix="civicloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the shared checkpoint folder and go on from
    there, so that several later passes do not each repeat what led to it. Being
    columnar, each pass reads only the columns it needs, and the measured size
    is known when a join has to choose its strategy."""
    path = f"{checkpoint_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    if (passing := _passing.get()) is not None:
        passing.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths that `settle` has written within the innermost `alone`.
_passing: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("passing", default=None)


def alone(work: Callable[[], DataFrame]) -> DataFrame:
    """What `work` makes, settled. The tables that were settled on the way there are
    removed, as nothing reads them any more: nothing but this result may be kept
    of what `work` makes. So are the shuffle files of the way, once the driver has
    collected what refers to them."""
    outer = _passing.set([])
    try:
        made = work()
    finally:
        passed = _passing.get()
        _passing.reset(outer)
    spark = made.sparkSession
    try:
        return settle(made)
    finally:
        for path in passed:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del made
        gc.collect()
        spark._jvm.System.gc()


@dataclass(frozen=True)
class Measure:
    """One running value: kind is count, sum, max, min or last (non-null)."""

    name: str
    kind: str
    expr: Column
    inclusive: bool = True


_AGG = {
    "count": lambda e: F.count(e),
    "sum": lambda e: F.sum(e),
    "max": lambda e: F.max(e),
    "min": lambda e: F.min(e),
    "last": lambda e: F.last(e, ignorenulls=True),
}


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("count", "sum"):
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)


def _pieced(df: DataFrame, chunk: Column | str) -> tuple[DataFrame, str]:
    """`df` with its piece numbers, and the name of their column. A column that `df` has is used as it
    is: scans one after the other over the same pieces then share one shuffle."""
    return (df, chunk) if isinstance(chunk, str) else (df.withColumn("_chunk", chunk), "_chunk")


def prefix_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    chunk: Column | str,
    measures: Sequence[Measure],
) -> DataFrame:
    """Running aggregates in `order` within `by`, computed piece by piece.

    `chunk` maps a row to an orderable piece number that never decreases along
    `order`. Pass 1 runs the window inside each (by, piece); pass 2 runs it
    over one summary row per piece; the two are combined row by row. A group of
    any size is therefore spread over its pieces.
    """
    by = list(by)
    keyed, piece = _pieced(df, chunk)
    local = W.partitionBy(*by, piece).orderBy(*order)
    rows = keyed
    totals = []
    for m in measures:
        frame = local.rowsBetween(W.unboundedPreceding, 0 if m.inclusive else -1)
        rows = rows.withColumn(m.name, _AGG[m.kind](m.expr).over(frame))
        if m.kind == "last":
            at = F.when(m.expr.isNotNull(), F.struct(*[F.col(c) for c in order]))
            totals.append(F.max_by(m.expr, at).alias(m.name))
        else:
            totals.append(_AGG[m.kind](m.expr).alias(m.name))
    pieces = W.partitionBy(*by).orderBy(piece).rowsBetween(W.unboundedPreceding, -1)
    reduce = {"count": "sum"}
    # Groups of one piece have nothing to carry: what is left is small wherever groups are.
    carried = [F.col("_c_" + m.name) for m in measures]
    carry = (
        keyed.groupBy(*by, piece)
        .agg(*totals)
        .select(
            *by,
            piece,
            *[_AGG[reduce.get(m.kind, m.kind)](F.col(m.name)).over(pieces).alias("_c_" + m.name) for m in measures],
        )
        .where(functools.reduce(lambda a, b: a | b, [c.isNotNull() for c in carried]))
    )
    out = rows.join(carry, [*by, piece], "left")
    for m in measures:
        out = out.withColumn(m.name, _combine(m.kind, F.col("_c_" + m.name), F.col(m.name)))
    return out.select(*df.columns, *[m.name for m in measures])


def ordinal(df: DataFrame, by: Sequence[str], order: Sequence[str], chunk: Column | str, name: str) -> DataFrame:
    """1-based position within the group, for groups of any size."""
    return prefix_scan(df, by, order, chunk, [Measure(name, "count", F.lit(1))])


def neighbours(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    chunk: Column | str,
    before: dict[str, str] | None = None,
    after: dict[str, str] | None = None,
    number: str | None = None,
) -> DataFrame:
    """Columns of the row before and after (new name -> column), across piece
    borders, null at the ends; and the row's number within the group.

    Inside a piece these are lag, lead and row_number; at a border the last and
    first rows of the neighbouring pieces stand in."""
    by = list(by)
    before, after = before or {}, after or {}
    keyed, piece = _pieced(df, chunk)
    local = W.partitionBy(*by, piece).orderBy(*order)
    at = F.struct(*[F.col(c) for c in order])

    def packed(names):
        return F.struct(*[F.col(c).alias(n) for n, c in names.items()])

    rows, ends = keyed, [F.count(F.lit(1)).alias("_n")]
    if before:
        rows = rows.withColumn("_prev", F.lag(packed(before)).over(local))
        ends.append(F.max_by(packed(before), at).alias("_tail"))
    if after:
        rows = rows.withColumn("_next", F.lead(packed(after)).over(local))
        ends.append(F.min_by(packed(after), at).alias("_head"))
    if number:
        rows = rows.withColumn("_i", F.row_number().over(local))
    pieces = W.partitionBy(*by).orderBy(piece)
    carry = [F.sum("_n").over(pieces.rowsBetween(W.unboundedPreceding, -1)).alias("_skip")]
    carry += [F.lag("_tail").over(pieces).alias("_from")] if before else []
    carry += [F.lead("_head").over(pieces).alias("_to")] if after else []
    out = rows.join(keyed.groupBy(*by, piece).agg(*ends).select(*by, piece, *carry), [*by, piece], "left")
    cols = [F.col(c) for c in df.columns]
    cols += [F.coalesce("_prev", "_from")[n].alias(n) for n in before]
    cols += [F.coalesce("_next", "_to")[n].alias(n) for n in after]
    cols += [(F.coalesce("_skip", F.lit(0)) + F.col("_i")).alias(number)] if number else []
    return out.select(*cols)


def previous(df: DataFrame, by, order, chunk: Column | str, values: dict[str, str]) -> DataFrame:
    return neighbours(df, by, order, chunk, before=values)


def following(df: DataFrame, by, order, chunk: Column | str, values: dict[str, str]) -> DataFrame:
    return neighbours(df, by, order, chunk, after=values)


def first_n(df: DataFrame, by: Sequence[str], order: Sequence, n: int, name: str = "rank") -> DataFrame:
    """The first n rows of every group. The optimizer limits each map task to n
    rows per group before the shuffle, so a hot group sends n rows per task."""
    win = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(win)).where(F.col(name) <= n)
