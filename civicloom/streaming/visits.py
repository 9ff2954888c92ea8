"""Visits: who may be counted, at most one count per browser per 24 hours from
the last counted visit, and the running total - as streams, with batch twins.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from civicloom.operators.skew import checkpoint_folder

DAY = 24 * 60 * 60 * 1_000_000
# What a declared crawler calls itself.
CRAWLERS = (
    r"(?i)bot|crawler|spider|slurp|bingpreview|facebookexternalhit|embedly|quora link preview"
    r"|pinterest|vkshare|whatsapp|telegram|skypeuripreview|monitor|uptime|curl|wget"
    r"|python-requests|headlesschrome"
)


def accepted(visits: DataFrame, site: str = "site", agent: str = "agent") -> DataFrame:
    """Same-origin visits by an agent that is neither empty nor a declared
    crawler; an absent origin is refused. Works on a table and on a stream."""
    name = F.coalesce(F.col(agent), F.lit(""))
    return visits.where((F.col(site) == "same-origin") & (name != "") & ~name.rlike(CRAWLERS))


# ---------------------------------------------------------------- batch twin
#
# Which visit counts depends on the one counted before it, so a browser's visits
# form a chain. To keep one browser's chain from being a single long task, time
# is cut into blocks. Each block is worked out for every possible way of entering
# it, which shrinks to a few steps because chains soon meet; those steps are
# followed block by block; and each block then marks its own counted visits.


#
# Rows reach Python sorted, many groups per batch, and are read as a stream: a
# step needs one block of one browser at a time, the other two only the last
# counted visit.


def _runs(frame: pd.DataFrame, keys: list[str]) -> Iterator[tuple[int, int]]:
    """(start, end) of each run of equal keys in a sorted frame."""
    turn = np.zeros(len(frame), dtype=bool)
    for k in keys:
        col = frame[k].to_numpy()
        turn[1:] |= col[1:] != col[:-1]
    edges = [0, *np.flatnonzero(turn).tolist(), len(frame)]
    return zip(edges[:-1], edges[1:])


def _whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The same rows in frames that end with a group: the last group of a frame
    waits for the next one."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        *_, (start, _end) = _runs(frame, keys)
        if start == 0 and held and all(held[-1][k].iloc[-1] == frame[k].iloc[0] for k in keys):
            held.append(frame)
            continue
        yield pd.concat([*held, frame.iloc[:start]], ignore_index=True)
        held = [frame.iloc[start:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _steps(days: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(frames, ["user", "block"]):
            users, blocks, us = (frame[c].to_numpy() for c in ("user", "block", "us"))
            out = {"user": [], "block": [], "entry": [], "leave": []}
            for a, z in _runs(frame, ["user", "block"]):
                if a == z:
                    continue
                ts = us[a:z]
                n = len(ts)
                # Entering can only happen in the first day or at the first visit after it.
                entries = np.arange(min(np.searchsorted(ts, (int(blocks[a]) * days + 1) * DAY) + 1, n))
                follow, last = np.searchsorted(ts, ts + DAY), entries.copy()
                for _ in range(days + 1):
                    step = follow[last]
                    last = np.where(step < n, step, last)
                # Entries that leave at the same visit are one step: keep its last.
                keep = np.append(ts[last[1:]] != ts[last[:-1]], True)
                out["user"].append(users[a:z][: keep.sum()])
                out["block"].append(blocks[a:z][: keep.sum()])
                out["entry"].append(ts[entries[keep]])
                out["leave"].append(ts[last[keep]])
            if out["user"]:
                yield pd.DataFrame({k: np.concatenate(v) for k, v in out.items()})

    return run


def _follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    user = block = last = anchor = None
    taken = False
    for frame in frames:
        out = []
        for u, b, entry, leave in zip(*(frame[c].tolist() for c in ("user", "block", "entry", "leave"))):
            if u != user:
                user, block, last = u, None, None
            if b != block:
                block, anchor, taken = b, last, False
                out.append((u, b, anchor))
            if not taken and (anchor is None or entry >= anchor + DAY):
                last, taken = leave, True
        yield pd.DataFrame(out, columns=["user", "block", "anchor"]).astype({"anchor": "Int64"})


def _mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    user = block = last = None
    for frame in frames:
        users, blocks, us, anchors = (frame[c].to_numpy() for c in ("user", "block", "us", "anchor"))
        out_user, out_us = [], []
        for a, z in _runs(frame, ["user", "block"]):
            if a == z:
                continue
            if users[a] != user or blocks[a] != block:
                user, block = users[a], blocks[a]
                last = None if pd.isna(anchors[a]) else int(anchors[a])
            ts = us[a:z]
            i = 0 if last is None else int(np.searchsorted(ts, last + DAY))
            while i < len(ts):
                last = int(ts[i])
                out_user.append(user)
                out_us.append(last)
                i = int(np.searchsorted(ts, last + DAY))
        yield pd.DataFrame({"user": out_user, "us": np.array(out_us, dtype="int64")})


def counted_visits(visits: DataFrame, user: str, ts: str, days: int = 7) -> DataFrame:
    """user, ts of every counted visit. A gap of exactly 24 hours counts; a visit
    without a browser key is not counted, here or in the stream."""
    kind = visits.schema[user].dataType.simpleString()
    rows = visits.where(F.col(user).isNotNull()).select(F.col(user).alias("user"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).withColumn(
        "block", F.floor(F.col("us") / F.lit(days * DAY))
    )
    sorted_rows = rows.repartition("user", "block").sortWithinPartitions("user", "block", "us")
    steps = sorted_rows.mapInPandas(_steps(days), f"user {kind}, block long, entry long, leave long")
    entry = steps.repartition("user").sortWithinPartitions("user", "block", "entry").mapInPandas(
        _follow, f"user {kind}, block long, anchor long"
    )
    entered = rows.join(entry, ["user", "block"]).repartition("user", "block").sortWithinPartitions("user", "block", "us")
    marked = entered.mapInPandas(_mark, f"user {kind}, us long")
    return marked.select(F.col("user").alias(user), F.timestamp_micros("us").alias(ts))


def total(counted: DataFrame) -> DataFrame:
    """One row: the number of counted visits; null, never zero, when there is
    nothing to count from."""
    return counted.agg(F.nullif(F.count(F.lit(1)), F.lit(0)).alias("total"))


# ---------------------------------------------------------------- stream


class CountOncePerDay(StatefulProcessor):
    """Buffers a browser's visits until the watermark has passed them, then folds
    them in time order.

    A visit within 24 hours after the last counted one can never count, so it is
    dropped on arrival; only visits that may still count are kept. Once the watermark
    has passed the last counted visit by 24 hours, no visit to come is affected by it
    and nothing is kept for the browser."""

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", ST.StructType([ST.StructField("us", ST.LongType())]))
        self.waiting = handle.getListState("waiting", ST.StructType([ST.StructField("us", ST.LongType())]))

    def _last(self) -> int | None:
        return self.last.get()[0] if self.last.exists() else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self._last()
        fresh: list[int] = []
        for pdf in rows:
            us = pdf["us"].to_numpy()
            if last is not None:
                us = us[us >= last + DAY]
            fresh += np.unique(us).tolist()
        if fresh:
            self.waiting.appendList([(int(u),) for u in fresh])
            self.handle.registerTimer(max(fresh) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted({row[0] for row in self.waiting.get()})
        last, counted = self._last(), []
        for us in (u for u in held if u <= limit):
            if last is None or us - last >= DAY:
                counted.append(us)
                last = us
        later = [(u,) for u in held if u > limit]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if last is not None and not later and limit >= last + DAY:
            self.last.clear()
        elif counted:
            self.last.update((last,))
            self.handle.registerTimer((last + DAY) // 1000 + 1)
        if counted:
            yield pd.DataFrame({"user": [key[0]] * len(counted), "us": counted}).astype({"us": "int64"})

    def close(self) -> None:
        pass


def counted_stream(visits: DataFrame, user: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Counted visits of a stream. Visits later than `late` behind the newest are
    dropped by the watermark; `late_visits` counts them."""
    kind = visits.schema[user].dataType.simpleString()
    timed = visits.where(F.col(user).isNotNull()).select(
        F.col(user).alias("user"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")
    ).withWatermark("ts", late)
    out = timed.groupBy("user").transformWithStateInPandas(
        statefulProcessor=CountOncePerDay(),
        outputStructType=f"user {kind}, us long",
        outputMode="Append",
        timeMode="EventTime",
    )
    return out.select(F.col("user").alias(user), F.timestamp_micros("us").alias(ts))


def total_stream(counted: DataFrame) -> DataFrame:
    return counted.groupBy().agg(F.count(F.lit(1)).alias("total"))


# ---------------------------------------------------------------- running a stream to its end


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _to_its_end(writer, stateful: bool = False) -> StreamingQuery:
    """Runs a stream over everything available. State with timers needs the RocksDB
    store; the session's own setting is put back once the query has taken it up."""
    spark = SparkSession.active()
    before = spark.conf.get(STORE)
    if stateful:
        spark.conf.set(STORE, ROCKS)
    try:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return query


def run_to_end(writer) -> StreamingQuery:
    """Runs a stream that holds state per key over everything available."""
    return _to_its_end(writer, stateful=True)


def late_visits(query: StreamingQuery) -> int:
    """Rows that a stream's watermark has dropped."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def drain(spark: SparkSession, stream: DataFrame, name: str, more: Sequence[Callable[[], None]] = (), late: list[int] | None = None) -> DataFrame:
    """Run an appending stream over everything available and return what it
    wrote. Output and progress go to a folder of this run below the cluster's
    shared checkpoint folder. Each of `more` lands further input, on which the stream
    goes on from where it was. `late` takes the number of rows each run has dropped."""
    base = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/progress")
        .outputMode("append")
    )
    for land in (None, *more):
        if land is not None:
            land()
        query = _to_its_end(writer, stateful=True)
        if late is not None:
            late.append(late_visits(query))
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drain_latest(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run an updating aggregate to its end; returns the last complete result.
    Every batch overwrites its own folder, so a repeated batch changes nothing."""
    base = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    newest: dict[str, int] = {}

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")
        newest["id"] = batch_id

    _to_its_end(stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/progress").outputMode("complete"))
    if not newest:  # a stream without any batch
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{base}/out/batch={newest['id']}")


def read_stream(spark: SparkSession, folder: str, table: str, per_trigger: int | None = None) -> DataFrame:
    """One table of a folder of parquet files as a stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)
