"""Crawl batches as change events, and freshness re-evaluated by changes and by the calendar.

Page changes hold state per page, freshness per bucket of pages: a batch touches those it has news
of, and a tick those with a page whose state changes on that day. Only these pages are told. Outputs are appended by the file sink, which
writes a batch once, also when it is run again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from civicloom.functions.dates import days_between, freshness
from civicloom.operators.pages import content_checksum
from civicloom.operators.skew import lookup_join

DAY_MS = 86_400_000
#: Days after which a fact that nobody has confirmed goes.
EXPIRY = 90
#: Buckets that the calendar's pages are dealt to; a stream's state holds to them.
BUCKETS = 1024


class LatestCopy(StatefulProcessor):
    """The newest copy of a page that is known: what a later copy is compared with.

    Of the copies in one batch the newest counts; one that is older than the known copy
    says nothing. With `forget_ms` a page not seen for so long is new again."""

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "n long, sha256 string", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max((int(n), sha) for pdf in rows for n, sha in zip(pdf["n"], pdf["sha256"]))
        known = self.known.get() if self.known.exists() else None
        if known is None or newest[0] >= known[0]:
            state = "new" if known is None else "same" if known[1] == newest[1] else "changed"
            self.known.update(newest)
            yield pd.DataFrame({"key": [key[0]], "n": [newest[0]], "state": [state], "sha256": [newest[1]]})

    def close(self) -> None:
        pass


def page_changes(crawl: DataFrame, key: str, html: str, order: str, forget_ms: int | None = None) -> DataFrame:
    """Stream of key, `order`, state (new / changed / same) and sha256 of a stream of crawled
    pages. Texts become checksums before anything is shuffled; pages without a key or an order are left out."""
    kind = crawl.schema[key].dataType.simpleString()
    copies = crawl.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(
        F.col(key).alias("key"), F.col(order).cast("long").alias("n"), F.coalesce(content_checksum(F.col(html)), F.lit("")).alias("sha256")
    )
    out = copies.groupBy("key").transformWithStateInPandas(
        statefulProcessor=LatestCopy(forget_ms), outputStructType=f"key {kind}, n long, state string, sha256 string",
        outputMode="Append", timeMode="ProcessingTime" if forget_ms else "None",
    )
    return out.select(F.col("key").alias(key), F.col("n").alias(order), "state", "sha256")


def appended(stream: DataFrame, path: str):
    """writeStream that appends a stream's rows under `path/log`."""
    return stream.writeStream.format("parquet").option("path", f"{path}/log").option("checkpointLocation", f"{path}/progress").outputMode("append")


class Calendar(StatefulProcessor):
    """The checks of a bucket of pages, and a timer for the next day on which the state of one of them changes.

    Told are changes of state (fresh, due, stale, undated; none without a cadence) and, once per
    check, that a fact nobody has confirmed has expired. Days are numbers since 1970-01-01.
    A bucket's pages are one state row of some 50 bytes a page, worked on as columns: a call costs the same for one
    page as for thousands."""

    STATES = ["undated", "fresh", "due", "stale"]  # by code; -1 is no state
    NEVER = 1 << 40

    def init(self, handle) -> None:
        self.handle = handle
        self.pages = handle.getValueState("pages", "rows binary")

    @classmethod
    def codes_of(cls, age, cadence, forced):
        """Codes of the states of pages; a cadence below 0 is none."""
        late = np.where(forced | (age > cadence), 3, np.where(age * 10 > cadence * 9, 2, 1))
        return np.where(cadence < 0, -1, np.where(age < 0, 0, late))

    @classmethod
    def state_of(cls, age: int, cadence: int | None, forced: bool) -> str | None:
        code = int(cls.codes_of(np.array([age]), np.array([-1 if cadence is None else cadence]), np.array([forced]))[0])
        return None if code < 0 else cls.STATES[code]

    def _known(self) -> pd.DataFrame | None:
        if self.pages.exists():
            return pa.ipc.open_stream(self.pages.get()[0]).read_all().to_pandas()
        return None

    def _tell(self, at: pd.DataFrame, today) -> list[pd.DataFrame]:
        """What is to be told of the pages `at` on their day; their columns are brought up to it."""
        age = today - at["checked"].to_numpy()
        cadence, forced, loose = at["cadence"].to_numpy(), at["forced"].to_numpy(), at["unconfirmed"].to_numpy()
        state, said = self.codes_of(age, cadence, forced), []

        def tell(which, what, states):
            at["n"] += which
            if which.any():
                told = {"key": at["key"][which], "n": at["n"][which], "day": today[which], "checked": at["checked"][which], "what": what, "state": states}
                said.append(pd.DataFrame(told))

        turned = state != at["told"].to_numpy()
        tell(turned, "state", np.array([*self.STATES, None], dtype=object)[state[turned]])
        gone = loose & ~at["expired"].to_numpy() & (age >= EXPIRY)
        tell(gone, "expiry", "expired")
        at["told"], at["expired"] = state, at["expired"].to_numpy() | gone
        paced = (cadence >= 0) & ~forced
        ages = [
            np.zeros_like(age), np.where(loose & ~at["expired"].to_numpy(), EXPIRY, -1),
            np.where(paced, cadence * 9 // 10 + 1, -1), np.where(paced, cadence + 1, -1),
        ]
        later = np.min([np.where(a > age, a, self.NEVER) for a in ages], axis=0)
        at["next"] = np.where(later == self.NEVER, self.NEVER, at["checked"].to_numpy() + later)
        return said

    def _keep(self, pages: pd.DataFrame) -> None:
        table = pa.Table.from_pandas(pages, preserve_index=False)
        with pa.BufferOutputStream() as sink:
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            self.pages.update((sink.getvalue().to_pybytes(),))
        following, known = int(pages["next"].min()), False
        for timer in list(self.handle.listTimers()):
            if timer == following * DAY_MS - 1:
                known = True
            else:
                self.handle.deleteTimer(timer)
        if following < self.NEVER and not known:
            self.handle.registerTimer(following * DAY_MS - 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        order = ["at", "checked", "cadence", "unconfirmed", "forced"]
        news = pd.concat(list(rows), ignore_index=True)[["key", *order]]
        news["cadence"] = news["cadence"].fillna(-1).clip(lower=-1)
        news = news.astype({"at": "int64", "checked": "int64", "cadence": "int64", "unconfirmed": "bool", "forced": "bool"})
        news = news.sort_values(order).drop_duplicates("key", keep="last").reset_index(drop=True)
        news = news.assign(told=np.int64(-1), expired=False, n=np.int64(0), next=np.int64(self.NEVER))
        old = self._known()
        if old is not None:
            before = old.set_index("key").reindex(news["key"]).reset_index()
            seen = before["n"].notna().to_numpy()
            for c in ("told", "n"):
                news.loc[seen, c] = before.loc[seen, c].astype("int64")
            same = seen & (before["checked"] == news["checked"]).to_numpy()
            news.loc[same, "expired"] = before.loc[same, "expired"].astype("bool")
            old = old[~old["key"].isin(news["key"])]
        today = np.maximum(news.pop("at").to_numpy(), timerValues.getCurrentWatermarkInMs() // DAY_MS)
        said = self._tell(news, today)
        self._keep(news if old is None or old.empty else pd.concat([old, news], ignore_index=True))
        yield from said

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pages, today = self._known(), timerValues.getCurrentWatermarkInMs() // DAY_MS
        due = (pages["next"] <= today).to_numpy()
        if due.any():
            at = pages[due].reset_index(drop=True)
            said = self._tell(at, np.full(len(at), today))
            self._keep(pd.concat([pages[~due], at], ignore_index=True))
            yield from said

    def close(self) -> None:
        pass


def freshness_stream(checks: DataFrame, ticks: DataFrame, key: str) -> DataFrame:
    """Stream of key, n (counts up per key), day, checked, what, state: what changes with checks and with the calendar.

    checks(key, last_checked_at, cadence, unconfirmed, forced, at): what is known of a page as of the
    day `at` on which it lands; forced: a document of its class has changed. ticks(day): the day has come.
    Checks without a key or a date are left out, and those that land for a day before the last tick's."""
    kind = checks.schema[key].dataType.simpleString()

    def noon(day: Column, hours: int) -> Column:
        return F.timestamp_seconds(F.unix_date(day) * 86400 + hours * 3600)

    known = checks.where(F.col(key).isNotNull() & F.col("last_checked_at").isNotNull() & F.col("at").isNotNull()).select(
        F.col(key).alias("key"), F.unix_date(F.col("at").cast("date")).alias("at"), F.unix_date(F.col("last_checked_at").cast("date")).alias("checked"),
        F.col("cadence").cast("int").alias("cadence"), F.coalesce("unconfirmed", F.lit(False)).alias("unconfirmed"),
        F.coalesce("forced", F.lit(False)).alias("forced"), noon(F.col("at").cast("date"), 12).alias("ts"),
    )
    # A tick is no page; it moves the watermark, a day behind, to its own midnight.
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema if f.name != "ts"]
    moved = ticks.where(F.col("day").isNotNull()).select(*none, noon(F.col("day").cast("date"), 24).alias("ts"))
    # The filter reads the time too, or it would be moved below the watermark and ticks with it.
    page = F.when(F.col("ts").isNotNull(), F.col("key").isNotNull())
    rows = known.unionByName(moved).withWatermark("ts", "1 day").where(page)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    out = dealt.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Calendar(), outputStructType=f"key {kind}, n long, day int, checked int, what string, state string",
        outputMode="Append", timeMode="EventTime",
    )
    return out.select(
        F.col("key").alias(key), "n", F.date_from_unix_date("day").alias("day"), F.date_from_unix_date("checked").alias("checked"), "what", "state"
    )


def freshness_tick(pages: DataFrame, classes: DataFrame, changed: DataFrame, as_of: Column) -> DataFrame:
    """Pages with their state for a day, classes with a changed document forced
    stale. pages(data_class, last_checked_at, ...); changed(data_class)."""
    dim = classes.select(F.col("name").alias("data_class"), F.col("cadence_days").alias("cadence"))
    forced = changed.select("data_class").distinct().withColumn("_forced", F.lit(True))
    known = dim.join(forced, "data_class", "left")
    out = lookup_join(pages, known, ["data_class"])
    state = freshness(F.col("last_checked_at"), as_of, F.col("cadence"), F.coalesce("_forced", F.lit(False)))
    return out.withColumn("age", days_between(F.col("last_checked_at"), as_of)).withColumn("state", state).drop("_forced")
