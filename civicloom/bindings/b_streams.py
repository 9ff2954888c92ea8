from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicloom.bindings import b_freshness as BF
from civicloom.bindings import b_text as BT
from civicloom.bindings.registry import Tables, query
from civicloom.operators.skew import checkpoint_folder, lookup_join
from civicloom.streaming import feeds
from civicloom.streaming import visits as V


def visits(events: DataFrame) -> DataFrame:
    """events as page visits: some from elsewhere, some by crawlers."""
    k = F.col("event_type")
    return events.select(
        "event_id", "user_id", "ts",
        F.when(k == "signup", "cross-site").when(k != "error", "same-origin").alias("site"),
        F.when((k == "click") & (F.col("value") > 50), "Mozilla (compatible; GoogleBOT/2.1)")
        .when((k == "click") & (F.col("value") < 5), "").otherwise("Mozilla/5.0").alias("agent"),
    )


FILTERED = """f AS (SELECT event_id, user_id, ts FROM events WHERE event_type IN ('view', 'purchase') OR (event_type = 'click' AND value BETWEEN 5 AND 50))"""
COUNTED = f"""RECURSIVE {FILTERED},
v AS (SELECT user_id, min(ts) AS ts FROM f GROUP BY 1
  UNION ALL SELECT f.user_id, min(f.ts) FROM v JOIN f ON f.user_id = v.user_id AND f.ts >= v.ts + INTERVAL 24 HOURS GROUP BY f.user_id, v.ts)"""


@query("stm_visit_filter", f"WITH {FILTERED} SELECT event_id, user_id FROM f")
def _(t):
    stream = V.accepted(visits(V.read_stream(t.spark, t.folder, "events"))).select("event_id", "user_id")
    return V.drain(t.spark, stream, "visit-filter")


def counted(t: Tables) -> DataFrame:
    return V.counted_visits(V.accepted(visits(t.events)), "user_id", "ts")


def folder(t: Tables, name: str) -> str:
    return f"{checkpoint_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def landing(df: DataFrame, path: str):
    """Lands a frame's rows where a stream picks them up."""
    return lambda: df.write.mode("append").parquet(path)


def from_folder(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def counted_by_stream(t: Tables) -> DataFrame:
    """The events as landed files; a later row of another day closes the last one."""
    path, rows = folder(t, "visits-in"), visits(t.events)
    landing(rows, path)()
    close = rows.agg(F.max("ts").alias("t")).select(
        F.lit(-1).cast(rows.schema["event_id"].dataType).alias("event_id"), F.lit(-1).cast(rows.schema["user_id"].dataType).alias("user_id"),
        (F.col("t") + F.expr("INTERVAL 3 DAYS")).cast(rows.schema["ts"].dataType).alias("ts"), F.lit("same-origin").alias("site"), F.lit("close").alias("agent"),
    )
    stream = V.counted_stream(V.accepted(from_folder(rows, path)), "user_id", "ts")
    return V.drain(t.spark, stream, "visits", [landing(close, path)]).where(F.col("user_id") >= 0)


@query("stm_visit_dedupe", f"WITH {COUNTED} SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at_time FROM v")
def _(t):
    return counted_by_stream(t).select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at_time"))


@query("agg_visit_total", f"WITH {COUNTED} SELECT count(*) AS total FROM v")
def _(t):
    return V.total(counted(t))


@query("stm_visit_total", f"WITH {COUNTED} SELECT count(*) AS total FROM v")
def _(t):
    # What the dedupe stream has written is the total's own input stream.
    path, done = folder(t, "counted-in"), counted_by_stream(t)
    landing(done, path)()
    return V.drain_latest(t.spark, V.total_stream(from_folder(done, path)), "visit-total")


@query("stm_page_changes", """
SELECT page_id, CASE WHEN url LIKE '%.html' THEN 'new' WHEN url LIKE '%#top' THEN 'changed' ELSE 'same' END AS state FROM pages WHERE url NOT LIKE '%/es/%'""")
def _(t):
    source, out = folder(t, "crawls-in"), folder(t, "crawls")
    for n, crawl in enumerate(BT.crawls(t)):
        landing(crawl.withColumn("n", F.lit(n)), source)()
        changes = feeds.page_changes(from_folder(crawl.withColumn("n", F.lit(n)), source), "page_id", "html", "n")
        V.run_to_end(feeds.appended(changes, out))
    return t.spark.read.parquet(f"{out}/log").where(F.col("n") == 1).select("page_id", "state")


def told(t: Tables, name: str, changed: DataFrame | None = None) -> DataFrame:
    """What the calendar tells of the pages up to the day of the tables: pages land
    90 days before, changes of documents a day before, then the day's tick."""
    checks, ticks, out = folder(t, f"{name}-in"), folder(t, f"{name}-ticks"), folder(t, name)
    day = BF.as_of().cast("date")
    classes = BF.classes(t).select(F.col("name").alias("data_class"), F.col("cadence_days").alias("cadence"))
    known = BF.pages(t).join(classes, "data_class", "left").select(
        "key", "last_checked_at", F.col("cadence").cast("int").alias("cadence"), (F.col("verification") == "V0").alias("unconfirmed"), "data_class"
    )
    landed = known.select("key", "last_checked_at", "cadence", "unconfirmed", F.lit(False).alias("forced"), F.date_sub(day, 90).alias("at"))
    landing(landed, checks)()
    tick = t.spark.range(1).select(day.alias("day"))
    landing(tick.limit(0), ticks)()

    def run():
        V.run_to_end(feeds.appended(feeds.freshness_stream(from_folder(landed, checks), from_folder(tick, ticks), "key"), out))

    run()
    if changed is not None:
        forced = lookup_join(known, changed.select("data_class").distinct(), ["data_class"], "left_semi").drop("data_class")
        landing(forced.withColumns({"forced": F.lit(True), "at": F.date_sub(day, 1)}).select(*landed.columns), checks)()
        run()
    landing(tick, ticks)()
    run()
    return t.spark.read.parquet(f"{out}/log")


@query("stm_freshness_tick", f"""WITH {BF.SQL},
forced AS (SELECT o_orderpriority AS c FROM orders GROUP BY 1 HAVING max(o_totalprice) < (SELECT max(o_totalprice) FROM orders))
SELECT key, data_class, CASE WHEN cadence IS NULL THEN NULL WHEN age < 0 THEN 'undated' WHEN data_class IN (SELECT c FROM forced) OR age > cadence THEN 'stale'
    WHEN age > 0.9 * cadence THEN 'due' ELSE 'fresh' END AS state FROM aged""")
def _(t):
    # Every class but the one with the dearest order had a document change.
    top = t.orders.groupBy(F.col("o_orderpriority").alias("data_class")).agg(F.max("o_totalprice").alias("p"))
    dearest = t.orders.agg(F.max("o_totalprice")).scalar()
    changed = top.withColumn("m", dearest).where(F.col("p") < F.col("m"))
    last = told(t, "freshness", changed).where(F.col("what") == "state").groupBy("key").agg(F.max_by("state", "n").alias("state"))
    return BF.pages(t).select("key", "data_class").join(last, "key", "left")


@query("stm_v0_expiry", f"WITH {BF.SQL} SELECT key, age FROM aged WHERE verification = 'V0' AND age >= 90")
def _(t):
    gone = told(t, "expiry").where(F.col("what") == "expiry")
    return gone.select("key", F.date_diff(BF.as_of().cast("date"), F.col("checked")).alias("age"))
