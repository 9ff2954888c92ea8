"""Readers, writers and streams on small files."""

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from civicloom.operators import pages as P
from civicloom.operators import validate as V_
from civicloom.sources import commits
from civicloom.sources import readers as SRC
from civicloom.sources import writers as SNK
from civicloom.streaming import feeds
from civicloom.streaming import visits as V

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 1, 8, 0, 0)


def greedy(visits):
    out, last = [], {}
    for user, ts in sorted(set(visits), key=lambda v: (v[0], v[1])):
        if user not in last or ts - last[user] >= DAY:
            last[user] = ts
            out.append((user, ts))
    return sorted(out)


def make(seed, n=1500, users=12, days=45):
    """A third of the visits by one browser; some exactly a day apart."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        user = 0 if i % 3 == 0 else rng.randrange(users)
        out.append((user, T0 + dt.timedelta(microseconds=rng.randrange(days * 86_400_000_000))))
    out += [(1, T0 + k * DAY) for k in range(20)] + [(2, T0 + dt.timedelta(hours=13 * k)) for k in range(20)]
    return out + [(3, T0 + DAY - dt.timedelta(microseconds=1)), (3, T0)]


@pytest.mark.parametrize("seed,block", [(1, 7), (2, 1), (3, 30)])
def test_batch_count_equals_the_sequential_rule(spark, seed, block):
    data = make(seed)
    got = V.counted_visits(spark.createDataFrame(data, "u long, ts timestamp"), "u", "ts", days=block)
    assert sorted((r["u"], r["ts"]) for r in got.collect()) == greedy(data)


def test_thirteen_hour_chain_counts_every_other(spark):
    data = [(1, T0 + dt.timedelta(hours=13 * k)) for k in range(5)]
    got = sorted(r["ts"] for r in V.counted_visits(spark.createDataFrame(data, "u long, ts timestamp"), "u", "ts").collect())
    assert got == [data[0][1], data[2][1], data[4][1]]


def test_stream_count_equals_batch(spark, tmp_path):
    data = sorted(make(5, n=300, days=10), key=lambda v: v[1])
    cut = [data[:150], data[150:], [(99, T0 + 60 * DAY)], [(99, T0 + 62 * DAY)]]
    for i, part in enumerate(cut):
        spark.createDataFrame(part, "u long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 0:
            schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = V.drain(spark, V.counted_stream(stream, "u", "ts", "1 hour"), "test-visits")
    want = [v for v in greedy(data)]
    assert sorted((r["u"], r["ts"]) for r in got.collect() if r["u"] != 99) == want


def test_stream_state_expires_and_late_visits_are_counted(spark, tmp_path):
    cols, source, progress = "u string, ts timestamp", str(tmp_path / "in"), str(tmp_path / "progress")

    def land(*rows):
        spark.createDataFrame(list(rows), cols).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(cols).parquet(source)
        writer = V.counted_stream(stream, "u", "ts", "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        return V.late_visits(V._to_its_end(writer.option("checkpointLocation", progress).outputMode("append"), stateful=True))

    def kept():
        state = spark.read.format("statestore").option("path", progress).option("stateVarName", "last").load()
        return {r["key"]["user"] for r in state.collect()}

    land(("a", T0), (None, T0))
    run()
    land(("b", T0 + dt.timedelta(hours=5)))
    run()
    assert kept() == {"a"}
    land(("c", T0 + 3 * DAY))
    run()
    assert "a" not in kept()
    land(("a", T0 + dt.timedelta(hours=6)), ("d", T0 + 3 * DAY))
    assert run() == 1
    got = spark.read.schema("u string, ts timestamp").parquet(str(tmp_path / "out")).collect()
    assert sorted((r["u"], r["ts"]) for r in got) == [("a", T0), ("b", T0 + dt.timedelta(hours=5))]


def test_a_stream_without_input_has_no_total(spark, tmp_path):
    spark.createDataFrame([], "u long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u long, ts timestamp").parquet(str(tmp_path / "in"))
    assert [r["total"] for r in V.drain_latest(spark, V.total_stream(stream), "none").collect()] in ([], [0])


def test_refusals(spark):
    data = [("same-origin", "Mozilla"), ("same-origin", "GoogleBOT"), ("same-origin", ""), ("cross-site", "Mozilla"), (None, "Mozilla"), ("same-origin", None)]
    assert V.accepted(spark.createDataFrame(data, "site string, agent string")).count() == 1


def test_total_of_nothing_is_unknown(spark):
    empty = spark.createDataFrame([], "u long, ts timestamp")
    assert V.total(empty).first()["total"] is None


def test_page_changes(spark, tmp_path):
    crawls = [
        [(1, "<article>a</article>", 1), (2, "<article>b</article>", 1), (None, "<article>x</article>", 1), (5, None, 1)],
        [(1, "<script>7</script><article>a</article>", 2), (2, "<article>c</article>", 2), (2, "<article>b</article>", 1), (3, "<article>n</article>", 2)],
        [(2, "<article>b</article>", 1), (5, "<article>now</article>", 3)],
    ]
    cols = "page long, html string, n int"
    out = str(tmp_path / "feed")

    def run():
        stream = spark.readStream.schema(cols).parquet(str(tmp_path / "in"))
        V.run_to_end(feeds.appended(feeds.page_changes(stream, "page", "html", "n"), out))
        return sorted((r["n"], r["page"], r["state"]) for r in spark.read.parquet(f"{out}/log").collect())

    def land(rows):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    land(crawls[0])
    first = run()
    assert first == [(1, 1, "new"), (1, 2, "new"), (1, 5, "new")]
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "feed" / "log").glob("part-*"))
    before = size()
    land(crawls[1])  # a stream that is started again goes on from what it knows
    second = run()
    assert second[3:] == [(2, 1, "same"), (2, 2, "changed"), (2, 3, "new")] and size() <= 3 * before
    # a batch whose end was not recorded runs again and adds nothing
    last = max((tmp_path / "feed" / "progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink()
    assert run() == second
    land(crawls[2])  # an older copy than the known one says nothing
    assert run() == [*second, (3, 5, "changed")]


def test_calendar_tells_only_what_changes(spark, tmp_path):
    cols, day0 = "key string, last_checked_at date, cadence int, unconfirmed boolean, forced boolean, at date", dt.date(2026, 1, 1)
    day = lambda n: day0 + dt.timedelta(days=n)
    checks, ticks, out = (str(tmp_path / x) for x in ("checks", "ticks", "out"))
    spark.createDataFrame([], "day date").write.parquet(ticks)
    seen = 0

    def run(rows=(), tick=None):
        """What one run adds to the log."""
        nonlocal seen
        if rows:
            spark.createDataFrame([(k, day(c), cad, u, f, day(at)) for k, c, cad, u, f, at in rows], cols).coalesce(1).write.mode("append").parquet(checks)
        if tick is not None:
            spark.createDataFrame([(day(tick),)], "day date").coalesce(1).write.mode("append").parquet(ticks)
        stream = feeds.freshness_stream(spark.readStream.schema(cols).parquet(checks), spark.readStream.schema("day date").parquet(ticks), "key")
        V.run_to_end(feeds.appended(stream, out))
        log = sorted(((r["n"], r["key"], (r["day"] - day0).days, r["what"], r["state"]) for r in spark.read.parquet(f"{out}/log").collect()), key=lambda r: (r[2], r[1], r[0]))
        fresh, seen = log[seen:], len(log)
        return [(k, d, s) for _, k, d, _, s in fresh]

    rows = [("a", 0, 10, False, False, 0), ("b", 5, 10, False, False, 0), ("c", 0, None, True, False, 0), ("d", 0, 100, True, False, 0)]
    assert run(rows) == [("a", 0, "fresh"), ("b", 0, "undated"), ("d", 0, "fresh")]
    assert run(tick=4) == []
    assert run(tick=9) == [("b", 9, "fresh")]
    assert run(tick=10) == [("a", 10, "due")]
    assert run(tick=10) == []
    # a tick that skips days tells where a page stands, not how it came there; a document of b's class has changed
    assert run([("b", 5, 10, False, True, 10)]) == [("b", 10, "stale")]
    assert run(tick=30) == [("a", 30, "stale")]
    assert run([("a", 30, 10, False, False, 31)]) == [("a", 31, "fresh")]
    assert run(tick=90) == [("a", 90, "stale"), ("c", 90, "expired"), ("d", 90, "expired")]
    assert run(tick=91) == [("d", 91, "due")]
    for age in range(-1, 40):  # the state is the one that the batch expression gives
        for cadence in (0, 1, 9, 10, 20, 21):
            want = "undated" if age < 0 else "stale" if age > cadence else "due" if age * 10 > cadence * 9 else "fresh"
            assert feeds.Calendar.state_of(age, cadence, False) == want


def test_calendar_works_on_whole_buckets():
    """A call to the state store costs more than a page: their number must not grow with the pages of a bucket."""
    calls = []

    class Value:
        row = None

        def exists(self):
            return self.row is not None

        def get(self):
            calls.append("get")
            return self.row

        def update(self, row):
            calls.append("update")
            self.row = row

    class Handle:
        timers = set()

        def getValueState(self, name, schema):
            return Value()

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, at):
            calls.append("timer")
            self.timers.add(at)

        def deleteTimer(self, at):
            calls.append("timer")
            self.timers.discard(at)

    class Times:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    handle, times, calendar, pages = Handle(), Times(), feeds.Calendar(), 5000
    calendar.init(handle)
    rows = pd.DataFrame({"key": range(pages), "at": 1000, "checked": [1000 - k % 7 for k in range(pages)], "cadence": [None if k % 5 == 0 else 20 for k in range(pages)],
                         "unconfirmed": [k % 2 == 0 for k in range(pages)], "forced": [k % 11 == 0 for k in range(pages)]})
    said = pd.concat(calendar.handleInputRows((0,), iter([rows[:2000], rows[2000:]]), times))
    log = {k: [(1, 1000, "stale" if k % 11 == 0 else "fresh")] if k % 5 else [] for k in range(pages)}
    while handle.timers:
        due = min(handle.timers)
        times.now = due + 1
        handle.timers.discard(due)
        said = pd.concat([said, *calendar.handleExpiredTimer((0,), times, None)])
    for k, told in log.items():
        days = [(1000 - k % 7 + 19, "due"), (1000 - k % 7 + 21, "stale")] if k % 5 and k % 11 else []
        days += [(1000 - k % 7 + 90, "expired")] if k % 2 == 0 else []
        told += [(len(told) + i, *d) for i, d in enumerate(days, 1)]
    assert {k: sorted(zip(g["n"], g["day"], g["state"])) for k, g in said.groupby("key")} == {k: v for k, v in log.items() if v}
    assert len(calls) < 300  # 21 days on which anything happens


def failing(df):
    """The same rows, but some task breaks while they are written."""

    def broken(batches):
        for i, b in enumerate(batches):
            yield b
            raise RuntimeError("lost on the way")

    return df.repartition(2).mapInArrow(broken, df.schema)


def test_inventory_and_baseline(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", dt.date(2026, 1, 1)), (2, "b", dt.date(2026, 1, 2))], "key int, kind string, last_checked_at date")
    path, measures = str(tmp_path / "inv"), {"a": F.count_if(F.col("kind") == "a")}
    assert commits.load(spark, path, df.schema).count() == 0 and commits.header(spark, path, "row_count long").count() == 0
    assert SNK.write_inventory(df, path, "one", measures).first().asDict() == {"row_count": 2, "a": 1}
    # a run that breaks is not seen, and can be run again
    more = df.unionByName(df.withColumn("key", F.col("key") + 10))
    with pytest.raises(Exception, match="lost on the way"):
        SNK.write_inventory(failing(more), path, "two", measures)
    assert (tmp_path / "inv" / "data" / "run=two").exists()
    assert commits.load(spark, path, df.schema).count() == 2
    assert commits.header(spark, path, "row_count long, a long").first().asDict() == {"row_count": 2, "a": 1}
    assert SNK.write_inventory(more, path, "two", measures).first().asDict() == {"row_count": 4, "a": 2}
    # run once more it changes nothing, whatever it is given
    assert SNK.write_inventory(df, path, "two", measures).first().asDict() == {"row_count": 4, "a": 2}
    assert sorted(r["key"] for r in commits.load(spark, path, df.schema).collect()) == [1, 2, 11, 12]
    assert SNK.write_inventory(df.limit(0), path, "three", measures).first().asDict() == {"row_count": 0, "a": 0}
    assert commits.load(spark, path, df.schema).count() == 0 and len(commits.commits(spark, path)) == 3
    with pytest.raises(ValueError):
        SNK.write_inventory(df, path, "../four")
    docs = str(tmp_path / "doc")
    assert SNK.write_per_document(df, docs, "kind", "one").first()["documents"] == 2
    assert sorted(map(tuple, commits.load(spark, docs, df.schema).collect())) == sorted(map(tuple, df.collect()))
    assert SNK.write_baseline(df, str(tmp_path / "base"), "key").first()["row_count"] == 2
    lines = spark.createDataFrame([(2, 0, "b", "two"), (1, 0, "a", "one")], "section int, rank int, key string, line string")
    SNK.write_report(lines, str(tmp_path / "report"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()] == ["one", "two"]


def test_rows_lost_in_storage_are_not_committed(spark, tmp_path, monkeypatch):
    df = spark.range(10)
    real = commits._present
    monkeypatch.setattr(commits, "_present", lambda s, schema, *paths: real(s, schema, *paths).where("id > 0"))
    with pytest.raises(commits.Incomplete):
        commits.commit(df, str(tmp_path / "t"), "one")
    assert commits.commits(spark, str(tmp_path / "t")) == []


def test_versions_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "versions")
    v = lambda rows: spark.createDataFrame(rows, "file string, sha256 string")
    count = lambda df: {r["file"]: r["versions"] for r in df.collect()}
    assert count(SNK.append_versions(v([("a", "1"), ("b", "1"), ("a", "1")]), path, "r1")) == {"a": 1, "b": 1}
    assert count(SNK.append_versions(v([("a", "2"), ("b", "1")]), path, "r2")) == {"a": 2, "b": 1}
    # a job that is run again neither doubles nor loses versions
    assert count(SNK.append_versions(v([("a", "2"), ("b", "1")]), path, "r2")) == {"a": 2, "b": 1}
    with pytest.raises(Exception, match="lost on the way"):
        SNK.append_versions(failing(v([("c", "1"), ("d", "1")])), path, "r3")
    assert count(SNK.append_versions(v([("c", "1"), ("d", "1")]), path, "r3")) == {"a": 2, "b": 1, "c": 1, "d": 1}
    with pytest.raises(Exception):  # a history that cannot be read is not an empty one
        bad = tmp_path / "bad" / "commits"
        bad.mkdir(parents=True)
        (bad / "part-0.parquet").write_text("no parquet")
        SNK.append_versions(v([("a", "1")]), str(tmp_path / "bad"), "r1").collect()
    # Reverting to a recorded checksum adds nothing.
    assert count(SNK.append_versions(v([("a", "1"), ("b", "1")]), path, "r4")) == {"a": 2, "b": 1, "c": 1, "d": 1}


def test_frontier(spark):
    robots = spark.createDataFrame([("h", 0, "User-agent: *"), ("h", 1, "Disallow: /no")], "host string, pos int, line string")
    found = spark.createDataFrame([(u,) for u in ["http://h/a#x", "http://h/a", " http://h/b ", "http://h/no/1", "http://g/no/1", None, "", "#top"]], "url string")
    seen = spark.createDataFrame([("http://h/b#y",), ("http://h/no/1",), ("http://h/b",)], "url string")
    got = {r["url"]: (r["state"], r["rule"]) for r in P.frontier(found, seen, P.robots_rules(robots)).collect()}
    assert got == {"http://h/a": ("fetch", None), "http://h/b": ("seen", None), "http://h/no/1": ("forbidden", "/no"), "http://g/no/1": ("fetch", None)}


def test_readers(spark, tmp_path):
    folder = tmp_path / "content" / "services" / "health"
    folder.mkdir(parents=True)
    (folder / "index.json").write_text(json.dumps({"pages": [{"slug": "one", "name": "One"}, {"slug": "two"}]}))
    (folder / "one.md").write_text("# One\nbody")
    (folder / "one.fil.md").write_text("# Isa")
    root = str(tmp_path / "content")
    got = [(r["section"], r["category"], r["pos"], r["slug"]) for r in SRC.scan_manifests(spark, root).orderBy("pos").collect()]
    assert got == [("services", "health", 0, "one"), ("services", "health", 1, "two")]
    broken = tmp_path / "content" / "services" / "civil"
    broken.mkdir()
    (broken / "index.json").write_text("{not json")
    (tmp_path / "content" / "services" / "empty").mkdir()
    (tmp_path / "content" / "services" / "empty" / "index.json").write_text('{"pages": []}')
    entries = SRC.scan_manifests(spark, root)
    errors = SRC.unreadable(entries).collect()
    assert entries.count() == 3 and [(r["category"], r["error"].endswith("civil/index.json")) for r in errors] == [("civil", True)]
    with pytest.raises(ValueError, match="1 violations.*civil"):
        V_.strict(SRC.unreadable(entries))
    bodies = {(r["slug"], r["locale"]): r["body"] for r in SRC.scan_bodies(spark, root).collect()}
    assert bodies == {("one", "en"): "# One\nbody", ("one", "fil"): "# Isa"}
    blobs = SRC.scan_blobs(spark, root, "*.md").collect()
    assert len(blobs) == 2 and all(len(b["sha256"]) == 64 for b in blobs)
    assert SRC.categories(SRC.scan_manifests(spark, root), "nowhere").count() == 0


def test_forecast_is_strict_and_never_throws(spark):
    good = {
        "utc_offset_seconds": 28800,
        "current": {"time": "2026-08-21T00:30", "temperature_2m": -0.5, "relative_humidity_2m": 80, "wind_speed_10m": 3, "weather_code": 3},
        "hourly": {"time": ["2026-08-21T00:00", "2026-08-21T01:00", "2026-08-21T02:00", "2026-08-21T03:00"], "temperature_2m": [1.0, None, 2.5], "weather_code": [0, 1, 98, 3]},
        "daily": {"precipitation_probability_max": [None]},
    }
    rows = [(json.dumps(good),), ("nope",), ("{}",), (json.dumps({**good, "hourly": 5}),), (None,)]
    df = spark.createDataFrame(rows, "x string").select(F.explode(F.array(SRC.forecast(F.col("x")))).alias("f"))
    out = df.where(F.col("f").isNotNull()).select(SRC.outlook(F.col("f")).alias("o")).collect()
    assert [[tuple(r) for r in row["o"]] for row in out] == [[("2026-08-21T02:00+08:00", 3, "unknown")]]
