"""Keyed state and jobs over streams that are run to their ends, batch by batch."""

import datetime as dt
import itertools
import json

import pytest
from pyspark.sql import functions as F

from tessera.sinks.store import Store
from tessera.streaming import jobs, progress

EVENTS = "scan_id string, seq long, type string, phase string, planned long, url string, findings long"
names = itertools.count()


def day(n, hour=0):
    return dt.datetime(2024, 1, n, hour)


@pytest.fixture
def feed(spark, tmp_path):
    """A function that appends rows to a folder and runs a query over it to its end; state is kept between calls."""

    class Feed:
        folder, state = str(tmp_path / "in"), str(tmp_path / "state")

        def put(self, schema, *rows):
            spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(self.folder)

        def stream(self, schema):
            return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(self.folder)

        def run(self, df, mode="update"):
            name = f"out{next(names)}"
            seen = []
            query = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", self.state).queryName(name)
            query = query.trigger(availableNow=True).start()
            # a query with timeouts of processing time does not end by itself
            query.awaitTermination(15)
            query.stop()
            return seen

    return Feed()


def test_live_snapshots_follow_the_batch_form(spark, feed):
    rows = [("a", 1, "phase", "robots", None, None, None), ("a", 2, "plan", None, 4, None, None), ("a", 3, "page", None, None, "u1", 5), ("b", 1, "phase", "robots", None, None, None), ("a", 4, "fetch", None, None, "u2", None)]
    more = [("a", 3, "page", None, None, "u1", 5), ("a", 5, "page", None, None, "u2", 2), ("a", 6, "end", None, None, None, None)]
    feed.put(EVENTS, *rows)
    first = {r.scan_id: tuple(r)[1:] for r in feed.run(progress.live_snapshots(feed.stream(EVENTS)))}
    assert first == {"a": (4, "robots", 4, 1, "u2", 5, False), "b": (1, "robots", None, 0, None, 0, False)}
    feed.put(EVENTS, *more)
    second = {r.scan_id: tuple(r)[1:] for r in feed.run(progress.live_snapshots(feed.stream(EVENTS)))}
    # the page that came again counts once
    assert second == {"a": (6, "robots", 4, 2, "u2", 7, True)}
    whole = spark.createDataFrame([*rows, *more[1:]], EVENTS)
    batch = {r.scan_id: (r.seq, r.phase, r.planned, r.done, r.url, r.findings, r.ended) for r in progress.snapshot(whole).collect()}
    assert batch == first | second


def test_late_events_fall_behind_the_watermark(feed):
    kind = "event_type string, ts timestamp, value double"
    feed.put(kind, ("a", day(1, 5), 1.0), ("a", day(1, 6), 2.0), ("b", day(3), 1.0))
    feed.put(kind, ("a", day(5), 1.0))
    feed.put(kind, ("a", day(1, 7), 9.0), ("a", day(5, 1), 1.0))
    got = [(r.event_type, r.window.start, r.n, r.value) for r in feed.run(progress.windowed_counts(feed.stream(kind)))]
    assert max(n for e, s, n, _ in got if s == day(1)) == 2 and [n for e, s, n, _ in got if s == day(5)][-1] == 2


def test_a_late_reader_sees_the_whole_log(spark, feed):
    feed.put(EVENTS, ("a", 1, "fetch", None, None, "u", None), ("b", 1, "fetch", None, None, "v", None))
    feed.put(EVENTS, ("a", 2, "end", None, None, None, None))
    got = feed.run(jobs.follow(spark, feed.folder, EVENTS, "a"), "append")
    assert [(r.scan_id, r.seq) for r in sorted(got, key=lambda r: r.seq)] == [("a", 1), ("a", 2)]
    feed.put(EVENTS, ("a", 3, "fetch", None, None, "w", None))
    assert [r.seq for r in feed.run(jobs.follow(spark, feed.folder, EVENTS, "a"), "append")] == [3]


def test_the_ledger_is_kept_in_a_store(spark, feed, tmp_path):
    kind = "site_id string, scan_id string, kind string, at timestamp, url string, error string, signatures array<string>, status string, pages long"
    store = Store(spark, str(tmp_path / "store"))
    home, shop = "https://a.example/", "https://a.example/shop"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    feed.put(kind, ("a", "s1", "page", day(1), home, None, ["x", "y"], None, None), ("a", "s1", "page", day(1), shop, None, ["z"], None, None), ("a", "s1", "end", day(1), None, None, None, None, 2))

    def run():
        jobs.keep_ledger(feed.stream(kind), store, 2).trigger(availableNow=True).start().awaitTermination(120)
        return {(r.site_id, r.signature): (r.status, r.first_seen_at, r.last_seen_at, r.resolved_at, r.resolved_scan_id) for r in jobs.kept_ledger(store).collect()}

    try:
        assert {k: v[0] for k, v in run().items()} == {("a", "x"): "open", ("a", "y"): "open", ("a", "z"): "open"}
        # the pages of the second scan come in two batches: x is gone, z's page failed, w is new
        feed.put(kind, ("a", "s2", "page", day(2), home, None, ["y", "w"], None, None), ("a", "s2", "end", day(2), None, None, None, None, 2))
        assert len(run()) == 3
        feed.put(kind, ("a", "s2", "page", day(2), shop, "timeout", None, None, None))
        got = run()
        assert got[("a", "x")] == ("resolved", day(1), day(1), day(2), "s2") and got[("a", "z")][0] == "open" and got[("a", "w")][:2] == ("open", day(2))
        assert got == run()
    finally:
        spark.conf.set(provider, before)


def test_a_replay_hands_over_to_the_live_events(spark, tmp_path):
    kind = "scan_id string, seq long, type string, at timestamp"
    event = lambda n, type="fetch": ("a", n, type, day(1) + dt.timedelta(seconds=n))
    log, live = str(tmp_path / "log"), str(tmp_path / "live")
    put = lambda folder, *rows: spark.createDataFrame(list(rows), kind).coalesce(1).write.mode("append").parquet(folder)
    put(log, *(event(n) for n in (1, 2, 3)))
    put(live, event(5), event(4))
    put(log, event(4))  # the log goes on while it is read
    sent = []
    sink = jobs.FrameSink(sent.append)

    def run():
        read = lambda folder: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)
        rows = jobs.handed_over(read(log), read(live))
        rows.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)

    run()
    numbers = lambda: [json.loads(f.removeprefix("data: "))["at"] for f in sent]
    assert len(sent) == 5 and numbers() == sorted(numbers()) and len(set(sent)) == 5
    put(live, event(7, "end"), event(5), event(8))
    put(log, event(5), event(6), event(7, "end"))
    run()
    assert len(sent) == 7 and numbers() == sorted(numbers()) and json.loads(sent[-1].removeprefix("data: "))["type"] == "end"
    sink(spark.createDataFrame([event(6)], kind), 0)  # a batch that is repeated
    assert len(sent) == 7


def test_trailing_windows_close_behind_the_watermark(spark, feed):
    kind = "ts timestamp, name string"
    feed.put(kind, (day(1, 5), "scan"), (day(1, 6), "scan"), (day(2), "signup"), (day(2, 1), "paid"))
    feed.put(kind, (day(9), "scan"))
    feed.put(kind, (day(9, 1), "scan"))  # what a batch tells holds from the next but one on
    feed.put(kind, (day(1, 7), "scan"), (day(10), "other"))  # too late for all its windows
    got = feed.run(progress.trailing_funnel(feed.stream(kind), {"scans": "scan", "signups": "signup", "paid": "paid"}, days=3), "append")
    assert {r.until.day: tuple(r)[1:] for r in got} == {2: (2, 0, 0, 0.0, 0.0), 3: (2, 1, 1, 50.0, 100.0), 4: (2, 1, 1, 50.0, 100.0), 5: (0, 1, 1, 0.0, 100.0)}


def test_scheduler_passes(spark):
    now = F.lit(day(10)).cast("timestamp")
    sites = spark.createDataFrame(
        [(1, 7, None, day(9), "daily"), (2, 7, None, day(8), "daily"), (3, 7, None, day(7), "weekly"), (4, 8, None, day(1), "daily"), (5, 9, None, day(1), "weekly"), (6, 7, None, day(11), "daily"), (7, 7, day(1), day(1), "daily"), (8, 7, None, day(1), "manual"), (9, 10, None, day(2), "weekly")],
        "id int, org_id int, archived_at timestamp, next_scan_at timestamp, scan_frequency string",
    )
    orgs = spark.createDataFrame(
        [(7, "growth", None, "sub", "active"), (8, "starter", None, "sub", "active"), (9, "growth", day(2), None, None), (10, "starter", None, "sub", "active")],
        "id int, plan string, trial_ends_at timestamp, subscription string, billing_status string",
    )
    kind = "org_id int, created_at timestamp"
    scans = spark.createDataFrame([(7, day(5))] * 198 + [(7, dt.datetime(2023, 12, 30))] * 50 + [(10, day(1))] * 30, kind)
    got = {r.site_id: (r.next_scan_at, r.scan_frequency, r.skipped) for r in jobs.scheduler_pass(sites, orgs, scans, now).collect()}
    assert got == {
        3: (day(17), "weekly", None), 2: (day(11), "daily", None), 1: (day(11), "daily", "quota"), 4: (None, "manual", "plan"), 5: (None, "manual", "plan"), 9: (day(17), "weekly", "quota"),
    }
    few = jobs.scheduler_pass(sites, orgs, scans, now, batch=2)
    assert {r.site_id for r in few.collect()} == {4, 5}


def test_scheduler_runs_on_ticks(spark, tmp_path):
    passes = []
    empty = spark.createDataFrame([], "id int, org_id int, archived_at timestamp, next_scan_at timestamp, scan_frequency string")
    orgs = spark.createDataFrame([], "id int, plan string, trial_ends_at timestamp, subscription string, billing_status string")
    scans = spark.createDataFrame([], "org_id int, created_at timestamp")
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    query = jobs.scheduler(ticks, lambda: (empty, orgs, scans), lambda decisions: passes.append(decisions.count()), every="1 second").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            if passes:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert passes and set(passes) == {0}
