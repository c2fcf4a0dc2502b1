"""Keyed state over streams that are cut into batches, stopped and started again."""

import datetime as dt
import itertools
import random
import time
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import ledger as ledgers
from tessera.streaming import progress, state

names = itertools.count()


def day(n, hour=0):
    return dt.datetime(2024, 1, n, hour)


@pytest.fixture
def feed(spark, tmp_path):
    """Appends rows to a folder, and runs a query over what came since its last run; its state is kept between runs."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.use_state_store(spark)

    class Feed:
        folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")

        def put(self, schema, *rows):
            spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(self.folder)

        def stream(self, schema):
            return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(self.folder)

        def run(self, df, mode, ends=True, rows=None, seconds=60):
            """All rows of a run; a query with timers has no end, so it is stopped when nothing is left to read."""
            seen = []
            query = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", self.checkpoint)
            if ends:
                query.trigger(availableNow=True).start().awaitTermination(seconds)
                return seen
            query = query.trigger(processingTime="200 milliseconds").start()
            try:
                self.watch(query, seen, rows, seconds)
            finally:
                query.stop()
            return seen

        def watch(self, query, seen, rows, seconds):
            until = time.time() + seconds
            while time.time() < until and not (rows(query, seen) if rows else False):
                if query.exception():
                    raise query.exception()
                time.sleep(0.2)

    yield Feed()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


SCANNED = "site_id string, scan_id string, kind string, at timestamp, url string, error string, signatures array<string>, status string, pages long"


def page(site, scan, at, url, found=(), error=None):
    return (site, scan, "page", at, f"https://{site}.example{url}", error, list(found), None, None)


def end(site, scan, at, pages):
    return (site, scan, "end", at, None, None, None, None, pages)


def issues(changes):
    last = {}
    for r in changes:
        key = (r.site_id, r.signature)
        if key not in last or r.version > last[key].version:
            last[key] = r
    return {k: (r.status, r.first_seen_at, r.last_seen_at, r.resolved_at, r.resolved_scan_id) for k, r in last.items()}


def test_pages_of_a_scan_may_come_in_any_batch(spark, feed):
    run = lambda: feed.run(state.ledger_changes(feed.stream(SCANNED), 3), "append")
    feed.put(SCANNED, page("a", "s1", day(1), "/", "xy"))
    assert run() == []
    feed.put(SCANNED, end("a", "s1", day(1), 2))
    assert run() == []
    feed.put(SCANNED, page("a", "s1", day(1), "/shop", "z"))
    got = run()
    assert {r.signature: r.status for r in got} == {"x": "open", "y": "open", "z": "open"}
    # the end first, a repeated page, a page that failed, and a later scan that is whole before this one
    feed.put(SCANNED, end("a", "s2", day(2), 2), page("a", "s2", day(2), "/", "yw"))
    feed.put(SCANNED, page("a", "s3", day(3), "/", "xyw"), end("a", "s3", day(3), 1))
    got += run()
    assert len(got) == 3
    feed.put(SCANNED, page("a", "s2", day(2), "/", "yw"), page("a", "s2", day(2), "/shop", error="timeout"))
    got += run()
    found = issues(got)
    assert found[("a", "x")] == ("open", day(1), day(3), None, None)
    assert found[("a", "z")] == ("open", day(1), day(1), None, None)
    assert found[("a", "y")][2] == day(3) and found[("a", "w")][1:3] == (day(2), day(3))
    # rows of an applied scan once more change nothing
    feed.put(SCANNED, page("a", "s2", day(2), "/", "q"), end("a", "s2", day(2), 1))
    assert run() == []


def test_decisions_hold_and_failed_scans_change_nothing(spark, feed):
    run = lambda: feed.run(state.ledger_changes(feed.stream(SCANNED), 2), "append")
    feed.put(SCANNED, page("a", "s1", day(1), "/", "xyz"), end("a", "s1", day(1), 1))
    got = run()
    decide = lambda s, to: ("a", None, "decision", day(2), None, None, [s], to, None)
    feed.put(SCANNED, decide("x", "wontfix"), decide("y", "in_progress"), decide("y", "unknown"), decide("absent", "wontfix"))
    feed.put(SCANNED, page("a", "s2", day(3), "/", ""), end("a", "s2", day(3), None))
    got += run()
    assert {s: i[0] for (_, s), i in issues(got).items()} == {"x": "wontfix", "y": "in_progress", "z": "open"}
    feed.put(SCANNED, page("a", "s3", day(4), "/", ""), end("a", "s3", day(4), 1))
    got += run()
    assert {s: (i[0], i[4]) for (_, s), i in issues(got).items()} == {"x": ("wontfix", None), "y": ("resolved", "s3"), "z": ("resolved", "s3")}


def test_the_stream_equals_the_batch_ledger_after_each_scan(spark, feed):
    rng = random.Random(5)
    scans, events = [], []
    for k in range(1, 6):
        for site in "ab":
            pages = [(f"/p{i}", [f"{site}{rng.randrange(12)}" for _ in range(rng.randrange(4))], "timeout" if rng.random() < 0.2 else None) for i in range(4) if rng.random() < 0.8]
            pages = [(u, [] if e else f, e) for u, f, e in pages] or [("/p0", [], None)]
            scans.append((site, f"{site}{k}", day(k), pages))
            events += [page(site, f"{site}{k}", day(k), u, f, e) for u, f, e in pages] + [end(site, f"{site}{k}", day(k), len(pages))]
    # rows of neighbouring scans are mixed, but a scan begins before a later one ends
    order = sorted(range(len(events)), key=lambda i: i + rng.uniform(0, 6))
    for i in range(0, len(order), 9):
        feed.put(SCANNED, *(events[j] for j in order[i : i + 9]))
    got = issues(feed.run(state.ledger_changes(feed.stream(SCANNED), 2), "append", seconds=120))
    kept = spark.createDataFrame([], "site_id string, signature string, status string, first_seen_at timestamp, last_seen_at timestamp, resolved_at timestamp, resolved_scan_id string")
    history = []
    for site, scan, at, pages in scans:
        found = [(site, s, f"https://{site}.example{u}") for u, f, _ in pages for s in f]
        history += found
        kind = "site_id string, signature string, page_url string"
        crawled = spark.createDataFrame([(site, f"https://{site}.example{u}", e) for u, _, e in pages], "site_id string, url string, error string")
        known = kept.where(F.col("site_id") == site)
        new = ledgers.reconcile(known, spark.createDataFrame(found, kind), spark.createDataFrame([h for h in history if h[0] == site], kind), crawled, scan, F.lit(at))
        rows = [tuple(r) for r in kept.where(F.col("site_id") != site).union(new.select(*kept.columns)).collect()]
        kept = spark.createDataFrame(rows, kept.schema)
    assert got == {(r.site_id, r.signature): tuple(r)[2:] for r in kept.collect()}
    assert {s[0] for s in got.values()} == {"open", "resolved"}


TOLD = f"scan_id string, ts timestamp, {state.EVENT}"


def told(scan, second, number, kind, phase=None, url=None, pages=None, index=None, counts=(None,) * 4, found=None):
    return (scan, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second), number, kind, phase, url, pages, index, *counts, found)


def test_the_live_buffer_outlives_a_restart(spark, feed):
    have = lambda n: lambda q, seen: sum(r.scan_id == "a" for r in seen) >= n
    first = [told("a", 0, 1, "phase", "robots"), told("a", 1, 2, "plan", pages=9), told("a", 2, 3, "fetch", url="u1"), told("a", 3, 4, "page", index=1, counts=(5, 3, 1, 1)), told("b", 0, 90, "plan", pages=2)]
    feed.put(TOLD, *first)
    got = feed.run(state.live_buffer(feed.stream(TOLD), kept=5), "update", ends=False, rows=have(1))
    (a,) = [r for r in got if r.scan_id == "a"]
    assert tuple(a)[1:12] == (4, "robots", 9, 1, "u1", 5, 3, 1, 1, 0, False) and [k.seq for k in a.kept] == [1, 2, 3, 4]
    # an event that came before, and more than the buffer holds
    second = [told("a", 3, 4, "page", index=1, counts=(5, 3, 1, 1)), told("a", 4, 5, "discovered", found=7), told("a", 5, 6, "page", index=2, counts=(2, 2, 0, 0)), told("a", 6, 7, "fetch", url="u2")]
    feed.put(TOLD, *second)
    got = feed.run(state.live_buffer(feed.stream(TOLD), kept=5), "update", ends=False, rows=have(1))
    (a,) = [r for r in got if r.scan_id == "a"]
    assert tuple(a)[1:12] == (7, "starting", 0, 2, "u2", 7, 5, 1, 1, 7, False) and [(k.seq, k.event_id) for k in a.kept] == [(n, n) for n in range(3, 8)]
    whole = spark.createDataFrame([*first, *second[1:]], TOLD)
    kept = {(r.scan_id, r.event_id): r.seq for r in progress.numbered(whole).collect() if r.scan_id == "a"}
    assert {k: s for k, s in kept.items() if s > 2} == {("a", k.event_id): k.seq for k in a.kept}


def state_rows(query):
    last = query.lastProgress
    return sum(o.numRowsTotal for o in last.stateOperators) if last else None


def test_a_scan_is_forgotten_after_its_end(feed):
    feed.put(TOLD, told("a", 0, 1, "plan", pages=9), told("a", 1, 2, "end"))
    seen_rows = []

    def empty(query, seen):
        seen_rows.append(state_rows(query))
        return bool(seen) and seen_rows[-1] == 0

    got = feed.run(state.live_buffer(feed.stream(TOLD), expiry_ms=1500), "update", ends=False, rows=empty)
    assert got[0].phase == "complete" and got[0].ended and seen_rows[-1] == 0 and max(filter(None, seen_rows), default=0) > 0


def test_rate_limits_open_a_window_at_the_first_hit_and_go(feed):
    kind = "key string, ts timestamp"
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    feed.put(kind, ("k", at(0)), ("k", at(1)), ("k", at(2)), ("other", at(2)))
    feed.put(kind, ("k", at(2)), ("k", at(3)), ("k", at(4)))
    seen_rows = []

    def empty(query, seen):
        seen_rows.append(state_rows(query))
        return len(seen) == 7 and seen_rows[-1] == 0

    got = feed.run(state.rate_limit(feed.stream(kind), 2, 2.0), "append", ends=False, rows=empty)
    found = Counter((r.key, r.ts.second, r.allowed, r["count"], r.retry_after) for r in got)
    # a hit at the very end of a window is in it
    assert found == Counter([("k", 0, True, 1, 0.0), ("k", 1, True, 2, 0.0), ("k", 2, False, 3, 0.0), ("other", 2, True, 1, 0.0), ("k", 2, False, 4, 0.0), ("k", 3, True, 1, 0.0), ("k", 4, True, 2, 0.0)])
    assert seen_rows[-1] == 0 and max(filter(None, seen_rows), default=0) > 0


class Kept:
    """A state that counts what is written to it."""

    def __init__(self):
        self.values, self.writes = {}, 0

    def _write(self, key, value):
        self.values[key] = value
        self.writes += 1

    exists = lambda self: bool(self.values)
    get = lambda self: self.values[()] if () in self.values else []
    iterator = lambda self: iter(list(self.values.items()))
    containsKey = lambda self, key: key in self.values
    getValue = lambda self, key: self.values[key]
    updateValue = lambda self, key, value: self._write(key, value)
    update = lambda self, value: self._write((), value)
    put = lambda self, values: self._write((), values)
    clear = lambda self: self.values.clear()


def test_a_batch_writes_each_issue_and_its_waiting_rows_once():
    keeper = state.LedgerKeeper()
    keeper.issues, keeper.waiting, keeper.last = Kept(), Kept(), Kept()
    rows = []
    for scan in range(1, 5):
        own = ["a", "b"] if scan % 2 else ["b"]
        rows += [(str(scan), "page", f"u{k}", f"/u{k}", True, scan, own, None, None) for k in range(3)]
        rows.append((str(scan), "end", None, None, True, scan, None, None, 3 if scan < 4 else 5))  # two pages of the last are to come
    frame = pd.DataFrame(rows, columns=state.ROUTED)
    (out,) = keeper.handleInputRows(("s", 0), iter([frame]), None)
    assert keeper.issues.writes == 2 and len(keeper.waiting.get()) == 1 and len(keeper.waiting.get()[0][0]) == 4
    assert {(r.signature, r.status, r.last_seen, r.version) for r in out.itertuples()} == {("a", "open", 3, 3), ("b", "open", 3, 3)}
    more = pd.DataFrame([("4", "page", f"u{k}", f"/u{k}", True, 4, ["b"], None, None) for k in (3, 4)], columns=state.ROUTED)
    (out,) = keeper.handleInputRows(("s", 0), iter([more]), None)
    assert {(r.signature, r.status, r.resolved_scan_id, r.version) for r in out.itertuples()} == {("a", "resolved", "4", 4), ("b", "open", None, 4)}
