"""State kept by key over streams: the issue ledger, the live buffer of a scan, rate limits.

The processors run by ``transformWithState`` and need a state store that holds
several states a key: ``use_state_store`` sets it for a session.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessera.functions.text import path_of
from tessera.streaming.progress import KEPT, VERDICT

ROWS = 10_000  # of a frame that a processor gives out
SETTABLE = ("open", "in_progress", "wontfix", "false_positive")


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def frames(rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    for i in range(0, len(rows), ROWS):
        yield pd.DataFrame(rows[i : i + ROWS], columns=columns).astype(object)


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


# the ledger
ISSUE = "status string, first_seen long, last_seen long, resolved long, resolved_scan_id string, url string, path string, version long"
CHANGE = "site_id string, signature string, status string, first_seen long, last_seen long, resolved long, resolved_scan_id string, version long"
ROUTED = ["scan_id", "kind", "url", "path", "ok", "at", "signatures", "status", "pages"]
# the rows of a batch are one entry, as each entry of a state costs far more than its bytes
WAITING = "rows array<struct<scan_id:string,at:long,url:string,path:string,ok:boolean,signatures:array<string>,pages:long,ended:boolean>>"


class LedgerKeeper(StatefulProcessor):
    """The issues of one part of a site, and the rows of its scans that have not ended.

    A scan is applied when its end has come and as many different pages as the
    end tells, whatever batches they came in; an earlier scan of the site that
    has begun goes first. Rows of a scan that is not newer than the last one
    applied are repeats and change nothing.
    """

    def init(self, handle) -> None:
        self.issues = handle.getMapState("issues", "signature string", ISSUE)
        self.waiting = handle.getListState("waiting", WAITING)
        self.last = handle.getValueState("last", "at long, scan_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else None
        new, decisions = [], []
        for frame in rows:
            for scan_id, kind, url, path, ok, at, signatures, status, pages in frame[ROUTED].itertuples(index=False):
                own = [] if signatures is None else list(signatures)
                if kind == "decision":
                    decisions += [(at, s, status) for s in own if status in SETTABLE]
                elif last is None or (at, scan_id) > last:
                    expected = None if pages is None or pd.isna(pages) else int(pages)
                    new.append((scan_id, int(at), url, path, bool(ok), own, expected, kind == "end"))
        changes: dict[str, tuple] = {}
        for _, signature, status in sorted(decisions):
            if signature in changes or self.issues.containsKey((signature,)):
                issue = changes.get(signature) or tuple(self.issues.getValue((signature,)))
                self._put(changes, signature, (status, *issue[1:]))
        if new:
            self._apply_ended(new, changes)
        # each call of the state store is a message, so an issue is written once, whatever scans changed it
        for signature, issue in changes.items():
            self.issues.updateValue((signature,), issue)
        out = [(key[0], s, *i[:5], i[7]) for s, i in changes.items()]
        yield from frames(out, names(CHANGE))

    def _put(self, changes: dict[str, tuple], signature: str, issue: tuple) -> None:
        changes[signature] = (*issue[:7], issue[7] + 1)

    def _apply_ended(self, new: list[tuple], changes: dict[str, tuple]) -> None:
        if not any(r[7] for r in new) and not self.waiting.exists():
            self.waiting.appendValue((new,))  # nothing can end yet
            return
        by_scan: dict[tuple, list[tuple]] = {}
        for r in [*(tuple(r) for (rows,) in self.waiting.get() for r in rows), *new]:
            by_scan.setdefault((r[1], r[0]), []).append(r)
        known, done = None, None
        for at, scan_id in sorted(by_scan):
            rows = by_scan[(at, scan_id)]
            ends = [r for r in rows if r[7]]
            pages: dict[str, tuple[str, bool]] = {}
            for r in rows:
                if not r[7]:
                    pages[r[2]] = (r[3], bool(r[4] or pages.get(r[2], (None, False))[1]))
            if not ends or (ends[0][6] is not None and len(pages) < ends[0][6]):
                break
            del by_scan[(at, scan_id)]
            if ends[0][6] is not None:  # a failed scan changes nothing
                if known is None:
                    known = {k[0]: tuple(v) for k, v in self.issues.iterator()}
                known |= changes
                self._apply(scan_id, at, rows, {p for p, ok in pages.values() if ok}, known, changes)
            done = (at, scan_id)
        if done:
            self.last.update(done)
        self.waiting.put([([r for rows in by_scan.values() for r in rows],)]) if by_scan else self.waiting.clear()

    def _apply(self, scan_id: str, at: int, rows: list[tuple], crawled: set[str], known: dict[str, tuple], changes: dict[str, tuple]) -> None:
        """As ``operators.ledger.reconcile``, over this part of the site; ``known`` are its issues before the scan."""
        found: dict[str, tuple[str, str]] = {}
        for _, _, url, path, _, signatures, _, _ in rows:
            for s in signatures or ():
                found[s] = max(found.get(s, (url, path)), (url, path))
        for s, (url, path) in found.items():
            if s not in known:
                self._put(changes, s, ("open", at, at, None, None, url, path, 0))
                continue
            status, first, _, resolved, by, top, top_path, version = known[s]
            if status == "resolved":
                status, resolved, by = "open", None, None
            self._put(changes, s, (status, first, at, resolved, by, *max((top, top_path), (url, path)), version))
        for s, issue in known.items():
            if s not in found and issue[0] in ("open", "in_progress") and issue[6] in crawled:
                self._put(changes, s, ("resolved", *issue[1:3], at, scan_id, *issue[5:]))

    def close(self) -> None:
        pass


def ledger_changes(events: DataFrame, buckets: int = 16) -> DataFrame:
    """(site_id, signature, status, first_seen_at, last_seen_at, resolved_at, resolved_scan_id, version): each change of an issue.

    ``events(site_id, scan_id, kind, at, url, error, signatures, status, pages)``:
    pages of scans with the signatures found on them, the end of each scan with
    its number of pages (null if it failed), and decisions on signatures. All
    rows of a scan carry its time ``at``. A site is split into ``buckets`` parts
    by a hash of the signature, so a large site is no single task; pages and ends
    go to all parts. A batch gives the last change of an issue in it, with
    ``version`` counting an issue's changes: rows are appended, never rewritten.
    """
    part = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    rows = events.select("*", part.alias("part"))
    own = F.filter("signatures", lambda s: F.pmod(F.xxhash64(s), F.lit(buckets)) == F.col("part"))
    rows = rows.select(
        F.col("site_id").cast("string").alias("site_id"), "part", F.col("scan_id").cast("string").alias("scan_id"), "kind", "url", path_of(F.col("url")).alias("path"),
        F.col("error").isNull().alias("ok"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), own.alias("signatures"), "status", F.col("pages").cast("long").alias("pages"),
    ).where("kind <> 'decision' or size(signatures) > 0")
    found = rows.groupBy("site_id", "part").transformWithStateInPandas(LedgerKeeper(), CHANGE, "Append", "None")
    when = lambda c, name: F.timestamp_micros(c).alias(name)
    return found.select(
        "site_id", "signature", "status", when("first_seen", "first_seen_at"), when("last_seen", "last_seen_at"), when("resolved", "resolved_at"), "resolved_scan_id", "version"
    )


def latest_issues(changes: DataFrame) -> DataFrame:
    """The ledger after all ``changes``: the last version of each issue."""
    rest = [c for c in changes.columns if c not in ("site_id", "signature", "version")]
    last = changes.groupBy("site_id", "signature").agg(F.max_by(F.struct(*rest), "version").alias("i"))
    return last.select("site_id", "signature", "i.*")


# the live buffer
EVENT = "event_id long, type string, phase string, url string, pages long, page_index long, findings long, definite long, review long, advisory long, found long"
BUFFERED = f"seq long, {EVENT}"
LIVE = (
    "scan_id string, seq long, phase string, planned long, done long, url string, findings long, definite long, review long, advisory long, discovered long, ended boolean,"
    " kept array<struct<seq:long,event_id:long>>"
)
LIVE_NAMES = "scan_id seq phase planned done url findings definite review advisory discovered ended kept".split()


def fold(kept: list[tuple]) -> tuple:
    """What a viewer sees of a scan: the state after its retained events, in their order."""
    phase, planned, done, url, discovered, ended = "starting", 0, 0, None, 0, False
    sums = [0, 0, 0, 0]
    for _, _, kind, new_phase, at, pages, index, *counts, found in kept:
        if kind == "phase":
            phase = new_phase
        elif kind == "plan":
            planned = pages
        elif kind == "fetch":
            url = at
        elif kind == "discovered":
            discovered += found or 0
        elif kind == "page":
            done, sums = index, [a + (b or 0) for a, b in zip(sums, counts, strict=True)]
        elif kind == "end":
            phase, ended = "complete", True
    return phase, planned, done, url, *sums, discovered, ended


class LiveBuffer(StatefulProcessor):
    """Numbers the events of a scan, keeps the newest, and forgets the scan some time after its end."""

    def __init__(self, kept: int, expiry_ms: int | None):
        self.kept, self.expiry_ms = kept, expiry_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", BUFFERED)
        self.seq = handle.getValueState("seq", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.events.get()] if self.events.exists() else []
        seq = self.seq.get()[0] if self.seq.exists() else 0
        have = {r[1] for r in kept}
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        for r in frame[names(EVENT)].itertuples(index=False):
            values = tuple(None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else x for x in r)
            values = tuple(int(x) if isinstance(x, float) else x for x in values)
            if values[0] not in have:  # else it came again
                have.add(values[0])
                seq += 1
                kept.append((seq, *values))
        kept = kept[-self.kept :]
        self.events.put(kept)
        self.seq.update((seq,))
        state = fold(kept)
        if state[-1] and self.expiry_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expiry_ms)
        yield pd.DataFrame([(key[0], seq, *state, [{"seq": r[0], "event_id": r[1]} for r in kept])], columns=LIVE_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.events.clear()
        self.seq.clear()
        yield pd.DataFrame(columns=LIVE_NAMES)

    def close(self) -> None:
        pass


def live_buffer(events: DataFrame, kept: int = KEPT, expiry_ms: int | None = 60_000) -> DataFrame:
    """A row a scan and batch: its number of events, its state, and the ``kept`` newest events with their numbers.

    ``events(scan_id, ts, event_id, type, phase, url, pages, page_index, findings,
    definite, review, advisory, found)``; events of a batch are numbered by
    (ts, event_id), batches in their order, and an event that is still kept is not
    numbered again. Sums reach over the kept events only. ``expiry_ms`` after
    an end the scan is forgotten, by a timer; a query with timers has no end of
    its own, so None is for streams that are run to their ends. Rows replace
    earlier ones of their scan.
    """
    rows = events.select(F.col("scan_id").cast("string").alias("scan_id"), "ts", *names(EVENT))
    return rows.groupBy("scan_id").transformWithStateInPandas(LiveBuffer(kept, expiry_ms), LIVE, "Update", "None" if expiry_ms is None else "ProcessingTime")


# rate limits
class RateLimiter(StatefulProcessor):
    """Counts the hits of a key in a window that its first hit opens; the count goes when no hit has come for a window's time."""

    def __init__(self, limit: int, window_seconds: float):
        self.limit, self.seconds = limit, window_seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start double, count int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, count = self.window.get() if self.window.exists() else (None, 0)
        out = []
        for ts in pd.concat(list(rows)).ts.sort_values():
            now = ts.timestamp()
            if start is None or now > start + self.seconds:
                start, count = now, 0
            count += 1
            ok = count <= self.limit
            out.append((key[0], ts, ok, count, 0.0 if ok else float(math.ceil(start + self.seconds - now))))
        self.window.update((start, count))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + math.ceil(self.seconds * 1000))
        yield pd.DataFrame(out, columns=names(VERDICT))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        yield pd.DataFrame(columns=names(VERDICT))

    def close(self) -> None:
        pass


def rate_limit(hits: DataFrame, limit: int, window_seconds: float) -> DataFrame:
    """(key, ts, allowed, count, retry_after): a verdict on each of hits(key, ts).

    At most ``limit`` are allowed from the first hit until ``window_seconds`` after
    it; a refused one may come again after ``retry_after`` whole seconds. A key's
    state goes when it had no hit for ``window_seconds`` of processing time.
    """
    rows = hits.select(F.col("key").cast("string").alias("key"), "ts")
    return rows.groupBy("key").transformWithStateInPandas(RateLimiter(limit, window_seconds), VERDICT, "Append", "ProcessingTime")
