"""Jobs that follow streams: the ledger after each scan, scheduled scans, replays of progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scratch import scratch_path
from tessera.operators.reports import cadence_allowed, due_sites, effective_plan, next_run, plans
from tessera.sinks.records import event_frames
from tessera.sinks.store import Store
from tessera.streaming.state import latest_issues, ledger_changes, use_state_store

CHANGES = (
    "site_id string, signature string, status string, first_seen_at timestamp, last_seen_at timestamp, resolved_at timestamp,"
    " resolved_scan_id string, version long"
)


def keep_ledger(events: DataFrame, store: Store, buckets: int = 16):
    """A query that keeps the ledger of a stream of scanned pages, ends of scans and decisions.

    Each batch appends the changes of issues to the log ``ledger_changes``, once
    even if it runs again; nothing is rewritten. ``kept_ledger`` reads the log.
    """
    use_state_store(events.sparkSession)
    folder = f"{store.folder}/ledger_changes"
    return ledger_changes(events, buckets).writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", f"{store.folder}/ledger_state")


def kept_ledger(store: Store) -> DataFrame:
    return latest_issues(store.log("ledger_changes", CHANGES))


def run_to_end(rows: DataFrame, name: str) -> DataFrame:
    """The rows that a stream of final rows appends until its sources are read, written to the shared folder."""
    spark = rows.sparkSession
    folder = scratch_path(spark, name)
    query = rows.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def scheduler_pass(sites: DataFrame, orgs: DataFrame, scans: DataFrame, now: Column, batch: int = 20) -> DataFrame:
    """(site_id, org_id, next_scan_at, scan_frequency, skipped): what one pass decides for the sites that are due.

    ``sites(id, org_id, archived_at, next_scan_at, scan_frequency)``,
    ``orgs(id, plan, trial_ends_at, subscription, billing_status)``, ``scans(org_id,
    created_at)``. Every due site is rescheduled before anything else. A plan
    that no longer has the cadence makes the site manual (skipped: plan); an
    organisation that has used its month's scans waits (skipped: quota), where
    the scans that this pass starts count too. Without a reason a scan starts.
    """
    due = due_sites(sites, orgs, now, batch).select(F.col("id").alias("site_id"), "org_id", "next_scan_at", "scan_frequency")
    plan = effective_plan(F.col("plan"), F.col("trial_ends_at"), F.col("subscription"), F.col("billing_status"), now)
    held = orgs.select(F.col("id").alias("org_id"), plan.alias("plan"))
    month = F.date_trunc("month", now)
    used = scans.where(F.col("created_at") >= month).groupBy("org_id").agg(F.count("*").alias("used"))
    limits = F.broadcast(plans(sites.sparkSession).select("plan", "max_scans"))
    rows = due.join(held, "org_id").join(limits, "plan", "left").join(used, "org_id", "left")
    rows = rows.withColumn("fits", cadence_allowed(F.col("plan"), F.col("scan_frequency")))
    # the n-th fitting site of an organisation finds n - 1 scans of this pass before it
    nth = F.sum(F.col("fits").cast("int")).over(Window.partitionBy("org_id").orderBy("next_scan_at", "site_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("nth", nth)
    full = F.coalesce("used", F.lit(0)) + F.col("nth") - 1 >= F.col("max_scans")
    reason = F.when(~F.col("fits"), "plan").when(full, "quota")
    return rows.select(
        "site_id", "org_id", F.when(F.col("fits"), next_run(now, F.col("scan_frequency"))).alias("next_scan_at"),
        F.when(F.col("fits"), F.col("scan_frequency")).otherwise("manual").alias("scan_frequency"), reason.alias("skipped"),
    )


def scheduler(ticks: DataFrame, tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], act: Callable[[DataFrame], None], every: str = "60 seconds"):
    """A query that makes a pass at each tick of a stream (of the rate source, say); passes never overlap.

    ``tables`` reads sites, organisations and scans anew; ``act`` gets the
    decisions of a pass.
    """

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            act(scheduler_pass(*tables(), F.current_timestamp()))

    return ticks.writeStream.foreachBatch(run).trigger(processingTime=every)


def follow(spark: SparkSession, folder: str, schema: str, scan_id: str) -> DataFrame:
    """The events of one scan as a stream over its log, from the first one on: a late reader sees what was, then what comes."""
    return spark.readStream.schema(schema).parquet(folder).where(F.col("scan_id") == scan_id)


def handed_over(history: DataFrame, live: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Streams of events(scan_id, seq, at, ...): what a log holds and what comes live, each event once.

    An event that the log and the live stream both bring, as those do that
    happen while the log is read, is told by its scan and ``seq``. What is
    remembered of an event goes when the watermark has passed it by ``late``.
    """
    return history.unionByName(live).withWatermark("at", late).dropDuplicatesWithinWatermark(["scan_id", "seq"])


class FrameSink:
    """A ``foreachBatch`` function that sends one scan's events as frames, in the order of their numbers.

    A number follows the one before without a gap, so a frame that came early
    waits for those before it, and one that was sent is not sent again: not
    when a batch is repeated either. ``first`` is the number of the first event to be
    had. After an end event nothing is sent.
    """

    def __init__(self, send: Callable[[str], None], first: int = 1):
        self.send, self.next = send, first
        self.waiting: dict[int, tuple[str, bool]] = {}
        self.ended = False

    def __call__(self, batch: DataFrame, number: int) -> None:
        ends = batch.groupBy("scan_id", F.col("seq").cast("long").alias("seq")).agg(F.max(F.col("type") == "end").alias("end"))
        for r in event_frames(batch).join(ends, ["scan_id", "seq"]).orderBy("seq").toLocalIterator():
            if r.seq >= self.next:
                self.waiting[r.seq] = (r.frame, r.end)
            while self.next in self.waiting and not self.ended:
                frame, self.ended = self.waiting.pop(self.next)
                self.send(frame)
                self.next += 1
