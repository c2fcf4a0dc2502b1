"""Live progress of scans, and rate limits, as keyed state over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEPT = 400
SNAPSHOT = "scan_id string, seq long, phase string, planned long, done long, url string, findings long, ended boolean"
VERDICT = "key string, ts timestamp, allowed boolean, count int, retry_after double"


def snapshot(events: DataFrame) -> DataFrame:
    """The state of each scan from all its events(scan_id, seq, type, ...), as one grouping."""
    c = F.col
    return events.groupBy("scan_id").agg(
        F.max("seq").alias("seq"),
        F.max_by(F.when(c("type") == "phase", c("phase")), F.when(c("type") == "phase", c("seq"))).alias("phase"),
        F.max_by(F.when(c("type") == "plan", c("planned")), F.when(c("type") == "plan", c("seq"))).alias("planned"),
        F.count_if(c("type") == "page").alias("done"),
        F.max_by(F.when(c("url").isNotNull(), c("url")), F.when(c("url").isNotNull(), c("seq"))).alias("url"),
        F.coalesce(F.sum(F.when(c("type") == "page", c("findings"))), F.lit(0)).alias("findings"),
        F.max(c("type") == "end").alias("ended"),
    )


def percent_done(done, planned, site_pages):
    """Whole percent of the planned pages, 100 at most."""
    total = F.coalesce(planned, site_pages, F.lit(25))
    return F.least(F.lit(100), F.floor(done / total * 100 + 0.5)).cast("int")


def live_snapshots(events: DataFrame, expiry_ms: int = 60_000) -> DataFrame:
    """A row a scan and batch, folded from the events so far; state goes a minute after the end."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq, phase, planned, done, url, findings, ended = state.get if state.exists else (0, None, None, 0, None, 0, False)
        rows = pd.concat(list(frames)).sort_values("seq")
        for r in rows.itertuples():
            if r.seq <= seq:  # a replayed batch changes nothing
                continue
            seq = int(r.seq)
            phase = r.phase if r.type == "phase" else phase
            planned = int(r.planned) if r.type == "plan" else planned
            if r.type == "page":
                done, findings = done + 1, findings + int(r.findings or 0)
            url = r.url if isinstance(r.url, str) else url
            ended = ended or r.type == "end"
        state.update((seq, phase, planned, done, url, findings, ended))
        if ended:
            state.setTimeoutDuration(expiry_ms)
        yield pd.DataFrame([(key[0], seq, phase, planned, done, url, findings, ended)], columns=[c.split()[0] for c in SNAPSHOT.split(", ")])

    return events.groupBy("scan_id").applyInPandasWithState(
        fold, SNAPSHOT, SNAPSHOT.split(", ", 1)[1], "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def numbered(events: DataFrame) -> DataFrame:
    """The newest events of each scan, at most ``KEPT``, with a number that grows by one."""
    from pyspark.sql import Window

    by = Window.partitionBy("scan_id")
    rows = events.withColumn("seq", F.row_number().over(by.orderBy("ts", "event_id")))
    return rows.withColumn("last", F.max("seq").over(by)).where(F.col("seq") > F.col("last") - KEPT).drop("last")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of event kinds in fixed windows of event time, with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def trailing_funnel(events: DataFrame, stages: dict[str, str], days: int = 30, late: str = "1 day") -> DataFrame:
    """(until, a count for each stage, and what part of the one before came to it): windows of ``days`` days that move by a day.

    ``stages`` names the kind of event(ts, name) that counts for each column, in
    order. Each event falls into ``days`` windows; those that the watermark has
    passed are final. A share is in percent with one decimal, 0 after an empty stage.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = rows.groupBy(F.window("ts", f"{days} days", "1 day")).agg(*(F.count_if(F.col("name") == kind).alias(c) for c, kind in stages.items()))
    steps = list(stages)
    share = lambda a, b: F.when(F.col(a) > 0, F.floor(F.col(b) / F.col(a) * 1000 + 0.5) / 10).otherwise(0.0)
    shares = [share(a, b).alias(f"{a}_to_{b}") for a, b in zip(steps, steps[1:], strict=False)]
    return counts.select(F.col("window.end").alias("until"), *steps, *shares)
