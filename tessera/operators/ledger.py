"""The issue ledger: open, resolve and reopen issues from one scan's findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import path_of

COLUMNS = ["site_id", "signature", "status", "first_seen_at", "last_seen_at", "resolved_at", "resolved_scan_id"]


def origin_paths(history: DataFrame) -> DataFrame:
    """The path of the greatest url that ever showed a signature, by site."""
    return history.groupBy("site_id", "signature").agg(path_of(F.max("page_url")).alias("origin"))


def reconcile(ledger: DataFrame, current: DataFrame, history: DataFrame, scan_pages: DataFrame, scan_id: str, now: Column) -> DataFrame:
    """The ledger after a scan, as a full outer join of state and findings.

    ``current(site_id, signature)``: the scan's findings. ``history(site_id,
    signature, page_url)``: findings of all scans. ``scan_pages(site_id, url,
    error)``: the pages of this scan. An issue that is gone is resolved only
    where its page was examined without error; decided issues keep their
    status; a resolved one that is back opens again.
    """
    now = now.cast("timestamp")
    seen = current.select("site_id", "signature").distinct().withColumn("seen", F.lit(True))
    crawled = scan_pages.where("error is null").select("site_id", path_of(F.col("url")).alias("origin")).distinct()
    covered = origin_paths(history).join(crawled, ["site_id", "origin"], "left_semi").select("site_id", "signature")
    covered = covered.withColumn("covered", F.lit(True))
    both = ledger.withColumn("known", F.lit(True)).join(seen, ["site_id", "signature"], "full")
    both = both.join(covered, ["site_id", "signature"], "left")
    known, here = F.col("known").isNotNull(), F.col("seen").isNotNull()
    closes = ~here & F.col("status").isin("open", "in_progress") & F.col("covered").isNotNull()
    reopens = here & (F.col("status") == "resolved")
    none_at, none_id = F.lit(None).cast("timestamp"), F.lit(None).cast("string")
    return both.select(
        "site_id",
        "signature",
        F.when(~known | reopens, "open").when(closes, "resolved").otherwise(F.col("status")).alias("status"),
        F.when(~known, now).otherwise(F.col("first_seen_at")).alias("first_seen_at"),
        F.when(here, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(reopens, none_at).when(closes, now).otherwise(F.col("resolved_at")).alias("resolved_at"),
        F.when(reopens, none_id).when(closes, scan_id).otherwise(F.col("resolved_scan_id")).alias("resolved_scan_id"),
    )


def decide(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """Applies the last decision of each issue; unknown statuses are ignored.

    ``decisions(site_id, signature, status, decided_at)``.
    """
    last = decisions.where(F.col("status").isin("open", "in_progress", "wontfix", "false_positive"))
    last = last.groupBy("site_id", "signature").agg(F.max_by("status", "decided_at").alias("decided"))
    return ledger.join(last, ["site_id", "signature"], "left").withColumn("status", F.coalesce("decided", "status")).select(*ledger.columns)


def status_counts(ledger: DataFrame, by: str = "site_id") -> DataFrame:
    """Counts of all five statuses, zeros included."""
    kinds = ("open", "in_progress", "resolved", "wontfix", "false_positive")
    return ledger.groupBy(by).agg(*(F.count_if(F.col("status") == k).alias(k) for k in kinds))


def days_to_fix(ledger: DataFrame, newest: int = 200) -> DataFrame:
    """The upper median of days between first sight and resolution, over the newest ones."""
    days = (F.unix_micros(F.col("resolved_at").cast("timestamp")) - F.unix_micros(F.col("first_seen_at").cast("timestamp"))) / 86_400e6
    rows = ledger.where("status = 'resolved' and resolved_at is not null").orderBy(F.desc("resolved_at"), "signature").limit(newest)
    rows = rows.agg(F.sort_array(F.collect_list(days)).alias("d"))
    middle = F.get("d", F.floor(F.size("d") / 2).cast("int"))
    return rows.select((F.floor(middle * 10 + 0.5) / 10).alias("median_days"))
