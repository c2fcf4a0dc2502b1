"""The rows that the engine writes: scans, pages, findings, events, requests, mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.operators.reports import with_names

# fixed values: how much of a page and of a public result is kept
KEPT_SOURCE, KEPT_FINDINGS = 800_000, 200
STATUSES = ("new", "contacted", "scoping", "quoted", "in_progress", "delivered", "closed")


def stable_id(*parts: Column) -> Column:
    """An id that a second run of the same write gives again."""
    return F.left(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), F.lit(32))


def scan_headers(sites: DataFrame, trigger: str, now: Column) -> DataFrame:
    """A queued scan for each of ``sites(id, org_id)``."""
    return sites.select(
        stable_id(F.col("id"), now).alias("id"), F.col("id").alias("site_id"), "org_id", F.lit("queued").alias("status"),
        F.lit(trigger).alias("trigger"), now.alias("created_at"),
    )


def scan_states(headers: DataFrame, log: DataFrame) -> DataFrame:
    """Scans as they stand after ``log(scan_id, status, at, pages, score, error)`` of their lives."""
    c = F.col
    last = log.groupBy("scan_id").agg(
        F.max_by("status", F.struct("at", c("status") != "running")).alias("now"),
        F.min(F.when(c("status") == "running", c("at"))).alias("started_at"),
        F.max(F.when(c("status").isin("complete", "failed"), c("at"))).alias("finished_at"),
        F.max_by("pages", F.when(c("pages").isNotNull(), c("at"))).alias("pages_scanned"),
        F.max_by("score", F.when(c("score").isNotNull(), c("at"))).alias("score"),
        F.max_by("error", F.when(c("error").isNotNull(), c("at"))).alias("error"),
    )
    rows = headers.join(last, c("id") == c("scan_id"), "left")
    return rows.select(
        *(F.coalesce("now", "status").alias("status") if x == "status" else c(x) for x in headers.columns),
        "started_at", "finished_at", "pages_scanned", "score", "error",
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """Rows of scanned pages; sources of ``KEPT_SOURCE`` characters or more are not kept."""
    failed = F.col("error").isNotNull() | F.coalesce(F.col("html") == "", F.lit(True))
    source = F.when(F.length("html") < KEPT_SOURCE, F.col("html"))
    return pages.select(
        stable_id(F.col("scan_id"), F.col("url")).alias("id"), "scan_id", "url", F.col("status").alias("status_code"),
        F.when(failed, F.coalesce("error", F.lit("no content"))).alias("error"),
        F.when(~failed, F.octet_length("html")).alias("bytes"), F.when(~failed, source).alias("html"),
    )


def finding_rows(findings: DataFrame, scan_id: Column, site_id: Column, now: Column) -> DataFrame:
    """Findings as they are stored: one bulk append a scan."""
    offsets = F.struct(F.col("start_off").alias("start"), F.col("end_off").alias("end"), F.col("elem_end_off").alias("elementEnd"))
    return findings.select(
        stable_id(scan_id, F.col("page_id"), F.col("node_id"), F.col("rule_id"), F.col("key")).alias("id"), scan_id.alias("scan_id"), site_id.alias("site_id"),
        "page_id", "rule_id", F.concat_ws(",", "wcag").alias("wcag"), "level", "impact", F.col("tier").alias("confidence"), "message",
        F.col("css_path").alias("selector"), "snippet", "line", "col", "signature", F.col("fix.strategy").alias("fix_kind"),
        F.to_json(F.struct("fix", offsets.alias("offsets"))).alias("fix_json"), now.alias("created_at"),
    )


def stored_findings(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Stored findings with their lists and fixes read again; malformed JSON gives nulls.

    ``titles(rule_id, title)``; a rule that is not known is its own title.
    """
    kind = "fix struct<strategy:string,attribute:string,value:string,tier:string,old:string,backdrop:string>, offsets struct<start:int,end:int,elementEnd:int>"
    extra = F.from_json(F.coalesce("fix_json", F.lit("{}")), kind)
    found = rows.withColumn("__x", extra).join(F.broadcast(titles.select("rule_id", F.col("title").alias("__title"))), "rule_id", "left")
    empty = F.array().cast("array<string>")
    new = {
        "wcag_list": F.when(F.coalesce("wcag", F.lit("")) == "", empty).otherwise(F.split("wcag", ",")),
        "title": F.coalesce("__title", "rule_id"), "fix": F.col("__x.fix"), "offsets": F.col("__x.offsets"),
    }
    if "ledger_status" in rows.columns:
        new["ledger_status"] = F.coalesce("ledger_status", F.lit("open"))
    return found.withColumns(new).drop("__x", "__title")


def event_rows(events: DataFrame, now: Column) -> DataFrame:
    """Events to append, with ``known``: unknown names are flagged, not dropped.

    ``events(name, org_id, user_id, props)`` with a map of properties.
    """
    names = events.sparkSession.createDataFrame([(n,) for n in fixed.EVENTS], "name string").withColumn("__known", F.lit(True))
    rows = events.join(F.broadcast(names), "name", "left")
    props = F.to_json(F.coalesce("props", F.create_map().cast("map<string,string>")))
    return rows.select(
        F.uuid().alias("id"), "org_id", "user_id", "name", props.alias("props_json"), F.coalesce("__known", F.lit(False)).alias("known"), now.alias("created_at")
    )


def public_scans(results: DataFrame, now: Column) -> DataFrame:
    """Public results(url, score, totals, findings, coverage): the first ``KEPT_FINDINGS`` findings, as JSON."""
    return results.select(
        stable_id(F.col("url"), now).alias("id"), "url", "score", F.to_json("totals").alias("totals_json"),
        F.to_json(F.slice("findings", 1, KEPT_FINDINGS)).alias("findings_json"), F.to_json("coverage").alias("coverage_json"), now.alias("created_at"),
    )


def service_requests(forms: DataFrame, now: Column) -> DataFrame:
    """New requests of forms(kind, contact_email, ...); those without an address are refused."""
    address = F.lower(F.trim("contact_email"))
    rows = forms.where(address != "").withColumn("contact_email", address)
    return rows.withColumns({"id": stable_id(F.col("kind"), F.col("contact_email"), now), "status": F.lit("new"), "created_at": now, "updated_at": F.lit(None).cast("timestamp")})


def unexpired(rows: DataFrame, now: Column, spared: Column | None = None) -> DataFrame:
    """Rows whose time is not over; ``spared`` ones stay for ever."""
    live = ~F.coalesce(F.col("expires_at") < now, F.lit(False))
    return rows.where(live if spared is None else live | spared)


def outbox_states(queued: DataFrame, log: DataFrame) -> DataFrame:
    """Mail(id, ...) with the last of its log(id, status, at, provider, error): queued, logged, sent or failed."""
    last = log.groupBy("id").agg(
        F.max_by("status", "at").alias("status"), F.max_by("provider", "at").alias("provider"), F.left(F.max_by("error", "at"), F.lit(400)).alias("error"),
        F.max(F.when(F.col("status").isin("logged", "sent"), F.col("at"))).alias("sent_at"),
    )
    return queued.join(last, "id", "left").withColumn("status", F.coalesce("status", F.lit("queued")))


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def exit_code(findings: DataFrame, failed: bool = False) -> int:
    """0 for no confirmed finding, 1 for some, 2 for a scan that failed."""
    return 2 if failed else int(not findings.where("tier = 'definite'").isEmpty())


def patch_text(plans: DataFrame) -> DataFrame:
    """(site_id, patch): the diffs of a site's pages, joined in order of their address."""
    parts = plans.where(F.coalesce(F.col("diff"), F.lit("")) != "").groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("url", "diff"))).alias("p"))
    return parts.select("site_id", F.array_join(F.transform("p", lambda x: x["diff"]), "\n").alias("patch"))


def event_frames(events: DataFrame, ended: DataFrame | None = None) -> DataFrame:
    """(scan_id, seq, frame): server-sent frames of progress events, in the order of ``seq``.

    A late reader of a scan in ``ended(scan_id, status)`` gets the history and one closing frame.
    """
    body = [c for c in events.columns if c not in ("scan_id", "seq")]
    frame = lambda x: F.concat(F.lit("data: "), x, F.lit("\n\n"))
    rows = events.select("scan_id", F.col("seq").cast("long").alias("seq"), frame(F.to_json(F.struct(*body))).alias("frame"))
    if ended is None:
        return rows
    last = events.groupBy("scan_id").agg(F.max("seq").cast("long").alias("seq"), F.max(F.col("type") == "end").alias("over"))
    close = ended.join(last, "scan_id", "left").where(~F.coalesce("over", F.lit(False)))
    end = frame(F.to_json(F.struct(F.lit("end").alias("type"), "status")))
    return rows.unionByName(close.select("scan_id", (F.coalesce("seq", F.lit(0)) + 1).alias("seq"), end.alias("frame")))


def recent(rows: DataFrame, limit: int = 100, **names: tuple[DataFrame, str]) -> DataFrame:
    """The newest rows by ``created_at``, each with the name of what it belongs to.

    ``names``: output column to (table(id, name), key column). The limit is
    taken before the joins, which keep every row.
    """
    return with_names(rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit), **names)


def numbered_documents(documents: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """New evidence documents(site_id, kind, content) with the next version of their site and kind, and a hash."""
    last = documents.groupBy("site_id", "kind").agg(F.max("version").alias("__last"))
    rows = new.join(last, ["site_id", "kind"], "left")
    nth = F.row_number().over(Window.partitionBy("site_id", "kind").orderBy("content"))
    return rows.withColumns(
        {"version": F.coalesce("__last", F.lit(0)) + nth, "content_hash": F.left(F.sha2("content", 256), F.lit(16)), "created_at": now}
    ).drop("__last")
