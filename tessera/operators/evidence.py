"""What the evidence documents say: summaries of findings, criteria and the ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import escaped, long_date, plural
from tessera.operators.scoring import conformance

VERDICTS = {
    "supports": "Supports", "partial": "Partially Supports", "does_not": "Does Not Support", "manual": "Needs Manual Review",
    "not_evaluated": "Not Evaluated",
}


def outstanding(findings: DataFrame, limit: int = 8) -> DataFrame:
    """(rule_id, n, example, wcag): confirmed findings by rule, the most frequent first, each with its first occurrence."""
    first = F.struct("page_id", "node_id")
    rows = findings.where("tier = 'definite'").groupBy("rule_id").agg(
        F.count("*").alias("n"), F.min_by("css_path", first).alias("example"), F.array_join(F.min_by("wcag", first), ", ").alias("wcag")
    )
    return rows.orderBy(F.desc("n"), "rule_id").limit(limit)


def verdict_summary(criteria: DataFrame) -> DataFrame:
    """(level, supports, partial, does_not, manual, not_evaluated) of criteria(level, verdict); a null level sums all."""
    counts = [F.count_if(F.col("verdict") == text).alias(name) for name, text in VERDICTS.items()]
    return criteria.rollup("level").agg(*counts)


def remarks(criteria: DataFrame) -> DataFrame:
    """Criteria with a sentence on how each verdict came about."""
    c = F.col
    text = (
        F.when(c("verdict") == "Not Evaluated", "Needs a person; no rule tests it.")
        .when(c("verdict") == "Does Not Support", F.concat(plural(c("failures"), "confirmed failure"), F.lit(" found by rules.")))
        .when(c("verdict") == "Partially Supports", F.concat(plural(c("reviews"), "possible issue"), F.lit(" to be confirmed.")))
        .when(c("verdict") == "Supports", "No failures; rules test it in full.")
        .otherwise("No failures by rules, which test it in part only.")
    )
    return criteria.withColumn("remarks", text)


def resolved_issues(ledger: DataFrame, findings: DataFrame, newest: int = 200) -> DataFrame:
    """The newest resolved issues, each with the rule of its earliest finding.

    ``findings(site_id, signature, rule_id, message, created_at, id)``.
    """
    rows = ledger.where("status = 'resolved'").orderBy(F.desc("resolved_at"), "site_id", "signature").limit(newest)
    # the few issues go first, so only their findings are grouped
    few = findings.join(F.broadcast(rows.select("site_id", "signature")), ["site_id", "signature"], "left_semi")
    first = F.struct("created_at", "id")
    any_one = few.groupBy("site_id", "signature").agg(F.min_by("rule_id", first).alias("rule_id"), F.min_by("message", first).alias("message"))
    return rows.join(any_one, ["site_id", "signature"], "left")


def documents_of(documents: DataFrame, site: str) -> DataFrame:
    """A site's documents without their content, newest first."""
    rows = documents.where(F.col("site_id") == site)
    return rows.select("kind", "version", "content_hash", "created_at").orderBy(F.desc("created_at"), F.desc("version"), "kind")


def _table(rows: DataFrame, *columns: str) -> DataFrame:
    """(site_id, n, html): a site's rows as one HTML table; they are few by the caller's limits."""
    cells = F.concat(*(F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns))
    line = F.concat(F.lit("<tr>"), cells, F.lit("</tr>"))
    gathered = rows.groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("h")))).alias("x"))
    head = "<table><tr>" + "".join(f"<th scope='col'>{c}</th>" for c in columns) + "</tr>"
    return gathered.select("site_id", F.concat(F.lit(head), F.array_join(F.transform("x", lambda v: v["h"]), ""), F.lit("</table>")).alias("html"))


def _document(sites: DataFrame, title: str, body: DataFrame) -> DataFrame:
    rows = sites.select(F.col("id").alias("site_id"), "name", "day").join(body, "site_id", "left")
    heading = F.concat(F.lit(f"<h1>{title}: "), escaped(F.col("name")), F.lit("</h1><p>"), long_date(F.col("day")), F.lit("</p>"))
    return rows.select("site_id", F.concat(heading, F.coalesce("html", F.lit("<p>Nothing to report.</p>"))).alias("content"))


def statement(sites: DataFrame, findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """An accessibility statement a site: its most frequent confirmed findings."""
    from pyspark.sql import Window

    rows = findings.where("tier = 'definite'").groupBy("site_id", "rule_id").agg(F.count("*").alias("count"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("count"), "rule_id"))).where("place <= 8")
    return _document(sites, "Accessibility statement", _table(rows, "rule_id", "count"))


def report(sites: DataFrame, findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """A conformance report a site: the verdict and remark of every criterion."""
    rows = remarks(conformance(findings, sites.select(F.col("id").alias("site_id")), "site_id")).withColumn("place", F.col("criterion"))
    return _document(sites, "Conformance report", _table(rows, "criterion", "level", "verdict", "remarks"))


def record(sites: DataFrame, findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """A remediation record a site: its newest resolved issues."""
    from pyspark.sql import Window

    rows = ledger.where("status = 'resolved'")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("resolved_at"), "signature"))).where("place <= 200")
    return _document(sites, "Remediation record", _table(rows, "signature", "first_seen_at", "resolved_at"))


# kinds of documents by name; others may be added
BUILDERS: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {"statement": statement, "vpat": report, "remediation": record}


def generate(kind: str, sites: DataFrame, findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """(site_id, kind, content) for sites(id, name, day): documents of one kind."""
    if kind not in BUILDERS:
        raise ValueError(f"unknown kind of document: {kind}")
    return BUILDERS[kind](sites, findings, ledger).withColumn("kind", F.lit(kind)).select("site_id", "kind", "content")
