"""Analyses stored pages: ``python -m tessera PAGES [--fix] [--json] [--out FOLDER]``.

PAGES is a Parquet table of (page_id, url, html). A report goes to the screen,
with --json as one line a finding; with --out the findings, the scores, and with
--fix the patched pages and their diffs are written to tables in FOLDER. The
exit code is 0 without confirmed findings, 1 with some, 2 if the scan failed.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scratch import drop_scratch, materialise
from tessera.operators import remediation, reports, rules, scoring
from tessera.sinks.records import exit_code, json_lines
from tessera.sources.html import html_elements

SHOWN = 3


def analysed(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings, written down, and the scores of pages."""
    elements = materialise(html_elements(pages), "elements")
    found = materialise(rules.find_all(elements, pages), "findings")
    return found, scoring.page_results(pages, found)


def report(found: DataFrame, scores: DataFrame) -> list[str]:
    """A few lines: totals, the mean score, and each rule with its first findings."""
    total = scores.agg(F.count("*").alias("pages"), F.avg("score").alias("score"), F.sum("definite").alias("definite"), F.sum("review").alias("review")).first()
    out = [f"{total.pages} pages, score {total.score or 0:.0f}/100", f"{total.definite or 0} confirmed, {total.review or 0} to review", ""]
    title = {r.id: r.message for r in rules.RULES}
    for r in reports.grouped_findings(found, SHOWN).orderBy("place", "nth").toLocalIterator():
        if r.nth == 1:
            out.append(f"{r.rule_impact:<8} {title.get(r.rule_id, r.rule_id)} ({r['items']}x, {', '.join(r.wcag)})")
        out.append(f"  {r.url} line {r.line or '?'}  {r.snippet[:92]}")
        if r.nth == SHOWN < r["items"]:
            out.append(f"  and {r['items'] - SHOWN} more")
    return out


def main(args: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description="Accessibility report of stored pages")
    parser.add_argument("pages")
    parser.add_argument("--fix", action="store_true")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--out")
    options = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    try:
        pages = spark.read.parquet(options.pages).select("page_id", "url", "html")
        found, scores = analysed(pages)
        if options.json:
            for r in json_lines(found.orderBy("page_id", "node_id", "rule_id")).toLocalIterator():
                print(r[0])
        else:
            print("\n".join(report(found, scores)))
        if options.out:
            found.write.mode("overwrite").parquet(f"{options.out}/findings")
            scores.write.mode("overwrite").parquet(f"{options.out}/scores")
            if options.fix:
                remediation.remediation_plan(pages, found).write.mode("overwrite").parquet(f"{options.out}/plans")
        return exit_code(found)
    except Exception as e:
        print(f"scan failed: {str(e)[:500]}", file=sys.stderr)
        return 2
    finally:
        drop_scratch(spark)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
