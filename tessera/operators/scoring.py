"""Scores, totals, coverage and conformance of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.text import rounded

IMPACTS, TIERS = tuple(fixed.IMPACT_WEIGHT), tuple(fixed.TIER_TENTHS)


def _lookup(values: dict[str, int], column: Column, other: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), column), F.lit(other))


def penalty_tenths(impact: Column = F.col, tier: Column = F.col) -> Column:
    """Weight of a finding in tenths; whole numbers sum alike in any order."""
    impact = F.col("impact") if impact is F.col else impact
    tier = F.col("tier") if tier is F.col else tier
    return _lookup(fixed.IMPACT_WEIGHT, impact, 1) * _lookup(fixed.TIER_TENTHS, tier, 10)


def score_of(tenths: Column) -> Column:
    """100 for no penalty, falling towards 0."""
    value = rounded(100 / (1 + F.coalesce(tenths, F.lit(0)) / F.lit(200.0)))
    return F.least(F.greatest(value, F.lit(0)), F.lit(100))


def totals(findings: DataFrame, *by: str) -> DataFrame:
    """Totals, counts by impact and tier, and the score of each group."""
    return findings.groupBy(*by).agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col("impact") == x).alias(x) for x in IMPACTS),
        *(F.count_if(F.col("tier") == x).alias(x) for x in TIERS),
        score_of(F.sum(penalty_tenths())).alias("score"),
    )


def rule_map(findings: DataFrame, *by: str) -> DataFrame:
    """by_rule: a map of rule to count for each group; counted before it is gathered."""
    counts = findings.groupBy(*by, "rule_id").count()
    return counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule_id", "count")))).alias("by_rule"))


def criterion_map(findings: DataFrame, *by: str) -> DataFrame:
    """by_wcag: a finding counts once for each of its criteria."""
    counts = findings.select(*by, F.explode("wcag").alias("criterion")).groupBy(*by, "criterion").count()
    return counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("criterion", "count")))).alias("by_wcag"))


def page_results(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Totals and score of every page; pages without findings score 100."""
    sums = totals(findings, "page_id")
    counts = [c for c in sums.columns if c not in ("page_id", "score")]
    return pages.select("page_id", "url").join(sums, "page_id", "left").select(
        "page_id", "url", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("score", F.lit(100)).alias("score")
    )


def coverage(elements: DataFrame) -> DataFrame:
    """(page_id, mode, complete): how much of a page its markup shows."""
    c = F.col
    root = c("attrs")["id"].isin("root", "app", "__next", "__nuxt", "gatsby-focus-wrapper")
    page = elements.groupBy("page_id").agg(
        F.max(F.coalesce(c("facts")["chars"].cast("int"), F.lit(0))).alias("chars"),
        F.count("*").alias("elements"),
        F.max(F.coalesce(root, F.lit(False))).alias("shell"),
        F.max((c("tag") == "script") & c("attrs")["src"].isNotNull()).alias("scripts"),
    )
    mode = F.when((c("chars") < 200) & (c("elements") < 60) & (c("shell") | c("scripts")), "client-rendered")
    mode = mode.when(c("shell") & (c("chars") < 800), "partial").otherwise("static")
    return page.select("page_id", mode.alias("mode"), (mode == "static").alias("complete"))


def criterion_rules() -> list[tuple[str, str, str, list[str]]]:
    """(criterion, level, how far automated, rules): the crosswalk of criteria to rules."""
    return [(i, level, auto, rules.split()) for i, level, auto, rules in fixed.CRITERIA]


def criteria(spark: SparkSession) -> DataFrame:
    """(criterion, level, automated, rules) as a table."""
    return spark.createDataFrame(criterion_rules(), "criterion string, level string, automated string, rules array<string>")


def conformance(findings: DataFrame, groups: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """One row a criterion, or one a criterion and group: failures, open questions and the verdict.

    ``groups`` lists the values of ``by`` to judge; those without findings are judged too.
    """
    table = criteria(findings.sparkSession)
    keys = [by] if by else []
    counts = findings.groupBy(*keys, "rule_id").agg(
        F.count_if(F.col("tier") == "definite").alias("d"), F.count_if(F.col("tier") == "review").alias("r")
    )
    rules = table.select("criterion", "level", "automated", F.explode_outer("rules").alias("rule_id"))
    if by:
        names = F.array(*(F.lit(x[0]) for x in fixed.CRITERIA))
        rules = groups.select(by, F.explode(names).alias("criterion")).join(F.broadcast(rules), "criterion")
    rows = rules.join(counts, [*keys, "rule_id"], "left").groupBy(*keys, "criterion", "level", "automated").agg(
        F.coalesce(F.sum("d"), F.lit(0)).alias("failures"), F.coalesce(F.sum("r"), F.lit(0)).alias("reviews")
    )
    return rows.withColumn("verdict", verdict(F.col("automated"), F.col("failures"), F.col("reviews")))


def verdict(automated: Column, failures: Column, reviews: Column) -> Column:
    """What rules can say of a criterion; advisory findings never count."""
    return (
        F.when(automated == "none", "Not Evaluated")
        .when(failures > 0, "Does Not Support")
        .when(reviews > 0, "Partially Supports")
        .when(automated == "full", "Supports")
        .otherwise("Needs Manual Review")
    )


def coverage_stats(spark: SparkSession) -> DataFrame:
    """How many criteria are tested, and the share in whole percent."""
    t = criteria(spark).agg(
        F.count("*").alias("total"), *(F.count_if(F.col("automated") == x).alias(x) for x in ("full", "partial", "none"))
    )
    return t.withColumn("tested_percent", rounded((F.col("full") + F.col("partial")) * 100 / F.col("total")))
