"""Addresses that sites list themselves, from robots files and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import url_path
from tessera.operators.frontier import NO_PAGE, origin_of

# fixed values: where sitemaps lie, how many are tried, how large they may be
PLACES, MOST_TRIED, SITEMAP_BYTES, ROBOTS_BYTES = ("/sitemap.xml", "/sitemap_index.xml"), 5, 10_000_000, 512_000


def _locations(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), 1)


def sitemap_candidates(origins: DataFrame, responses: DataFrame) -> DataFrame:
    """(origin, tried, url): the sitemaps to read, those of the robots file first, the last named of them first."""
    robots = responses.where(F.octet_length("body") <= ROBOTS_BYTES).select("url", "body")
    named = F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1)
    rows = origins.select("origin").distinct().withColumn("url", F.concat("origin", F.lit("/robots.txt"))).join(robots, "url", "left")
    own = F.filter(F.coalesce(named, F.array().cast("array<string>")), lambda u: origin_of(u) == F.col("origin"))
    usual = F.array(*(F.concat("origin", F.lit(p)) for p in PLACES))
    tried = F.slice(F.concat(F.reverse(own), usual), 1, MOST_TRIED)
    return rows.select("origin", F.posexplode(tried).alias("tried", "url"))


def sitemap_urls(origins: DataFrame, responses: DataFrame, limit: int = 500) -> DataFrame:
    """(origin, url, place): pages that sitemaps list, in the order found, ``limit`` finds a site at most.

    ``responses(url, status, body)``. An index is followed one level deep, by
    one join of the listed sitemaps with the responses; each sitemap is read
    once. Only pages of the same origin count.
    """
    good = responses.where((F.col("status") < 400) & (F.octet_length("body") <= SITEMAP_BYTES)).select("url", "body")
    first = sitemap_candidates(origins, responses).groupBy("origin", "url").agg(F.min("tried").alias("tried"))
    top = first.join(good, "url").select("origin", "tried", "url", F.col("body").rlike("(?i)<sitemapindex").alias("index"), "body")
    listed = top.select("origin", "tried", "index", F.posexplode_outer(_locations(F.col("body"))).alias("i", "loc"))
    listed = listed.where(F.col("loc").isNotNull() & (origin_of(F.col("loc")) == F.col("origin")))
    own = listed.where("not index").select("origin", "tried", "i", F.lit(-1).alias("j"), "loc")
    below = listed.where("index").groupBy("origin", F.col("loc").alias("url")).agg(F.min(F.struct("tried", "i")).alias("at"))
    below = below.join(top.select("origin", "url"), ["origin", "url"], "left_anti")
    inner = below.join(good, "url").where(~F.col("body").rlike("(?i)<sitemapindex"))
    inner = inner.select("origin", "at.tried", "at.i", F.posexplode_outer(_locations(F.col("body"))).alias("j", "loc")).where("loc is not null")
    found = own.unionByName(inner.where(origin_of(F.col("loc")) == F.col("origin")))
    found = found.where(~url_path(F.col("loc")).rlike(NO_PAGE)).withColumn("url", F.split_part("loc", F.lit("#"), F.lit(1)))
    order = Window.partitionBy("origin").orderBy("tried", "i", "j")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return found.groupBy("origin", "url").agg(F.min("place").alias("place"))
