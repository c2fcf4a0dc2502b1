"""A crawl of many sites over stored responses, as an iterated dataflow."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.functions.scratch import materialise
from tessera.functions.text import path_shape, url_path
from tessera.operators.frontier import extract_links, origin_of, priority, robots_allowed
from tessera.sources.sheets import PAGE_BYTES, is_page

# fixed values: pages fetched at a time, and addresses remembered for each page of the budget
BATCH, REMEMBERED = 4, 20


def crawl(
    starts: DataFrame,
    responses: DataFrame,
    robots: DataFrame | None = None,
    listed: DataFrame | None = None,
    most_pages: int = 25,
    on_round: Callable[[dict], None] | None = None,
) -> DataFrame:
    """(site_id, url, position, status, html, error): the pages that a polite crawl of each site takes, in order.

    ``starts(site_id, url)``; ``responses(url, status, content_type, body)``
    stands for the network; ``robots(origin, ord, allow, prefix)`` are the
    rules, ``listed(site_id, url, place)`` what sitemaps name. All sites move
    at once: in each round a site ranks its queue anew by the shapes that it
    has covered and takes ``BATCH`` addresses; links that it has not seen
    join the queue. Rounds end when no queue can go on, after ``most_pages``
    at most for a crawl without refusals. The state is a table in shared
    storage, cut once a round; the driver sees one count.

    ``on_round`` gets the metrics of each round (round, pages, sites, errors,
    links), which Spark observes while it writes the round's pages and
    links. What it raises does not stop the crawl.
    """
    spark = starts.sparkSession
    # a later place is a later find; after a round the rank is the place, so ties keep their order
    queue = starts.select("site_id", "url", F.lit(0).cast("long").alias("place"))
    if listed is not None:
        queue = queue.unionByName(listed.select("site_id", "url", F.col("place").cast("long")).where("place > 0"))
    queue = queue.groupBy("site_id", "url").agg(F.min("place").alias("place"))
    known = materialise(queue.withColumn("state", F.lit("queued")), "crawl")
    pages = spark.createDataFrame([], known.select("site_id", "url").schema).withColumns(
        {"position": F.lit(0), "status": F.lit(0), "html": F.lit(""), "error": F.lit("")}
    )
    site = Window.partitionBy("site_id")
    rounds = 0
    while True:
        shapes = pages.groupBy("site_id", path_shape(F.col("url")).alias("shape")).agg(F.count("*").alias("times"))
        counts = pages.groupBy("site_id").agg(F.count("*").alias("taken"))
        waiting = known.where("state = 'queued'").withColumn("shape", path_shape(F.col("url"))).join(shapes, ["site_id", "shape"], "left")
        waiting = waiting.join(counts, "site_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
        waiting = waiting.where(F.col("taken") < most_pages).withColumn("rank", priority(F.col("url"), F.coalesce("times", F.lit(0))))
        ranked = waiting.withColumn("place", F.row_number().over(site.orderBy("rank", "place", "url")).cast("long"))
        ranked = materialise(ranked.select("site_id", "url", "place", "taken"), "crawl-ranked")
        batch = ranked.where(F.col("place") <= F.least(F.lit(BATCH), most_pages - F.col("taken")))
        if batch.isEmpty():
            return pages.orderBy("site_id", "position")
        visit = batch.withColumn("path", url_path(F.col("url"))).withColumn("origin", origin_of(F.col("url")))
        if robots is not None:
            visit = robots_allowed(visit, robots).where("allowed").drop("allowed")
        visit = visit.join(responses, "url", "left").where(F.col("status").isNull() | is_page(F.col("content_type")))
        large = F.octet_length("body") > PAGE_BYTES
        error = F.when(F.col("status").isNull(), "unreachable").when(large, "too large")
        order = F.row_number().over(site.orderBy("place"))
        taken = visit.select(
            "site_id", "url", (F.col("taken") + order).cast("int").alias("position"), F.col("status").cast("int").alias("status"),
            F.when(error.isNull(), F.col("body")).alias("html"), error.alias("error"),
        )
        watched = Observation()
        taken = taken.observe(
            watched, F.count("*").alias("pages"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.approx_count_distinct("site_id").alias("sites")
        )
        taken = materialise(taken, "crawl-pages")
        pages = pages.unionByName(taken)
        # links of this round that the site has not seen, in order of page and first mention
        source = taken.where("html is not null").select(F.struct("site_id", "position").alias("page_id"), "url", "html")
        links = extract_links(source, in_order=True).select("page_id.site_id", F.col("link").alias("url"), "page_id.position", "place")
        links = links.groupBy("site_id", "url").agg(F.min(F.struct("position", "place")).alias("at")).join(known.select("site_id", "url"), ["site_id", "url"], "left_anti")
        sizes = known.groupBy("site_id").agg(F.count("*").alias("seen"))
        fresh = links.join(sizes, "site_id").withColumn("n", F.row_number().over(site.orderBy("at", "url")))
        fresh = fresh.where(F.col("seen") + F.col("n") <= most_pages * REMEMBERED)
        fresh = fresh.select("site_id", "url", (F.lit(1 << 40) + F.col("n")).cast("long").alias("place"), F.lit("queued").alias("state"))
        moved = ranked.select("site_id", "url", F.col("place").alias("rank"))
        done = batch.select("site_id", "url", F.lit("done").alias("done"))
        old = known.join(moved, ["site_id", "url"], "left").join(done, ["site_id", "url"], "left")
        old = old.select("site_id", "url", F.coalesce("rank", "place").alias("place"), F.coalesce("done", "state").alias("state"))
        found = Observation()
        both = old.withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)))
        known = materialise(both.observe(found, F.count_if("fresh").alias("links")).drop("fresh"), "crawl")
        rounds += 1
        if on_round is not None:
            with contextlib.suppress(Exception):  # a listener must not stop a crawl
                on_round({"round": rounds, **watched.get, **found.get})
