"""Rendered pages: linked style sheets, and the choice between a browser's rendering and the plain source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.frontier import resolved, same_origin

# fixed values: what is read of a page and of its style sheets
MOST_SHEETS, SHEET_BYTES, PAGE_BYTES = 8, 2_000_000, 5_000_000
LINK = r"(?i)(<link\b[^>]*>)"
IS_SHEET = r"""(?i)rel\s*=\s*["']?[^"'>]*stylesheet"""
TARGET = r"""(?i)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s">]+))"""


def is_page(content_type: Column) -> Column:
    """Whether a response is an HTML page."""
    return F.coalesce(content_type.rlike("(?i)text/html|application/xhtml"), F.lit(False))


def fetched_pages(responses: DataFrame) -> DataFrame:
    """The pages among ``responses(url, status, content_type, body)``: HTML within the size limit."""
    ok = is_page(F.col("content_type")) & (F.octet_length("body") <= PAGE_BYTES)
    return responses.where(ok).select("url", "status", F.col("body").alias("html"))


def stylesheet_urls(pages: DataFrame) -> DataFrame:
    """(page_id, place, sheet): the first eight linked style sheets of a page's own origin, in order."""
    tags = F.filter(F.regexp_extract_all("html", F.lit(LINK), 1), lambda t: t.rlike(IS_SHEET))
    raw = F.transform(tags, lambda t: F.trim(F.concat(*(F.regexp_extract(t, TARGET, i) for i in (1, 2, 3)))))
    rows = pages.select("page_id", "url", F.posexplode_outer(raw).alias("place", "raw")).where("raw <> ''")
    rows = rows.withColumn("sheet", resolved(F.col("url"), F.col("raw"), keep_fragment=True)).where(same_origin(F.col("sheet"), F.col("url")))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("place"))
    return rows.withColumn("place", nth).where(F.col("place") <= MOST_SHEETS).select("page_id", "place", "sheet")


def with_linked_css(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """``pages`` with ``css``: the bodies of their linked sheets in order, one a line.

    ``responses(url, status, body)``. Sheets that failed, were not fetched or
    are too large count as empty. Each sheet is joined by its address, so
    shared ones are read once; a page's text is shuffled only by its own id, into
    a fixed number of partitions: parsing costs far more than the few bytes by
    which adaptive execution would put pages together.
    """
    sheets = responses.groupBy("url").agg(F.min_by("body", "status").alias("body"), F.min("status").alias("status"))
    ok = (F.col("status") < 400) & (F.octet_length("body") <= SHEET_BYTES)
    found = stylesheet_urls(pages).join(sheets, F.col("sheet") == sheets["url"], "left")
    found = found.select("page_id", F.struct("place", F.when(ok, F.col("body")).otherwise("").alias("body")).alias("x"))
    # eight sheets a page at most
    css = found.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["body"]), "\n").alias("css"))
    spark = pages.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return pages.repartition(parts, "page_id").join(css, "page_id", "left").withColumn("css", F.coalesce("css", F.lit("")))


def rendered(pages: DataFrame, browser: DataFrame | None) -> DataFrame:
    """(page_id, url, html, css, mode): a browser's rendering where there is one, else the source and its sheets.

    ``browser(page_id, url, html)``; a browser's styles come as measurements,
    so its pages have no linked css.
    """
    plain = pages.select("page_id", "url", "html", F.coalesce("css", F.lit("")).alias("css"))
    if browser is None:
        return plain.withColumn("mode", F.lit("static"))
    b = browser.where("html is not null").select("page_id", F.col("url").alias("b_url"), F.col("html").alias("b_html"))
    rows = plain.join(b, "page_id", "left")
    by = F.col("b_html").isNotNull()
    return rows.select(
        "page_id", F.coalesce("b_url", "url").alias("url"), F.coalesce("b_html", "html").alias("html"),
        F.when(by, "").otherwise(F.col("css")).alias("css"), F.when(by, "browser").otherwise("static").alias("mode"),
    )


def css_note(unreadable: Column) -> Column:
    """What to say of rules whose selectors are not evaluated; null where there are none."""
    return F.when(unreadable > 0, F.concat(unreadable.cast("string"), F.lit(" CSS rule(s) with selectors that are not evaluated may affect text contrast")))


def css_coverage(elements: DataFrame) -> DataFrame:
    """(page_id, unreadable, complete, note) of every page."""
    n = F.max(F.when(F.col("tag") == "html", F.col("facts")["unreadable"].cast("int")))
    rows = elements.groupBy("page_id").agg(F.coalesce(n, F.lit(0)).alias("unreadable"))
    return rows.select("page_id", "unreadable", (F.col("unreadable") == 0).alias("complete"), css_note(F.col("unreadable")).alias("note"))
