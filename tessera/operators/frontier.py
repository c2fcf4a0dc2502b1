"""Links, robots rules and the order of a crawl over a given corpus."""

from __future__ import annotations

from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import path_shape, url_path

# fixed values: endings of addresses that are no pages
NO_PAGE = r"(?i)\.(pdf|zip|png|jpe?g|gif|svg|webp|avif|ico|css|js|mjs|json|xml|txt|mp[34]|webm|mov|avi|woff2?|ttf|eot|docx?|xlsx?|pptx?|gz|tar|dmg|exe)$"
# fixed values: pages that matter most
RISKY = r"(?i)(checkout|cart|payment|account|login|signup|register|contact|search|booking|apply)"
HREF = r"""(?i)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def raw_links(html: Column) -> Column:
    """Targets of the links in a page's source, in any of three quotings, distinct."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<a\b[^>]*>)"), 1)
    each = F.transform(tags, lambda t: F.concat(*(F.regexp_extract(t, HREF, i) for i in (1, 2, 3))))
    ok = F.filter(each, lambda u: (u != "") & ~u.rlike(r"(?i)^(#|mailto:|tel:|javascript:|data:)"))
    return F.array_distinct(ok)


def resolved(base: Column, link: Column, keep_fragment: bool = False) -> Column:
    """Absolute addresses, without fragments unless kept; null for bad ones. No built-in joins urls."""

    def join_all(bases: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([_join(b, u, keep_fragment) for b, u in zip(bases, links, strict=True)], dtype=object)

    return F.pandas_udf(join_all, "string")(base, link)


def _join(base: str, link: str, keep_fragment: bool) -> str | None:
    try:
        url = urljoin(base, link.strip())
        url = url if keep_fragment else urldefrag(url)[0]
        return url if urlsplit(url).netloc else None
    except (ValueError, AttributeError):
        return None


def origin_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+)", 1))


def same_origin(a: Column, b: Column) -> Column:
    return origin_of(a) == origin_of(b)


def extract_links(pages: DataFrame, in_order: bool = False) -> DataFrame:
    """(page_id, link): same-origin page links of every page, distinct; ``in_order`` adds the place of the first mention."""
    rows = pages.select("page_id", "url", F.posexplode_outer(raw_links(F.col("html"))).alias("place", "raw")).where("raw is not null")
    rows = rows.select("page_id", "url", "place", resolved(F.col("url"), F.col("raw")).alias("link"))
    is_page = same_origin(F.col("link"), F.col("url")) & ~url_path(F.col("link")).rlike(NO_PAGE)
    rows = rows.where(is_page)
    if in_order:
        return rows.groupBy("page_id", "link").agg(F.min("place").alias("place"))
    return rows.select("page_id", "link").distinct()


def priority(url: Column, times_seen: Column) -> Column:
    """Lower goes first: shallow paths and unseen shapes, then risky pages; bad urls last."""
    path = url_path(url)
    depth = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    score = depth * 10 + F.when(times_seen > 0, 200 + times_seen * 40).otherwise(0)
    score = score + F.when(url.rlike(r"\?[^#]"), 30).otherwise(0) - F.when(path.rlike(RISKY), 60).otherwise(0)
    score = score - F.when(depth == 0, 100).otherwise(0)
    return F.when(path == url, 1000).otherwise(score).cast("int")


def crawl_order(urls: DataFrame, budget: int | None = None) -> DataFrame:
    """(url, shape, priority, position) of a known set of urls(site_id, url, seq).

    Shapes already taken push later pages of the shape back, as a running
    count within (site, shape); ties go by ``seq``. With ``budget`` the first
    so many of each site.
    """
    shaped = urls.withColumn("shape", path_shape(F.col("url")))
    nth = F.row_number().over(Window.partitionBy("site_id", "shape").orderBy("seq", "url")) - 1
    ranked = shaped.withColumn("priority", priority(F.col("url"), nth))
    ranked = ranked.withColumn("position", F.row_number().over(Window.partitionBy("site_id").orderBy("priority", "seq", "url")))
    return ranked.where(F.col("position") <= budget) if budget else ranked


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(origin, ord, allow, prefix): the rules of each file's group for ``agent``.

    ``files(origin, body)``. A group starts at a user-agent line that follows a
    rule; the first group that names the agent holds, else the first for *.
    """
    lines = files.select("origin", F.posexplode_outer(F.split("body", "\n")).alias("ord", "raw"))
    line = F.trim(F.split_part("raw", F.lit("#"), F.lit(1)))
    lines = lines.select("origin", "ord", F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1)))).alias("field"), F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).alias("value"))
    lines = lines.where(F.col("field").isin("user-agent", "allow", "disallow"))
    by_file = Window.partitionBy("origin").orderBy("ord")
    is_agent = F.col("field") == "user-agent"
    starts = is_agent & ~F.coalesce(F.lag(is_agent).over(by_file), F.lit(False))
    lines = lines.withColumn("starts", starts).withColumn("grp", F.sum(F.col("starts").cast("int")).over(by_file))
    agents = lines.where(is_agent).withColumn("named", (F.col("value") != "*") & F.contains(F.lit(agent.lower()), F.lower("value")) & (F.col("value") != ""))
    chosen = agents.where("named or value = '*'").groupBy("origin").agg(F.coalesce(F.min(F.when(F.col("named"), F.col("grp"))), F.min(F.when(F.col("value") == "*", F.col("grp")))).alias("grp"))
    rules = lines.where(~is_agent & (F.col("value") != "")).join(chosen, ["origin", "grp"])
    return rules.select("origin", "ord", (F.col("field") == "allow").alias("allow"), F.replace("value", F.lit("*"), F.lit("")).alias("prefix"))


def robots_allowed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``paths(origin, path)`` with ``allowed``: the longest rule decides, the first of equal ones.

    A path meets rules as an equal key: it is cut to each length that a rule of
    its origin has, and a cut that is a rule's prefix hits it. An origin has as
    many lengths as its longest rule has characters, however many rules it has.
    """
    sized = rules.withColumn("size", F.length("prefix"))
    lengths = sized.groupBy("origin").agg(F.sort_array(F.collect_set("size")).alias("sizes"))
    wanted = paths.select("origin", "path").distinct().join(lengths, "origin")
    cuts = F.transform(F.filter("sizes", lambda n: n <= F.length("path")), lambda n: F.left("path", n))
    # of rules with one prefix the first counts
    first = sized.groupBy("origin", "prefix").agg(F.min_by("allow", "ord").alias("allow"))
    hits = wanted.select("origin", "path", F.explode(cuts).alias("prefix")).join(first, ["origin", "prefix"])
    best = hits.groupBy("origin", "path").agg(F.max_by("allow", F.length("prefix")).alias("allow"))
    return paths.join(best, ["origin", "path"], "left").select(*paths.columns, F.coalesce("allow", F.lit(True)).alias("allowed"))
