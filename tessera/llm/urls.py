"""URL filters: curated rules, and a path-template tree a host with labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
BROADCAST_ROWS = 200_000
MOST_RULES = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(rules: tuple[tuple[str, str], ...], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; ``MOST_RULES`` at most."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    # written from the shortest to the longest, so that the longest is asked first
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


STEPS = 20


def rate_step(lab: Column, bad: Column) -> Column:
    """A share of bad labels, smoothed by one of each kind, on a grid of equal standard errors: 0 to 31."""
    return F.round(F.asin(F.sqrt((bad + 1) / (lab + 2))) * STEPS).cast("int")


def merge_steps(steps: Column, z: float) -> Column:
    """(step, name) of groups of neighbouring steps of (step, lab, bad, low, high, n).

    A step joins the group before it when a two-proportion test, pooled with
    one good and one bad pseudo-label each, finds no difference at ``z``
    standard errors. A parent has 32 steps at most, so the fold is short
    however many branches there are; a group is named by its first and last
    branch and their number.
    """
    kind = "array<struct<lab:double,bad:double,low:string,high:string,n:bigint,steps:array<int>>>"

    def join(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        n1, n2 = last["lab"] + 2, s["lab"] + 2
        p1, p2 = (last["bad"] + 1) / n1, (s["bad"] + 1) / n2
        pool = (last["bad"] + s["bad"] + 2) / (n1 + n2)
        alike = F.abs(p1 - p2) <= z * F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
        alone = F.struct(s["lab"], s["bad"], s["low"], s["high"], s["n"], F.array(s["step"]))
        both = F.struct(
            last["lab"] + s["lab"], last["bad"] + s["bad"], F.least(last["low"], s["low"]), F.greatest(last["high"], s["high"]),
            last["n"] + s["n"], F.array_append(last["steps"], s["step"]),
        )
        one = lambda x: F.array(x).cast(kind)
        merged = F.concat(F.slice(acc, 1, F.size(acc) - 1), one(both))
        return F.when(F.size(acc) == 0, one(alone)).when(alike, merged).otherwise(F.concat(acc, one(alone)))

    groups = F.aggregate(steps, F.array().cast(kind), join)
    between = lambda g: F.when(g["n"] == 2, "|").otherwise(F.concat(F.lit("|.."), (g["n"] - 2).cast("string"), F.lit("..|")))
    name = lambda g: F.when(g["n"] == 1, g["low"]).otherwise(F.concat(F.lit("{"), g["low"], between(g), g["high"], F.lit("}")))
    return F.flatten(F.transform(groups, lambda g: F.transform(g["steps"], lambda s: F.struct(s.alias("step"), name(g).alias("name")))))


def sent(table: DataFrame) -> DataFrame:
    """A written table of a few short strings a row, marked for broadcast if it is small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def branch_names(counts: DataFrame, support: int, z: float) -> DataFrame:
    """(host, template, child, name) of the literal branches among (host, template, child, n, lab, bad).

    A segment is literal, whatever its share, when ``support`` urls of its
    branch have it, or ``support`` hosts have it at this level and it holds no
    digit; all others are variable. Literal siblings of ``support`` labels or
    more whose shares of bad labels do not differ get one name.
    """
    wide = counts.where(~F.col("child").rlike("[0-9]")).groupBy("child").agg(F.count_distinct("host").alias("hosts"))
    wide = sent(materialise(wide.where(F.col("hosts") >= support).select("child", F.lit(True).alias("wide")), "wide"))
    literal = counts.join(wide, "child", "left").where((F.col("n") >= support) | F.coalesce("wide", F.lit(False)))
    literal = literal.withColumn("step", F.when(F.col("lab") >= support, rate_step(F.col("lab"), F.col("bad"))))
    steps = literal.where("step is not null").groupBy("host", "template", "step").agg(
        F.sum("lab").alias("lab"), F.sum("bad").alias("bad"), F.min("child").alias("low"), F.max("child").alias("high"), F.count("*").alias("n")
    )
    steps = steps.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("step", "lab", "bad", "low", "high", "n"))).alias("steps"))
    names = steps.select("host", "template", F.explode_outer(merge_steps(F.col("steps"), z)).alias("g"))
    names = names.select("host", "template", F.col("g.step").alias("step"), F.col("g.name").alias("name"))
    found = literal.join(names, ["host", "template", "step"], "left")
    return found.select("host", "template", "child", F.coalesce("name", "child").alias("name"))


def shape_shares(stats: DataFrame, weight: float) -> DataFrame:
    """(shape, share, evidence): the share of bad labels of a shape over all hosts, and its labels.

    ``stats(shape, lab, bad)``. Each level of a shape is smoothed by ``weight``
    labels at the share of the level above it, the first by that of all urls;
    so a shape without labels stands at its parents' share.
    """
    shapes = stats.groupBy("shape").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    parts = F.split("shape", "/")
    ends = F.sequence(F.lit(1), F.size(parts))
    each = shapes.select("*", F.posexplode(F.transform(ends, lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("level", "node"))
    nodes = each.groupBy("level", "node").agg(F.sum("lab").alias("n_lab"), F.sum("bad").alias("n_bad"))
    chain = each.join(nodes, ["level", "node"]).groupBy("shape", "lab").agg(F.sort_array(F.collect_list(F.struct("level", "n_lab", "n_bad"))).alias("chain"))
    fold = F.aggregate("chain", F.lit(0.5), lambda p, x: (x["n_bad"] + p * F.when(x["level"] == 0, 2.0).otherwise(weight)) / (x["n_lab"] + F.when(x["level"] == 0, 2.0).otherwise(weight)))
    return chain.select("shape", fold.alias("share"), F.col("lab").alias("evidence"))


def url_filters(
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    depth: int = 4,
    support: int = 5,
    z: float = 1.645,
    weight: float = 5.0,
    reject: float = 0.6,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict, template, shape, purity) for every row.

    The urls that a rule fits carry its verdict and are the labelled ones.
    For each host a tree of path segments is grown ``depth`` levels deep
    (``branch_names``): variable segments become wildcards, literal siblings
    whose labels do not differ statistically become one branch. A template's
    purity is its share of blocked labels on the host, smoothed by ``weight``
    labels at the share of its shape (the template before merging) over all
    hosts, which backs off level by level (``shape_shares``). Urls that no
    rule fits are blocked where the purity is ``reject`` or above and their
    shape has ``support`` labels or more on any hosts; so a section without
    labels of its own is never blocked for what its neighbours hold.

    Rows are never shuffled while the branch tables are small (their size is
    checked); counts are combined before each shuffle, so a hot host is no
    hot task.

    Defined cases: a null url, or one without ``://``, has empty host and path,
    no rule, and shares one template; repeated rows count and are judged one
    by one; null ids pass through; an empty table gives no rows; other columns
    are ignored.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    rows = rows.withColumn("fit", longest_rule(rules, F.col("host"), F.col("path")))
    rows = rows.select(
        "id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("given"),
        F.split(F.regexp_replace("path", "^/", ""), "/").alias("segments"), F.lit("").alias("template"), F.lit("").alias("shape"),
    )
    lab = F.count("given").cast("double").alias("lab")
    bad = F.count(F.when(F.col("given") == "block", 1)).cast("double").alias("bad")

    for level in range(depth):
        rows = rows.withColumn("child", F.get("segments", F.lit(level)))
        counts = rows.where("child is not null").groupBy("host", "template", "child").agg(F.count("*").alias("n"), lab, bad)
        counts = materialise(counts, "branches")
        named = sent(materialise(branch_names(counts, support, z), "names"))
        rows = rows.join(named, ["host", "template", "child"], "left")
        step = lambda x: F.when(F.col("child").isNull(), "").otherwise(F.concat(F.lit("/"), F.coalesce(x, F.lit("*"))))
        literal = F.when(F.col("name").isNotNull(), F.col("child"))
        rows = rows.withColumns({"template": F.concat("template", step(F.col("name"))), "shape": F.concat("shape", step(literal))})
        rows = rows.drop("child", "name")

    deeper = F.when(F.size("segments") > depth, "/**").otherwise("")
    rows = rows.withColumns({"template": F.concat("template", deeper), "shape": F.concat("shape", deeper)}).drop("segments")
    stats = materialise(rows.groupBy("host", "template", "shape").agg(lab, bad), "templates")
    own = stats.groupBy("host", "template").agg(F.sum("lab").alias("own_lab"), F.sum("bad").alias("own_bad"))
    purity = stats.select("host", "template", "shape").join(own, ["host", "template"]).join(shape_shares(stats, weight), "shape")
    share = F.round((F.col("own_bad") + weight * F.col("share")) / (F.col("own_lab") + weight), 6)
    purity = sent(materialise(purity.select("host", "template", "shape", share.alias("purity"), "evidence"), "purity"))
    judged = rows.join(purity, ["host", "template", "shape"])
    blocks = (F.col("purity") >= reject) & (F.col("evidence") >= support)
    verdict = F.coalesce("given", F.when(blocks, "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "shape", "purity")
