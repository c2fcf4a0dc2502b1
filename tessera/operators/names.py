"""Accessible names as joins over elements and their runs of text.

Names from contents are put together from the inside out: each piece of text
climbs from the element that holds it to the elements around it, up to six
levels and no further than an element that hides or renames what it holds.
Elements meet by (page, number); only whole texts of labels, legends and the
like are found by interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scratch import materialise
from tessera.operators.cascade import nearest
from tessera.sources.html import NAMED_BY_CONTENT, UNSEEN

WHITE = r"(?U)[\s\x1C-\x1F]+"
LEVELS = 6
BUTTONS = ("submit", "button", "reset")
AT = ["page_id", "node_id"]
c = F.col


def stripped(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), rf"^{WHITE}|{WHITE}$", "")


def collapsed(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, WHITE, " "))


def _attr(name: str) -> Column:
    return F.coalesce(c("attrs")[name], F.lit(""))


def _kind() -> Column:
    return F.lower(F.when(_attr("type") == "", "text").otherwise(_attr("type")))


def _at(after: Column, holder: Column, nth: Column) -> Column:
    """A place that sorts by document order."""
    return F.struct(after.alias("after"), (-holder).alias("inner"), nth.alias("nth")).alias("at")


def _hides(hidden: bool) -> Column:
    unseen = c("tag").isin(*sorted(UNSEEN))
    return unseen if hidden else unseen | c("hidden")


def texts_of(elements: DataFrame, runs: DataFrame, targets: DataFrame, hidden: bool = False) -> DataFrame:
    """(page_id, node_id, text): the text of each of ``targets(page_id, node_id, last_id)``; images give their alternative.

    Scripts, heads and the like inside a target are left out, and hidden
    elements unless ``hidden``. A target without text has the empty one.
    """
    words = runs.select(*AT, _at(c("after"), c("node_id"), c("nth")), "text")
    images = elements.where((c("tag") == "img") & (_attr("alt") != ""))
    images = images.select(*AT, _at(c("node_id"), c("node_id"), F.lit(0)), F.concat(F.lit(" "), _attr("alt"), F.lit(" ")).alias("text"))
    pieces = words.unionByName(images)
    hides = elements.where(_hides(hidden)).select(*AT, "last_id")
    holders = nearest(pieces.select(*AT).distinct(), hides, "around").join(hides.select(*AT, F.lit(True).alias("own")), AT, "left")
    holders = holders.select(*AT, F.when(c("own"), c("node_id")).otherwise(F.coalesce("around", F.lit(-1))).alias("stop"))
    wanted = targets.select("page_id", c("node_id").alias("of"), "last_id").distinct()
    inside = wanted.join(holders, "page_id").where((c("node_id") >= c("of")) & (c("node_id") <= c("last_id")) & (c("stop") <= c("of")))
    whole = inside.select(*AT, "of").join(pieces, AT).groupBy("page_id", "of").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("xs"))
    whole = whole.select("page_id", "of", collapsed(F.array_join(F.transform("xs", lambda x: x["text"]), "")).alias("text"))
    return wanted.join(whole, ["page_id", "of"], "left").select("page_id", c("of").alias("node_id"), F.coalesce("text", F.lit("")).alias("text"))


def _referenced(elements: DataFrame) -> DataFrame:
    """(page_id, node_id, pos, target, last_id): elements that others name by their ids, the first of each id."""
    first = elements.where(_attr("id") != "").groupBy("page_id", _attr("id").alias("id"))
    first = first.agg(F.min(F.struct("node_id", "last_id")).alias("t")).select("page_id", "id", c("t.node_id").alias("target"), c("t.last_id").alias("last_id"))
    ids = elements.where(_attr("aria-labelledby") != "").select(*AT, F.posexplode(F.split(_attr("aria-labelledby"), WHITE)).alias("pos", "id"))
    return ids.join(first, ["page_id", "id"]).select(*AT, "pos", "target", "last_id")


def _children(elements: DataFrame) -> DataFrame:
    """Titles of graphics, legends of field sets and captions of tables, by their parents."""
    kids = elements.where("tag in ('title', 'legend', 'caption')").select("page_id", "node_id", "last_id", c("parent_id").alias("of"), c("tag").alias("part"))
    homes = elements.where("tag in ('svg', 'fieldset', 'table')").select("page_id", c("node_id").alias("of"), c("tag").alias("home"))
    fits = F.create_map(*(F.lit(x) for kv in {"svg": "title", "fieldset": "legend", "table": "caption"}.items() for x in kv))
    return kids.join(homes, ["page_id", "of"]).where(c("part") == fits[c("home")]).drop("home")


def _contents(elements: DataFrame, runs: DataFrame, said: DataFrame) -> DataFrame:
    """(page_id, node_id, contents): names from contents; ``said(page_id, node_id, names, titles)`` are referenced texts and graphics' titles."""
    rows = elements.join(said, AT, "left")
    kind = _kind()
    part = (
        F.when(F.size(F.coalesce("names", F.array().cast("array<string>"))) > 0, F.array_join("names", " "))
        .when(stripped(c("attrs")["aria-label"]) != "", stripped(c("attrs")["aria-label"]))
        .when(c("tag").isin("img", "area"), _attr("alt"))
        .when(c("tag") == "svg", F.coalesce(F.array_join("titles", " "), F.lit("")))
        .when(c("tag") == "input", F.when(kind.isin(*BUTTONS), _attr("value")).otherwise(""))
    )
    rows = materialise(rows.select(*AT, "parent_id", "tag", _hides(False).alias("hides"), part.alias("part")), "name-parts")
    ups = rows.select(*AT, F.when(~c("hides") & c("part").isNull(), c("parent_id")).alias("up"))
    # what each element's pieces reach: itself and the next ones around it
    reach = ups.select(*AT, F.array("node_id").alias("reach"), "up")
    above = ups.select("page_id", c("node_id").alias("up"), c("up").alias("next"))
    for _ in range(LEVELS - 1):
        reach = reach.join(above, ["page_id", "up"], "left").select(
            *AT, F.when(c("up").isNotNull(), F.concat("reach", F.array("up"))).otherwise(c("reach")).alias("reach"), c("next").alias("up")
        )
    words = runs.select(*AT, _at(c("after"), c("node_id"), c("nth")), "text")
    leaves = rows.where("not hides and part is not null and parent_id is not null")
    leaves = leaves.select("page_id", c("parent_id").alias("node_id"), _at(c("node_id"), c("node_id"), F.lit(0)), c("part").alias("text"))
    met = words.unionByName(leaves).join(reach.select(*AT, "reach"), AT).select("page_id", F.explode("reach").alias("node_id"), "at", "text")
    named = rows.where(c("tag").isin(*sorted(NAMED_BY_CONTENT))).select(*AT)
    whole = met.join(named, AT, "left_semi").groupBy(*AT).agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("xs"))
    return whole.select(*AT, collapsed(F.array_join(F.transform("xs", lambda x: x["text"]), " ")).alias("contents"))


def accessible_names(elements: DataFrame, runs: DataFrame) -> DataFrame:
    """(page_id, node_id, acc_name, acc_source): each element's accessible name and where it comes from.

    ``elements`` and ``runs`` (``html.text_runs``) are of the same pages and are
    read several times, so written tables serve best; texts that several steps use are
    written down. It gives what the pass over one page gives. Elements without a
    name have an empty one and a null source.
    """
    refs = _referenced(elements)
    kids = _children(elements)
    labels = elements.where("tag = 'label'").select(*AT, "last_id", _attr("for").alias("for"))
    fields = elements.where("tag in ('input', 'select', 'textarea')").select(*AT, _attr("id").alias("id"))

    whole = refs.select("page_id", c("target").alias("node_id"), "last_id").unionByName(labels.select(*AT, "last_id"))
    whole = texts_of(elements, runs, whole.unionByName(kids.where("part = 'title'").select(*AT, "last_id")), hidden=True)
    whole = materialise(whole, "label-texts")
    seen = texts_of(elements, runs, kids.where("part <> 'title'").select(*AT, "last_id"))

    told = refs.join(whole.withColumnRenamed("node_id", "target"), ["page_id", "target"])
    told = told.groupBy(*AT).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("names"))
    parts = kids.join(whole.unionByName(seen).distinct(), AT)
    parts = parts.groupBy("page_id", c("of").alias("node_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]).alias("titles"))
    said = materialise(told.join(parts, AT, "full_outer"), "told-names")

    by_for = labels.where("for <> ''").groupBy("page_id", c("for").alias("id")).agg(F.min("node_id").alias("label"))
    texts = whole.select("page_id", c("node_id").alias("label"), "text")
    by_for = fields.join(by_for, ["page_id", "id"]).join(texts, ["page_id", "label"]).select(*AT, c("text").alias("label_for"))
    wraps = nearest(fields, labels, "label").join(texts, ["page_id", "label"]).select(*AT, c("text").alias("label_wrap"))

    rows = elements.select(*AT, "tag", "attrs").join(said, AT, "left").join(by_for, AT, "left").join(wraps, AT, "left")
    rows = rows.join(_contents(elements, runs, said), AT, "left")
    tag, kind, one = c("tag"), _kind(), F.get("titles", 0)
    button, field = (tag == "input") & kind.isin(*BUTTONS), tag.isin("input", "select", "textarea")
    names = F.array_join(F.filter("names", lambda x: x != ""), " ")
    some = lambda value: F.coalesce(value, F.lit("")) != ""
    ways = [
        (some(names), names, "aria-labelledby"),
        (stripped(c("attrs")["aria-label"]) != "", stripped(c("attrs")["aria-label"]), "aria-label"),
        (tag.isin("img", "area") & c("attrs")["alt"].isNotNull(), stripped(c("attrs")["alt"]), "alt"),
        (button & (stripped(c("attrs")["value"]) != ""), stripped(c("attrs")["value"]), "value"),
        (button & (kind != "button"), F.initcap(kind), "implicit"),
        ((tag == "input") & (kind == "image") & (stripped(c("attrs")["alt"]) != ""), stripped(c("attrs")["alt"]), "alt"),
        (field & some(c("label_for")), c("label_for"), "label-for"),
        (field & some(c("label_wrap")), c("label_wrap"), "label-wrap"),
        ((tag == "svg") & some(one), one, "svg-title"),
        ((tag == "fieldset") & one.isNotNull(), one, "legend"),
        ((tag == "table") & one.isNotNull(), one, "caption"),
        (some(c("contents")), c("contents"), "contents"),
        (stripped(c("attrs")["title"]) != "", stripped(c("attrs")["title"]), "title"),
    ]
    name, source = F.lit(None).cast("string"), F.lit(None).cast("string")
    for holds, value, way in reversed(ways):
        holds = F.coalesce(holds, F.lit(False))
        name, source = F.when(holds, value).otherwise(name), F.when(holds, F.lit(way)).otherwise(source)
    return rows.select(*AT, F.coalesce(name, F.lit("")).alias("acc_name"), source.alias("acc_source"))
