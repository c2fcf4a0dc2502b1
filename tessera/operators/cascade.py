"""Style sheets against elements as joins: selectors, the cascade, and what text inherits.

An element's subtree are the elements from ``node_id`` to ``last_id``, so an
ancestor is a row whose interval holds the element's number. Everything
is joined by page, and within a page by a key or an interval. Joins sort: pages
share their sheets, so written rules and elements are small files, whose size tells
little of what a broadcast of them would hold on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessera.functions.color import parse_color
from tessera.functions.scratch import materialise
from tessera.sources import css

STEP = "struct<child:boolean,tag:string,ids:array<string>,classes:array<string>>"
RULES = f"ord int, weight array<int>, steps array<{STEP}>, decls array<struct<name:string,value:string,important:boolean>>"
PROPERTIES = ("color", "font-size", "font-weight", "background-color", "background")
NUMBER = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))"
c = F.col


def nearest(nodes: DataFrame, others: DataFrame, name: str = "ancestor_id") -> DataFrame:
    """``nodes(page_id, node_id)`` with the nearest of ``others(page_id, node_id, last_id)`` around each, where there is one."""
    o = others.select("page_id", c("node_id").alias("__from"), c("last_id").alias("__to"))
    found = nodes.select("page_id", "node_id").join(o.hint("merge"), "page_id").where((c("__from") < c("node_id")) & (c("__to") >= c("node_id")))
    return nodes.join(found.groupBy("page_id", "node_id").agg(F.max("__from").alias(name)).hint("merge"), ["page_id", "node_id"], "left")


def sheet_rules(elements: DataFrame) -> DataFrame:
    """(page_id, ord, weight, steps, decls): the rules of each page's style sheets, linked ones first.

    Selectors that are not evaluated are left out; steps go from right to left.
    Sheets are few bytes but costly to parse, so they lie in a fixed number of
    partitions, which adaptive execution does not put together.
    """
    spark = elements.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    sheets = elements.where("tag in ('html', 'style')").repartition(parts, "page_id").groupBy("page_id").agg(
        F.concat_ws(
            "\n",
            F.max(F.when(c("tag") == "html", F.nullif(c("facts")["linked"], F.lit("")))),
            F.transform(F.sort_array(F.collect_list(F.when(c("tag") == "style", F.struct("node_id", "own_text")))), lambda x: x["own_text"]),
        ).alias("css")
    )
    sheets = sheets.where("css <> ''")
    kind = sheets.schema["page_id"].dataType.simpleString()
    step = pa.struct([("child", pa.bool_()), ("tag", pa.string()), ("ids", pa.list_(pa.string())), ("classes", pa.list_(pa.string()))])
    decl = pa.struct([("name", pa.string()), ("value", pa.string()), ("important", pa.bool_())])
    kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(step), pa.list_(decl)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                rules = [r for r in css.parse_css(text)[0] if r.steps]
                columns = [
                    [r.order for r in rules],
                    [list(r.weight) for r in rules],
                    [[dict(zip(("child", "tag", "ids", "classes"), s, strict=True)) for s in r.steps] for r in rules],
                    [[{"name": n, "value": v, "important": i} for n, (v, i) in r.decls.items()] for r in rules],
                ]
                ids = pa.array([page.as_py()] * len(rules), b.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns, kinds)], ["page_id", "ord", "weight", "steps", "decls"])

    return sheets.mapInArrow(run, f"page_id {kind}, {RULES}")


def _shapes(elements: DataFrame) -> DataFrame:
    """Elements by each key that a selector's step may have: id, classes, tag, anything."""
    names = F.filter(F.split(F.coalesce(c("attrs")["class"], F.lit("")), r"\s+"), lambda x: x != "")
    rows = elements.select("page_id", "node_id", "parent_id", "last_id", "tag", c("attrs")["id"].alias("id"), names.alias("classes"))
    keys = F.concat(F.array(F.lit("*"), c("tag")), F.when(c("id") != "", F.array(F.concat(F.lit("#"), "id"))).otherwise(F.array()), F.transform("classes", lambda x: F.concat(F.lit("."), x)))
    return rows.select("*", F.explode(F.array_distinct(keys)).alias("key"))


def _key(step: Column) -> Column:
    by_id = F.when(F.size(step["ids"]) > 0, F.concat(F.lit("#"), F.get(step["ids"], 0)))
    by_class = F.when(F.size(step["classes"]) > 0, F.concat(F.lit("."), F.get(step["classes"], 0)))
    return F.coalesce(by_id, by_class, step["tag"], F.lit("*"))


def _fits(step: Column) -> Column:
    tag = step["tag"].isNull() | (step["tag"] == c("tag"))
    return tag & F.forall(step["ids"], lambda i: F.coalesce(i == c("id"), F.lit(False))) & (F.size(F.array_except(step["classes"], c("classes"))) == 0)


def matched(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, node_id, ord): the elements that each rule selects.

    Rules meet elements by the key of their rightmost step. Each further step
    moves on to the parent, or to the nearest element around that fits; a
    longer selector takes one more join, and the driver sees how long the longest is.
    """
    shapes = _shapes(elements)
    longest = rules.agg(F.max(F.size("steps"))).first()[0] or 0
    first = rules.select("page_id", "ord", "steps", F.get("steps", 0).alias("step")).withColumn("key", _key(c("step")))
    state = first.join(shapes.hint("merge"), ["page_id", "key"]).where(_fits(c("step"))).select("page_id", "node_id", "ord", "steps", c("node_id").alias("at"), c("parent_id").alias("up"))
    for k in range(1, longest):
        done, more = state.where(F.size("steps") <= k), state.where(F.size("steps") > k)
        more = more.withColumnRenamed("node_id", "of").withColumn("step", F.get("steps", k)).withColumn("key", _key(c("step")))
        around = more.join(shapes.hint("merge"), ["page_id", "key"]).where(
            F.when(c("step.child"), c("node_id") == c("up")).otherwise((c("node_id") < c("at")) & (c("last_id") >= c("at"))) & _fits(c("step"))
        )
        near = around.groupBy("page_id", "of", "ord").agg(F.max(F.struct("node_id", "parent_id")).alias("n"), F.first("steps").alias("steps"))
        state = done.unionByName(near.select("page_id", c("of").alias("node_id"), "ord", "steps", c("n.node_id").alias("at"), c("n.parent_id").alias("up")))
    return state.select("page_id", "node_id", "ord")


def declared(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, node_id, name, value): the declaration of each property that holds for an element.

    Important ones come before others, then those of heavier selectors, then
    later ones; an element's own come after those of sheets.
    """
    ranked = F.struct("important", F.get("weight", 0), F.get("weight", 1), F.get("weight", 2), "ord")
    sheets = matched(elements, rules).join(rules.select("page_id", "ord", "weight", F.explode("decls").alias("d")).hint("merge"), ["page_id", "ord"])
    sheets = sheets.select("page_id", "node_id", "ord", "weight", "d.name", "d.value", "d.important")
    chunks = elements.where(c("attrs")["style"].isNotNull()).select("page_id", "node_id", F.posexplode(F.split(c("attrs")["style"], ";")).alias("ord", "chunk"))
    raw = F.trim(F.regexp_extract("chunk", r"(?s)^[^:]*:(.*)$", 1))
    own = chunks.select(
        "page_id", "node_id", "ord", F.lower(F.trim(F.split_part("chunk", F.lit(":"), F.lit(1)))).alias("name"),
        F.trim(F.regexp_replace(raw, r"(?i)!important$", "")).alias("value"), raw.rlike(r"(?i)!important$").alias("important"), (raw != "").alias("said"),
    ).where("name <> '' and said")
    own = own.groupBy("page_id", "node_id", "name").agg(F.max_by(F.struct("value", "important", "ord"), "ord").alias("d"))
    top = F.array(*[F.lit(1 << 30)] * 3)
    own = own.select("page_id", "node_id", "d.ord", top.alias("weight"), "name", "d.value", "d.important")
    return sheets.unionByName(own).groupBy("page_id", "node_id", "name").agg(F.max_by("value", ranked).alias("value"))


RGBA = StructType([StructField(k, DoubleType()) for k in "rgba"])


@F.pandas_udf(RGBA)
def _color(values: pd.Series) -> pd.DataFrame:
    rows = [parse_color(v) or (None,) * 4 for v in values]
    return pd.DataFrame(rows, columns=list("rgba"), dtype="float64")


@F.pandas_udf(StringType())
def _layer(color: pd.Series, background: pd.Series) -> pd.Series:
    """The color of a background, from its own property or from the shorthand; null for none."""
    return pd.Series([css.backdrop_of({"background-color": a, "background": b or ""}) for a, b in zip(color, background, strict=True)], dtype="object")


def _size(value: Column, tag: Column) -> Column:
    """struct(scale, px): a size is ``scale`` times the inherited one, or ``px``; both null to inherit."""
    raw = F.lower(F.trim(value))
    words = F.create_map(*(F.lit(x) for kv in css.KEYWORD_PX.items() for x in (kv[0], float(kv[1]))))
    heads = F.create_map(*(F.lit(x) for kv in css.HEADING_PX.items() for x in (kv[0], float(kv[1]))))
    n = F.regexp_extract(raw, NUMBER, 1).try_cast("double")
    px = F.when(F.coalesce(value, F.lit("")) == "", heads[tag]).otherwise(
        F.coalesce(words[raw], F.when(raw.endswith("px"), n).when(raw.endswith("pt"), n * (96 / 72)).when(raw.endswith("rem"), n * 16).when(raw.endswith("em") | raw.endswith("%"), None).otherwise(n))
    )
    scale = F.when(raw.endswith("rem"), None).when(raw.endswith("em"), n).when(raw.endswith("%"), n / 100)
    return F.struct(scale.alias("scale"), px.alias("px"))


def text_looks(elements: DataFrame) -> DataFrame:
    """(page_id, node_id, fg, bg, px, bold): how text is seen, where colors are known, of elements with text of their own.

    Each such element meets the styled elements around it and itself, and folds
    their styles from the outside in: a color is taken on, a size may scale the one
    before, backgrounds are laid over each other. A background that cannot
    be read makes the colors of all text inside unknown.
    """
    # written down, as four joins read them and each would parse the sheets anew
    held = declared(elements, materialise(sheet_rules(elements), "sheet-rules")).where(c("name").isin(*PROPERTIES))
    style = held.groupBy("page_id", "node_id").agg(*(F.max(F.when(c("name") == p, c("value"))).alias(p) for p in PROPERTIES))
    bold_tags = [*css.HEADING_PX, "strong", "b"]
    places = elements.select("page_id", "node_id", "last_id", "tag")
    styled = places.join(style.hint("merge"), ["page_id", "node_id"], "left").where(c("tag").isin(bold_tags) | F.coalesce(*(c(f"`{p}`") for p in PROPERTIES)).isNotNull())
    weight = F.lower(F.trim(c("`font-weight`")))
    heavy = F.regexp_extract(weight, NUMBER, 1).try_cast("double") >= 700
    styled = styled.withColumn("layer", _layer(c("`background-color`"), F.coalesce("background", F.lit(""))))
    said = F.coalesce("color", F.lit("")) != ""
    styled = styled.select(
        "page_id", c("node_id").alias("at"), "last_id", said.alias("said"), _color("color").alias("color"), c("color").rlike("(?i)inherit|currentcolor").alias("keeps"),
        _size(c("`font-size`"), c("tag")).alias("size"),
        F.when(F.coalesce(weight, F.lit("")) != "", weight.isin("bold", "bolder") | F.coalesce(heavy, F.lit(False))).when(c("tag").isin(bold_tags), True).alias("bold"),
        (F.coalesce("layer", F.lit("")) != "").alias("painted"), _color("layer").alias("back"),
    )
    texts = elements.where("not hidden_deep and length(own_text) >= 2").select("page_id", "node_id")
    chain = texts.join(styled.hint("merge"), "page_id").where((c("at") <= c("node_id")) & (c("last_id") >= c("node_id")))
    parts = ["at", "said", "color", "keeps", "size", "bold", "painted", "back"]
    chain = chain.groupBy("page_id", "node_id").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("chain"))

    def over(top: Column, under: Column) -> Column:
        mix = [F.when(top["a"] >= 1, top[k]).otherwise(F.floor(top[k] * top["a"] + under[k] * (1 - top["a"]) + 0.5).cast("double")).alias(k) for k in "rgb"]
        return F.struct(*mix)

    def step(acc: Column, x: Column) -> Column:
        known_color = x["color"]["r"].isNotNull()
        color = F.when(~x["said"], acc["color"]).when(known_color, x["color"]).when(F.coalesce(x["keeps"], F.lit(False)), acc["color"])
        px = F.coalesce(x["size"]["scale"] * acc["px"], x["size"]["px"], acc["px"])
        lost = x["painted"] & x["back"]["r"].isNull()
        back = F.when(x["painted"] & (x["back"]["a"] > 0), over(x["back"], acc["back"])).otherwise(acc["back"])
        return F.struct(color.alias("color"), px.alias("px"), F.coalesce(x["bold"], acc["bold"]).alias("bold"), back.alias("back"), (acc["known"] & ~lost).alias("known"))

    white = F.struct(*(F.lit(255.0).alias(k) for k in "rgb"))
    none = F.lit(None).cast(RGBA)
    start = F.struct(none.alias("color"), F.lit(16.0).alias("px"), F.lit(False).alias("bold"), white.alias("back"), F.lit(True).alias("known"))
    look = chain.select("page_id", "node_id", F.aggregate("chain", start, step).alias("l")).where("l.known and l.color.r is not null")

    def spelled(color: Column) -> Column:
        return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(F.floor(color[k] + 0.5).cast("long")), 2, "0")) for k in "rgb"))

    return look.select("page_id", "node_id", spelled(over(c("l.color"), c("l.back"))).alias("fg"), spelled(c("l.back")).alias("bg"), c("l.px").alias("px"), c("l.bold").alias("bold"))
