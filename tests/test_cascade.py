"""Selectors, the cascade and inheritance by joins, against the pass over one page."""

import random

import pytest

from tessera.functions.scratch import scratch_path
from tessera.operators import cascade
from tessera.sources import css
from tessera.sources.html import Document, html_elements

SHEET = """
p{color:#333;font-size:1.5em} .a{color:red !important} #x .a{color:blue} div > p.b{background:#eee url(x.png)} ul li{font-weight:700}
div p{font-size:120%} section .a.b, h2.a{background-color:rgba(0,0,0,0.5)} #y{color:hsl(120,50%,40%);font-size:12pt} a:hover{color:red}
@media screen{.c{color:inherit;background:transparent}} @media print{p{color:pink}} div section > p > b{color:nonsense} .d{font-size:large;font-weight:400}
* > em{color:#123456} div div .e{background:#ff0}
"""
TAGS = "div section p ul li h2 b em span".split()


def random_page(rng):
    def element(depth):
        tag = rng.choice(TAGS)
        attrs = ""
        if rng.random() < 0.5:
            attrs += f' class="{" ".join(rng.sample("abcde", rng.randrange(1, 3)))}"'
        if rng.random() < 0.1:
            attrs += f' id="{rng.choice("xy")}"'
        if rng.random() < 0.2:
            attrs += f' style="{rng.choice(["color:#abc", "color:#00f;color:GREEN", "font-size:2rem !important;font-size:9px", "background:#80808080", "color: rgb(1, 2, 3) !important", "font-weight:bolder;:x;y", "hidden"])}"'
        inner = "".join(element(depth + 1) for _ in range(rng.randrange(0, 4))) if depth < 6 else ""
        return f"<{tag}{attrs}>text {rng.randrange(9)}{inner}</{tag}>"

    return f"<style>{SHEET}</style>" + "".join(element(0) for _ in range(4))


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    rows = [(k, random_page(rng), None) for k in range(12)]
    rows += [(100, "<p class='n'>linked</p><style>.n{font-size:20px}</style>", ".n{color:#777;font-size:30px}"), (101, "<p>plain</p>", ""), (102, None, None), (103, "<p hidden style='color:red'>unseen</p><b style='color:red'>x</b>", None)]
    frame = spark.createDataFrame(rows, "page_id long, html string, css string")
    return {r[0]: r for r in rows}, html_elements(frame, css_col="css").cache()


def test_rules_select_the_same_elements(pages):
    rows, elements = pages
    got = {tuple(r) for r in cascade.matched(elements, cascade.sheet_rules(elements)).collect()}
    want = set()
    for k, html, linked in rows.values():
        if html:
            doc = Document(html)
            inline = "\n".join("".join(x for x in n.kids if isinstance(x, str)) for n in doc.nodes if n.tag == "style")
            rules, _ = css.parse_css("\n".join(filter(None, (linked, inline))))
            want |= {(k, n.number, r.order) for r in rules for n in doc.nodes if css.matches(n, r)}
    assert got == want and len(want) > 300


def test_text_looks_the_same(pages):
    rows, elements = pages
    got = {(r.page_id, r.node_id): (r.fg, r.bg, round(r.px, 6), r.bold) for r in cascade.text_looks(elements).collect()}
    facts = elements.where("facts['fg'] is not null").select("page_id", "node_id", "facts").collect()
    want = {(r.page_id, r.node_id): (r.facts["fg"], r.facts["bg"], round(float(r.facts["px"]), 6), r.facts["bold"] == "true") for r in facts}
    assert got == want and len({v for v in want.values()}) > 30


def test_nearest_ancestors(spark, pages):
    _, elements = pages
    got = {(r.page_id, r.node_id): r.list_id for r in cascade.nearest(elements.where("tag = 'b'").select("page_id", "node_id"), elements.where("tag in ('ul', 'div')"), "list_id").collect()}
    up = {(r.page_id, r.node_id): (r.parent_id, r.tag) for r in elements.collect()}

    def found(page, node):
        node = up[(page, node)][0]
        while node is not None and up[(page, node)][1] not in ("ul", "div"):
            node = up[(page, node)][0]
        return node

    assert got == {k: found(*k) for k, (_, tag) in up.items() if tag == "b"} and len(got) > 5
    assert elements.where("last_id < node_id").count() == 0


def test_sheets_are_parsed_once_by_several_tasks(spark):
    pages = spark.createDataFrame([(i, f"<style>.a{{color:#0000{i:02x}}}</style><p class=a>text") for i in range(40)], "page_id long, html string")
    elements = html_elements(pages)
    rules = cascade.sheet_rules(elements)
    assert rules.rdd.getNumPartitions() >= 4  # adaptive execution would put so few bytes into one
    elements.write.mode("overwrite").parquet(path := scratch_path(spark, "elements"))
    looks = cascade.text_looks(spark.read.parquet(path))
    assert "MapInArrow" not in looks._jdf.queryExecution().optimizedPlan().toString()
    assert {r.fg for r in looks.collect()} == {f"#0000{i:02x}" for i in range(40)}


def test_joins_sort_whatever_the_size_of_files(spark, pages):
    """Spark would broadcast such small inputs; files of pages that share their sheets are small too, but not what they hold."""
    _, elements = pages
    lists = elements.where("tag in ('ul', 'div')")
    for rows in (cascade.text_looks(elements), cascade.nearest(elements.where("tag = 'b'").select("page_id", "node_id"), lists)):
        assert rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
