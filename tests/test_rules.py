"""Each rule on a page that it reports and on one that it does not."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import color
from tessera.operators import rules
from tessera.sources import sheets
from tessera.sources.html import html_elements

# rule: (body or whole page that is reported, one that is not)
CASES = {
    "img-alt": ('<img src="x.png">', '<img src="x.png" alt=""><img role="none" src="y.png"><img aria-label="z" src="z.png"><img hidden src="h.png">'),
    "img-alt-placeholder": ('<img alt="photo 12" src="x">', '<img alt="Two swans" src="x"><img alt="" src="y">'),
    "svg-name": ('<svg role="img"></svg>', '<svg role="img"><title>Chart</title></svg><svg></svg>'),
    "button-name": ("<button></button>", '<button>Go</button><input type="submit"><button aria-label="x"></button>'),
    "link-name": ('<a href="/x"></a>', '<a href="/x">Prices</a><a></a>'),
    "link-generic-text": ('<a href="/x">Click here</a>', '<a href="/x">Our prices</a><a href="/y" aria-label="Our team">more</a>'),
    "input-label": ('<input type="text">', '<label>Name <input type="text"></label><input type="hidden"><input type="submit">'),
    "label-orphan": ('<label for="gone">Name</label>', '<label for="n">Name</label><input id="n"><label for="gone" hidden>x</label>'),
    "frame-title": ('<iframe src="/x"></iframe>', '<iframe src="/x" title="Map"></iframe>'),
    "nested-interactive": ('<a href="/x"><button>b</button></a>', '<a href="/x">t</a><button>b</button>'),
    "html-has-lang": ("<html><body></body></html>", '<html lang="en"><body></body></html>'),
    "html-lang-valid": ('<html lang="english!"><body></body></html>', '<html lang="en-GB"><body></body></html>'),
    "document-title": ("<html><head><title> </title></head><body></body></html>", "<html><head><title>Shop</title></head><body></body></html>"),
    "page-has-h1": ("<h2>x</h2>", "<h1>x</h1>"),
    "heading-order": ("<h1>a</h1><h3>b</h3>", '<h1>a</h1><h2>b</h2><h3>c</h3><h1>d</h1><h5 hidden>x</h5>'),
    "empty-heading": ("<h2></h2>", "<h2>x</h2>"),
    "duplicate-id": ('<p id="a">x</p><p id="a">y</p>', '<p id="a">x</p><p id="b">y</p>'),
    "list-structure": ("<ul><div>x</div></ul>", "<ul><li>x</li></ul>"),
    "table-headers": ("<table><tr><td>a</td></tr><tr><td>b</td></tr></table>", "<table><tr><th>a</th></tr><tr><td>b</td></tr></table><table><tr><td>one row</td></tr></table>"),
    "landmark-main": ("<p>x</p>", "<main>x</main>"),
    "landmark-unique": ("<nav>a</nav><nav>b</nav>", '<nav aria-label="a">a</nav><nav aria-label="b">b</nav>'),
    "skip-link": ("<nav>x</nav>", '<a href="#m"><span hidden>Skip to content</span></a><nav>x</nav>'),
    "tabindex-positive": ('<p tabindex="3">x</p>', '<p tabindex="0">x</p><p tabindex="-1">y</p>'),
    "aria-hidden-focusable": ('<div aria-hidden="true"><button>x</button></div>', '<div aria-hidden="true"><p>x</p></div>'),
    "aria-valid-role": ('<div role="fancy">x</div>', '<div role="button">x</div>'),
    "aria-valid-attr": ('<div aria-labell="x">y</div>', '<div aria-label="x">y</div>'),
    "aria-required-attr": ('<div role="slider">x</div>', '<div role="slider" aria-valuenow="2">x</div><input type="checkbox" role="checkbox" aria-checked="true"><div role="none checkbox">t</div>'),
    "meta-viewport-zoom": ('<meta name="viewport" content="user-scalable=no">', '<meta name="viewport" content="width=device-width, maximum-scale=5">'),
    "meta-refresh": ('<meta http-equiv="refresh" content="5;url=/x">', '<meta http-equiv="content-type" content="text/html">'),
    "autoplay-media": ('<video autoplay src="v"></video>', '<video autoplay muted src="v"></video>'),
    "video-captions": ('<video src="v"></video>', '<video src="v"><track kind="captions" src="t"></video>'),
    "blink-marquee": ("<marquee>x</marquee>", "<p>x</p>"),
    "color-contrast": ('<p style="color:#bbb">pale words</p>', '<p style="color:#222">dark words</p>'),
    "focus-not-obscured": ("<style>a:focus{outline:none}</style>", "<style>a:focus{outline:none;box-shadow:0 0 2px red}</style>"),
    "click-handler-no-keyboard": ('<div onclick="f()">x</div>', '<button onclick="f()">x</button><div onclick="f()" tabindex="0">y</div>'),
    "interactive-role-not-focusable": ('<div role="button">x</div>', '<div role="button" tabindex="0">x</div><div role="button" aria-disabled="true">y</div>'),
    "skip-link-target-missing": ('<a href="#gone">Skip to content</a>', '<a href="#m">Skip to content</a><main id="m">x</main><a href="#gone">other</a>'),
    "accesskey-duplicate": ('<a href="/a" accesskey="s">a</a><a href="/b" accesskey="S">b</a>', '<a href="/a" accesskey="s">a</a><a href="/b" accesskey="t">b</a>'),
    "aria-describedby-orphan": ('<input aria-describedby="gone">', '<input aria-describedby="d"><p id="d">x</p>'),
    "aria-boolean-invalid": ('<div aria-expanded="yes">x</div>', '<div aria-expanded="true" aria-pressed="mixed">x</div>'),
    "aria-live-invalid": ('<div aria-live="loud">x</div>', '<div aria-live="polite">x</div>'),
    "aria-presentation-on-interactive": ('<button role="presentation">x</button>', '<div role="presentation">x</div>'),
    "aria-redundant-role": ('<button role="button">x</button>', '<button role="button menuitem">x</button><div role="button">y</div><nav role="">z</nav>'),
    "autocomplete-missing": ('<input type="password" name="" id="username">', '<input name="email" autocomplete="email"><input type="search" name="city"><input name="color"><input type="checkbox" name="email">'),
    "autocomplete-invalid": ('<input autocomplete="mailbox">', '<input autocomplete="section-a shipping email">'),
    "fieldset-legend-missing": ('<input type="radio" name="r"><input type="radio" name="r">', '<fieldset><legend>Size</legend><input type="radio" name="r"><input type="radio" name="r"></fieldset><input type="radio" name="one">'),
    "label-empty": ('<label for="n"></label><input id="n">', '<label for="n">Name</label><input id="n">'),
    "button-type-missing": ("<form><button>x</button></form>", '<form><button type="submit">x</button></form><button>y</button>'),
    "link-same-name-different-target": ('<a href="#t">Learn more</a><a href="/b">Learn more</a>', '<a href="/a#x">Learn more</a><a href="/a#y">learn more</a><a href="/c">no</a><a href="/d">no</a>'),
    "link-empty-href": ('<a href="#">x</a>', '<a href="/x">x</a><a href="#" hidden>y</a><div hidden><a href="javascript:f()">z</a></div>'),
    "link-url-as-text": ('<a href="/x">https://a.example/very/long/address</a>', '<a href="/x">https://a.co</a><a href="/y">Our long page of prices</a>'),
    "new-window-no-warning": ('<a href="/x" target="_blank">x</a>', '<a href="/x" target="_blank">x (opens in a new tab)</a>'),
    "main-multiple": ("<main>a</main><main>b</main>", "<main>a</main><main hidden>b</main>"),
    "landmark-nesting": ("<article><header>x</header></article>", "<header>x</header><section><footer hidden>y</footer></section>"),
    "h1-multiple": ("<h1>a</h1><h1>b</h1>", "<h1>a</h1><h2>b</h2>"),
    "definition-list-structure": ("<dl><p>x</p></dl>", "<dl><dt>a</dt><dd>b</dd><div><dt>c</dt><dd>d</dd></div></dl>"),
    "th-scope-missing": ("<table><tr><th>a</th></tr><tr><th>b</th><td>c</td></tr></table>", '<table><tr><th scope="col">a</th></tr><tr><th scope="row">b</th><td>c</td></tr></table>'),
    "id-invalid": ('<p id="a b">x</p>', '<p id="ab">x</p>'),
    "audio-no-transcript": ('<div><audio src="a"></audio></div>', '<div><audio src="a"></audio><a href="/t">Transcript</a></div>'),
    "video-no-audio-description": ('<video src="v"></video>', '<video src="v"><track kind="descriptions" src="d"></video>'),
    "object-no-fallback": ('<object data="x"></object>', '<object data="x">A chart of sales</object>'),
    "viewport-missing": ("<head><title>x</title></head><body></body>", '<head><meta name="viewport" content="width=device-width"></head><body></body>'),
    "text-justified": ("<style>p{text-align:justify}</style>", "<style>p{text-align:left}</style>"),
    "title-attribute-as-label": ('<button title="Close"></button>', '<button title="Close">Close</button>'),
    "iframe-negative-tabindex": ('<iframe tabindex="-1" title="x"></iframe>', '<iframe title="x"></iframe>'),
    "duplicate-alt-adjacent": ('<a href="/x"><img alt="Home" src="h">Home</a>', '<a href="/x"><img alt="" src="h">Home</a>'),
}
MEASURED = {"target-size-minimum", "horizontal-scroll"}
DEAD = {"noscript-missing"}


def run(spark, pages, **more):
    frame = spark.createDataFrame([(i, f"https://a.example/{i}", *p) for i, p in enumerate(pages)], "page_id long, url string, html string, css string")
    elements = html_elements(frame, css_col="css").cache()
    return rules.find_all(elements, frame, **more)


@pytest.fixture(scope="module")
def reported(spark):
    pages = [(html, None) for pair in CASES.values() for html in pair]
    found = run(spark, pages).groupBy("page_id").agg(F.collect_set("rule_id").alias("r"))
    return {r.page_id: set(r.r) for r in found.collect()}


def test_every_rule_has_its_pages():
    assert set(CASES) | MEASURED | DEAD == set(rules.BY_ID)


@pytest.mark.parametrize("rule", CASES)
def test_rule(reported, rule):
    at = 2 * list(CASES).index(rule)
    assert rule in reported[at] and rule not in reported.get(at + 1, set())


def test_section_508_values():
    got = {r.id: r.section508 for r in rules.RULES if r.section508}
    one = ["502.3.1"]
    assert got == {
        "img-alt": one, "button-name": one, "link-name": one, "input-label": one, "click-handler-no-keyboard": one,
        "html-has-lang": ["501"], "color-contrast": ["502.3"],
    }


def test_focus_rules_keep_source_order(spark):
    css = "".join(f"{s}:focus{{outline:0}}" for s in ("z", "b", "z", "m", "a"))
    found = run(spark, [("<body>x</body>", css)]).where("rule_id = 'focus-not-obscured'")
    assert {r.key for r in found.collect()} == {"z:focus", "b:focus", "m:focus"}


def test_linked_sheets_reach_the_rules(spark):
    html = '<head><link rel="stylesheet" href="/a.css"><link rel="icon" href="/i.css"><link href="b.css" rel="stylesheet"><link rel=stylesheet href="https://cdn.example/c.css"></head><body><p class="pale">hardly seen</p></body>'
    pages = spark.createDataFrame([(1, "https://a.example/x/", html), (2, "https://a.example/y", "<p>none</p>")], "page_id long, url string, html string")
    got = sheets.stylesheet_urls(pages).orderBy("place").collect()
    assert [(r.page_id, r.place, r.sheet) for r in got] == [(1, 1, "https://a.example/a.css"), (1, 2, "https://a.example/x/b.css")]
    responses = spark.createDataFrame(
        [("https://a.example/a.css", 200, ".pale{color:#ccc}"), ("https://a.example/x/b.css", 404, "p{text-align:justify}")], "url string, status int, body string"
    )
    css = {r.page_id: r.css for r in sheets.with_linked_css(pages, responses).collect()}
    assert css == {1: ".pale{color:#ccc}\n", 2: ""}
    elements = html_elements(sheets.with_linked_css(pages, responses), css_col="css").cache()
    found = {(r.page_id, r.rule_id) for r in rules.find_all(elements, pages).collect()}
    assert (1, "color-contrast") in found and (1, "text-justified") not in found
    assert not html_elements(pages).where("facts['fg'] = '#cccccc'").count()


def test_rendering_falls_back_to_the_source(spark):
    pages = spark.createDataFrame([(1, "u1", "<p>1", "c1"), (2, "u2", "<p>2", "c2")], "page_id long, url string, html string, css string")
    browser = spark.createDataFrame([(2, "u2b", "<p>two"), (1, "u1b", None)], "page_id long, url string, html string")
    got = {r.page_id: (r.url, r.html, r.css, r.mode) for r in sheets.rendered(pages, browser).collect()}
    assert got == {1: ("u1", "<p>1", "c1", "static"), 2: ("u2b", "<p>two", "", "browser")}
    assert {r.mode for r in sheets.rendered(pages, None).collect()} == {"static"}


def test_pages_among_responses(spark):
    rows = [("a", 200, "text/html; charset=utf-8", "x"), ("b", 200, "application/xhtml+xml", "y"), ("c", 200, "image/png", "z"), ("d", 200, None, "w"), ("e", 200, "text/html", "x" * 5_000_001)]
    df = spark.createDataFrame(rows, "url string, status int, content_type string, body string")
    assert {r.url for r in sheets.fetched_pages(df).collect()} == {"a", "b"}


def test_css_coverage(spark):
    frame = spark.createDataFrame([(1, "<p>x", "a:hover{color:red} p{color:#111}"), (2, "<p>x", "")], "page_id long, html string, css string")
    got = {r.page_id: (r.unreadable, r.complete, r.note) for r in sheets.css_coverage(html_elements(frame, css_col="css")).collect()}
    assert got[1][:2] == (1, False) and got[1][2].startswith("1 CSS rule") and got[2] == (0, True, None)


def test_measured_looks_win(spark):
    html = '<p style="color:#222">dark words</p><b style="color:#ddd">pale words</b><i>tiny</i><u>half seen</u>'
    frame = spark.createDataFrame([(1, "https://a.example/", html)], "page_id long, url string, html string")
    elements = html_elements(frame).cache()
    path = {r.tag: r.css_path for r in elements.collect()}
    seen = [
        (1, path["p"], "rgb(200, 200, 200)", "rgb(255, 255, 255)", 16.0, "400", 1.0),
        (1, path["b"], "rgb(0, 0, 0)", "rgb(255, 255, 255)", 16.0, "bold", None),
        (1, path["u"], "rgb(0, 0, 0)", "rgb(255, 255, 255)", 16.0, "400", 0.3),
    ]
    kind = "page_id long, css_path string, color string, background string, font_size double, font_weight string, opacity double"
    measured = spark.createDataFrame(seen, kind).withColumns({"visible": F.lit(True), "interactive": F.lit(False), "width": F.lit(9.0), "height": F.lit(9.0), "display": F.lit("block")})
    found = rules.find_all(elements, frame, measured).where("rule_id = 'color-contrast'")
    assert {(r.tag, r.key, r.fix.old, r.fix.backdrop) for r in found.collect()} == {("p", None, "#c8c8c8", "#ffffff"), ("u", None, "#b3b3b3", "#ffffff")}
    assert {r.tag for r in rules.find_all(elements, frame).where("rule_id = 'color-contrast'").collect()} == {"b"}


def test_backdrops(spark):
    rows = [(1, ["rgba(0, 0, 0, 0)", "rgb(1, 2, 3)", "rgb(9, 9, 9)"]), (2, ["rgba(0, 0, 0, 0.5)", "transparent"]), (3, [])]
    df = spark.createDataFrame(rows, "i int, b array<string>")
    got = {r.i: r.c for r in df.select("i", color.nearest_backdrop(F.col("b")).alias("c")).collect()}
    assert got == {1: "rgb(1, 2, 3)", 2: "rgb(255, 255, 255)", 3: "rgb(255, 255, 255)"}


def test_measured_rules(spark):
    frame = spark.createDataFrame([(1, "https://a.example/", '<a href="/x">x</a><button>b</button><button id="ok">c</button>')], "page_id long, url string, html string")
    elements = html_elements(frame).cache()
    path = {r.attrs.get("id") or r.tag: r.css_path for r in elements.collect()}
    rows = [(1, path["a"], True, 9.0, 9.0, True, "inline"), (1, path["button"], True, 20.0, 30.0, True, "block"), (1, path["ok"], True, 24.0, 24.0, True, "block")]
    measured = spark.createDataFrame(rows, "page_id long, css_path string, visible boolean, width double, height double, interactive boolean, display string")
    layout = spark.createDataFrame([(1, 1300, 1280)], "page_id long, scroll_width int, client_width int")
    found = rules.find_all(elements, frame, measured, layout)
    assert [(r.key, r.tag) for r in found.where("rule_id = 'target-size-minimum'").collect()] == [(None, "button")]
    assert found.where("rule_id = 'horizontal-scroll'").count() == 1
    fits = layout.withColumn("scroll_width", F.lit(1284))
    assert rules.find_all(elements, frame, measured, fits).where("rule_id = 'horizontal-scroll'").count() == 0


def test_a_suggested_color_is_worked_out_once(spark):
    """Not once for each channel, step and use, which took a tenth of a second a row."""
    rows = spark.createDataFrame([("#bbbbbb", "#ffffff"), ("#777777", "#000000"), ("#00ff00", "#ffffff"), ("#000000", "#000000")], "fg string, bg string")
    better = rows.select("fg", color.suggested_color(F.col("fg"), F.col("bg"), F.lit(4.5)).alias("better"))
    assert better._jdf.queryExecution().analyzed().toString().count("conv(") <= 12
    assert [r.better for r in better.collect()][0] == "#767676"


def test_pages_with_linked_sheets_are_parsed_by_many_tasks(spark):
    pages = spark.createDataFrame([(i, f"https://a.example/{i}", "<link rel=stylesheet href=/x.css>") for i in range(40)], "page_id long, url string, html string")
    responses = spark.createDataFrame([("https://a.example/x.css", 200, "p{}")], "url string, status int, body string")
    rows = sheets.with_linked_css(pages, responses)
    assert rows.rdd.getNumPartitions() >= 4
    assert {(r.css, r.page_id) for r in rows.collect()} == {("p{}", i) for i in range(40)}
