"""Parser, rules, scores, ledger and remediation on pages of our own."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import color, text
from tessera.operators import frontier, ledger, remediation, reports, rules, scoring
from tessera.sources.css import declared, matches, parse_css
from tessera.sources.html import ICONS, Document, element_rows, html_elements

BROKEN = """<html><head><meta name="viewport" content="width=device-width, user-scalable=no"><title></title>
<style>.pale{color:#aaaaaa;background:#ffffff} a:focus{outline:none}</style></head><body>
<nav><a href="/1">one</a><a href="/2">two</a><a href="/3">three</a><a href="/4">four</a><a href="/5">five</a>
<a href="/6">six</a><a href="/7">seven</a><a href="/8">eight</a><a href="/9">nine</a><a href="/10">ten</a></nav>
<nav><a href="/x">alpha</a><a href="/y">beta</a></nav>
<h1>Shop</h1><h4>Deals</h4><h3></h3>
<img src="a.png"><img src="b.png" alt="image"><img src="c.png" alt="photo-1.jpg">
<input type="email" placeholder="Your mail"><input type="text"><label for="nothing">Phone</label><input type="tel">
<button></button><button class="icon-close"></button><a href="/more">click here</a><a href="/img"><img src="d.png"></a>
<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>
<ul><div>no item</div></ul><p id="twice">a</p><p id="twice">b</p><span tabindex="5">t</span>
<div role="checkbox" tabindex="0">c</div><div role="fancy">r</div><div aria-labeled="z">l</div>
<div aria-hidden="true"><button>hidden</button></div><iframe src="https://www.youtube.com/embed/x"></iframe>
<video autoplay src="v.mp4"></video><p class="pale">hardly seen text</p></body></html>"""

CLEAN = """<!doctype html><html lang="en"><head><meta name="viewport" content="width=device-width, initial-scale=1"><title>Fine</title></head>
<body><a href="#main">Skip to content</a><nav aria-label="Main"><a href="/about">About us</a></nav><main id="main"><h1>Welcome</h1><h2>More</h2>
<img src="a.png" alt="A red bicycle by a wall"><img src="b.png" alt=""><form><label for="mail">Mail</label><input id="mail" type="email" autocomplete="email">
<button type="submit">Send</button></form><table><caption>Prices</caption><tr><th scope="col">Thing</th><th scope="col">Price</th></tr><tr><td>Pen</td><td>2</td></tr></table>
<div role="checkbox" aria-checked="false" tabindex="0">News</div><iframe title="Map" src="/m"></iframe>
<video src="v.mp4"><track kind="captions" src="v.vtt"></video><p style="color:#222222">dark text on white</p></main></body></html>"""

MUST = """img-alt button-name link-name input-label frame-title html-has-lang document-title heading-order empty-heading
duplicate-id list-structure tabindex-positive aria-valid-role aria-valid-attr aria-required-attr aria-hidden-focusable
meta-viewport-zoom autoplay-media video-captions landmark-main landmark-unique link-generic-text img-alt-placeholder
table-headers color-contrast focus-not-obscured label-orphan skip-link""".split()
MUST_NOT = "img-alt button-name link-name input-label frame-title html-has-lang duplicate-id meta-viewport-zoom img-alt-placeholder".split()


def analysed(spark, *htmls):
    pages = spark.createDataFrame([(i, f"https://a.example/p{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    elements = html_elements(pages).cache()
    return pages, elements, rules.find_all(elements, pages).cache()


@pytest.fixture(scope="module")
def both(spark):
    return analysed(spark, BROKEN, CLEAN)


def test_catalog_is_complete():
    assert len(rules.RULES) == 69 == len(rules.BY_ID)
    known = set(rules.BY_ID)
    assert all(r.impact in scoring.IMPACTS and r.wcag for r in rules.RULES) and len(known) == 69


def test_broken_page_fires(both):
    found = {r.rule_id for r in both[2].where("page_id = 0").select("rule_id").distinct().collect()}
    assert set(MUST) <= found, set(MUST) - found


def test_clean_page_is_quiet(both):
    rows = both[2].where("page_id = 1").select("rule_id", "tier").collect()
    assert not {r.rule_id for r in rows} & set(MUST_NOT)
    assert not [r for r in rows if r.tier == "definite"]


def test_scores(both):
    pages, _, found = both
    score = {r.page_id: r.score for r in scoring.page_results(pages, found).collect()}
    assert score[0] < 40 and score[1] >= 90


def test_worked_scores(spark):
    rows = [(1, "critical", "definite"), (2, "serious", "definite"), (3, "critical", "review"), (4, "critical", "advisory")]
    df = scoring.totals(spark.createDataFrame(rows, "p int, impact string, tier string"), "p")
    assert {r.p: r.score for r in df.collect()} == {1: 67, 2: 80, 3: 83, 4: 100}


def test_contrast_has_a_suggestion(both):
    row = both[2].where("rule_id = 'color-contrast'").first()
    assert row.fix.strategy == "css-color" and row.fix.value.startswith("#")


def test_patch_and_rescan(spark, both):
    pages, _, found = both
    plan = {r.page_id: r for r in remediation.remediation_plan(pages, found).collect()}
    patched = plan[0].patched
    assert 'lang="en"' in patched and "user-scalable=no" not in patched and 'tabindex="0"' in patched
    assert 'title="YouTube video player"' in patched and '<img src="a.png">' in patched
    assert plan[0].diff.startswith("--- a/") and plan[1].diff == "" and plan[0].automatic > 0
    _, _, after = analysed(spark, patched)
    count = lambda df: df.where("page_id = 0 and tier = 'definite'").count()
    assert count(after) < count(found)
    new = {r.rule_id for r in after.collect()} - {r.rule_id for r in found.where("page_id = 0").collect()}
    assert not new


def test_nothing_is_cut_in_long_parents(spark):
    long, names = "<p>" + "words " * 1000 + "</p>", " ".join(f"layout-{i}x" for i in range(400))
    deep = f'<button><span class="{names}"><i class="{names} icon-search"></i></span></button>'
    pages = [
        f'<body><audio src="a.mp3"></audio>{long}<a href="/t">Transcript</a>{deep}</body>',
        f'<body><audio src="a.mp3"></audio>{long}<button><i class="{names}"></i></button></body>',
    ]
    found = analysed(spark, *pages)[2]
    assert [r.page_id for r in found.where("rule_id = 'audio-no-transcript'").collect()] == [1]
    fixes = {r.page_id: str(r.fix) for r in found.where("rule_id = 'button-name'").collect()}
    assert "Search" in fixes[0] and "Search" not in fixes[1]


def test_icon_words_name_their_own_icon():
    for pattern, word in ICONS:
        assert next(w for p, w in ICONS if p.search(word)) == word and pattern.search(word)


@pytest.mark.parametrize("html", ["<p>a<p>b", "<div><span></div></span>", "<!doctype html><html>", "<table><tr><td>x"])
def test_malformed_pages_parse(html):
    rows = list(element_rows(html))
    assert rows[0]["tag"] == "html" and {"head", "body"} <= {r["tag"] for r in rows}


def test_empty_pages_have_no_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "  ")], "page_id long, html string")
    assert html_elements(df).count() == 0


def test_shell_is_client_rendered(spark):
    page = '<html><head></head><body><div id="root"></div><script src="/app.js"></script></body></html>'
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    row = scoring.coverage(html_elements(df)).first()
    assert row.mode == "client-rendered" and not row.complete


def test_measured_rules(spark):
    pages, elements, _ = analysed(spark, "<html><head></head><body><button>x</button></body></html>")
    m = spark.createDataFrame([(0, "body > button", True, 16.0, 16.0, True, "block")], "page_id long, css_path string, visible boolean, width double, height double, interactive boolean, display string")
    wide = spark.createDataFrame([(0, 405, 400)], "page_id long, scroll_width int, client_width int")
    found = {r.rule_id for r in rules.find_all(elements, pages, m, wide).collect()}
    assert {"target-size-minimum", "horizontal-scroll"} <= found
    same = spark.createDataFrame([(0, 404, 400)], "page_id long, scroll_width int, client_width int")
    assert "horizontal-scroll" not in {r.rule_id for r in rules.find_all(elements, pages, None, same).collect()}


@pytest.mark.parametrize(
    ("value", "rgba"),
    [("#fff", (255, 255, 255, 1)), ("#000000", (0, 0, 0, 1)), ("rgb(255, 0, 0)", (255, 0, 0, 1)), ("rgba(0, 0, 0, 0.5)", (0, 0, 0, 0.5)), ("white", (255, 255, 255, 1)),
     ("hsl(0, 100%, 50%)", (255, 0, 0, 1)), ("var(--x)", None), ("linear-gradient(red, blue)", None), ("currentColor", None), ("", None)],
)
def test_colors(value, rgba):
    assert color.parse_color(value) == rgba


def test_contrast(spark):
    df = spark.createDataFrame([("#000000", "#ffffff"), ("#ffffff", "#ffffff"), ("#767676", "#ffffff")], "f string, b string")
    a, b, c = (r.r for r in df.select(color.contrast_ratio(F.col("f"), F.col("b")).alias("r")).collect())
    assert abs(a - 21) < 1e-9 and b == 1 and 4.5 <= c < 4.6
    sizes = spark.createDataFrame([(16.0, False), (24.0, False), (19.0, True)], "px double, bold boolean")
    assert [r.r for r in sizes.select(color.required_ratio(F.col("px"), F.col("bold")).alias("r")).collect()] == [4.5, 3.0, 3.0]


def test_cascade():
    doc = Document('<style></style><p id="me" class="a" style="font-size:12px">x</p><div class="b"><p>y</p></div>')
    sheet, unreadable = parse_css("p{color:red} .a{color:blue} #me{color:#333333} @media print{p{color:lime}} a:hover{color:red} [x]{background:red} div > p{color:teal}")
    p, q = (n for n in doc.nodes if n.tag == "p")
    assert declared(p, sheet)["color"] == "#333333" and declared(q, sheet)["color"] == "teal" and unreadable == 2
    assert not any(matches(p, r) for r in sheet if r.selector == "div > p")


def test_signatures(spark):
    df = spark.createDataFrame([("https://a.b/x?1", "p"), ("https://c.d/x?2", "p"), ("https://a.b/x", "q")], "u string, s string")
    a, b, c = (r.g for r in df.select(text.signature(F.lit("r"), F.col("u"), F.col("s"), F.lit(None).cast("string")).alias("g")).collect())
    assert a == b != c and len(a) == 20


def test_attributes():
    assert remediation.set_attribute("<a>", "x", "1") == '<a x="1">'
    assert remediation.set_attribute("<br/>", "x", "1") == '<br x="1" />'
    assert remediation.set_attribute("<a x='0' y>", "x", '"') == '<a x="&quot;" y>'
    assert remediation.remove_attribute('<a x="0" y="1">', "x") == '<a y="1">'
    assert remediation.unified_diff("a\nb", "a\nb") == "" and "-b\n+c\n" in remediation.unified_diff("a\nb", "a\nc")
    assert remediation.apply_edits("<p></p>", [(0, 3, "A", "1"), (0, 3, "B", "2")])[1:] == (["1"], ["2"])


def test_a_diff_is_whole_whatever_the_length():
    """Applied to the text before it gives the one after, with no more lines left out and put in than were changed."""
    rng = random.Random(5)
    for n, changed in ((40, 6), (6_000, 2), (9_000, 300)):
        before = [rng.choice(["</li>", f"line {k}"]) for k in range(n)]
        after = list(before)
        for k in rng.sample(range(n), changed):
            after[k] += "!"
        lines = remediation.unified_diff("\n".join(before), "\n".join(after)).splitlines()[2:]
        assert sum(x.startswith("-") for x in lines) == sum(x.startswith("+") for x in lines) == changed
        got, at = [], 0
        for line in lines:
            if hunk := re.match(r"@@ -(\d+),", line):
                got += before[at : int(hunk[1]) - 1]
                at = int(hunk[1]) - 1
                continue
            assert line[0] == "+" or before[at] == line[1:]
            got += [line[1:]] if line[0] != "-" else []
            at += line[0] != "+"
        assert got + before[at:] == after


HOSTS = {
    "localhost": True, "127.0.0.1": True, "10.1.2.3": True, "172.16.0.1": True, "172.32.0.1": False, "192.168.1.1": True, "169.254.169.254": True,
    "0.0.0.0": True, "100.64.0.1": True, "::1": True, "fd00::1": True, "fe80::1": True, "printer.local": True, "::ffff:127.0.0.1": True,
    "example.com": False, "8.8.8.8": False, "1.1.1.1": False, "2001:4860::8888": False,
}


def test_hosts(spark):
    df = spark.createDataFrame([(h,) for h in HOSTS], "h string").select("h", text.private_host(F.col("h")).alias("p"))
    assert {r.h: r.p for r in df.collect()} == HOSTS


def test_robots(spark):
    files = spark.createDataFrame([("o", "User-agent: *\nDisallow: /admin\nDisallow: /cart # x\nAllow: /cart/public\n")], "origin string, body string")
    paths = spark.createDataFrame([("o", p) for p in ("/", "/admin/users", "/cart", "/cart/public")] + [("none", "/x")], "origin string, path string")
    got = {r.path: r.allowed for r in frontier.robots_allowed(paths, frontier.robots_rules(files, "bot")).collect()}
    assert got == {"/": True, "/admin/users": False, "/cart": False, "/cart/public": True, "/x": True}


def test_many_robots_rules_of_one_origin(spark):
    rules = [("o", k, k % 3 == 0, f"/{k % 50}/{k}") for k in range(10_000)] + [("o", 10_001, False, "/7"), ("o", 10_002, True, "/7"), ("o", 10_003, False, "")]
    paths = [f"/{k % 60}/{k}{'/x' * (k % 3)}" for k in range(0, 12_000, 37)] + ["/", "/7", "/70"]
    df = spark.createDataFrame(rules, "origin string, ord int, allow boolean, prefix string")
    got = {r.path: r.allowed for r in frontier.robots_allowed(spark.createDataFrame([("o", p) for p in paths] + [("none", "/")], "origin string, path string"), df).where("origin = 'o'").collect()}

    def allowed(path):
        hits = [(len(p), -k, a) for _, k, a, p in rules if path.startswith(p)]
        return max(hits)[2] if hits else True

    assert got == {p: allowed(p) for p in paths}



def test_links(spark):
    html = """<a href="/a">x</a><a href='b'>y</a><a href=/c>z</a><a href="https://else.example/">e</a><a href="/i.png">i</a><a href="mailto:a@b.c">m</a><a href="#f">f</a>"""
    df = spark.createDataFrame([(1, "https://a.example/d/", html)], "page_id long, url string, html string")
    assert {r.link for r in frontier.extract_links(df).collect()} == {"https://a.example/a", "https://a.example/d/b", "https://a.example/c"}


T0, T1 = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)
LEDGER = "site_id string, signature string, status string, first_seen_at timestamp, last_seen_at timestamp, resolved_at timestamp, resolved_scan_id string"


def reconciled(spark, state, current, pages):
    led = spark.createDataFrame([("s", sig, st, T0, T0, T0 if st == "resolved" else None, "old" if st == "resolved" else None) for sig, st in state], LEDGER)
    cur = spark.createDataFrame([("s", x) for x in current], "site_id string, signature string")
    hist = spark.createDataFrame([("s", sig, f"https://a/{sig}/") for sig in {*current, *(x for x, _ in state)}], "site_id string, signature string, page_url string")
    pg = spark.createDataFrame([("s", f"https://a/{p}", e) for p, e in pages], "site_id string, url string, error string")
    rows = ledger.reconcile(led, cur, hist, pg, "new", F.lit(T1)).collect()
    return {r.signature: r for r in rows}


def test_ledger_transitions(spark):
    state = [("fixed", "open"), ("busy", "in_progress"), ("away", "open"), ("broken", "open"), ("back", "resolved"), ("mute", "wontfix"), ("kept", "open")]
    got = reconciled(spark, state, ["new", "back", "mute", "kept"], [("fixed", None), ("busy", None), ("broken", "timeout"), ("new", None)])
    status = {k: r.status for k, r in got.items()}
    assert status == {"fixed": "resolved", "busy": "resolved", "away": "open", "broken": "open", "back": "open", "mute": "wontfix", "kept": "open", "new": "open"}
    assert got["fixed"].resolved_scan_id == "new" and got["back"].resolved_at is None and got["back"].first_seen_at == T0
    assert got["new"].first_seen_at == T1 and got["mute"].last_seen_at == T1 and got["away"].last_seen_at == T0


def test_plans(spark):
    now = F.lit(T1)
    rows = [("growth", datetime.datetime(2024, 1, 9), None, "none"), ("growth", datetime.datetime(2023, 12, 1), None, "none"),
            ("growth", datetime.datetime(2023, 12, 1), "sub", "active"), ("growth", None, None, "none"), ("growth", datetime.datetime(2024, 1, 1, 12), None, "none")]
    df = spark.createDataFrame(rows, "p string, t timestamp, s string, b string")
    assert [r.e for r in df.select(reports.effective_plan(F.col("p"), F.col("t"), F.col("s"), F.col("b"), now).alias("e")).collect()] == ["growth", "free", "growth", "growth", "growth"]
    cases = {("free", "daily"): False, ("free", "manual"): True, ("starter", "weekly"): True, ("starter", "daily"): False, ("growth", "daily"): True, ("scale", "sixhourly"): True}
    df = spark.createDataFrame(list(cases), "p string, c string")
    assert {(r.p, r.c): r.ok for r in df.select("p", "c", reports.cadence_allowed(F.col("p"), F.col("c")).alias("ok")).collect()} == cases


def test_rate_limit_opens_at_the_first_hit(spark, tmp_path):
    from tessera.streaming import state

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    state.use_state_store(spark)
    base = datetime.datetime(2024, 1, 1, 0, 0, 50)
    hits = [("k", base + datetime.timedelta(seconds=s)) for s in (0, 5, 10, 59, 61)]
    spark.createDataFrame(hits, "key string, ts timestamp").write.parquet(str(tmp_path / "hits"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "hits"))
    seen = []
    run = state.rate_limit(stream, 2, 60).writeStream.foreachBatch(lambda b, n: seen.extend(b.collect())).outputMode("append").start()
    try:
        for _ in range(120):
            if len(seen) == 5 or run.awaitTermination(1):
                break
    finally:
        run.stop()
        spark.conf.set(provider, before)
    assert [r.allowed for r in sorted(seen, key=lambda r: r.ts)] == [True, True, False, False, True]
