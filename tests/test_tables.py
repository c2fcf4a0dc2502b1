"""Sitemaps, crawls, sinks, accounts, evidence and reports on small tables with results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import accounts, crawl, evidence, frontier, remediation, reports, rules
from tessera.sinks import records
from tessera.sinks.store import Store, changed, without
from tessera.sources import sitemap, tables
from tessera.sources.html import html_elements


def day(n, hour=0):
    return dt.datetime(2024, 1, n, hour)


def table(spark, kind, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], kind)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def at(n):
    return F.lit(day(n)).cast("timestamp")


# sources
def test_sitemaps(spark):
    loc = lambda *us: "<urlset>" + "".join(f"<url><loc> {u} </loc></url>" for u in us) + "</urlset>"
    responses = table(
        spark, "url string, status int, body string",
        ("https://a.example/robots.txt", 200, "User-agent: *\nSitemap: https://a.example/one.xml\nsitemap: https://a.example/two.xml\nSitemap: https://b.example/x.xml"),
        ("https://a.example/two.xml", 200, "<sitemapindex>" + loc("https://a.example/inner.xml", "https://a.example/nested.xml", "https://a.example/one.xml")[8:]),
        ("https://a.example/nested.xml", 200, "<sitemapindex><loc>https://a.example/deep.xml</loc></sitemapindex>"),
        ("https://a.example/deep.xml", 200, loc("https://a.example/never")),
        ("https://a.example/inner.xml", 200, loc("https://a.example/i1#top", "https://a.example/pic.png", "https://b.example/far")),
        ("https://a.example/one.xml", 200, loc("https://a.example/o1", "https://a.example/i1")),
        ("https://a.example/sitemap.xml", 500, loc("https://a.example/broken")),
        ("https://c.example/sitemap.xml", 200, loc(*(f"https://c.example/{i}" for i in range(9)))),
    )
    origins = table(spark, "origin string", ("https://a.example",), ("https://c.example",), ("https://d.example",))
    tried = sitemap.sitemap_candidates(origins, responses).where("origin like '%a.ex%'").orderBy("tried")
    assert [r.url.rsplit("/", 1)[1] for r in tried.collect()] == ["two.xml", "one.xml", "sitemap.xml", "sitemap_index.xml"]
    got = rows_of(sitemap.sitemap_urls(origins, responses, limit=5))
    assert got == [("https://a.example", "https://a.example/i1", 1), ("https://a.example", "https://a.example/o1", 2)] + [("https://c.example", f"https://c.example/{i}", i + 1) for i in range(5)]


def test_crawl(spark):
    page = lambda *links: "".join(f'<a href="{x}">x</a>' for x in links)
    html = "text/html"
    responses = table(
        spark, "url string, status int, content_type string, body string",
        ("https://a.example/", 200, html, page("/p/1", "/p/2", "/p/3", "/about", "/cart", "/secret", "https://b.example/z")),
        ("https://a.example/p/1", 200, html, page("/p/4", "/deep/er/page")), ("https://a.example/p/2", 200, html, ""), ("https://a.example/p/3", 200, html, ""),
        ("https://a.example/p/4", 200, html, ""), ("https://a.example/about", 200, html, page("/")), ("https://a.example/cart", 200, html, ""),
        ("https://a.example/secret", 200, html, ""), ("https://a.example/deep/er/page", 200, html, ""), ("https://a.example/feed", 200, "application/json", "{}"),
        ("https://b.example/", 200, html, page("/gone")),
    )
    starts = table(spark, "site_id int, url string", (1, "https://a.example/"), (2, "https://b.example/"))
    robots = frontier.robots_rules(table(spark, "origin string, body string", ("https://a.example", "User-agent: *\nDisallow: /secret")), "bot")
    listed = table(spark, "site_id int, url string, place int", (1, "https://a.example/feed", 1), (1, "https://a.example/about", 2))
    got = crawl.crawl(starts, responses, robots, listed, most_pages=6).collect()
    paths = [(r.site_id, r.position, text_path(r.url), r.error) for r in got]
    # the start is shallow, so it goes first; then the sitemap's page; the json feed and /secret take no place
    assert paths[:2] == [(1, 1, "/", None), (1, 2, "/about", None)]
    assert paths[2][2] == "/cart" and {p[2] for p in paths[3:5]} <= {"/p/1", "/p/2", "/p/3"} and len([p for p in paths if p[0] == 1]) == 6
    assert not {"/secret", "/feed"} & {p[2] for p in paths}
    assert [(p[2], p[3]) for p in paths if p[0] == 2] == [("/", None), ("/gone", "unreachable")]
    told = []

    def listen(metrics):
        told.append(metrics)
        raise ValueError("a listener that fails")

    whole = crawl.crawl(starts, responses, robots, most_pages=50, on_round=listen).where("site_id = 1")
    assert [m["round"] for m in told] == list(range(1, len(told) + 1))
    assert sum(m["pages"] for m in told) == 8 + 2 and sum(m["errors"] for m in told) == 1 and (told[0]["pages"], told[0]["sites"], told[0]["links"]) == (2, 2, 7)
    assert whole.count() == 8 == whole.select("url").distinct().count()
    assert [r.position for r in whole.orderBy("position").collect()] == list(range(1, 9))


def text_path(url):
    return "/" + url.split("/", 3)[3]


# sinks
def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    kind = "id int, v string"
    assert store.snapshot("t", kind).count() == 0 and store.log("l", kind).count() == 0 and store.versions("t") == []
    assert store.replace("t", table(spark, kind, (1, "a"))) == 1
    assert store.update("t", kind, lambda rows: rows.unionByName(table(spark, kind, (2, "b")))) == 2
    with pytest.raises(Exception):  # noqa: B017 - a failed write leaves the old version
        store.update("t", kind, lambda rows: rows.withColumn("v", F.raise_error(F.lit("no"))))
    assert store.update("t", kind, lambda rows: rows.where("id > 1")) == 3
    assert rows_of(store.snapshot("t", kind)) == [(2, "b")] and store.versions("t") == [2, 3]
    store.append("l", table(spark, kind, (1, "a")))
    store.append("l", table(spark, kind, (1, "a")))
    assert store.log("l", kind).count() == 2


def test_partial_updates(spark):
    kind = "id int, status string, notes string, updated_at timestamp"
    rows = table(spark, kind, (1, "new", "n", None), (2, "new", None, day(1)))
    updates = table(spark, kind, (1, "quoted", None, day(2)), (1, None, "later", day(3)), (1, "scoping", None, day(1)), (9, "new", "x", day(2)))
    assert rows_of(changed(rows, updates, "id", ["status", "notes"])) == [(1, "quoted", "later", day(3)), (2, "new", None, day(1))]


def test_deleting_a_site_takes_its_children(spark):
    tables = {
        "sites": table(spark, "id int", (1,), (2,)), "scans": table(spark, "id int, site_id int", (10, 1), (20, 2)),
        "pages": table(spark, "id int, scan_id int", (100, 10), (200, 20), (101, 10)), "findings": table(spark, "id int, page_id int", (1000, 100), (2000, 200)),
        "states": table(spark, "site_id int, signature string", (1, "a"), (2, "b")),
    }
    parents = {"findings": ("pages", "page_id"), "scans": ("sites", "site_id"), "pages": ("scans", "scan_id"), "states": ("sites", "site_id")}
    left = without(tables, parents, table(spark, "id int", (1,)), "sites")
    assert {n: rows_of(df) for n, df in left.items()} == {"sites": [(2,)], "scans": [(20, 2)], "pages": [(200, 20)], "findings": [(2000, 200)], "states": [(2, "b")]}


def test_scan_lives(spark):
    heads = records.scan_headers(table(spark, "id int, org_id int", (1, 7), (2, 7), (3, 8)), "manual", at(1))
    ids = {r.site_id: r.id for r in heads.collect()}
    assert {r.status for r in heads.collect()} == {"queued"} and len(set(ids.values())) == 3
    log = table(
        spark, "scan_id string, status string, at timestamp, pages int, score int, error string",
        (ids[1], "running", day(1, 1), None, None, None), (ids[1], "complete", day(1, 2), 5, 80, None), (ids[2], "running", day(1, 3), None, None, None),
        (ids[2], "failed", day(1, 3), None, None, "no pages"),
    )
    got = {r.site_id: (r.status, r.started_at, r.finished_at, r.pages_scanned, r.score, r.error) for r in records.scan_states(heads, log).collect()}
    assert got == {
        1: ("complete", day(1, 1), day(1, 2), 5, 80, None), 2: ("failed", day(1, 3), day(1, 3), None, None, "no pages"), 3: ("queued", None, None, None, None, None),
    }


def test_page_and_finding_rows(spark):
    pages = table(spark, "scan_id string, url string, status int, html string, error string", ("s", "a", 200, "<p>x", None), ("s", "b", None, None, "gone"), ("s", "c", 200, "y" * 800_000, None), ("s", "d", 200, "", None))
    got = {r.url: (r.error, r.bytes, r.html) for r in records.page_rows(pages).collect()}
    assert got == {"a": (None, 4, "<p>x"), "b": ("gone", None, None), "c": (None, 800_000, None), "d": ("no content", None, None)}
    frame = table(spark, "page_id long, url string, html string", (1, "https://a.example/", '<img src="x"><p id="a b">x</p>'))
    found = rules.find_all(html_elements(frame).cache(), frame)
    stored = records.finding_rows(found, F.lit("s"), F.lit("w"), at(1))
    assert stored.count() == found.count() == stored.select("id").distinct().count()
    back = records.stored_findings(stored.withColumn("ledger_status", F.lit(None).cast("string")), rules.catalog(spark)).where("rule_id = 'img-alt'").first()
    assert back.wcag_list == ["1.1.1"] and back.fix.strategy == "set-attribute" and back.offsets.start == 0 and back.ledger_status == "open" and back.title == "Image has no alternative text"
    odd = stored.where("rule_id = 'img-alt'").withColumns({"fix_json": F.lit("{bad"), "rule_id": F.lit("other"), "wcag": F.lit("")})
    row = records.stored_findings(odd, rules.catalog(spark)).first()
    assert (row.fix, row.title, row.wcag_list) == (None, "other", [])


def test_events_and_requests(spark):
    events = table(spark, "name string, org_id int, user_id int, props map<string,string>", ("login", 1, 2, {"a": "b"}), ("odd", None, None, None))
    got = {r.name: (r.known, r.props_json) for r in records.event_rows(events, at(1)).collect()}
    assert got == {"login": (True, '{"a":"b"}'), "odd": (False, "{}")}
    forms = table(spark, "kind string, contact_email string", ("audit", " A@b.co "), ("audit", " "), ("audit", None))
    assert [(r.contact_email, r.status) for r in records.service_requests(forms, at(1)).collect()] == [("a@b.co", "new")]
    results = spark.range(1).select(F.lit("u").alias("url"), F.lit(50).alias("score"), F.struct(F.lit(1).alias("n")).alias("totals"), F.sequence(F.lit(1), F.lit(300)).alias("findings"), F.struct(F.lit("static").alias("mode")).alias("coverage"))
    row = records.public_scans(results, at(1)).first()
    assert row.findings_json.count(",") == 199 and row.totals_json == '{"n":1}'
    recent = records.recent(table(spark, "id int, org int, created_at timestamp", (1, 7, day(1)), (2, None, day(3)), (3, 9, day(2))), 2, org_name=(table(spark, "id int, name string", (7, "seven"), (9, "nine")), "org"))
    assert rows_of(recent.select("id", "org_name")) == [(2, None), (3, "nine")]


def test_expiry_and_mail(spark):
    rows = table(spark, "id int, expires_at timestamp, accepted_at timestamp", (1, day(1), None), (2, day(3), None), (3, None, None), (4, day(1), day(1)))
    assert [r.id for r in records.unexpired(rows, at(2)).orderBy("id").collect()] == [2, 3]
    assert [r.id for r in records.unexpired(rows, at(2), F.col("accepted_at").isNotNull()).orderBy("id").collect()] == [2, 3, 4]
    log = table(spark, "id int, status string, at timestamp, provider string, error string", (1, "sent", day(2), "p", None), (2, "failed", day(2), "p", "x" * 500))
    got = {r.id: (r.status, r.sent_at, len(r.error or "")) for r in records.outbox_states(table(spark, "id int, to_email string", (1, "a"), (2, "b"), (3, "c")), log).collect()}
    assert got == {1: ("sent", day(2), 0), 2: ("failed", None, 400), 3: ("queued", None, 0)}


def test_frames_patches_and_codes(spark):
    events = table(spark, "scan_id string, seq int, type string, url string", ("s", 1, "fetch", "u"), ("s", 2, "end", None), ("t", 1, "fetch", "v"))
    ended = table(spark, "scan_id string, status string", ("s", "complete"), ("t", "failed"), ("w", "complete"))
    got = {(r.scan_id, r.seq): r.frame for r in records.event_frames(events, ended).collect()}
    assert got[("s", 1)] == 'data: {"type":"fetch","url":"u"}\n\n' and got[("t", 2)] == 'data: {"type":"end","status":"failed"}\n\n' and ("s", 3) not in got and ("w", 1) in got
    plans = table(spark, "site_id int, url string, diff string", (1, "b", "dB"), (1, "a", "dA"), (1, "c", ""), (2, "x", None))
    assert rows_of(records.patch_text(plans)) == [(1, "dA\ndB")]
    found = table(spark, "tier string", ("review",), ("definite",))
    assert [records.exit_code(found), records.exit_code(found.where("tier = 'review'")), records.exit_code(found, failed=True)] == [1, 0, 2]
    assert [r.value for r in records.json_lines(table(spark, "a int, b string", (1, None))).collect()] == ['{"a":1}']


# accounts
def test_accounts(spark):
    users = table(spark, "id int, email string, name string", (1, "a@x.co", "A"), (2, "b@x.co", "B"))
    orgs = table(spark, "id int, name string, plan string", (7, "Seven", "free"), (8, "Eight", "growth"))
    member = table(spark, "org_id int, user_id int, role string, created_at timestamp", (8, 1, "owner", day(2)), (7, 1, "member", day(1)), (8, 9, "member", day(1)))
    assert rows_of(accounts.members(member, users).select("org_id", "email")) == [(7, "a@x.co"), (8, "a@x.co")]
    assert rows_of(accounts.organisations_of(member, orgs).where("user_id = 1").select("name", "nth")) == [("Eight", 2), ("Seven", 1)]
    kind = "org_id int, invited_by int, email string, token_hash string, accepted_at timestamp, revoked_at timestamp, expires_at timestamp"
    asked = table(spark, kind, (7, 1, "n@x.co", "t1", None, None, day(9)), (7, 5, "m@x.co", "t2", None, None, day(1)), (8, 1, "o@x.co", "t3", day(1), None, day(9)), (8, 1, "p@x.co", "t4", None, day(1), day(9)))
    assert rows_of(accounts.open_invitations(asked, users, orgs).select("email", "org_name", "invited_by_email")) == [("m@x.co", "Seven", None), ("n@x.co", "Seven", "a@x.co")]
    assert [accounts.valid_invitation(asked, orgs, t, at(2)).count() for t in ("t1", "t2", "t3", "t4", "t5")] == [1, 0, 0, 0, 0]
    assert rows_of(accounts.seats_used(orgs, member, asked)) == [(7, 3), (8, 2)]
    sessions = table(spark, "id string, user_id int, org_id int, expires_at timestamp", ("own", 1, 8, day(9)), ("first", 1, 99, day(9)), ("null", 1, None, day(9)), ("old", 1, 7, day(1)), ("none", 2, 7, day(9)), ("lost", 3, 7, day(9)))
    got = {r.id: (r.org_id, r.role, r.plan) for r in accounts.active_sessions(sessions, users, member, orgs, at(2)).collect()}
    assert got == {"own": (8, "owner", "growth"), "first": (7, "member", "free"), "null": (7, "member", "free"), "none": (None, None, None)}


def test_slugs_are_unique(spark):
    names = table(spark, "id int, name string", (1, "Acme Co"), (2, "ACME co!"), (3, "***"), (4, "Other"), (5, "acme-co"))
    taken = table(spark, "slug string", ("acme-co",), ("acme-co-3",), ("other-2",))
    assert rows_of(accounts.unique_slugs(names, taken)) == [(1, "acme-co-2"), (2, "acme-co-4"), (3, "team"), (4, "other"), (5, "acme-co-5")]


# evidence
def test_evidence(spark):
    kind = "site_id string, page_id int, node_id int, rule_id string, tier string, impact string, css_path string, wcag array<string>"
    found = table(spark, kind, ("s", 1, 5, "img-alt", "definite", "critical", "b", ["1.1.1"]), ("s", 1, 2, "img-alt", "definite", "critical", "a", ["1.1.1"]), ("s", 1, 1, "id-invalid", "definite", "minor", "c", ["4.1.1"]), ("s", 1, 9, "page-has-h1", "review", "moderate", "d", ["1.3.1", "2.4.6"]))
    assert [tuple(r) for r in evidence.outstanding(found).collect()] == [("img-alt", 2, "a", "1.1.1"), ("id-invalid", 1, "c", "4.1.1")]
    judged = evidence.remarks(evidence.conformance(found))
    text_of = {r.criterion: r.remarks for r in judged.collect()}
    assert text_of["1.1.1"].startswith("2 confirmed failures ") and text_of["4.1.1"].startswith("1 confirmed failure ") and text_of["2.4.6"].startswith("1 possible issue ")
    sums = {r.level: r for r in evidence.verdict_summary(judged).collect()}
    assert sum(sums[None][x] for x in evidence.VERDICTS) == 50 == sum(sums[k][x] for k in ("A", "AA") for x in evidence.VERDICTS)
    assert sums[None].not_evaluated == 23 and sums[None].does_not == 2
    ledger = table(spark, "site_id string, signature string, status string, first_seen_at timestamp, resolved_at timestamp", ("s", "x", "resolved", day(1), day(3)), ("s", "y", "open", day(1), None), ("s", "z", "resolved", day(1), day(4)))
    history = table(spark, "site_id string, signature string, rule_id string, message string, created_at timestamp, id int", ("s", "x", "late", "l", day(2), 1), ("s", "x", "early", "e", day(1), 2), ("s", "y", "n", "n", day(1), 3))
    assert [(r.signature, r.rule_id) for r in evidence.resolved_issues(ledger, history).orderBy(F.desc("resolved_at")).collect()] == [("z", None), ("x", "early")]
    sites = table(spark, "id string, name string, day timestamp", ("s", "A & B", day(5)), ("t", "T", day(5)))
    for word, needle in (("statement", "<td>img-alt</td><td>2</td>"), ("vpat", "<td>1.1.1</td><td>A</td><td>Does Not Support</td>"), ("remediation", "<td>z</td>")):
        docs = {r.site_id: r.content for r in evidence.generate(word, sites, found, ledger).collect()}
        assert needle in docs["s"] and "A &amp; B" in docs["s"] and "January 5, 2024" in docs["s"] and needle not in docs["t"]
    with pytest.raises(ValueError):
        evidence.generate("poem", sites, found, ledger)
    old = table(spark, "site_id string, kind string, version int, content_hash string, created_at timestamp", ("s", "vpat", 3, "h", day(1)), ("s", "statement", 1, "h", day(2)), ("t", "vpat", 1, "h", day(3)))
    new = records.numbered_documents(old, evidence.generate("vpat", sites.where("id = 's'"), found, ledger), at(6)).first()
    assert new.version == 4 and len(new.content_hash) == 16
    assert [(r.kind, r.version) for r in evidence.documents_of(old, "s").collect()] == [("statement", 1), ("vpat", 3)]


# reports
SCANS = "id string, site_id string, status string, score int, created_at timestamp, started_at timestamp, finished_at timestamp"


def test_change_summary_and_rollup(spark):
    scans = table(spark, SCANS, ("a1", "a", "complete", 70, day(1), day(1), day(1)), ("a2", "a", "complete", 80, day(5), day(5), day(6)), ("a3", "a", "failed", None, day(7), None, None), ("b1", "b", "complete", 50, day(2), None, day(2)), ("c1", "c", "complete", 60, day(1), None, day(1)), ("c2", "c", "complete", 60, day(2), None, day(2)))
    other = {r.scan_id: (r.other, r.other_score) for r in reports.newest_other(scans, scans.where("status = 'complete'")).collect()}
    assert other == {"a1": ("a2", 80), "a2": ("a1", 70), "b1": (None, None), "c1": ("c2", 60), "c2": ("c1", 60)}
    ledger = table(spark, "site_id string, status string, first_seen_at timestamp, resolved_scan_id string", ("a", "open", day(5), None), ("a", "open", day(4), None), ("a", "resolved", day(1), "a2"), ("a", "resolved", day(1), "a1"), ("b", "open", day(1), None))
    got = {r.scan_id: tuple(r)[1:] for r in reports.change_summary(scans, ledger, scans.where("id in ('a2', 'b1', 'c2')")).collect()}
    assert got == {"a2": (80, 70, 1, 1, "up 10", True), "b1": (50, None, 0, 0, None, False), "c2": (60, 60, 0, 0, "unchanged", False)}
    sites = table(spark, "id string, org_id int, name string, archived_at timestamp, created_at timestamp", ("a", 1, "A", None, day(1)), ("b", 1, "B", None, day(2)), ("d", 1, "D", None, day(3)), ("c", 1, "C", day(9), day(4)))
    assert [tuple(r)[:6] for r in reports.site_rollup(sites, scans, ledger).collect()] == [("d", 1, "D", None, None, 0), ("b", 1, "B", 50, day(2), 1), ("a", 1, "A", 80, day(6), 2)]


def test_groups_and_teasers(spark):
    kind = "scan string, page_id int, node_id int, rule_id string, impact string, tier string, css_path string"
    rows = [("s", 1, i, f"r{k}", ("minor", "critical", "serious")[k % 3], "definite" if k < 4 else "review", "p") for k in range(11) for i in range(k + 1)]
    found = table(spark, kind, *rows)
    got = reports.teaser(found, "scan").first()
    assert got.shown == ["r10", "r7", "r4"] and got.hidden_groups == 8 and got.hidden_items == 66 - 24 and got.hidden_names == ["r1", "r8", "r5", "r2", "r9", "r6"]
    groups = reports.group_by_rule(found)
    assert tuple(reports.tier_counts(groups).first()) == (66, 10, 56, 0)
    assert reports.of_tier(groups, "definite").count() == 4 and reports.of_tier(groups, "odd").count() == 11
    assert tuple(reports.tier_counts(groups.where("false")).first()) == (0, 0, 0, 0)


def test_plans_and_rates(spark):
    plans = table(spark, "url string, automatic int, manual int", ("b", 1, 0), ("a", 1, 5), ("c", 4, 0), ("d", 0, 0))
    assert [r.url for r in reports.plans_of_scan(plans).collect()] == ["c", "a", "b"] and tuple(reports.plan_totals(plans).first()) == (6, 5)
    events = table(spark, "name string", *[("public_scan_completed",)] * 8, ("public_scan_email_captured",), ("login",))
    assert reports.capture_rate(events).first().rate == "13%" and reports.capture_rate(events.where("name = 'login'")).first().rate == "—"


def test_remediation_says_what_is_left(spark):
    html = '<p tabindex="4">x</p><img src="a"><p>y</p>'
    pages = table(spark, "page_id long, url string, html string", (1, "https://a.example/shop/x.html", html), (2, "https://a.example/", "<p>x"))
    found = rules.find_all(html_elements(pages).cache(), pages)
    plan = {r.page_id: r for r in remediation.remediation_plan(pages, found).collect()}
    assert plan[1].filename == "shop/x.html" and plan[2].filename == "index.html" and plan[1].diff.startswith("--- a/shop/x.html")
    assert 'tabindex="0"' in plan[1].patched and plan[1].automatic == 1 and any(a.startswith("tabindex-positive|") for a in plan[1].applied)
    # the page has no html tag, so its missing language is certain but no edit can be built
    assert any(s.startswith("html-has-lang|") for s in plan[1].skipped)
    left = {(g.rule_id, g.strategy) for g in plan[1].guidance}
    assert ("img-alt", "set-attribute") in left and ("html-has-lang", "set-attribute") in left and len(plan[1].guidance) == plan[1].manual
    inside = remediation.edit_of("<body>\n    <p>", {"fix": {"strategy": "insert-first-child", "value": "<a>", "tier": "review"}, "start_off": 0, "end_off": 6, "elem_end_off": None})
    assert inside == (6, 6, "\n    <a>")


def test_rules_can_be_added(spark):
    rules.register(rules.Rule("no-center", "1.4.8", "AAA", "minor", rules.ADVISORY, "Centred text", "tag = 'center'"))
    rules.register(rules.Rule("has-body", "1.1.1", "A", "minor", rules.REVIEW, "Body"), lambda e: rules.findings_of(e.where("tag = 'body'"), "has-body"))
    try:
        frame = table(spark, "page_id long, url string, html string", (1, "https://a.example/", "<center>x</center>"))
        found = {r.rule_id for r in rules.find_all(html_elements(frame).cache(), frame).collect()}
        assert {"no-center", "has-body"} <= found
        for bad in (rules.Rule("img-alt", "1", "A", "minor", rules.REVIEW, "x", "true"), rules.Rule("new", "1", "A", "minor", rules.REVIEW, "x")):
            with pytest.raises(ValueError):
                rules.register(bad)
    finally:
        rules.unregister("no-center")
        rules.unregister("has-body")
    assert len(rules.RULES) == 69


def test_words(spark):
    now = dt.datetime(2024, 3, 1, 12)
    ago = lambda **d: now - dt.timedelta(**d)
    cases = {None: "never", ago(seconds=20): "just now", ago(seconds=-20): "in under a minute", ago(minutes=5, seconds=31): "6m ago", ago(minutes=-90): "in 2h", ago(hours=23, minutes=40): "1d ago", ago(days=29): "29d ago", ago(days=31): "Jan 30, 2024"}
    df = table(spark, "t timestamp", *((k,) for k in cases)).select("t", text.relative_time(F.col("t"), F.lit(now).cast("timestamp")).alias("w"))
    assert {r.t: r.w for r in df.collect()} == cases
    left = table(spark, "t timestamp", (ago(hours=-1),), (ago(hours=30),), (ago(days=-14),), (None,)).select(text.days_left(F.col("t"), F.lit(now).cast("timestamp")).alias("d"))
    assert [r.d for r in left.collect()] == [1, 0, 14, None]
    one = spark.range(1).select(
        text.plural(F.lit(1), "issue").alias("a"), text.plural(F.lit(0), "issue").alias("b"), text.patch_filename(F.lit("https://a.example")).alias("c"),
        F.transform(F.array(*map(F.lit, ("--- a", "+++ b", "@@ -1", "+x", "-y", " z"))), text.diff_class).alias("d"), text.long_date(F.lit(now)).alias("e"),
    ).first()
    assert tuple(one) == ("1 issue", "0 issues", "index.html", ["meta", "meta", "meta", "add", "del", "ctx"], "March 1, 2024")
    mails = table(spark, "e string", ("a@b.co",), ("a b@c.co",), ("a@b",), ("a@b.c",), (None,)).select(text.valid_email(F.col("e")).alias("ok"))
    assert [r.ok for r in mails.collect()] == [True, False, False, False, False]
    words = table(spark, "p string", ("Password123",), ("short",), ("x" * 201,), ("good enough words",), (None,)).select(text.password_fault(F.col("p")).alias("f"))
    assert [r.f for r in words.collect()] == ["common", "short", "long", None, "short"]


def test_logs_hide_secrets(spark):
    deep = '{"a":{"b":{"c":{"d":{"e":{"token":"kept"}}}}}}'
    df = table(spark, "j string", ('{"Token":"x","tokens":1,"list":[{"api_key":"k"}],"n":{"password":"p"}}',), (deep,), ("no json",), (None,))
    got = [r.s for r in df.select(reports.scrub_json(F.col("j")).alias("s")).collect()]
    assert got == ['{"Token":"[redacted]","tokens":1,"list":[{"api_key":"[redacted]"}],"n":{"password":"[redacted]"}}', deep, "no json", None]
    m = spark.range(1).select(reports.scrub(F.create_map(F.lit("cookie"), F.lit("x"), F.lit("cookies"), F.lit("y"))).alias("m")).first().m
    assert m == {"cookie": "[redacted]", "cookies": "y"}


def test_several_tables_change_at_once(spark, tmp_path):
    from tessera.sinks.store import Store

    store, kind = Store(spark, str(tmp_path / "s")), "id int"
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], kind)
    read = lambda name, *n: sorted(r.id for r in store.at(name, kind, *n).collect())
    assert read("a") == []
    assert store.commit({"a": rows(1), "b": rows(10)}) == 1
    # a writer that dies between its tables shows nothing
    store.replace("a", rows(5), keep=9)
    assert read("a") == [1] and read("b") == [10]
    assert store.commit({"b": rows(20, 21)}) == 2
    assert read("a") == [1] and read("b") == [20, 21] and read("b", 1) == [10]


def test_command_line(spark, tmp_path, capsys):
    from tessera.__main__ import main

    pages, out = str(tmp_path / "pages"), str(tmp_path / "out")
    spark.createDataFrame([(k, f"https://a.example/{k}", '<img src="x">' * 4) for k in range(3)], "page_id long, url string, html string").write.parquet(pages)
    assert main([pages, "--fix", "--out", out], spark) == 1
    text = capsys.readouterr().out
    assert text.startswith("3 pages, score ") and "Image has no alternative text (12x, 1.1.1)" in text and "and 9 more" in text
    assert spark.read.parquet(f"{out}/findings").where("rule_id = 'img-alt'").count() == 12 and spark.read.parquet(f"{out}/plans").count() == 3
    assert main([pages, "--json"], spark) == 1
    assert sum('"rule_id":"img-alt"' in x for x in capsys.readouterr().out.splitlines()) == 12
    assert main([str(tmp_path / "absent")], spark) == 2


def test_slugs_of_many_equal_names_hold_no_lists(spark):
    """The n-th free number comes from a running count; a list of the numbers up to n for each name is quadratic."""
    taken = ["acme", "acme-3", "acme-3", "acme-4", "acme-9", "acme-0", "acme-07", "other-2"]
    names = spark.range(1, 41).select("id", F.lit("Acme").alias("name"))
    slugs = accounts.unique_slugs(names, table(spark, "slug string", *((x,) for x in taken)))
    plan = slugs._jdf.queryExecution().analyzed().toString()
    assert "sequence(" not in plan and "collect_set" not in plan
    free = [n for n in range(2, 99) if f"acme-{n}" not in taken]
    assert [r.slug for r in slugs.orderBy("id").collect()] == [f"acme-{n}" for n in free[:40]]


def test_a_large_table_is_dealt_out_by_its_bytes(spark, tmp_path, monkeypatch):
    """One file of one row group, which would be one task's work."""
    rows = spark.range(2000).select(F.col("id").alias("page_id"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    size = sum(f.stat().st_size for f in (tmp_path / "pages.parquet").iterdir() if not f.name.endswith(".crc"))
    monkeypatch.setattr(tables, "SPREAD_BYTES", 1000)
    dealt = tables.read_table(spark, str(tmp_path), "pages", True, 10_000)
    assert dealt.rdd.getNumPartitions() == -(-size // 10_000) > 4
    assert max(dealt.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()) < 300
    assert sorted(dealt.collect()) == sorted(rows.collect())
    assert tables.read_table(spark, str(tmp_path), "pages", True).rdd.getNumPartitions() < 4  # for other callers it lies as it lay


def test_links_of_several_targets_are_shuffled_before_they_are_put_together(spark):
    rows = [(1, "a", "/x", 5), (1, "a", "/y", 7), (1, "a", "/x", 3), (1, "b", "/x", 1), (1, "b", "/x", 2), (2, "a", None, 1), (2, "a", "/x", 4), (3, "c", None, 1), (3, "c", "/x", 2), (3, "c", "/y", 3)]
    links = spark.createDataFrame(rows, "page_id long, k string, href string, node_id int")
    found = rules.several_targets(links, ["page_id", "k"])
    assert rows_of(found) == [(1, "a", 2, 3), (3, "c", 2, 1)]
    lines = found._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert "HashAggregate" not in "".join(lines[max(i for i, x in enumerate(lines) if "Exchange" in x) :])
