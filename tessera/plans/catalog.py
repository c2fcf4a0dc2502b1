"""Registered queries of the conformance engine and the SQL they must equal.

The driver's tables stand in for the engine's own: orders for scans (status,
priority, time), lineitem for findings (return flag for the tier, line status
for the state), customer for sites, nation for organisations, part for the
rule catalog, events for the event log, pages for crawled pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import color, text
from tessera.functions.scratch import materialise, scratch_path
from tessera.operators import frontier, ledger, remediation, reports, rules, scoring
from tessera.sources.html import html_elements
from tessera.sources.tables import read_table
from tessera.streaming import jobs, progress, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PARSED_BYTES = 2 << 20  # of pages, as they lie in the table, that one task parses: some 10 s
c = F.col


def query(sql: str | None = None):
    """Registers a function of (table reader) under its name, with its SQL if it has one."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name, spread=False: read_table(spark, sf_dir, name, spread, PARSED_BYTES))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def money(x: Column) -> Column:
    """Exact sums whatever the order of rows."""
    return x.cast("decimal(18,2)")


# the flagship: pages to elements to findings to scores
def _analysed(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Elements are written down once: five rule passes read them, a few columns each."""
    pages = t("pages", spread=True)
    elements = materialise(html_elements(pages), "elements")
    return pages, elements, rules.find_all(elements, pages)


# These tables' pages break four rules, all told by their source; other findings would show as a difference.
PAGE_PATH = r"coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), ''), '/')"
FOUND_SQL = rf"""
with links as (select page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) as link, unnest(range(1, 1 + len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')))) as k from pages),
named as (select *, lower(trim(replace(regexp_extract(link, '>([^<]*)<', 1), '&amp;', '&'))) as name, split_part(regexp_extract(link, '"([^"]*)"', 1), '#', 1) as href from links),
twice as (select page_id, name as key, min(k) as k, arg_min(link, k) as link from named where length(name) >= 3 group by all having count(distinct href) >= 2),
skips as (select page_id, count(*) as n, count(*) filter (k <= 5 and link like '%"#%' and regexp_matches(name, 'skip|jump')) as s from named group by 1),
found as (
  select page_id, 'landmark-main' as rule_id, 'moderate' as impact, 'body' as css_path, strpos(html, '<body') as col, null as key from pages where not regexp_matches(html, '(?i)<main[ >]|role="main"')
  union all select page_id, 'viewport-missing', 'moderate', 'head', strpos(html, '<head'), null from pages where not regexp_matches(html, '(?i)<meta[^>]+name="viewport"')
  union all select page_id, 'skip-link', 'serious', 'body', strpos(html, '<body'), null from pages left join skips using (page_id) where (html like '%<nav%' or n >= 10) and coalesce(s, 0) = 0
  union all select page_id, 'link-same-name-different-target', 'moderate', 'body > nav > ul > li:nth-of-type(' || k || ') > a', strpos(html, link), key from twice join pages using (page_id)),
f as (select found.*, 'review' as tier, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as site, case impact when 'serious' then 20 else 8 end as tenths,
  substr(sha1(rule_id || '|' || {PAGE_PATH} || '|' || css_path || '|' || coalesce(key, '')), 1, 20) as signature from found join pages using (page_id))
"""
COUNTS_SQL = ", ".join(f"count(*) filter ({k} = '{x}') as {x}" for k, xs in (("impact", scoring.IMPACTS), ("tier", scoring.TIERS)) for x in xs)
SCORE_SQL = "cast(floor(100 / (1 + sum(tenths) / 200.0::double) + 0.5) as int)"


@query(FOUND_SQL + f"""
, s as (select page_id, count(*) as total, {COUNTS_SQL}, {SCORE_SQL} as score from f group by 1)
select page_id, url, {", ".join(f"coalesce({x}, 0) as {x}" for x in ("total", *scoring.IMPACTS, *scoring.TIERS))}, coalesce(score, 100) as score from pages left join s using (page_id)
""")
def page_scores(t):
    pages, _, found = _analysed(t)
    return scoring.page_results(pages, found)


@query(FOUND_SQL + "select page_id, rule_id, impact, tier, css_path, 1 as line, cast(col as int) as col, key, signature from f")
def page_findings(t):
    _, _, found = _analysed(t)
    return found.select("page_id", "rule_id", "impact", "tier", "css_path", "line", "col", "key", "signature")


@query()
def page_elements(t):
    return html_elements(t("pages", spread=True)).select("page_id", "node_id", "parent_id", "depth", "tag", "css_path", "role", "acc_name", "hidden_deep", "focusable")


@query(r"""
with p as (select page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)(<(?:script|style|title)[^>]*>).*?</', '\1</', 'g') as html from pages),
e as (select page_id, lower(unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1))) as tag from p) select tag, count(*) as n, count(distinct page_id) as pages from e group by 1
""")
def element_tags(t):
    return html_elements(t("pages", spread=True)).groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query(r"""
with p as (select page_id, html, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style|title)[^>]*>.*?</(script|style|title)>', '', 'g') as body from pages),
s as (select page_id, length(trim(regexp_replace(replace(regexp_replace(body, '<[^>]*>', '', 'g'), '&amp;', '&'), '\s+', ' ', 'g'))) as chars, len(regexp_extract_all(body, '<[a-zA-Z]')) as elements,
  regexp_matches(body, '\sid="(root|app|__next|__nuxt|gatsby-focus-wrapper)"') as shell, regexp_matches(html, '<script[^>]*\ssrc=') as scripts from p),
m as (select page_id, case when chars < 200 and elements < 60 and (shell or scripts) then 'client-rendered' when shell and chars < 800 then 'partial' else 'static' end as mode from s)
select page_id, mode, mode = 'static' as complete from m
""")
def page_coverage(t):
    return scoring.coverage(html_elements(t("pages", spread=True)))


@query(FOUND_SQL + f"select site, count(*) as total, {COUNTS_SQL}, {SCORE_SQL} as score from f group by 1")
def site_totals(t):
    _, _, found = _analysed(t)
    site = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return scoring.totals(found.withColumn("site", site), "site")


@query(FOUND_SQL + "select rule_id, impact, tier, arg_min(css_path, page_id) as example, count(*) as items, count(distinct page_id) as pages from f group by all")
def rule_report(t):
    _, _, found = _analysed(t)
    return reports.group_by_rule(found)


CRITERIA_SQL = ", ".join(f"('{i}', '{level}', '{auto}', [{', '.join(repr(x) for x in names)}]::varchar[])" for i, level, auto, names in scoring.criterion_rules())


@query(FOUND_SQL + f"""
, k(criterion, level, automated, rules) as (values {CRITERIA_SQL}),
n as (select k.criterion, k.level, k.automated, (select count(*) from f where list_contains(k.rules, f.rule_id)) as reviews from k)
select criterion, level, automated, 0::bigint as failures, reviews, case when automated = 'none' then 'Not Evaluated' when reviews > 0 then 'Partially Supports'
  when automated = 'full' then 'Supports' else 'Needs Manual Review' end as verdict from n
""")
def conformance(t):
    _, _, found = _analysed(t)
    return scoring.conformance(found)


@query(FOUND_SQL + """
select page_id, coalesce(nullif(substr(""" + PAGE_PATH + """, 2), ''), 'index.html') as filename, 0 as n_applied, 0 as n_skipped, 0 as automatic, cast(count(f.rule_id) as int) as manual,
  array_to_string(list(rule_id order by rule_id) filter (rule_id is not null), ',') as left_to_people, sha256(html) as patched_sha256, sha256('') as diff_sha256
from pages left join f using (page_id, url) group by page_id, url, html
""")
def remediation_plans(t):
    pages, _, found = _analysed(t)
    rows = remediation.remediation_plan(pages, found)
    left = F.array_join(F.sort_array(F.transform("guidance", lambda g: g["rule_id"])), ",")
    return rows.select(
        "page_id", "filename", F.size("applied").alias("n_applied"), F.size("skipped").alias("n_skipped"), "automatic", "manual", left.alias("left_to_people"),
        F.sha2("patched", 256).alias("patched_sha256"), F.sha2("diff", 256).alias("diff_sha256"),
    )


@query(r"""
with x as (select page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as origin, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as link from pages)
select distinct page_id, case when link like '/%' then origin || split_part(link, '#', 1) else split_part(link, '#', 1) end as link from x
where (link like '/%' or starts_with(link, origin || '/')) and not regexp_matches(split_part(split_part(link, '#', 1), '?', 1), '(?i)\.(pdf|zip|png|jpe?g|gif|svg|webp|avif|ico|css|js|mjs|json|xml|txt|mp[34]|webm|mov|avi|woff2?|ttf|eot|docx?|xlsx?|pptx?|gz|tar|dmg|exe)$')
""")
def page_links(t):
    return frontier.extract_links(t("pages", spread=True))


@query("select 50 as total, 2 as full, 25 as partial, 23 as none, 54 as tested_percent")
def coverage_stats(t):
    return scoring.coverage_stats(t("region").sparkSession)


@query(r"""
with x as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as link from pages)
select distinct page_id, link from x where not regexp_matches(link, '^(#|mailto:|tel:|javascript:|data:)') and link <> ''
""")
def raw_links(t):
    return t("pages").select("page_id", F.explode_outer(frontier.raw_links(c("html"))).alias("link")).where("link is not null")


@query(r"""
select page_id, case when regexp_matches(html, '(?i)<meta[^>]+name="viewport"') then 0 else 1 end as viewport_missing,
  case when regexp_matches(html, '(?i)<main[ >]') then 0 else 1 end as main_missing,
  case when regexp_matches(html, '<html[^>]* lang="[^"]+"') then 0 else 1 end as lang_missing from pages
""")
def page_rule_flags(t):
    _, elements, _ = pages = _analysed(t)
    found = rules.page_findings(elements)
    flags = found.groupBy("page_id").agg(*(F.max((c("rule_id") == r).cast("int")).alias(a) for r, a in (("viewport-missing", "viewport_missing"), ("landmark-main", "main_missing"), ("html-has-lang", "lang_missing"))))
    return pages[0].select("page_id").join(flags, "page_id", "left").select("page_id", *(F.coalesce(a, F.lit(0)).alias(a) for a in ("viewport_missing", "main_missing", "lang_missing")))


# urls
PATH = r"case when regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) end"


@query(rf"""
with p as (select page_id, {PATH} as p from pages)
select page_id, case when regexp_replace(p, '/$', '') = '' then '/' else regexp_replace(p, '/$', '') end as path from p
""")
def url_paths(t):
    return t("pages").select("page_id", text.path_of(c("url")).alias("path"))


SHAPE = r"""'/' || array_to_string(list_transform(list_filter(string_split(p, '/'), lambda s: s <> ''),
  lambda s: case when regexp_matches(s, '^\d+$') or length(s) > 24 then ':id' else s end), '/')"""


@query(rf"""
with p as (select {PATH} as p from pages) select {SHAPE} as shape, count(*) as n from p group by 1
""")
def path_shapes(t):
    return t("pages").groupBy(text.path_shape(c("url")).alias("shape")).agg(F.count("*").alias("n"))


@query(rf"""
with p as (select page_id, url, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) as site, {PATH} as p from pages),
s as (select page_id, url, site, p, {SHAPE} as shape, len(list_filter(string_split(p, '/'), lambda s: s <> '')) as depth from p),
n as (select *, row_number() over (partition by site, shape order by page_id, url) - 1 as seen from s),
q as (select page_id, site, shape, cast(depth * 10 + case when seen > 0 then 200 + seen * 40 else 0 end + case when regexp_matches(url, '\?[^#]') then 30 else 0 end
  - case when regexp_matches(p, '(?i)(checkout|cart|payment|account|login|signup|register|contact|search|booking|apply)') then 60 else 0 end
  - case when depth = 0 then 100 else 0 end as int) as priority, url from n)
select page_id, shape, priority, cast(row_number() over (partition by site order by priority, page_id, url) as int) as position from q qualify position <= 25
""")
def crawl_frontier(t):
    """The first 25 addresses of each site."""
    urls = t("pages").select(frontier.origin_of(c("url")).alias("site_id"), "url", c("page_id").alias("seq"))
    return frontier.crawl_order(urls, 25).select(c("seq").alias("page_id"), "shape", "priority", "position")


@query(rf"""
with p as (select page_id, {PATH} as p from pages) select page_id, substr(sha1('img-alt' || '|' || p || '|' || 'body > img' || '|' || ''), 1, 20) as signature from p
""")
def signatures(t):
    return t("pages").select("page_id", text.signature(F.lit("img-alt"), c("url"), F.lit("body > img"), F.lit(None).cast("string")).alias("signature"))


ROBOTS = "User-agent: *\nDisallow: /en/1\nAllow: /en/11\nDisallow: /de\n# note\nUser-agent: other\nDisallow: /\n"


@query(rf"""
with p as (select page_id, {PATH} as p from pages),
r(ord, allow, prefix) as (values (1, false, '/en/1'), (2, true, '/en/11'), (3, false, '/de') union all select page_id + 10, page_id % 2 = 0, '/en/' || page_id from pages),
h as (select page_id, allow, row_number() over (partition by page_id order by length(prefix) desc, ord) as n from p join r on starts_with(p, prefix))
select p.page_id, coalesce(h.allow, true) as allowed from p left join (select * from h where n = 1) h on p.page_id = h.page_id
""")
def robots_allowed(t):
    files = t("pages").sparkSession.createDataFrame([("o", ROBOTS)], "origin string, body string")
    paths = t("pages").select("page_id", F.lit("o").alias("origin"), text.url_path(c("url")).alias("path"))
    # and a rule for each page, all of one origin
    rules = frontier.robots_rules(files, "ourbot")
    more = t("pages").select(F.lit("o").alias("origin"), (c("page_id") + 10).alias("ord"), (c("page_id") % 2 == 0).alias("allow"), F.concat(F.lit("/en/"), "page_id").alias("prefix"))
    ok = frontier.robots_allowed(paths.select("origin", "path").distinct(), rules.unionByName(more))
    return paths.join(ok, ["origin", "path"]).select("page_id", "allowed")


# joins
@query("""
select l_returnflag as tier, o_orderstatus as status, count(*) as n, sum(cast(l_extendedprice as decimal(18,2))) as price
from lineitem join orders on l_orderkey = o_orderkey group by all
""")
def findings_with_scans(t):
    rows = t("lineitem").join(t("orders"), c("l_orderkey") == c("o_orderkey"))
    return rows.groupBy(c("l_returnflag").alias("tier"), c("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum(money(c("l_extendedprice"))).alias("price"))


@query("select l_partkey as signature, max(o_orderdate) as last_seen from lineitem join orders on l_orderkey = o_orderkey group by 1")
def last_seen(t):
    rows = t("lineitem").select("l_orderkey", "l_partkey").join(t("orders").select("o_orderkey", "o_orderdate"), c("l_orderkey") == c("o_orderkey"))
    return rows.groupBy(c("l_partkey").alias("signature")).agg(F.max("o_orderdate").alias("last_seen"))


@query("select event_id, event_type, c_name from events left join customer on user_id = c_custkey")
def events_with_owner(t):
    return t("events").join(t("customer"), c("user_id") == c("c_custkey"), "left").select("event_id", "event_type", "c_name")


@query("""
select o_orderstatus as status, n_name as org, count(*) as n from orders left join customer on o_custkey = c_custkey
left join nation on c_nationkey = n_nationkey group by all
""")
def requests_by_org(t):
    sites = t("customer").select(c("c_custkey").alias("id"), c("c_nationkey").alias("name"))
    rows = reports.with_names(t("orders").select("o_orderstatus", "o_custkey"), org_id=(sites, "o_custkey"))
    rows = reports.with_names(rows, org=(t("nation").select(c("n_nationkey").alias("id"), c("n_name").alias("name")), "org_id"))
    return rows.groupBy(c("o_orderstatus").alias("status"), "org").agg(F.count("*").alias("n"))


@query("select c_custkey as site from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def sites_never_scanned(t):
    return t("customer").join(t("orders"), c("c_custkey") == c("o_custkey"), "left_anti").select(c("c_custkey").alias("site"))


@query("select c_custkey as site from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def sites_with_finished_scan(t):
    return t("customer").join(t("orders").where("o_orderstatus = 'F'"), c("c_custkey") == c("o_custkey"), "left_semi").select(c("c_custkey").alias("site"))


@query("""
select o_custkey as site, o_orderkey as scan, o_orderstatus as status from orders
qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1
""")
def latest_scan(t):
    rows = reports.latest(t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey"))
    return rows.select(c("o_custkey").alias("site"), c("o_orderkey").alias("scan"), c("o_orderstatus").alias("status"))


@query("""
with last as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders)
select a.o_custkey as site, a.o_orderkey as scan, b.o_orderkey as other from last a left join last b on a.o_custkey = b.o_custkey and b.n = 2 where a.n = 1
""")
def newest_other_scan(t):
    scans = t("orders").select(c("o_orderkey").alias("id"), c("o_custkey").alias("site_id"), F.lit("complete").alias("status"), F.lit(0).alias("score"), c("o_orderdate").alias("created_at"))
    last = reports.latest(scans, "site_id", F.desc("created_at"), F.desc("id"))
    return reports.newest_other(scans, last).select(c("site_id").alias("site"), c("scan_id").alias("scan"), "other")


@query("select count(*) as n from orders where o_orderdate >= (select max(o_orderdate) - interval 30 day from orders)")
def new_since_scan(t):
    start = t("orders").agg((F.max("o_orderdate") - F.expr("interval 30 days")).alias("start"))
    return t("orders").join(F.broadcast(start), c("o_orderdate") >= c("start")).agg(F.count("*").alias("n"))


LEDGER_SQL = """
with f as (select distinct l_suppkey as site, l_partkey as sig from lineitem where l_returnflag = 'R'),
led as (select l_suppkey as site, l_partkey as sig, case when min(l_linenumber) = 1 then 'open' when min(l_linenumber) = 2 then 'resolved' else 'wontfix' end as status
  from lineitem where l_returnflag <> 'N' group by all),
cov as (select distinct s_suppkey as site from supplier where s_suppkey % 2 = 0)
select coalesce(led.site, f.site) as site_id, coalesce(led.sig, f.sig) as signature,
  case when led.site is null or (f.site is not null and status = 'resolved') then 'open'
    when f.site is null and status = 'open' and cov.site is not null then 'resolved' else status end as status
from led full join f on led.site = f.site and led.sig = f.sig left join cov on cov.site = coalesce(led.site, f.site)
"""


@query(LEDGER_SQL)
def ledger_reconcile(t):
    items = t("lineitem").select(c("l_suppkey").alias("site_id"), c("l_partkey").alias("signature"), "l_returnflag", "l_linenumber")
    now, none = F.timestamp_seconds(F.lit(0)), F.lit(None).cast("timestamp")
    first = F.min("l_linenumber")
    status = F.when(first == 1, "open").when(first == 2, "resolved").otherwise("wontfix")
    state = items.where("l_returnflag <> 'N'").groupBy("site_id", "signature").agg(status.alias("status"))
    state = state.withColumns({"first_seen_at": now, "last_seen_at": now, "resolved_at": none, "resolved_scan_id": F.lit(None).cast("string")})
    url = F.concat(F.lit("https://s.example/"), c("site_id").cast("string"))
    history = items.select("site_id", "signature", url.alias("page_url"))
    pages = t("supplier").where("s_suppkey % 2 = 0").select(c("s_suppkey").alias("site_id"), F.concat(F.lit("https://s.example/"), c("s_suppkey").cast("string")).alias("url"), F.lit(None).cast("string").alias("error"))
    return ledger.reconcile(state, items.where("l_returnflag = 'R'"), history, pages, "s", now).select("site_id", "signature", "status")


# aggregations
@query("""
with e as (select count(*) filter (event_type = 'view') a, count(*) filter (event_type = 'click') b, count(*) filter (event_type = 'signup') c,
  count(*) filter (event_type = 'purchase') d from events where ts >= timestamp '2024-01-10')
select a as visits, b as started, c as signed, d as paid, case when b > 0 then floor(c / b * 100 * 10 + 0.5) / 10 else 0 end as signup_rate,
  case when c > 0 then floor(d / c * 100 * 10 + 0.5) / 10 else 0 end as paid_rate from e
""")
def funnel(t):
    events = t("events").select(c("event_type").alias("name"), c("ts").alias("created_at"))
    return reports.funnel(events, F.lit("2024-01-10").cast("timestamp"), ("view", "click", "signup", "purchase"))


@query("""
select (select count(*) from customer) as sites, (select count(*) from orders) as scans, (select count(*) from lineitem) as findings,
  (select count(distinct user_id) from events) as users
""")
def headline_counts(t):
    parts = [t("customer").agg(F.count("*").alias("sites")), t("orders").agg(F.count("*").alias("scans")), t("lineitem").agg(F.count("*").alias("findings")), t("events").agg(F.count_distinct("user_id").alias("users"))]
    out = parts[0]
    for more in parts[1:]:
        out = out.join(F.broadcast(more))  # single rows
    return out


@query("""
select l_suppkey as site_id, count(*) filter (l_linestatus = 'O') as open, 0::bigint as in_progress, count(*) filter (l_linestatus = 'F') as resolved,
  0::bigint as wontfix, 0::bigint as false_positive from lineitem group by 1
""")
def ledger_status_counts(t):
    status = F.when(c("l_linestatus") == "O", "open").otherwise("resolved")
    return ledger.status_counts(t("lineitem").select(c("l_suppkey").alias("site_id"), status.alias("status")))


@query("""
with k(ord, status) as (values (0, 'new'), (1, 'contacted'), (2, 'scoping'), (3, 'quoted'), (4, 'in_progress'), (5, 'delivered'), (6, 'closed')),
r as (select case o_orderstatus when 'O' then 'new' when 'F' then 'closed' else 'quoted' end as status, cast(floor(o_totalprice) as bigint) as v from orders)
select k.ord, k.status, count(r.status) as n, coalesce(sum(v), 0)::bigint as value from k left join r on k.status = r.status group by all
""")
def service_pipeline(t):
    status = F.when(c("o_orderstatus") == "O", "new").when(c("o_orderstatus") == "F", "closed").otherwise("quoted")
    return reports.service_pipeline(t("orders").select(status.alias("status"), F.floor("o_totalprice").alias("quoted_amount")))


@query("select l_partkey as rule_id, count(*) as n, count(distinct l_suppkey) as sites from lineitem group by 1 order by n desc, rule_id limit 12")
def top_issues(t):
    return reports.top_issues(t("lineitem").select(c("l_partkey").alias("rule_id"), c("l_suppkey").alias("site_id")))


@query("""
with o as (select case c_mktsegment when 'BUILDING' then 'free' when 'MACHINERY' then 'scale' when 'AUTOMOBILE' then 'growth' else 'starter' end as plan from customer),
p(plan, price) as (values ('free', 0), ('starter', 79), ('growth', 249), ('scale', 749))
select sum(price)::bigint as mrr, count(*) filter (price > 0) as paying from o join p using (plan)
""")
def recurring_revenue(t):
    plan = F.when(c("c_mktsegment") == "BUILDING", "free").when(c("c_mktsegment") == "MACHINERY", "scale").when(c("c_mktsegment") == "AUTOMOBILE", "growth").otherwise("starter")
    return reports.recurring_revenue(t("customer").select(plan.alias("plan")))


@query("select o_custkey as org, strftime(o_orderdate, '%Y-%m') as period, count(*) as scans from orders group by all")
def monthly_usage(t):
    return t("orders").groupBy(c("o_custkey").alias("org"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count("*").alias("scans"))


@query("select o_orderkey as page, count(l_orderkey) as n from orders left join (select * from lineitem where l_returnflag = 'R') on l_orderkey = o_orderkey group by 1")
def findings_per_page(t):
    some = t("lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    return t("orders").join(some, c("o_orderkey") == c("l_orderkey"), "left").select(c("o_orderkey").alias("page"), F.coalesce("k", F.lit(0)).alias("n"))


@query("""
select n_nationkey as org, n_name as name, (select count(*) from customer where c_nationkey = n_nationkey) as sites,
  (select count(*) from supplier where s_nationkey = n_nationkey) as users,
  (select count(*) from orders join customer on o_custkey = c_custkey where c_nationkey = n_nationkey) as scans,
  (select max(o_orderdate) from orders join customer on o_custkey = c_custkey where c_nationkey = n_nationkey) as last_activity from nation
""")
def org_rollup(t):
    orgs = t("nation").select(c("n_nationkey").alias("id"), c("n_name").alias("name"))
    sites = t("customer").select(c("c_custkey").alias("id"), c("c_nationkey").alias("org_id"))
    users = t("supplier").select(c("s_nationkey").alias("org_id"))
    scans = t("orders").select(c("o_custkey").alias("site_id"), c("o_orderdate").alias("created_at")).join(sites.withColumnRenamed("id", "site_id"), "site_id")
    return reports.org_rollup(orgs, sites, users, scans).select(c("id").alias("org"), "name", "sites", "users", "scans", "last_activity")


IMPACT = "case l_linenumber when 1 then 'critical' when 2 then 'serious' when 3 then 'moderate' else 'minor' end"
TIER = "case l_returnflag when 'R' then 'definite' when 'A' then 'review' else 'advisory' end"
SCORED = f"""
with f as (select l_orderkey as scan, l_suppkey as site, {IMPACT} as impact, {TIER} as tier from lineitem),
w as (select *, case impact when 'critical' then 10 when 'serious' then 5 when 'moderate' then 2 else 1 end * case tier when 'definite' then 10 when 'review' then 4 else 0 end as p from f)
"""


def row_place() -> Column:
    """A row's place in its table, which tells rows of one key apart."""
    return F.struct("_metadata.file_path", "_metadata.row_index")


def _as_findings(t) -> DataFrame:
    return t("lineitem").select(
        row_place().alias("seq"),
        c("l_orderkey").alias("scan"), c("l_suppkey").alias("site"), c("l_suppkey").alias("site_id"), c("l_partkey").alias("signature"),
        c("l_orderkey").alias("page_id"), c("l_linenumber").alias("node_id"), c("l_partkey").cast("string").alias("rule_id"),
        F.expr(IMPACT).alias("impact"), F.expr(TIER).alias("tier"), F.concat(F.lit("p"), c("l_linenumber").cast("string")).alias("css_path"),
    )


def _totals_sql(by: str) -> str:
    counts = ", ".join([f"count(*) filter (impact = '{x}') as {x}" for x in scoring.IMPACTS] + [f"count(*) filter (tier = '{x}') as {x}" for x in scoring.TIERS])
    return SCORED + f"select {by}, count(*) as total, {counts}, cast(floor(100 / (1 + sum(p) / 200.0::double) + 0.5) as int) as score from w group by 1"


@query(f"""
with f as (select cast(l_partkey % 13 as varchar) as rule_id, l_orderkey as page_id, l_linenumber as node_id, {IMPACT} as impact from lineitem),
g as (select rule_id, count(*) as items, arg_min(impact, page_id * 100 + node_id) as impact from f group by 1),
p as (select rule_id, items, row_number() over (order by case impact when 'critical' then 0 when 'serious' then 1 when 'moderate' then 2 else 3 end, items desc, rule_id) as place from g),
n as (select *, row_number() over (partition by rule_id order by page_id, node_id) as nth from f)
select rule_id, cast(place as int) as place, items, cast(nth as int) as nth, page_id, node_id from n join p using (rule_id) where nth <= 3
""")
def report_items(t):
    """The first three findings of each rule, in the order of a report."""
    rows = _as_findings(t).withColumn("rule_id", (c("signature") % 13).cast("string"))
    return reports.grouped_findings(rows, 3).select("rule_id", "place", "items", "nth", "page_id", "node_id")


@query(_totals_sql("scan"))
def scan_totals(t):
    return scoring.totals(_as_findings(t), "scan")


@query(_totals_sql("site"))
def site_scores(t):
    return scoring.totals(_as_findings(t), "site")


@query("""
with d as (select l_suppkey as site, l_returnflag as r, count(*) as n from lineitem group by all)
select site, array_to_string(list(r || '=' || n order by r), ',') as by_rule from d group by 1
""")
def rule_maps(t):
    rows = t("lineitem").select(c("l_suppkey").alias("site"), c("l_returnflag").alias("rule_id"))
    m = F.transform(F.map_entries("by_rule"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return scoring.rule_map(rows, "site").select("site", F.array_join(m, ",").alias("by_rule"))


@query(f"""
with f as (select l_partkey as rule_id, l_orderkey as page_id, l_linenumber as node_id, {IMPACT} as impact from lineitem)
select cast(rule_id as varchar) as rule_id, arg_min(impact, page_id * 100 + node_id) as impact, count(*) as items, count(distinct page_id) as pages from f group by rule_id
""")
def findings_by_rule(t):
    return reports.group_by_rule(_as_findings(t)).select("rule_id", "impact", "items", "pages")


@query("""
with d as (select l_partkey, count(*) filter (l_returnflag = 'R') as f, count(*) filter (l_returnflag = 'A') as r from lineitem group by 1)
select p_partkey as criterion, coalesce(f, 0) as failures, coalesce(r, 0) as reviews, case when p_size % 3 = 0 then 'Not Evaluated' when f > 0 then 'Does Not Support'
  when r > 0 then 'Partially Supports' when p_size % 3 = 1 then 'Supports' else 'Needs Manual Review' end as verdict from part left join d on p_partkey = l_partkey
""")
def criterion_verdicts(t):
    d = t("lineitem").groupBy("l_partkey").agg(F.count_if(c("l_returnflag") == "R").alias("f"), F.count_if(c("l_returnflag") == "A").alias("r"))
    automated = F.element_at(F.array(F.lit("none"), F.lit("full"), F.lit("partial")), c("p_size") % 3 + 1)
    verdict = scoring.verdict(automated, c("f"), c("r"))
    rows = t("part").join(d, c("p_partkey") == c("l_partkey"), "left")
    return rows.select(c("p_partkey").alias("criterion"), F.coalesce("f", F.lit(0)).alias("failures"), F.coalesce("r", F.lit(0)).alias("reviews"), verdict.alias("verdict"))


@query("""
with d as (select epoch_us(o_orderdate) - epoch_us(timestamp '1992-01-01') as us from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 200),
s as (select list(us / 86400e6 order by us) as l from d) select floor(l[len(l) // 2 + 1] * 10 + 0.5) / 10 as median_days from s
""")
def days_to_fix(t):
    rows = t("orders").where("o_orderstatus = 'F'").select(F.lit("resolved").alias("status"), c("o_orderdate").alias("resolved_at"), F.lit("1992-01-01").cast("timestamp").alias("first_seen_at"), c("o_orderkey").alias("signature"))
    return ledger.days_to_fix(rows)


@query("""
with m as (select strftime(o_orderdate, '%Y-%m') as period, count(*) as n from orders group by 1)
select period, n, cast(floor(n * 100 / greatest(1, max(n) over ()) + 0.5) as int) as bar from m
""")
def trend_bars(t):
    m = t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"))
    top = m.agg(F.greatest(F.lit(1), F.max("n")).alias("top"))
    return m.join(F.broadcast(top)).select("period", "n", text.rounded(c("n") * 100 / c("top")).alias("bar"))


@query("""
with e as (select *, row_number() over (partition by user_id order by ts, event_id) as seq from events)
select cast(user_id as varchar) as scan_id, max(seq) as seq, count(*) filter (event_type = 'view') as done, max(event_type = 'error') as ended from e group by 1
""")
def progress_snapshots(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(c("event_type") == "view", "page").when(c("event_type") == "error", "end").otherwise("phase")
    none = F.lit(None)
    rows = t("events").select(c("user_id").cast("string").alias("scan_id"), F.row_number().over(w).alias("seq"), kind.alias("type"), c("event_type").alias("phase"), none.cast("long").alias("planned"), none.cast("string").alias("url"), none.cast("long").alias("findings"))
    return progress.snapshot(rows).select("scan_id", c("seq").cast("long").alias("seq"), "done", "ended")


@query("""
with e as (select *, row_number() over (partition by user_id order by ts, event_id) as seq, count(*) over (partition by user_id) as n from events)
select event_id, user_id as scan_id, seq from e where seq > n - 400
""")
def progress_buffer(t):
    return progress.numbered(t("events").withColumnRenamed("user_id", "scan_id")).select("event_id", "scan_id", c("seq").cast("long").alias("seq"))


@query("select l_orderkey as page, l_partkey as id, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_ids(t):
    return t("lineitem").groupBy(c("l_orderkey").alias("page"), c("l_partkey").alias("id")).agg(F.count("*").alias("n")).where("n > 1")


@query("""
select o_orderkey as scan, case when p is null then 'first' when s > p then 'up ' || (s - p) when s < p then 'down ' || (p - s) else 'unchanged' end as movement from (
select o_orderkey, cast(floor(o_totalprice) as bigint) % 101 as s, lag(cast(floor(o_totalprice) as bigint) % 101) over (partition by o_custkey order by o_orderdate, o_orderkey) as p from orders)
""")
def score_movement(t):
    s = F.floor("o_totalprice") % 101
    rows = t("orders").select("o_orderkey", s.alias("s"), F.lag(s).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("p"))
    move = F.coalesce(reports.movement(c("s"), c("p")), F.lit("first"))
    return rows.select(c("o_orderkey").alias("scan"), move.alias("movement"))


@query("""
select l_orderkey as page, l_linenumber as node, cast(l_quantity as int) % 6 + 1 as level from lineitem
qualify level > lag(cast(l_quantity as int) % 6 + 1) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) + 1
""")
def heading_jumps(t):
    level = c("l_quantity").cast("int") % 6 + 1
    rows = t("lineitem").select(c("l_orderkey").alias("page"), c("l_linenumber").alias("node"), level.alias("rank"), "l_partkey", "l_suppkey")
    return rules.jumps(rows, ["page"], ["node", "l_partkey", "l_suppkey"]).select("page", "node", c("rank").alias("level"))


@query("""
select l_suppkey as page, l_orderkey as node, l_linenumber as line from lineitem
qualify row_number() over (partition by l_suppkey, l_partkey order by l_orderkey, l_linenumber) > 1
""")
def repeated_keys(t):
    rows = rules.repeats(t("lineitem"), ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber"])
    return rows.select(c("l_suppkey").alias("page"), c("l_orderkey").alias("node"), c("l_linenumber").alias("line"))


@query("""
select l_suppkey as page, l_partkey as name, count(distinct l_shipdate) as targets, min(l_orderkey) as first_node from lineitem group by all having count(distinct l_shipdate) >= 2
""")
def names_with_several_targets(t):
    rows = t("lineitem").select(c("l_suppkey").alias("page"), c("l_partkey").alias("name"), c("l_shipdate").alias("href"), c("l_orderkey").alias("node_id"))
    return rules.several_targets(rows, ["page", "name"]).select("page", "name", c("n").alias("targets"), c("node_id").alias("first_node"))


# order and limits
@query(f"""
select l_orderkey as scan, l_linenumber as node, {TIER} as tier, {IMPACT} as impact from lineitem
order by case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end, least(l_linenumber, 4), l_partkey, l_orderkey limit 500
""")
def worst_findings(t):
    rows = _as_findings(t)
    order = [reports.rank(c("tier"), scoring.TIERS), reports.rank(c("impact"), scoring.IMPACTS), c("signature"), c("scan")]
    return rows.orderBy(*order).limit(500).select("scan", c("node_id").alias("node"), "tier", "impact")


@query("""
with x as (select l_orderkey, l_linenumber, l_returnflag, l_linestatus from lineitem order by l_orderkey desc, l_linenumber limit 500)
select l_orderkey as scan, l_linenumber as node from x where l_linestatus = 'O'
""")
def limit_then_filter(t):
    """Rows of one key go by their place in the table, so the result does not depend on how Spark deals out the files."""
    rows = t("lineitem").withColumn("seq", row_place()).orderBy(F.desc("l_orderkey"), "l_linenumber", "seq").limit(500).where("l_linestatus = 'O'")
    return rows.select(c("l_orderkey").alias("scan"), c("l_linenumber").alias("node"))


@query("select * from (select o_orderkey as scan, o_orderdate as created_at from orders order by o_orderdate desc, o_orderkey desc limit 20) order by created_at, scan")
def scan_history(t):
    rows = t("orders").select(F.lit("s").alias("site_id"), c("o_orderkey").alias("scan_id"), c("o_orderdate").alias("created_at"))
    return reports.scan_history(rows, "s").select(c("scan_id").alias("scan"), "created_at")


@query("""
select c_custkey as lead, max(o_totalprice) as score from customer left join orders on o_custkey = c_custkey group by 1 order by score asc nulls last, lead desc limit 200
""")
def leads_nulls_last(t):
    best = t("orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("score"))
    rows = t("customer").join(best, c("c_custkey") == c("o_custkey"), "left").select(c("c_custkey").alias("lead"), "score")
    return rows.orderBy(F.asc_nulls_last("score"), F.desc("lead")).limit(200)


@query("select l_orderkey as page, l_linenumber as node from lineitem where l_returnflag = 'R' qualify row_number() over (partition by l_orderkey order by l_linenumber) <= 3")
def worst_three_per_page(t):
    rows = t("lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("page"), c("l_linenumber").alias("node"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy("node"))).where("n <= 3").drop("n")


@query("""
select c_custkey as id, c_name as name from customer where c_acctbal <= 0 order by c_acctbal, c_custkey limit 20
""")
def due_sites(t):
    day = lambda x: F.timestamp_micros((x * 1e6).cast("long"))
    sites = t("customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_nationkey").alias("org_id"), F.lit(None).cast("timestamp").alias("archived_at"), day(c("c_acctbal")).alias("next_scan_at"), F.lit("daily").alias("scan_frequency"))
    orgs = t("nation").select(c("n_nationkey").alias("id"), F.lit("growth").alias("plan"))
    return reports.due_sites(sites, orgs, F.timestamp_seconds(F.lit(0))).select("id", "name")


# sets
@query("select l_partkey as k from lineitem where l_returnflag = 'R' union all select l_partkey from lineitem where l_linestatus = 'O'")
def candidates_union_all(t):
    rows = t("lineitem")
    return rows.where("l_returnflag = 'R'").select(c("l_partkey").alias("k")).unionAll(rows.where("l_linestatus = 'O'").select(c("l_partkey").alias("k")))


@query("select l_partkey as k from lineitem where l_returnflag = 'R' except select l_partkey from lineitem where l_linestatus = 'O'")
def rules_introduced(t):
    rows = t("lineitem")
    return rows.where("l_returnflag = 'R'").select(c("l_partkey").alias("k")).subtract(rows.where("l_linestatus = 'O'").select("l_partkey"))


@query("select l_partkey as k from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_linestatus = 'O'")
def present_and_crawled(t):
    rows = t("lineitem")
    return rows.where("l_returnflag = 'R'").select(c("l_partkey").alias("k")).intersect(rows.where("l_linestatus = 'O'").select("l_partkey"))


# entitlements and schedules
@query("""
select c_custkey as org, case when c_custkey % 3 = 0 and c_custkey % 2 = 0 then 'growth' when c_acctbal <= -86400 / 86400.0 then 'free' else 'growth' end as plan from customer
""")
def effective_plans(t):
    now = F.timestamp_seconds(F.lit(0))
    ends = F.timestamp_micros((c("c_acctbal") * 86_400e6).cast("long"))
    sub = F.when(c("c_custkey") % 3 == 0, "sub")
    billing = F.when(c("c_custkey") % 2 == 0, "active").otherwise("past_due")
    return t("customer").select(c("c_custkey").alias("org"), reports.effective_plan(F.lit("growth"), ends, sub, billing, now).alias("plan"))


@query("""
select c_custkey as org, (c_custkey % 40) < 30 as allowed, 'growth' as next_plan from customer
""")
def quota_checks(t):
    orgs = t("customer").select(c("c_custkey").alias("org"), F.lit("starter").alias("plan"), (c("c_custkey") % 40).alias("used"))
    return reports.check_limit(orgs, c("used"), "max_scans").select("org", "allowed", "next_plan")


@query("""
select n_name as org, n_nationkey % 4 as p, case n_nationkey % 4 when 0 then false when 1 then false else true end as daily_allowed from nation
""")
def cadence_checks(t):
    plan = F.element_at(F.array(*(F.lit(p) for p in ("free", "starter", "growth", "scale"))), c("n_nationkey") % 4 + 1)
    return t("nation").select(c("n_name").alias("org"), (c("n_nationkey") % 4).alias("p"), reports.cadence_allowed(plan, F.lit("daily")).alias("daily_allowed"))


@query("select o_orderkey as site, o_orderdate + interval 168 hour as next_run from orders")
def next_runs(t):
    return t("orders").select(c("o_orderkey").alias("site"), reports.next_run(c("o_orderdate"), F.lit("weekly")).alias("next_run"))


# scalar functions
@query("""
with k as (select p_partkey, p_partkey % 256 as v from part), s as (select p_partkey, v / 255.0::double as s from k),
l as (select p_partkey, case when s <= 0.03928 then s / 12.92 else pow((s + 0.055) / 1.055, 2.4) end as l from s)
select p_partkey as id, floor(1.05 / (l + 0.05) * 100 + 0.5) / 100 as ratio, 1.05 / (l + 0.05) >= 4.5 as enough from l
""")
def gray_contrast(t):
    two = F.lower(F.lpad(F.hex((c("p_partkey") % 256).cast("long")), 2, "0"))
    ratio = color.contrast_ratio(F.concat(F.lit("#"), two, two, two), F.lit("#ffffff"))
    need = color.required_ratio(F.lit(16.0), F.lit(False))
    return t("part").select(c("p_partkey").alias("id"), text.rounded(ratio, 2).alias("ratio"), (ratio >= need).alias("enough"))


@query("""
select p_partkey as id, left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 40) as slug, case when length(p_type) > 12 then left(p_type, 11) || '…' else p_type end as short from part
""")
def slugs(t):
    return t("part").select(c("p_partkey").alias("id"), text.slug(c("p_name")).alias("slug"), text.shortened(c("p_type"), 12).alias("short"))


@query("""
select event_id, cast(json_extract(props, '$.n') as bigint) as n from events
""")
def event_props(t):
    return t("events").select("event_id", reports.tolerant_json(c("props"), "n bigint")["n"].alias("n"))


@query("select conv_id, turn, role, coalesce(lag(role) over (partition by conv_id order by turn), '') as before from conversations")
def turn_order(t):
    return t("conversations").select("conv_id", "turn", "role", F.coalesce(F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")).alias("before"))


@query("select s_suppkey as site, case when s_acctbal >= 90 then 'good' when s_acctbal >= 70 then 'fair' when s_acctbal >= 50 then 'poor' else 'bad' end as band from supplier")
def score_bands(t):
    return t("supplier").select(c("s_suppkey").alias("site"), text.score_band(c("s_acctbal")).alias("band"))


# streams run to their ends
def _stream_of(df: DataFrame, name: str, parts: int, part: Column) -> DataFrame:
    """A stream over the rows of a table, which come in ``parts`` batches by the number in ``part``."""
    spark = df.sparkSession
    folder = scratch_path(spark, name)
    rows = materialise(df.withColumn("__part", part), name)
    files = spark.sparkContext.defaultParallelism
    for k in range(parts):  # a later write is a later file
        rows.where(c("__part") == k).drop("__part").coalesce(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query("select event_type, date_trunc('day', ts) as day, count(*) as n from events group by all")
def streamed_daily_counts(t):
    events = t("events").select(c("ts").cast("timestamp").alias("ts"), "event_type", "value")
    spark, out = events.sparkSession, scratch_path(events.sparkSession, "daily-counts")
    counts = progress.windowed_counts(_stream_of(events, "daily-events", 2, F.pmod(F.xxhash64("ts", "event_type"), F.lit(2)))).select("event_type", c("window.start").cast("timestamp_ntz").alias("day"), "n")
    run = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state")
    run.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").select("event_type", "day", "n")


FUNNEL = {"shown": "view", "captured": "click", "signups": "signup", "paid": "purchase"}


@query("""
with e as (select event_type, date_trunc('day', ts) as day, max(ts) over () as last from events),
w as (select day + to_days(cast(i as int)) as until, event_type, last from (select day, event_type, last, unnest(range(1, 31)) as i from e)),
n as (select until, count(*) filter (event_type = 'view') as shown, count(*) filter (event_type = 'click') as captured,
  count(*) filter (event_type = 'signup') as signups, count(*) filter (event_type = 'purchase') as paid from w group by until, last having until <= last - interval 1 day)
select *, case when shown > 0 then floor(captured / shown * 1000 + 0.5) / 10 else 0.0 end as shown_to_captured,
  case when captured > 0 then floor(signups / captured * 1000 + 0.5) / 10 else 0.0 end as captured_to_signups,
  case when signups > 0 then floor(paid / signups * 1000 + 0.5) / 10 else 0.0 end as signups_to_paid from n
""")
def trailing_funnels(t):
    events = t("events").select(c("ts").cast("timestamp").alias("ts"), c("event_type").alias("name"))
    rows = jobs.run_to_end(progress.trailing_funnel(_stream_of(events, "funnel-events", 2, F.pmod(F.xxhash64("ts", "name"), F.lit(2))), FUNNEL), "funnels")
    return rows.withColumn("until", c("until").cast("timestamp_ntz"))


@query("""
with e as (select *, row_number() over (partition by user_id order by ts, event_id) as seq, count(*) over (partition by user_id) as n from events)
select event_id, cast(user_id as varchar) as scan_id, seq from e where seq > n - 400
""")
def live_buffers(t):
    """What the buffers hold after a stream of events, which come in order of their time."""
    source = t("events").select(c("user_id").alias("scan_id"), c("ts").cast("timestamp").alias("ts"), "event_id", c("event_type").alias("type"))
    spark, out = source.sparkSession, scratch_path(source.sparkSession, "live-buffers")
    rest = [x.split() for x in state.EVENT.split(", ") if x.split()[0] not in source.columns]
    events = source.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in rest))
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select((F.unix_micros("a") / 2 + F.unix_micros("b") / 2).cast("long")).first()
    state.use_state_store(spark)
    rows = state.live_buffer(_stream_of(events, "live-events", 2, (F.unix_micros("ts") > F.lit(ends[0] or 0)).cast("int")), expiry_ms=None)
    run = rows.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state")
    run.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema(rows.schema).parquet(f"{out}/rows").groupBy("scan_id").agg(F.max_by("kept", "seq").alias("kept"))
    return last.select("scan_id", F.explode("kept").alias("k")).select("k.event_id", "scan_id", "k.seq")


# scans of suppliers' sites: a year of shipping is a scan, a line number a page, a part a signature
@query("""
with f as (select l_suppkey as site, year(l_shipdate) as scan, l_linenumber as page, l_partkey % 40 as sig from lineitem),
pages as (select distinct site, scan, page from f),
sigs as (select site, sig, min(scan) as first, max(scan) as last from f group by all),
hist as (select distinct site, sig, scan, max(page) over (partition by site, sig order by scan) as top from f),
scans as (select distinct site, scan from f),
seen as (select site, sig, scan from hist),
gaps as (select k.site, k.sig, s.scan, (select max(h.top) from hist h where h.site = k.site and h.sig = k.sig and h.scan <= s.scan) as top,
  exists (select 1 from seen x where x.site = k.site and x.sig = k.sig and x.scan = s.scan) as here from sigs k join scans s on s.site = k.site and s.scan >= k.first),
closed as (select g.site, g.sig, min(g.scan) as scan from gaps g join sigs k on k.site = g.site and k.sig = g.sig join pages p on p.site = g.site and p.scan = g.scan and p.page = g.top
  where not g.here and g.scan > k.last group by all)
select cast(k.site as varchar) as site_id, cast(k.sig as varchar) as signature, case when closed.scan is null then 'open' else 'resolved' end as status,
  k.first as first_seen, k.last as last_seen, cast(closed.scan as varchar) as resolved_scan_id from sigs k left join closed on closed.site = k.site and closed.sig = k.sig
""")
def streamed_ledger(t):
    """The ledger after a stream of scans whose pages are spread over the batches."""
    found = t("lineitem").select(c("l_suppkey").cast("string").alias("site_id"), F.year("l_shipdate").alias("year"), "l_linenumber", (c("l_partkey") % 40).cast("string").alias("s"))
    at = F.make_timestamp("year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    none = F.lit(None)
    rest = [none.cast("string").alias("error"), none.cast("string").alias("status")]
    pages = found.groupBy("site_id", "year", "l_linenumber").agg(F.collect_set("s").alias("signatures"))
    pages = pages.select("site_id", "year", F.lit("page").alias("kind"), F.concat(F.lit("https://s.example/"), "l_linenumber").alias("url"), "signatures", none.cast("long").alias("pages"), *rest)
    ends = found.groupBy("site_id", "year").agg(F.countDistinct("l_linenumber").alias("pages"))
    ends = ends.select("site_id", "year", F.lit("end").alias("kind"), none.cast("string").alias("url"), none.cast("array<string>").alias("signatures"), "pages", *rest)
    events = pages.unionByName(ends).withColumns({"scan_id": c("year").cast("string"), "at": at})
    state.use_state_store(events.sparkSession)
    # ends come first, and the pages of a scan with any of three batches
    part = F.when(c("kind") == "end", 0).otherwise(F.pmod(F.xxhash64("site_id", "url"), F.lit(3)))
    changes = jobs.run_to_end(state.ledger_changes(_stream_of(events, "scan-events", 3, part), buckets=2), "ledger-changes")
    kept = state.latest_issues(changes)
    return kept.select("site_id", "signature", "status", F.year("first_seen_at").cast("long").alias("first_seen"), F.year("last_seen_at").cast("long").alias("last_seen"), "resolved_scan_id")


from tessera.plans import broken, tables  # noqa: E402, F401 - register their queries too
