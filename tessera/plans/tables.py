"""More registered queries: reports, records, accounts and words over the driver's tables.

Again orders stand for scans, lineitem for findings, customer for sites,
nation for organisations, supplier for users and events for logs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import accounts, crawl, evidence, frontier, reports, scoring
from tessera.plans.catalog import IMPACT, TIER, _analysed, _as_findings, query
from tessera.sinks import records, store
from tessera.sources import sheets, sitemap
from tessera.sources.html import html_elements, of_tags

c = F.col
EPOCH = "timestamp '1998-01-01'"


def moment(sql: str = EPOCH) -> Column:
    return F.expr(sql).cast("timestamp")


def plain(column: str) -> Column:
    """A time as it was stored, without a zone."""
    return c(column).cast("timestamp_ntz")


# reports
SCAN_SQL = """
select o_orderkey as id, o_custkey as site_id, case o_orderstatus when 'F' then 'complete' when 'O' then 'running' else 'failed' end as status,
  cast(floor(o_totalprice) as bigint) % 101 as score, o_orderdate as created_at from orders
"""
LEDGER_SQL = """
select l_suppkey as site_id, l_partkey as signature, case l_returnflag when 'R' then 'resolved' when 'A' then 'open' else 'wontfix' end as status,
  l_shipdate as first_seen_at, l_orderkey as resolved_scan_id from lineitem
"""


def scans(t) -> DataFrame:
    status = F.when(c("o_orderstatus") == "F", "complete").when(c("o_orderstatus") == "O", "running").otherwise("failed")
    none = F.lit(None).cast("timestamp")
    return t("orders").select(
        c("o_orderkey").alias("id"), c("o_custkey").alias("site_id"), status.alias("status"), (F.floor("o_totalprice") % 101).alias("score"),
        c("o_orderdate").cast("timestamp").alias("created_at"), none.alias("started_at"), c("o_orderdate").cast("timestamp").alias("finished_at"),
    )


def issues(t) -> DataFrame:
    status = F.when(c("l_returnflag") == "R", "resolved").when(c("l_returnflag") == "A", "open").otherwise("wontfix")
    return t("lineitem").select(
        c("l_suppkey").alias("site_id"), c("l_partkey").alias("signature"), status.alias("status"), c("l_shipdate").cast("timestamp").alias("first_seen_at"),
        c("l_orderkey").alias("resolved_scan_id"), c("l_shipdate").cast("timestamp").alias("resolved_at"),
    )


@query(f"""
with s as ({SCAN_SQL}), done as (select * from s where status = 'complete' qualify row_number() over (partition by site_id order by created_at desc, id desc) = 1),
o as (select site_id, count(*) as n from ({LEDGER_SQL}) where status = 'open' group by 1)
select c_custkey as id, c_name as name, done.score, done.created_at as last_scan_at, coalesce(o.n, 0) as open_issues from customer
left join done on done.site_id = c_custkey left join o on o.site_id = c_custkey where c_acctbal >= 0
""")
def site_rollup(t):
    archived = F.when(c("c_acctbal") < 0, moment())
    sites = t("customer").select(c("c_custkey").alias("id"), c("c_nationkey").alias("org_id"), c("c_name").alias("name"), archived.alias("archived_at"), moment().alias("created_at"))
    rows = reports.site_rollup(sites, scans(t), issues(t))
    return rows.select("id", "name", "score", plain("last_scan_at").alias("last_scan_at"), "open_issues")


@query(f"""
with s as ({SCAN_SQL}), w as (select * from s where status = 'complete'),
p as (select a.id, b.score, row_number() over (partition by a.id order by b.created_at desc, b.id desc) as n from w a join w b on a.site_id = b.site_id and a.id <> b.id),
l as ({LEDGER_SQL}), new as (select w.id, count(*) as n from w join l on l.site_id = w.site_id where l.status = 'open' and first_seen_at >= created_at group by 1),
gone as (select w.id, count(*) as n from w join l on l.site_id = w.site_id and l.resolved_scan_id = w.id where l.status = 'resolved' group by 1)
select w.id as scan_id, w.score, p.score as previous_score, coalesce(new.n, 0) as new_issues, coalesce(gone.n, 0) as resolved_issues,
  case when w.score > p.score then 'up ' || (w.score - p.score) when w.score < p.score then 'down ' || (p.score - w.score) when w.score = p.score then 'unchanged' end as movement,
  coalesce(new.n, 0) > 0 or coalesce(gone.n, 0) > 0 or coalesce(w.score <> p.score, false) as notify
from w left join p on p.id = w.id and p.n = 1 left join new on new.id = w.id left join gone on gone.id = w.id
""")
def change_summaries(t):
    rows = scans(t)
    return reports.change_summary(rows, issues(t), rows.where("status = 'complete'"))


@query(f"""
with f as (select l_partkey as rule_id, l_orderkey as page_id, l_linenumber as node_id, {TIER} as tier from lineitem),
g as (select rule_id, arg_min(tier, page_id * 100 + node_id) as tier, count(*) as items from f group by 1)
select cast(sum(items) as bigint) as all, cast(coalesce(sum(items) filter (tier = 'definite'), 0) as bigint) as definite,
  cast(coalesce(sum(items) filter (tier = 'review'), 0) as bigint) as review, cast(coalesce(sum(items) filter (tier = 'advisory'), 0) as bigint) as advisory from g
""")
def tier_counts(t):
    return reports.tier_counts(reports.group_by_rule(_as_findings(t), "seq"))


@query(f"""
with f as (select l_partkey as rule_id, l_orderkey as page_id, l_linenumber as node_id, {TIER} as tier from lineitem),
g as (select rule_id, arg_min(tier, page_id * 100 + node_id) as tier, count(*) as items from f group by 1)
select cast(rule_id as varchar) as rule_id, items from g where tier = 'review'
""")
def groups_to_review(t):
    return reports.of_tier(reports.group_by_rule(_as_findings(t), "seq"), "review").select("rule_id", "items")


@query(f"""
with f as (select l_suppkey as scan, cast(l_partkey % 13 as varchar) as rule_id, {IMPACT} as impact, l_orderkey * 100 + l_linenumber as spot from lineitem),
g as (select scan, rule_id, count(*) as items, arg_min(impact, spot) as impact from f group by all),
n as (select *, row_number() over (partition by scan order by case impact when 'critical' then 0 when 'serious' then 1 when 'moderate' then 2 else 3 end, items desc, rule_id) as n from g)
select scan, array_to_string(list(rule_id order by n) filter (n <= 3), ',') as shown, count(*) filter (n > 3) as hidden_groups,
  cast(coalesce(sum(items) filter (n > 3), 0) as bigint) as hidden_items, coalesce(array_to_string(list(rule_id order by n) filter (n between 4 and 9), ','), '') as hidden_names
from n group by 1
""")
def public_teasers(t):
    found = _as_findings(t).select(c("site").alias("scan"), (c("signature") % 13).cast("string").alias("rule_id"), "impact", "page_id", "node_id")
    rows = reports.teaser(found, "scan")
    return rows.select("scan", F.array_join("shown", ",").alias("shown"), "hidden_groups", "hidden_items", F.array_join("hidden_names", ",").alias("hidden_names"))


@query(f"""
with f as (select l_partkey as rule_id, l_orderkey as page_id, l_linenumber as node_id, {TIER} as tier from lineitem)
select cast(rule_id as varchar) as rule_id, count(*) as n, 'p' || arg_min(node_id, page_id * 100 + node_id) as example from f where tier = 'definite'
group by 1 order by n desc, rule_id limit 8
""")
def outstanding_findings(t):
    found = _as_findings(t).withColumn("wcag", F.array(F.lit("1.1.1")))
    return evidence.outstanding(found).select("rule_id", "n", "example")


VERDICT_SQL = """
select p_partkey as criterion, case when p_size % 2 = 0 then 'A' else 'AA' end as level, case when p_size % 3 = 0 then 'Not Evaluated' when f > 0 then 'Does Not Support'
  when r > 0 then 'Partially Supports' when p_size % 3 = 1 then 'Supports' else 'Needs Manual Review' end as verdict, coalesce(f, 0) as failures, coalesce(r, 0) as reviews
from part left join (select l_partkey, count(*) filter (l_returnflag = 'R') as f, count(*) filter (l_returnflag = 'A') as r from lineitem group by 1) on p_partkey = l_partkey
"""


def judged(t) -> DataFrame:
    d = t("lineitem").groupBy("l_partkey").agg(F.count_if(c("l_returnflag") == "R").alias("f"), F.count_if(c("l_returnflag") == "A").alias("r"))
    rows = t("part").join(d, c("p_partkey") == c("l_partkey"), "left")
    automated = F.element_at(F.array(F.lit("none"), F.lit("full"), F.lit("partial")), c("p_size") % 3 + 1)
    failures, reviews = F.coalesce("f", F.lit(0)), F.coalesce("r", F.lit(0))
    level = F.when(c("p_size") % 2 == 0, "A").otherwise("AA")
    return rows.select(c("p_partkey").alias("criterion"), level.alias("level"), scoring.verdict(automated, failures, reviews).alias("verdict"), failures.alias("failures"), reviews.alias("reviews"))


@query(f"""
with v as ({VERDICT_SQL})
select level, count(*) filter (verdict = 'Supports') as supports, count(*) filter (verdict = 'Partially Supports') as partial, count(*) filter (verdict = 'Does Not Support') as does_not,
  count(*) filter (verdict = 'Needs Manual Review') as manual, count(*) filter (verdict = 'Not Evaluated') as not_evaluated from v group by rollup (level)
""")
def verdict_summary(t):
    return evidence.verdict_summary(judged(t))


@query(f"""
with v as ({VERDICT_SQL})
select criterion, case verdict when 'Not Evaluated' then 'Needs a person; no rule tests it.'
  when 'Does Not Support' then failures || ' confirmed failure' || case when failures = 1 then '' else 's' end || ' found by rules.'
  when 'Partially Supports' then reviews || ' possible issue' || case when reviews = 1 then '' else 's' end || ' to be confirmed.'
  when 'Supports' then 'No failures; rules test it in full.' else 'No failures by rules, which test it in part only.' end as remarks from v
""")
def verdict_remarks(t):
    return evidence.remarks(judged(t)).select("criterion", "remarks")


@query("""
with r as (select l_suppkey as site_id, l_partkey as signature, l_linenumber, max(l_shipdate) as latest from lineitem where l_returnflag = 'R' group by all order by latest desc, site_id, signature, l_linenumber limit 200),
f as (select l_suppkey as site_id, l_partkey as signature, arg_min(l_linenumber, l_orderkey * 100 + l_linenumber) as rule_id from lineitem group by all)
select site_id, signature, l_linenumber as line, rule_id from r left join f using (site_id, signature)
""")
def resolved_issues(t):
    items = t("lineitem")
    ledger = items.where("l_returnflag = 'R'").groupBy(c("l_suppkey").alias("site_id"), c("l_partkey").alias("signature"), c("l_linenumber").alias("line")).agg(F.max("l_shipdate").alias("resolved_at"))
    # one issue a line number keeps the order of equal times whole
    ledger = ledger.withColumn("status", F.lit("resolved")).orderBy(F.desc("resolved_at"), "site_id", "signature", "line").limit(200)
    found = items.select(c("l_suppkey").alias("site_id"), c("l_partkey").alias("signature"), c("l_linenumber").alias("rule_id"), F.lit("m").alias("message"), c("l_orderkey").alias("created_at"), c("l_linenumber").alias("id"))
    return evidence.resolved_issues(ledger, found).select("site_id", "signature", "line", "rule_id")


@query("select o_custkey as scan, cast(sum(l_quantity) as bigint) as automatic, sum(l_linenumber)::bigint as manual from lineitem join orders on l_orderkey = o_orderkey group by 1")
def plan_totals(t):
    rows = t("lineitem").join(t("orders"), c("l_orderkey") == c("o_orderkey"))
    return reports.plan_totals(rows.select(c("o_custkey").alias("scan"), c("l_quantity").cast("long").alias("automatic"), c("l_linenumber").alias("manual")), "scan")


@query("""
with e as (select count(*) filter (event_type = 'view') as scans, count(*) filter (event_type = 'signup') as captured from events)
select scans, captured, case when scans > 0 then cast(floor(captured / scans * 100 + 0.5) as int) || '%' else '—' end as rate from e
""")
def capture_rate(t):
    return reports.capture_rate(t("events").select(c("event_type").alias("name")), "view", "signup")


# accounts
def people(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers as users, nations as organisations; a user belongs to its own nation and to the next one."""
    users = t("supplier").select(c("s_suppkey").alias("id"), F.concat("s_name", F.lit("@x.example")).alias("email"), c("s_name").alias("name"))
    orgs = t("nation").select(c("n_nationkey").alias("id"), c("n_name").alias("name"), F.lit("free").alias("plan"))
    member = t("supplier").select(c("s_suppkey").alias("user_id"), F.explode(F.array(c("s_nationkey"), (c("s_nationkey") + 1) % 25)).alias("org_id"), F.lit("member").alias("role"))
    return users, orgs, member.withColumn("created_at", F.timestamp_seconds(c("org_id")))


MEMBER_SQL = "select s_suppkey as user_id, unnest([s_nationkey, (s_nationkey + 1) % 25]) as org_id, s_name from supplier"


@query(f"select org_id, user_id, s_name || '@x.example' as email from ({MEMBER_SQL})")
def members(t):
    users, _, member = people(t)
    return accounts.members(member, users).select("org_id", "user_id", "email")


@query(f"select user_id, org_id, n_name as name, cast(row_number() over (partition by user_id order by org_id) as int) as nth from ({MEMBER_SQL}) join nation on n_nationkey = org_id")
def organisations_of_users(t):
    _, orgs, member = people(t)
    return accounts.organisations_of(member, orgs).select("user_id", "org_id", "name", "nth")


def invited(t) -> DataFrame:
    none = F.lit(None).cast("timestamp")
    return t("customer").select(
        c("c_custkey").alias("id"), c("c_nationkey").alias("org_id"), (c("c_custkey") % 150).alias("invited_by"), c("c_name").alias("email"),
        F.when(c("c_custkey") % 3 == 0, moment()).otherwise(none).alias("accepted_at"), F.when(c("c_custkey") % 5 == 0, moment()).otherwise(none).alias("revoked_at"),
        F.timestamp_seconds(F.floor("c_acctbal")).alias("expires_at"),
    )


@query("""
select c_custkey as id, n_name as org_name, s_name || '@x.example' as invited_by_email from customer join nation on n_nationkey = c_nationkey
left join supplier on s_suppkey = c_custkey % 150 where c_custkey % 3 <> 0 and c_custkey % 5 <> 0
""")
def pending_invitations(t):
    users, orgs, _ = people(t)
    return accounts.open_invitations(invited(t), users, orgs).select("id", "org_name", "invited_by_email")


@query(f"""
select n_nationkey as org_id, (select count(*) from ({MEMBER_SQL}) where org_id = n_nationkey) + (select count(*) from customer where c_nationkey = n_nationkey and c_custkey % 3 <> 0 and c_custkey % 5 <> 0) as seats
from nation
""")
def seats_used(t):
    _, orgs, member = people(t)
    return accounts.seats_used(orgs, member, invited(t))


@query(f"""
with m as ({MEMBER_SQL}), s as (select event_id as id, user_id, cast(event_id % 25 as int) as wanted from events where value >= 0),
h as (select s.id, s.user_id, m.org_id, row_number() over (partition by s.id order by m.org_id <> s.wanted, m.org_id) as n from s join m using (user_id))
select id, user_id, org_id from h where n = 1
""")
def active_sessions(t):
    users, orgs, member = people(t)
    live = F.when(c("value") >= 0, moment("timestamp '2030-01-01'")).otherwise(moment())
    rows = t("events").select(c("event_id").alias("id"), "user_id", (c("event_id") % 25).cast("int").alias("org_id"), live.alias("expires_at"))
    return accounts.active_sessions(rows, users, member, orgs, moment("timestamp '2024-01-01'")).select("id", "user_id", "org_id")


@query("""
with n as (select p_partkey as id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as base, row_number() over (partition by p_name order by p_partkey) as nth from part)
select id, case when nth = 1 then base else base || '-' || nth end as slug from n
""")
def unique_slugs(t):
    taken = t("part").limit(0).select(c("p_name").alias("slug"))
    return accounts.unique_slugs(t("part").select(c("p_partkey").alias("id"), c("p_name").alias("name")), taken)


@query(r"select event_id, regexp_matches(event_type || event_id || case when event_id % 2 = 0 then '@' else ' @' end || 'x.' || substr('example', 1, cast(event_id % 4 as int)), '^[^\s@]+@[^\s@]+\.[^\s@]{2,}$') as valid from events")
def email_checks(t):
    address = F.concat("event_type", c("event_id").cast("string"), F.when(c("event_id") % 2 == 0, "@").otherwise(" @"), F.lit("x."), F.substring(F.lit("example"), F.lit(1), (c("event_id") % 4).cast("int")))
    return t("events").select("event_id", text.valid_email(address).alias("valid"))


# records
@query("""
with log as (select event_id, user_id as scan_id, ts, case event_type when 'view' then 'running' when 'purchase' then 'complete' when 'error' then 'failed' end as status, cast(floor(value) as int) as score from events
  where event_type in ('view', 'purchase', 'error')),
last as (select scan_id, arg_max(status, (ts, status <> 'running')) as status, min(ts) filter (status = 'running') as started_at, max(ts) filter (status <> 'running') as finished_at,
  arg_max(score, ts) filter (status = 'complete') as score from log group by 1)
select c_custkey as id, coalesce(status, 'queued') as status, started_at, finished_at, score from customer left join last on scan_id = c_custkey
""")
def scan_states(t):
    heads = t("customer").select(c("c_custkey").alias("id"), F.lit("queued").alias("status"))
    status = F.when(c("event_type") == "view", "running").when(c("event_type") == "purchase", "complete").otherwise("failed")
    log = t("events").where("event_type in ('view', 'purchase', 'error')").select(
        c("user_id").alias("scan_id"), status.alias("status"), c("ts").cast("timestamp").alias("at"), F.lit(None).cast("int").alias("pages"),
        F.when(status == "complete", F.floor("value").cast("int")).alias("score"), F.lit(None).cast("string").alias("error"),
    )
    rows = records.scan_states(heads, log)
    return rows.select("id", "status", plain("started_at").alias("started_at"), plain("finished_at").alias("finished_at"), "score")


@query("select page_id, case when page_id % 7 = 0 then 'gone' end as error, case when page_id % 7 <> 0 then strlen(html) end as bytes, case when page_id % 7 <> 0 and length(html) < 800000 then length(html) end as kept from pages")
def page_rows(t):
    error = F.when(c("page_id") % 7 == 0, "gone")
    rows = t("pages").select(c("page_id").cast("string").alias("scan_id"), "url", F.lit(200).alias("status"), "html", error.alias("error"))
    return records.page_rows(rows).select(c("scan_id").cast("long").alias("page_id"), "error", c("bytes").cast("long").alias("bytes"), F.length("html").cast("long").alias("kept"))


@query("select event_type as name, event_type in ('login', 'logout') as known, count(*) as n from (select case event_type when 'view' then 'login' else event_type end as event_type from events) group by all")
def known_events(t):
    rows = t("events").select(F.when(c("event_type") == "view", "login").otherwise(c("event_type")).alias("name"), F.lit(1).alias("org_id"), "user_id", F.create_map(F.lit("k"), F.lit("v")).alias("props"))
    return records.event_rows(rows, moment()).groupBy("name", "known").agg(F.count("*").alias("n"))


@query("select c_custkey as id from customer where floor(c_acctbal) >= 1000 or c_custkey % 3 = 0")
def purged_invitations(t):
    return records.unexpired(invited(t), F.timestamp_seconds(F.lit(1000)), c("accepted_at").isNotNull()).select("id")


@query("""
select c_custkey as id, coalesce(status, 'queued') as status, sent_at from customer left join (select user_id, arg_max(status, (ts, event_id)) as status, max(ts) filter (status in ('logged', 'sent')) as sent_at
from (select *, case event_type when 'view' then 'logged' when 'purchase' then 'sent' else 'failed' end as status from events) group by 1) on user_id = c_custkey
""")
def outbox_states(t):
    status = F.when(c("event_type") == "view", "logged").when(c("event_type") == "purchase", "sent").otherwise("failed")
    log = t("events").select(c("user_id").alias("id"), status.alias("status"), c("ts").cast("timestamp").alias("at"), F.lit("p").alias("provider"), F.lit("e").alias("error"))
    return records.outbox_states(t("customer").select(c("c_custkey").alias("id")), log).select("id", "status", plain("sent_at").alias("sent_at"))


@query("""
with u as (select user_id, arg_max(event_type, ts) filter (event_type <> 'view') as segment, arg_max(value, ts) filter (value is not null) as balance from events group by 1)
select c_custkey as id, coalesce(segment, c_mktsegment) as segment, coalesce(balance, c_acctbal) as balance from customer left join u on user_id = c_custkey
""")
def partial_updates(t):
    rows = t("customer").select(c("c_custkey").alias("id"), c("c_mktsegment").alias("segment"), c("c_acctbal").alias("balance"))
    updates = t("events").select(c("user_id").alias("id"), F.when(c("event_type") != "view", c("event_type")).alias("segment"), c("value").alias("balance"), c("ts").alias("updated_at"))
    return store.changed(rows, updates, "id", ["segment", "balance"])


@query("""
with o as (select o_orderkey from orders join customer on o_custkey = c_custkey where c_nationkey <> 3)
select 'scans' as kind, count(*) as n from o union all select 'findings', count(*) from lineitem where l_orderkey in (select o_orderkey from o)
union all select 'sites', count(*) from customer where c_nationkey <> 3
""")
def cascading_delete(t):
    tables = {
        "sites": t("customer").select(c("c_custkey").alias("id"), "c_nationkey"), "scans": t("orders").select(c("o_orderkey").alias("id"), c("o_custkey").alias("site_id")),
        "findings": t("lineitem").select(c("l_orderkey").alias("scan_id")),
    }
    left = store.without(tables, {"findings": ("scans", "scan_id"), "scans": ("sites", "site_id")}, tables["sites"].where("c_nationkey = 3"), "sites")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n") for name, df in left.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("select l_suppkey as site_id, array_to_string(list(l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_returnflag), chr(10)) as patch from lineitem where l_linestatus = 'O' group by 1")
def patches(t):
    at = F.concat_ws("/", *(F.lpad(c(x).cast("string"), 12, "0") for x in ("l_orderkey", "l_linenumber", "l_partkey")))
    rows = t("lineitem").select(c("l_suppkey").alias("site_id"), at.alias("url"), F.when(c("l_linestatus") == "O", c("l_returnflag")).otherwise("").alias("diff"))
    return records.patch_text(rows)


@query("""select user_id as scan_id, event_id as seq, 'data: {"type":"' || event_type || '","value":' || cast(floor(value) as int) || '}' || chr(10) || chr(10) as frame from events""")
def event_frames(t):
    return records.event_frames(t("events").select(c("user_id").alias("scan_id"), c("event_id").alias("seq"), c("event_type").alias("type"), F.floor("value").cast("int").alias("value")))


@query("""select '{"id":' || n_nationkey || ',"name":"' || n_name || '"}' as value from nation""")
def json_rows(t):
    return records.json_lines(t("nation").select(c("n_nationkey").alias("id"), c("n_name").alias("name")))


@query("""
with e as (select event_id, user_id, ts from events order by ts desc, event_id desc limit 100) select event_id as id, c_name as site_name from e left join customer on c_custkey = user_id
""")
def recent_events(t):
    rows = t("events").select(c("event_id").alias("id"), "user_id", c("ts").alias("created_at"))
    names = t("customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"))
    return records.recent(rows, 100, site_name=(names, "user_id")).select("id", "site_name")


@query("""
with old as (select c_nationkey as site_id, c_mktsegment as kind, max(c_custkey) as last from customer where c_custkey % 2 = 0 group by all)
select n_nationkey as site_id, k as kind, cast(coalesce(last, 0) + 1 as bigint) as version, substr(sha256(n_name || k), 1, 16) as content_hash
from nation, (values ('BUILDING'), ('poem')) as v(k) left join old on old.site_id = n_nationkey and old.kind = k
""")
def document_versions(t):
    old = t("customer").where("c_custkey % 2 = 0").select(c("c_nationkey").alias("site_id"), c("c_mktsegment").alias("kind"), c("c_custkey").alias("version"))
    new = t("nation").select(c("n_nationkey").alias("site_id"), F.explode(F.array(F.lit("BUILDING"), F.lit("poem"))).alias("kind"), "n_name")
    new = new.select("site_id", "kind", F.concat("n_name", "kind").alias("content"))
    return records.numbered_documents(old, new, moment()).select("site_id", "kind", "version", "content_hash")


# words
@query("""
with d as (select event_id, (epoch_ms(timestamp '2024-01-15') - epoch_ms(ts)) as ms, ts from events),
m as (select *, ms < 0 as later, cast(floor(abs(ms) / 60000 + 0.5) as int) as mi from d), h as (select *, cast(floor(mi / 60 + 0.5) as int) as ho from m), a as (select *, cast(floor(ho / 24 + 0.5) as int) as da from h)
select event_id, case when mi < 1 then case when later then 'in under a minute' else 'just now' end
  when mi < 60 then case when later then 'in ' || mi || 'm' else mi || 'm ago' end when ho < 24 then case when later then 'in ' || ho || 'h' else ho || 'h ago' end
  when da < 30 then case when later then 'in ' || da || 'd' else da || 'd ago' end else strftime(ts, '%b %-d, %Y') end as words from a
""")
def relative_times(t):
    return t("events").select("event_id", text.relative_time(c("ts"), F.lit("2024-01-15").cast("timestamp")).alias("words"))


@query("""
select o_orderkey as id, cast(greatest(0, ceil((epoch_ms(o_orderdate) - epoch_ms(timestamp '1998-01-01 06:00:00')) / 86400000)) as int) as days,
  strftime(o_orderdate, '%B %-d, %Y') as day from orders
""")
def trial_days(t):
    return t("orders").select(c("o_orderkey").alias("id"), text.days_left(c("o_orderdate"), moment("timestamp '1998-01-01 06:00:00'")).alias("days"), text.long_date(c("o_orderdate")).alias("day"))


@query(r"""
select page_id, case when p = '' then 'index.html' else p end as filename, substr(sha256(url), 1, 16) as short_hash, substr(sha256(url), 1, 32) as half_hash, sha256(url) as whole_hash
from (select page_id, url, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '^/', '') as p from pages)
""")
def patch_names(t):
    whole = F.sha2("url", 256)
    return t("pages").select("page_id", text.patch_filename(c("url")).alias("filename"), F.left(whole, F.lit(16)).alias("short_hash"), F.left(whole, F.lit(32)).alias("half_hash"), whole.alias("whole_hash"))


@query("""
with d as (select conv_id, turn, case turn % 5 when 0 then '+++ ' when 1 then '@@ ' when 2 then '-' when 3 then '+' else ' ' end || role as line from conversations)
select conv_id, turn, case when line[1:3] in ('+++', '---') or line[1:2] = '@@' then 'meta' when line[1] = '+' then 'add' when line[1] = '-' then 'del' else 'ctx' end as class from d
""")
def diff_classes(t):
    mark = F.element_at(F.array(*map(F.lit, ("+++ ", "@@ ", "-", "+", " "))), (c("turn") % 5 + 1).cast("int"))
    return t("conversations").select("conv_id", "turn", text.diff_class(F.concat(mark, c("role"))).alias("class"))


@query("""select event_id, replace(replace(props, '"k":', '"token":'), ' ', '') as raw, case when event_id % 2 = 0 then '{"token":"[redacted]"}' else replace(props, ' ', '') end as clean from events""")
def scrubbed_props(t):
    raw = F.replace(F.replace("props", F.lit('"k":'), F.lit('"token":')), F.lit(" "), F.lit(""))
    kept = F.when(c("event_id") % 2 == 0, raw).otherwise(c("props"))
    return t("events").select("event_id", raw.alias("raw"), reports.scrub_json(kept).alias("clean"))


# sources
@query("select page_id from pages where page_id % 3 = 0 and strlen(html) <= 5000000")
def fetched_pages(t):
    kind = F.element_at(F.array(F.lit("text/html; charset=utf-8"), F.lit("image/png"), F.lit("text/css")), (c("page_id") % 3 + 1).cast("int"))
    rows = t("pages").select(c("page_id").cast("string").alias("url"), F.lit(200).alias("status"), kind.alias("content_type"), c("html").alias("body"))
    return sheets.fetched_pages(rows).select(c("url").cast("long").alias("page_id"))


@query(r"""
with p as (select page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as o from pages), k as (select page_id, o, unnest(range(10)) as i from p)
select page_id, cast(i + 1 - case when i > 2 then 1 else 0 end as int) as place, o || '/s' || i || '.css' as sheet from k where i <> 2 and i < 9
""")
def stylesheet_urls(t):
    """Ten sheets a page, the third of another site: the first eight of its own."""
    tags = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("<link rel='stylesheet' href='"), F.when(i == 2, "https://cdn.example").otherwise(""), F.lit("/s"), i.cast("string"), F.lit(".css'>")))
    return sheets.stylesheet_urls(t("pages").select("page_id", "url", F.array_join(tags, "").alias("html"))).withColumn("place", c("place").cast("int"))


@query("""
with o as (select distinct regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as origin from pages),
u as (select distinct split_part(url, '#', 1) as url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as origin from pages) select origin, count(*) as n from u group by 1
""")
def sitemap_pages(t):
    """A sitemap for each site that names all of its pages, below an index."""
    pages = t("pages").select("url", frontier.origin_of(c("url")).alias("origin"))
    origins = pages.select("origin").distinct()
    locs = pages.groupBy("origin").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<loc>"), "url", F.lit("</loc>")))), "").alias("body"))
    inner = locs.select(F.concat("origin", F.lit("/inner.xml")).alias("url"), F.lit(200).alias("status"), "body")
    index = origins.select(F.concat("origin", F.lit("/sitemap.xml")).alias("url"), F.lit(200).alias("status"), F.concat(F.lit("<sitemapindex><loc>"), "origin", F.lit("/inner.xml</loc></sitemapindex>")).alias("body"))
    return sitemap.sitemap_urls(origins, inner.unionByName(index), 100_000).groupBy("origin").agg(F.count("*").alias("n"))


@query()
def site_crawls(t):
    """A crawl of every site over its own pages, from the first of them, all others named by sitemaps."""
    pages = t("pages").select("page_id", F.split_part("url", F.lit("#"), F.lit(1)).alias("url"), "html").withColumn("site_id", frontier.origin_of(c("url")))
    pages = pages.groupBy("site_id", "url").agg(F.min("page_id").alias("page_id"), F.min("html").alias("html"))
    starts = pages.groupBy("site_id").agg(F.min_by("url", "page_id").alias("url"))
    listed = pages.select("site_id", "url", (c("page_id") + 1).alias("place"))
    responses = pages.select("url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), c("html").alias("body"))
    return crawl.crawl(starts, responses, None, listed, most_pages=8).select("site_id", "url", "position", "error")


@query("select page_id, 0 as unreadable, true as complete, null::varchar as note from pages where not regexp_matches(html, '(?s)<style>[^<]*[:\\[][^<{]*\\{')")
def css_notes(t):
    return sheets.css_coverage(html_elements(t("pages", spread=True)))


@query("""
with p as (select page_id, len(regexp_extract_all(html, '<a ')) as n from pages), x as (select page_id, n, unnest(range(1, n + 3)) as i from p)
select page_id, cast(i as int) as place, case when i = 1 then 'h1' when i <= n + 1 then 'a' else 'title' end as tag from x
""")
def tag_selection(t):
    return of_tags(html_elements(t("pages", spread=True)), "h1", "a", "title").select("page_id", "place", "tag")


@query()
def evidence_documents(t):
    pages, _, found = _analysed(t)
    found = found.withColumn("site_id", frontier.origin_of(c("url")))
    sites = pages.select(frontier.origin_of(c("url")).alias("id")).distinct().withColumns({"name": c("id"), "day": moment()})
    ledger = found.select("site_id", "signature", F.lit("resolved").alias("status"), moment().alias("first_seen_at"), moment().alias("resolved_at")).distinct()
    kinds = [evidence.generate(kind, sites, found, ledger) for kind in evidence.BUILDERS]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
