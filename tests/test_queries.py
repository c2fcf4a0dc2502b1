"""Each registered query of the engine with SQL equals DuckDB on a small scale."""

import datetime
import decimal
import os

import duckdb
import pytest

from tessera.functions.scratch import materialise
from tessera.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (decimal.Decimal, float)):
        return round(float(v), 9)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = db.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got == want


def test_of_findings_of_one_place_the_first_row_tells_the_tier(spark, tmp_path):
    """Parts whose first place comes twice, with other flags; one thread of DuckDB takes the first row, though the SQL leaves it open; Spark would take the smallest file's."""
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    con = duckdb.connect()
    con.execute("set threads = 1")
    flags = "case {} when 0 then 'R' when 1 then 'A' else 'N' end"
    for i in range(3):
        flag = flags.format(f"(l_partkey + {i}) % 3")
        con.execute(f"copy (select lineitem.* replace ({flag} as l_returnflag) from '{SF}/lineitem.parquet', range({3 - i})) to '{folder}/part-{i}.parquet'")
    con.execute(f"create view lineitem as select * from '{folder}/*.parquet'")
    for name in ("groups_to_review", "tier_counts"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        cursor = con.execute(catalog.ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(cursor.fetchall())


def test_findings_without_a_place_are_no_first_ones(spark, tmp_path):
    """Rows without a page or an element count, but the tier and impact of a rule are those of the first row that has both."""
    con = duckdb.connect()
    page, node = "case when l_quantity < 5 then null else l_orderkey end", "case when l_quantity > 45 then null else l_linenumber end"
    con.execute(f"copy (select lineitem.* replace ({page} as l_orderkey, {node} as l_linenumber) from '{SF}/lineitem.parquet') to '{tmp_path}/lineitem.parquet'")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    for name in ("groups_to_review", "tier_counts", "findings_by_rule"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        cursor = con.execute(catalog.ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_rows_of_one_key_are_cut_by_their_place_in_the_table(spark, tmp_path):
    """At the limit all rows tie; one thread of DuckDB keeps the first ones, though the SQL leaves it open; Spark reads the largest file first."""
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    con = duckdb.connect()
    con.execute("set threads = 1")
    for i, (n, status) in enumerate([(50, "O"), (60, "F"), (600, "O")]):
        row = f"1::bigint as l_orderkey, 1 as l_linenumber, '{status}' as l_linestatus, 'R' as l_returnflag, repeat(sha256(k::varchar), 9) as l_comment"
        con.execute(f"copy (select {row} from range({n}) r(k)) to '{folder}/part-{i}.parquet'")
    con.execute(f"create view lineitem as select * from '{folder}/*.parquet'")
    got = [tuple(r) for r in catalog.QUERIES["limit_then_filter"](spark, str(tmp_path)).collect()]
    assert got == con.execute(catalog.ORACLES["limit_then_filter"]).fetchall() and len(got) == 440


def test_titles_that_end_within_a_reference(spark, tmp_path):
    titles = ["a &amp", "b &am", "c &amp;&amp;&amp", "&amp;lt; &copy; d", "&lt;e", "f " * 95 + "&amp &amp &amp"]
    rows = [(i, f"https://a.example/{i}", f"<html><title>{title}</title></html>") for i, title in enumerate(t for t in titles for _ in range(6))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("accessible_names", "shell_coverage"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        cursor = con.execute(catalog.ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


# what FOUND_SQL leaves out: links whose name says nothing, which menus of the words "this" or "here" hold
GENERIC_SQL = """
  union all select page_id, 'link-generic-text', 'moderate', 'body > nav > ul > li:nth-of-type(' || k || ') > a', strpos(html, link), null
    from named join pages using (page_id) where trim(regexp_replace(name, '[^a-z\\s]', '', 'g')) in ('this', 'here')),"""


def test_found_sql_leaves_out_nothing_but_generic_links(spark, tmp_path, monkeypatch):
    """On menus with such words the queries find what the reference finds, so they differ from their SQL by this rule only."""
    menus = ["for this stnded", "The here. Onha the", "This of this, ou", "thisó und der Der", "thisen there heren", "ist das ein"]
    page = '<html lang="en"><head><title>T</title></head><body><nav><ul>{}</ul></nav><article><h1>T</h1><p>x</p></article></body></html>'
    links = ["".join(f'<li><a href="/{w}">{w}</a></li>' for w in menu.split()) for menu in menus]
    rows = [(i, f"https://a{i % 2}.example/en/{i}", page.format(menu)) for i, menu in enumerate(links)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    pages, elements, found = catalog._analysed(lambda name, spread=False: spark.read.parquet(f"{tmp_path}/{name}.parquet"))
    analysed = pages, elements, materialise(found, "found")
    monkeypatch.setattr(catalog, "_analysed", lambda t: analysed)  # once for the six queries
    end = "from twice join pages using (page_id)),"
    for name in ("page_findings", "page_scores", "site_totals", "rule_report", "remediation_plans", "conformance"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        sql = catalog.ORACLES[name]
        assert sql.count(end) == 1
        cursor = con.execute(sql.replace(end, end[:-2] + GENERIC_SQL))
        names = [d[0] for d in cursor.description]
        got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
        assert got == sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
        if name == "page_findings":
            known = {tuple(map(plain, r)) for r in con.execute(sql).fetchall()}
            places = sorted((r[0], r[4]) for r in got if r not in known)
            at = "body > nav > ul > li:nth-of-type({}) > a".format
            assert places == [(0, at(2)), (1, at(2)), (2, at(1)), (2, at(3)), (3, at(1))]


def test_entry_stands_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
