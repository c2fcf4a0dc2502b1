"""Ranked search, spelling groups and main texts against brute-force versions, and on rough tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import extraction, queries, search, spelling

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(TERM.findall((text or "").translate(AZ)))


def ranking(docs, items, top=20):
    """Rows (item, rank, doc, score) by plain loops."""
    counted = [(i, c) for i, c in ((i, terms(t)) for i, t in docs) if c]
    n, total, df = len(counted), sum(sum(c.values()) for _, c in counted), Counter(w for _, c in counted for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for w, k in df.items()}
    out = []
    for item, text in items:
        found = []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(k * weight[w] * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, k in terms(text).items() if w in c)
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


# 11
def test_search_equals_a_scan_of_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows_of(queries.op11_search(spark, SF)) == ranking(docs, items)


def test_search_over_small_shards_and_blocks(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    index = search.build_index(docs.repartition(5), shard_bytes=2000)
    assert index.shards.count() > 20
    want = ranking([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 3)
    assert rows_of(search.search(index, items, top=3, block_terms=40)) == want


def test_search_breaks_ties_by_document(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(200, 0, -1)] + [(None, "same"), (7, "same words here")], "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "WORDS words none"), (1, "WORDS words none"), (2, None), (3, ""), (4, "absent")], "item_id int, text string")
    got = rows_of(search.search(search.build_index(docs, shard_bytes=100), items, top=10))
    ids = [1, 2, 3, 4, 5, 6, 7, 7, 8, 9]
    assert Counter((r[0], r[1], r[2]) for r in got) == Counter((1, k, i) for _ in range(2) for k, i in enumerate(ids, 1))


def test_search_on_rough_and_empty_tables(spark, rough, none):
    items = spark.createDataFrame([(1, "alpha1 Ünïcode"), (None, "tail line"), (3, None)], "item_id long, text string").withColumn("score", F.lit(1)).withColumn("k", F.lit(2))
    docs = [(r.doc_id, r.text) for r in rough.select("doc_id", "text").collect()]
    found = search.search(search.build_index(rough), items)
    assert rows_of(found) == ranking(docs, [(r.item_id, r.text) for r in items.collect()])
    assert search.search(search.build_index(none), items).count() == 0
    assert search.search(search.build_index(rough), items.where("false")).count() == 0
    named = rough.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert dict(search.search(search.build_index(named), items).dtypes)["doc_id"] == "string"


# 12
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def grouped(docs, length=6, count=5, damage=199):
    """Rows (word, form, root, n, n_near, form_n) by plain loops."""
    found = Counter()
    for i, text in docs:
        for w, k in Counter(RUN.findall((text or "").translate(AZ))).items():
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            found[w[: h % len(w)] + w[h % len(w) + 1 :] if h % damage == 0 else w] += k
    words = {w: n for w, n in found.items() if len(w) >= length and n >= count}
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1 :]].add(w)
            if (cut := w[:i] + w[i + 1 :]) in words:
                near[w].add(cut)
                near[cut].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(ws, key=lambda x: (-words[x], x)) for w, ws in near.items() if ws}
    form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()), key=repr)


def spelled(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_spelling_groups_equal_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert spelled(queries.op12_spelling(spark, SF)) == grouped(docs)


def test_spelling_of_edits_accents_chains_and_ties(spark):
    texts = ["colour " * 150, "Color " * 6, "colors colors " * 3, "colourr " * 30, "colouzr " * 6, "naïveté " * 30, "naiveté " * 6, "naìveté " * 5, "abcdef abcdeg " * 25, "abcdeh " * 5, "ÀÉÎÕÜß×÷ " * 5, "aàaàaà " * 5 + "aàaàaa " * 25]
    rows = [(k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelled(spelling.spelling_groups(docs))
    assert got == grouped(rows)
    by_word = {r[0]: r for r in got}
    assert by_word["colouzr"][1:3] == ("colour", "colour")
    assert by_word["abcdeh"][1] == "abcdef"


def test_spelling_of_one_band_that_many_words_share(spark):
    words = [a + b + c + "stem" + d for a in "abcdefgh" for b in "ijklm" for c in "nopq" for d in "rstuvw"]  # 960 words of one shape
    rows = [(k, " ".join(words)) for k in range(5)]
    assert spelled(spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == grouped(rows)


def test_spelling_joins_never_broadcast_the_words(spark):
    """Small tables, which Spark would broadcast at its own threshold."""
    words = spark.createDataFrame([("spelling", 9), ("speling", 5), ("spellings", 5)], "word string, n long").repartition(2)
    assert "Broadcast" not in spelling.near_pairs(words)._jdf.queryExecution().executedPlan().toString()
    docs = spark.createDataFrame([(i, "spelling spellings") for i in range(9)], "doc_id long, text string")
    groups = spelling.spelling_groups(docs, damage=1 << 40)
    assert "Broadcast" not in groups._jdf.queryExecution().executedPlan().toString()
    assert {(r.word, r.n_near) for r in groups.collect()} == {("spelling", 1), ("spellings", 1)}


def test_spelling_on_rough_and_empty_tables(rough, none):
    rows = [(r.doc_id, r.text) for r in rough.select("doc_id", "text").collect()]
    assert spelled(spelling.spelling_groups(rough, least_count=1)) == grouped(rows, count=1)
    assert spelling.spelling_groups(none).count() == 0


# 13
LONG = "A long sentence of the article that says a lot of things in many words, so that its block is dense. "
P = LONG.strip()
PAGES = {
    "article among parts": (
        f"<header><h1>Site</h1><nav>x</nav></header><main><article><header><h1>T</h1></header><p>a &amp; b&nbsp;&#x41;<script>if(a<b){{'</p>'}}</script></p>"
        f"<section class='comments'><article><p>{LONG * 9}</p></article></section><footer>tags</footer></article><aside>{LONG * 9}</aside></main>",
        "T\na & b A",
    ),
    "parts by names": (
        f"<head><title>x</title></head><div id=header><h1>Site</h1></div><div id=menu><ul><li><a>a</a><li><a>b</a></ul></div><div id='content'><h1>T</h1><p>{LONG}<p>Hi."
        f"<div class='advert'>Buy {LONG * 3}</div><p>{LONG}</div><div id=comments><p>{LONG * 9}</p></div><div id=footer>x</div>",
        f"T\n{P}\nHi.\n{P}",
    ),
    "no names": (f"<div><a href=x>home</a> <a>about</a></div><div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div>Copyright</div>", f"Title\n{P}\nShort.\n{P}"),
    "states are no parts": (f"<div class='cookie-notice'>{LONG * 9}</div><div class='has-sidebar wrap'><p>{LONG}</p></div><form><p>{LONG * 9}<input></form>", P),
    "short article": (f"<article><p>Be.</article><footer>{LONG}</footer>", "Be."),
    "broken": ("<article></p><p><b>one<br><p>two</b> two</div><p>three</article>", "one\ntwo two\nthree"),
    "tables and lists": ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul><pre> a\n b</pre>x<br>y<!-- c --></article>", "a\nb\nc\nx\ny\na b\nx y"),
    "never closed": ("<article><p>text<script>never", "text"),
    "cut tag": ("<article><p>text <a href='x", "text"),
    "quote in a value": ("<article><a title=it's>x</a> y</article>", "x y"),
    "hidden": ("<article><p hidden>no<p style='display: none'>no<p>yes<div aria-hidden=true>no</div></article>", "yes"),
    "only text": ("just  text &lt;b&gt;", "just text <b>"),
    "only links": ("<ul><li><a>a</a><li><a>b</a></ul>", "a\nb"),
    "a name on everything": (f"<div class=notice><p>{LONG}</div>", P),
    "nothing": ("<nav>x</nav><script>y</script>", ""),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    html, text = PAGES[name]
    assert extraction.extract_text(html) == text


def test_article_of_every_page(spark):
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op13_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body))
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_extraction_of_rough_pages(spark):
    rows = [(i, None if i % 2 else "u", html, "old", 1) for i, (html, _) in enumerate(PAGES.values())] * 2 + [(None, "u", "<p>" * 20_000 + "<div " * 20_000 + "x", "old", 1), (99, None, f"<article><p>{'word ' * 200_000}", "old", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = extraction.extract_pages(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: r for r in got.collect()}
    assert [found[i].text for i in range(len(PAGES))] == [t for _, t in PAGES.values()]
    assert found[99].n_chars == 999_999
    assert got.count() == len(rows)
    assert extraction.extract_pages(pages.where("false")).count() == 0
