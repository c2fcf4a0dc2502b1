"""Each operator against a brute-force version, and on rough, empty and skewed tables."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontamination, licenses, lines, minhash, packing, pii, quality, queries, sharding, toxicity, urls

from .conftest import PASSAGE, ROWS

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


# 1
def test_urls_follow_the_rules(spark):
    cases = {
        "https://a.org/x": ("a.org", "/x", "org/", "allow"), "http://WWW.Example.ORG/es/1?q": ("www.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"), "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"), "http://x.com/de/z": ("x.com", "/de/z", "com/de/", "block"), "http://a.org": ("a.org", "", None, None),
        "http://a.org?x": ("a.org", "", None, None), "no scheme": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None),
    }
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(cases)], "page_id long, url string, host string, n int")
    got = {r.page_id: r for r in urls.url_filters(pages).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict or (verdict is None and got[i].verdict in ("allow", "block"))
    assert urls.url_filters(pages.where("false")).count() == 0


def parsed_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = re.split("[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(AZ), slash + path


def ruled(host, path):
    fits = [r for r in urls.RULES if (host == r[1].split("/")[0] or host.endswith("." + r[1].split("/")[0])) and path.startswith("/" + r[1].split("/", 1)[1])]
    return max(fits, key=lambda r: len(r[1]), default=None)


def merged_names(branches, z=1.645):
    """Names of (child, lab, bad) siblings that are told apart by their labels."""
    by_step = defaultdict(list)
    for child, lab, bad in branches:
        by_step[int(np.floor(np.arcsin(np.sqrt((bad + 1) / (lab + 2))) * 20 + 0.5))].append((child, lab, bad))
    groups = []
    for step in sorted(by_step):
        names, lab, bad = [c for c, _, _ in by_step[step]], sum(x for _, x, _ in by_step[step]), sum(x for _, _, x in by_step[step])
        if groups:
            _, l0, b0 = groups[-1]
            n1, n2 = l0 + 2, lab + 2
            pool = (b0 + bad + 2) / (n1 + n2)
            if abs((b0 + 1) / n1 - (bad + 1) / n2) <= z * (pool * (1 - pool) * (1 / n1 + 1 / n2)) ** 0.5:
                groups[-1] = (groups[-1][0] + names, l0 + lab, b0 + bad)
                continue
        groups.append((names, lab, bad))
    out = {}
    for names, _, _ in groups:
        n = len(names)
        name = names[0] if n == 1 else "{" + min(names) + ("|" if n == 2 else f"|..{n - 2}..|") + max(names) + "}"
        out |= dict.fromkeys(names, name)
    return out


def judged_urls(rows, depth=4, support=5, weight=5.0, reject=0.6):
    """{id: (host, path, rule, verdict, template, shape, purity)} by plain loops."""
    state = []
    for i, url in rows:
        host, path = parsed_url(url)
        rule = ruled(host, path)
        state.append({"id": i, "host": host, "path": path, "rule": rule, "seg": re.sub("^/", "", path).split("/"), "t": "", "s": ""})
    for level in range(depth):
        counts = defaultdict(lambda: [0, 0, 0])
        for r in state:
            if level < len(r["seg"]):
                c = counts[(r["host"], r["t"], r["seg"][level])]
                c[0] += 1
                c[1] += r["rule"] is not None
                c[2] += bool(r["rule"] and r["rule"][0] == "block")
        hosts = defaultdict(set)
        for h, _, c in counts:
            if not re.search("[0-9]", c):
                hosts[c].add(h)
        literal = {k: v for k, v in counts.items() if v[0] >= support or len(hosts[k[2]]) >= support}
        names, siblings = {k: k[2] for k in literal}, defaultdict(list)
        for (h, t, c), (_, lab, bad) in literal.items():
            if lab >= support:
                siblings[(h, t)].append((c, lab, bad))
        for (h, t), branches in siblings.items():
            for c, name in merged_names(branches).items():
                names[(h, t, c)] = name
        for r in state:
            if level < len(r["seg"]):
                k = (r["host"], r["t"], r["seg"][level])
                r["t"] += "/" + names.get(k, "*")
                r["s"] += "/" + (k[2] if k in names else "*")
    own, pool, shapes = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), Counter()
    for r in state:
        if len(r["seg"]) > depth:
            r["t"], r["s"] = r["t"] + "/**", r["s"] + "/**"
        good, bad = r["rule"] is not None, bool(r["rule"] and r["rule"][0] == "block")
        parts = r["s"].split("/")
        for c in (own[(r["host"], r["t"])], *(pool["/".join(parts[: k + 1])] for k in range(len(parts)))):
            c[0] += good
            c[1] += bad
        shapes[r["s"]] += good
    out = {}
    for r in state:
        parts, share = r["s"].split("/"), 0.5
        for k in range(len(parts)):
            n, b = pool["/".join(parts[: k + 1])]
            w = 2.0 if k == 0 else weight
            share = (b + share * w) / (n + w)
        n, b = own[(r["host"], r["t"])]
        purity = (b + weight * share) / (n + weight)
        verdict = r["rule"][0] if r["rule"] else "block" if round(purity, 6) >= reject and shapes[r["s"]] >= support else "allow"
        out[r["id"]] = (r["host"], r["path"], r["rule"] and r["rule"][1], verdict, r["t"], r["s"], round(purity, 6))
    return out


def test_urls_against_brute_force(spark):
    rng, rows = random.Random(12), []
    hosts = ["a.org", "example.org", "b.com", "c.com", "d.com", "e.net", "f.net", "g.net"]
    for i in range(700):
        path = "/" + rng.choice(["de", "fr", "es", "en", "shop", "x" + str(rng.randrange(40))]) + "/" + rng.choice(["", str(rng.randrange(300)), "a/b", "p/q/r/s/t", "index"])
        rows.append((i, f"http://{rng.choice(hosts)}{path}" + rng.choice(["", "?x/y", "#z"])))
    rows += [(900 + k, u) for k, u in enumerate([None, "", "no scheme", "http://a.org", "://", "http://e.net//x"])] + rows[:3]
    got = {r.page_id: tuple(r)[1:] for r in urls.url_filters(spark.createDataFrame(rows, "page_id long, url string").repartition(3)).collect()}
    want = judged_urls(rows)
    for i, w in want.items():
        assert got[i][:6] == w[:6] and abs(got[i][6] - w[6]) < 2e-6, (got[i], w)
    assert {got[i][3] for i in got if got[i][2] is None} == {"allow", "block"}


def test_urls_learn_from_other_hosts(spark):
    """A section that rules block elsewhere is bad on a host without rules; sections without any labels are not."""
    rows = [f"http://h{k}.example.org/es/{i}" for k in range(6) for i in range(6)] + [f"http://k{k}.example.net/es/{i}" for k in range(3) for i in range(2)]
    rows += [f"http://s.com/de/{i}" for i in range(40)] + [f"http://s.com/{part}/{i}" for part in ("item", "blog") for i in range(40)]
    got = urls.url_filters(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"))
    found = {(r.host, r.template, r.verdict): r["count"] for r in got.groupBy("host", "template", "verdict").count().collect()}
    assert all(found[(f"k{k}.example.net", "/es/*", "block")] == 2 for k in range(3))
    assert found[("s.com", "/de/*", "block")] == 40 and found[("s.com", "/item/*", "allow")] == 40 and found[("s.com", "/blog/*", "allow")] == 40


def test_urls_keep_small_sections_of_a_hot_host(spark):
    """Forty sections of twenty urls each stay apart, though each has a fortieth of the host."""
    rows = [f"http://hot.com/{'de' if k == 0 else 'fr' if k == 1 else f'part{k}'}/{i}" for k in range(40) for i in range(20)]
    got = urls.url_filters(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).groupBy("template", "verdict").count().collect()
    assert len(got) == 40 and {(r.template, r.verdict) for r in got if r.verdict == "block"} == {("/de/*", "block")}


def test_urls_on_rough_rows(spark, rough, none):
    docs = rough.withColumnsRenamed({"text": "url"}).withColumns({c: F.lit("x") for c in ("host", "template", "shape", "child", "rule")})
    got = urls.url_filters(docs, id_col="doc_id").collect()
    want = Counter((i, parsed_url(t)[0]) for i, t in ROWS)
    assert Counter((r.doc_id, r.host) for r in got) == want and all(r.verdict == "allow" for r in got)
    assert urls.url_filters(none.withColumnRenamed("text", "url"), id_col="doc_id").count() == 0


# 2
def test_shards(spark, rough, none):
    rows = sharding.shard(rough).collect()
    assert len(rows) == len(ROWS)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(0 <= s < 24 for s in slots)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert sharding.shard(none).count() == 0


def test_shards_are_even_with_a_hot_text(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text " * 20).otherwise(F.concat(F.lit("t"), F.repeat(F.col("id").cast("string"), 20))).alias("text"))
    sums = [r.s for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 24 and max(sums) - min(sums) <= 0.03 * sum(sums) / 24


def test_shards_with_many_ranges(spark, monkeypatch):
    """More ranges for more rows: the same law, gapless slots, each row once."""
    monkeypatch.setattr(sharding, "ROWS_A_RANGE", 5)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), (F.col("id") % 40).cast("int")).alias("text"))
    rows = sharding.shard(docs).collect()
    slots, sums = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert sorted(r.doc_id for r in rows) == list(range(3000)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len(sums) == 24 and max(sums.values()) - min(sums.values()) <= 0.03 * sum(sums.values()) / 24


def test_splitters_against_brute_force(spark):
    """Sizes and rows of each range, and the range of each key, equal a sorted list's."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 700).cast("string")).alias("text"))
    rows = docs.select(F.xxhash64("text").alias("text_key"), F.xxhash64("doc_id").alias("id_key"), (F.length("text") + 8).cast("long").alias("size"))
    rows = rows.withColumn("key", sharding.composite_key()).cache()
    splitters, each = sharding.find_splitters(rows, rows.agg(F.sum("size")).first()[0], 40)
    want = [[0, 0] for _ in range(len(splitters) + 1)]
    for r in rows.withColumn("range", sharding._range_of(splitters)).collect():
        k = sharding.shard_of_range(splitters, r.key)
        assert r.range == k
        want[k][0] += r.size
        want[k][1] += 1
    assert [tuple(w) for w in want] == each and splitters == sorted(set(splitters))
    due = sum(w[0] for w in want) / 40
    assert max(w[0] for w in want) <= 1.6 * due


def test_levels():
    assert sharding.level_for([5, 0, 1], 6) == [0, 3, 2] or sum(sharding.level_for([5, 0, 1], 6)) in (5, 6, 7)
    assert sharding.level_for([0, 0], 10) == [5, 5]


# 3
def marked(words, items, width=13):
    hit, found = [False] * len(words), set()
    for name, ws in items:
        n = min(width, len(ws))
        if not n:
            continue
        windows = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                found.add(name)
                hit[i : i + n] = [True] * n
    return hit, found


def test_automaton_against_brute_force():
    rng = random.Random(7)
    for width in (1, 2, 3, 5):
        items = [(str(k), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 9))]) for k in range(6)]
        automaton = decontamination.SuffixAutomaton(items, width)
        for _ in range(60):
            words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 30))]
            hit, found = automaton.scan(words)
            assert (hit.tolist(), found) == marked(words, items, width)


def test_blocks_of_items_give_what_one_gives(spark):
    """Benchmarks of many blocks, on the tables and with remote matches in one document."""
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = decontamination.decontaminate(docs, bench, remove_spans=True)
    many = decontamination.decontaminate(docs, bench, block_words=300, remove_spans=True)
    assert len(list(decontamination.benchmark_blocks(bench, 300))) > 5 and one.where("contaminated").count() > 0
    assert Counter(map(str, one.collect())) == Counter(map(str, many.collect()))


def test_decontamination(spark, rough, none):
    bench = spark.createDataFrame([(1, PASSAGE[:200]), (2, "one"), (3, None), (None, "alpha1"), (4, "")], "item_id long, text string")
    rows = decontamination.decontaminate(rough, bench, block_words=5, remove_spans=True, carry=True).collect()
    items = [("1", ALNUM.findall(PASSAGE[:200])), ("2", ["one"])]
    want = Counter()
    for i, t in ROWS:
        words = ALNUM.findall((t or "").translate(AZ))
        hit, found = marked(words, items)
        want[(i, len(words), sum(hit), tuple(sorted(found)), sum(hit) > 0 and 20 * sum(hit) >= len(words))] += 1
    assert Counter((r.doc_id, r["__n_words"], r["__n_hit"], tuple(r["__items"]), r["__contaminated"]) for r in rows) == want
    assert all(r["__clean_text"] == "" for r in rows if r.doc_id == 4) and all(r.value == "v" for r in rows)
    assert decontamination.decontaminate(none, bench).count() == 0
    assert decontamination.decontaminate(rough, bench.where("false")).where("contaminated").count() == 0


# 4
def base_statistics(text):
    words = BLANK.findall(text or "")
    seen = [ln for ln in (text or "").split("\n") if BLANK.search(ln)]
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {p + k for v in windows.values() if len(v) > 1 for p in v for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(seen) - len(set(seen)), len(covered)


@pytest.mark.parametrize("source", ["rough", "tables"])
def test_quality_statistics(spark, rough, labels, source):
    rows = ROWS if source == "rough" else texts(spark)
    docs = rough if source == "rough" else spark.read.parquet(f"{SF}/documents.parquet")
    marks = labels if source == "rough" else spark.read.parquet(f"{SF}/labels.parquet")
    got = Counter()
    for r in quality.quality_rules(docs, marks).collect():
        got[(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)] += 1
        assert not (r.kept and r.base_failed)
    want = Counter()
    for i, t in rows:
        s = base_statistics(t)
        want[(i, *s, s[0] < 10 or 100 * s[4] > 20 * s[0])] += 1
    assert got == want


def test_quality_without_rows_or_labels(rough, none, labels):
    assert quality.quality_rules(none, labels).count() == 0
    assert quality.quality_rules(rough, labels.where("false")).where("llr_millis <> 0").count() == 0


def test_quality_ratio_tells_junk(spark):
    marks, docs = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    rows = quality.quality_rules(docs, marks).join(marks, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg("llr_millis").alias("m")).collect()
    mean = {r.quality: r.m for r in rows}
    assert mean[1] > mean[0]


def test_quality_counts_every_gram_of_every_labelled_row(spark):
    """60,000 words and some 180,000 pairs, of which each says on which side its text is."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{rng.randrange(30_000)}" for _ in range(300))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.quality_rules(docs, marks).where("kept").collect()}
    assert kept == {i for i in range(600) if i % 2 == 0}


@pytest.mark.parametrize("sent", [25, 0])
def test_quality_scores_against_brute_force(spark, monkeypatch, sent):
    """Weights of all buckets and means of all rows, with the table sent and with it joined."""
    monkeypatch.setattr(quality, "BROADCAST_BITS", sent)
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 10_000 * sent)
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in marks.where("quality = 1").collect()}
    rows = [(i, BLANK.findall(t or "")) for i, t in texts(spark)]
    bits = quality.table_bits(sum(len((t or "").encode()) for _, t in texts(spark)))
    single = spark.createDataFrame([(w,) for w in {w for _, ws in rows for w in ws}], "w string")
    h = {r.w: r.h for r in single.select("w", F.xxhash64("w").alias("h")).collect()}
    double = spark.createDataFrame([(h[a], h[b]) for a, b in {p for _, ws in rows for p in pairwise(ws)}], "a long, b long")
    h2 = {(r.a, r.b): r.h for r in double.select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    grams = [(i, [(x % 2**64) >> (64 - bits) for x in (*(h[w] for w in ws), *(h2[h[a], h[b]] for a, b in pairwise(ws)))]) for i, ws in rows]
    raw, target = Counter(), Counter()
    for i, g in grams:
        raw.update(g)
        if i in good:
            target.update(g)
    share = sum(target.values()) / sum(raw.values())
    want = Counter()
    for i, g in grams:
        total = sum(round(1000 * float(np.log((target[x] - (i in good) + 1) / ((raw[x] - 1) * share + 1)))) for x in g)
        want[(i, total // (len(g) or 1))] += 1
    assert Counter((r.doc_id, r.llr_millis) for r in quality.quality_rules(docs, marks).collect()) == want


def test_quality_verdicts_against_brute_force(spark):
    """The cut is found among all labelled rows, and every row stands on its side of it."""
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {}
    for r in marks.where("quality is not null").collect():
        good[r.doc_id] = max(good.get(r.doc_id, 0), int(r.quality == 1))
    rows = quality.quality_rules(docs, marks).collect()
    scores = sorted((r.llr_millis, good[r.doc_id]) for r in rows if not r.base_failed and r.doc_id in good)
    shares = [(sum(g for s, g in scores if s >= cut) / sum(g for _, g in scores) - sum(1 - g for s, g in scores if s >= cut) / sum(1 - g for _, g in scores), -cut) for cut in {s for s, _ in scores}]
    best = -max(shares)[1]
    below = [s for s, _ in scores if s < best]
    cut = (best + max(below) + 1) // 2 if below else best
    assert Counter((r.doc_id, r.kept) for r in rows) == Counter((r.doc_id, not r.base_failed and r.llr_millis >= cut) for r in rows)


def test_quality_table_grows():
    assert [quality.table_bits(n) for n in (0, 25_000_000, 50_000_000_000)] == [10, 17, 21]


def test_quality_threshold_follows_the_scores():
    # half way between the worst good row and the best other one
    assert quality.score_threshold([(-900, 0, 5), (-300, 0, 5), (-200, 1, 5), (10, 1, 50)]) == -250
    assert quality.score_threshold([(-300, 0, 9), (-200, 1, 1), (-100, 0, 1), (10, 1, 50)]) == -45
    assert quality.score_threshold([(s, 1, 1) for s in range(100)]) == 1
    assert quality.score_threshold([]) == 0


# 5
SHAPES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(d - 9 if d > 9 else d for d in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_of(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in SHAPES.items() for m in re.finditer(p, text or "") if holds(k, m[0]))


def test_pii_base(spark, rough, none):
    rng = random.Random(3)
    pieces = ["a", "b.c", "@", "a@b.c", "_d@e.f", ".", "-", "+", "+1 (377) 555-0271", "4363361756619572", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5.6.7.8", "é", "😀", "\x01", "\x02", " ", "\n", "9", "(555)"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 20)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find_pii(docs).select("doc_id", pii.spelled("base").alias("s")).collect()}
    assert got == {i: base_of(t) for i, t in rows}
    got = Counter((r.doc_id, r.s) for r in pii.find_pii(rough).select("doc_id", pii.spelled("base").alias("s")).collect())
    assert got == Counter((i, base_of(t)) for i, t in ROWS)
    assert pii.find_pii(none).count() == 0


def test_pii_cues_find_more(spark):
    rows = [(i, f"please call hotline +1 (555) 555-{1000 + i} today") for i in range(20)]
    rows += [(50, "please call hotline 555-777-1234 today"), (51, "year 1999-2000 is long gone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find_pii(docs).select("doc_id", pii.spelled("spans").alias("s")).collect()}
    assert got[50] == "phone:20:32" and got[51] == "" and got[3].startswith("phone:20:")


def test_pii_finds_numbers_in_groups(spark):
    values = ["030 1234 5678", "826 555 4081", "(826) 555-4081", "DE89 3704 0044 0532 0130 00", "4111 1111 1111 1112", "826.555.4081"]
    rows = [(i, f"please call hotline +1 (555) 555-{1000 + i} today") for i in range(60)]
    rows += [(100 + k, f"please call hotline {v} today") for k, v in enumerate(values)] + [(200, "the years 1999 2000 2001 went by"), (201, "call hotline 12 34")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find_pii(docs).select("doc_id", pii.spelled("spans").alias("s")).collect()}
    assert [got[100 + k] for k in range(len(values))] == [f"phone:20:{20 + len(v)}" for v in values] and got[200] == got[201] == ""


def graph_scores(edges, support, rounds):
    last = lambda c: c.split()[0] if c.startswith(">") else c.split()[-1]
    width, seeds, open_ = defaultdict(set), defaultdict(set), set()
    for kind, value, cue in edges:
        width[cue].add(value)
        if kind:
            seeds[(cue, kind)].add(value)
        else:
            open_.add((value, cue))
    backing = {k: float(len(v)) for k, v in seeds.items()}
    scores = {k: n / len(width[k[0]]) for k, n in backing.items() if n >= support}
    for _ in range(rounds):
        total = Counter(backing)
        for value, cue in open_:
            for kind in {k for _, k in scores}:
                near = [s for (c, k), s in scores.items() if k == kind and (value, c) in open_ and last(c) != last(cue) and (c[0] == ">") == (cue[0] == ">")]
                total[(cue, kind)] += max(near, default=0.0)
        scores = {k: n / len(width[k[0]]) for k, n in total.items() if n >= support}
    return scores


def test_pii_graph_against_brute_force(spark):
    rng, edges = random.Random(2), set()
    for _ in range(160):
        value, cue = rng.randrange(40), rng.choice(["call", "please call", "ring", "tel", "my tel", "no", "at"])
        edges.add((None if value >= 14 else rng.choice(["phone", "phone", "card"]), str(value), cue))
    df = spark.createDataFrame(list(edges), "kind string, value string, cue string")
    for rounds in (0, 1, 3):
        got = {(r.cue, r.kind): r.score for r in pii.scored_cues(df, 3, rounds).collect()}
        want = graph_scores(edges, 3, rounds)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and want


def test_pii_instances_induce_new_cues(spark):
    """No seed follows "tel", but the numbers that "hotline" finds do; so "tel" finds another one."""
    rows = [(i, f"hotline +1 (555) 555-{1000 + i} x") for i in range(200)] + [(300 + k, f"hotline 826 555 {4000 + k} x tel 826 555 {4000 + k} y") for k in range(12)]
    rows += [(400, "tel 826 555 9999 y"), (401, "room 826 555 9999 z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    count = lambda rounds: {r.doc_id: r.n for r in pii.find_pii(docs, confidence=0.8, rounds=rounds).select("doc_id", F.size("spans").alias("n")).collect()}
    assert count(0)[400] == 0 and count(3)[400] == 1 and count(3)[401] == 0


def test_pii_cues_behind_a_place(spark):
    rows = [(i, f"w{i} +1 (555) 555-{1000 + i} is my number") for i in range(20)] + [(50, "x 826 555 4081 is my number"), (51, "x 826 555 4081 days later")]
    got = {r.doc_id: r.s for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.spelled("spans").alias("s")).collect()}
    assert got[50] == "phone:2:14" and got[51] == ""


def planted(spark, seed=9):
    """Documents of the tables, into which seeds and unseen identifiers are put behind and before telling words."""
    rng, rows, want = random.Random(seed), [], {}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    for i, text in docs:
        words = text.split(" ")
        at, what = rng.randrange(len(words) + 1), rng.randrange(20)
        start = len(" ".join(words[:at])) + (at > 0)
        if what < 16:
            words.insert(at, rng.choice(["hotline +49 {} 9", "+49 {} 9 fernruf"]).format(digits(9)))
        elif what < 17:
            value = rng.choice([f"0{digits(2)} {digits(3)} {digits(4)}", digits(8)])
            before = rng.random() < 0.5
            words.insert(at, f"hotline {value}" if before else f"{value} fernruf")
            want[i] = (start + 8 * before, start + 8 * before + len(value))
        elif what == 17:
            words.insert(at, f"invoice {digits(8)}")
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string"), want


def test_pii_finds_planted_identifiers(spark):
    docs, want = planted(spark)
    got = {r.doc_id: {tuple(s)[1:] for s in r.spans} - {tuple(s)[1:] for s in r.base} for r in pii.find_pii(docs).collect()}
    found = sum(w in got[i] for i, w in want.items())
    added = sum(map(len, got.values()))
    assert len(want) > 30 and found >= 0.9 * len(want) and found >= 0.9 * added


def test_pii_added_spans_against_brute_force(spark):
    docs, _ = planted(spark, 4)
    rows = pii.base_spans(docs, "doc_id", "text", 64).collect()
    edges = {(k if k != "others" else None, s.value, cue) for r in rows for k in (*pii.KINDS, "others") for s in r[k] for cue in s.cues}
    good = {}
    for (cue, kind), score in graph_scores(edges, 5, 3).items():
        if score >= 0.9:
            good[cue] = max(good.get(cue, (0, "")), (score, kind))
    want = {(r.id, pii.KINDS.index(min(good[c][1] for c in s.cues if c in good)), s.start, s.end) for r in rows for s in r.others if any(c in good for c in s.cues)}
    got = {(r.doc_id, *s) for r in pii.find_pii(docs).collect() for s in {tuple(x) for x in r.spans} - {tuple(x) for x in r.base}}
    assert got == want and len(want) > 30


def test_pii_in_a_text_with_many_matches(spark):
    text = " ".join(f"mail u{i}@ex.co or 10.0.{i % 256}.1" for i in range(3000)) + " é 1.2.3.4"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.find_pii(docs).select(pii.spelled("base").alias("s")).first().s == base_of(text)


def test_pii_cue_with_half_seeds_marks_nothing(spark):
    rows = [(i, f"the order number +1 (555) 555-{1000 + i} today") for i in range(5)]
    rows += [(10 + i, f"the order number 2024000{100 + i} today") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.find_pii(docs).where("size(spans) > size(base)").count() == 0


# 6
def test_distances(spark):
    rng, rows = random.Random(5), []
    for _ in range(250):
        a = "".join(rng.choice("abcé") for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 40])))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i, kind = rng.randint(0, len(b)), rng.random()
            b[i : i + (kind > 0.4)] = rng.choice("abc") if kind > 0.2 else ""
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for tau in (1, 2, 3):
        df2 = df.withColumns({"x": lines.code_points(F.col("a"), tau), "y": lines.code_points(F.col("b"), tau)})
        for r in df2.select("a", "b", lines.distance_within(F.col("x"), F.col("y"), tau).alias("ok")).collect():
            assert r.ok == (edits(r.a, r.b) <= tau)


def test_keys_count_characters(spark):
    """A line with characters of several bytes still meets its plain neighbour."""
    rows = [(1, "the quick brown fox jumps over the lazy dog again"), (2, "the quick brown fox jumps over the lazy dog agaîn"), (3, "the quick brown fôx jumps ovér the lazy dog again!")]
    keys = {r.i: r.k for r in spark.createDataFrame(rows, "i int, t string").select("i", lines.segment_keys(lines.wide(F.col("t")), F.length("t"), 2).alias("k")).collect()}
    assert all(len(k) == 12 for k in keys.values()) and {*keys[1][:3]} & {*keys[2]} and {*keys[1][:3]} & {*keys[3]}
    got = {r.doc_id: list(r.removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: []}


def removed_lines(rows, tau=2, least=30, as_list=False):
    told = lambda x: len(x) >= least or any(unicodedata.category(c)[0] in "LN" for c in x)
    norm = lambda t: [x.strip(" ") for x in re.sub(r"[ \t\x0b\f\r]+", " ", (t or "").lower()).split("\n")]
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k, x in enumerate(norm(t)):
            if told(x):
                first.setdefault(x, (i, k))
    out = []
    by_length = defaultdict(list)
    for y in first:
        if len(y) >= least:
            by_length[len(y)].append(y)
    for i, t in rows:
        seen, gone = set(), []
        for k, x in enumerate(norm(t)):
            if not told(x):
                continue
            near = range(-tau, tau + 1) if len(x) >= least else ()
            earlier = i is not None and (first[x][0] < i or any(first[y] < first[x] and alike(x, y, tau) for d in near for y in by_length[len(x) + d]))
            if x in seen or earlier:
                gone.append(k)
            seen.add(x)
        out.append((i, tuple(gone)))
    return out if as_list else Counter(out)


def alike(x, y, tau):
    """Whether two strings are within ``tau`` edits; most pairs are told apart by their character counts."""
    a, b = Counter(x), Counter(y)
    return sum(((a - b) + (b - a)).values()) <= 2 * tau and edits(x, y) <= tau


def test_line_dedup(spark, rough, none):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(25, 60))) + "." for _ in range(12)]
    rows = []
    for i in range(80):
        own = []
        for _ in range(rng.randint(1, 5)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randrange(len(x))
                x[k : k + rng.randint(0, 1)] = rng.choice(["", "z", "yy"])
            own.append("".join(x))
        rows.append((i, "\n".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, tuple(r.removed)) for r in lines.dedup_lines(docs).collect())
    want = removed_lines(rows)
    assert got == want
    out = lines.dedup_lines(rough, prefix="__").collect()
    assert Counter((r.doc_id, tuple(r["__removed"])) for r in out) == removed_lines(ROWS)
    assert Counter(r.text for r in out if r.doc_id in (1, 2, 3, 12)) == Counter(t for i, t in ROWS if i in (1, 2, 3, 12))
    assert {r.text for r in out if r.doc_id == 10} == {"same line of some length, said twice\n"} and all(r.removed == 4 for r in out)
    assert lines.dedup_lines(none).count() == 0


def test_short_lines(spark):
    """Equal short lines go, alike ones and those without a letter or digit stay."""
    rows = [(1, "All rights reserved.\n\n}\n---\nPage 1"), (2, "all  rights reserved. \n\n}\n---\nPage 2"), (3, "Page 2\nÉ\né\nIt goes on."), (None, "Page 1\nPage 1\n}"), (4, "All rights reserved!")]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: list(r.removed) for r in out} == {1: [], 2: [0], 3: [0, 2], None: [1], 4: []}
    assert Counter((r.doc_id, tuple(r.removed)) for r in out) == removed_lines(rows)
    assert {r.doc_id: r.text for r in out}[3] == "É\nIt goes on."


@pytest.mark.parametrize("hot", [64, 3])
def test_lines_that_share_one_segment(spark, monkeypatch, hot):
    """Many lines with one text in common, at its start, middle or end, some of them near others; short rests and repeats in a line too."""
    monkeypatch.setattr(lines, "HOT_KEY", hot)
    rng, own = random.Random(13), []
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    common = word(16)
    for k in range(150):
        a, b = word(16), word(16)
        own.append([common + a + b, a + common + b, a + b + common][k % 3])
    own += ["abc" * 14, "abc" * 13 + "abd", "ab" * 20, "ab" * 20 + "a"]
    for x in rng.sample(own, 60):
        y = list(x)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(y))
            y[i : i + rng.randint(0, 1)] = rng.choice(["", "z", "zz"])
        own.append("".join(y))
    rng.shuffle(own)
    rows = [(i, "\n".join(own[i::40])) for i in range(40)]
    got = Counter((r.doc_id, tuple(r.removed)) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == removed_lines(rows) and sum(len(k[1]) for k in got) > 20


# 7
@pytest.mark.parametrize("name", [queries.TOKENIZER, "byte_bpe_50k.json"])
def test_encoder_equals_the_library(spark, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library, ours = Tokenizer.from_file(path), packing.WordEncoder(path, most=50)
    odd = ["a\x1cb", "a\x85b", "a\xa0b", "a​b", "<|endoftext|> x", "I'S it's don''t're", "a_b__c 12³ ¼ ª", "Straße İ Σας", "é", "\x00", "x’s", "ǅ ŉ ſ", "word" * 40, "", "…—“q”", "﻿", "中文字", "'ll", "'S"]
    for t in [*odd, *(t for _, t in texts(spark))]:
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:50]


def test_packing_is_a_round_trip(spark, rough, none):
    import public_tokenizers

    pieces = packing.pack_documents(rough, queries.TOKENIZER).collect()
    encoder = packing.WordEncoder(public_tokenizers.path(queries.TOKENIZER))
    docs = Counter()
    for i, t in ROWS:
        docs[(i, len(encoder.encode(t)) // 4 + 1)] += 1
    per = defaultdict(int)
    windows = defaultdict(list)
    for p in pieces:
        per[(p.doc_id, p.doc_tokens)] += p.length
        windows[p.sequence_id].append(p)
        ids = np.frombuffer(encoder.encode(next(t for i, t in ROWS if i == p.doc_id and len(encoder.encode(t)) // 4 + 1 == p.doc_tokens)), "<u4").tolist() + [2]
        assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    assert per == {k: k[1] * n for k, n in docs.items()}
    for ps in windows.values():
        ps.sort(key=lambda p: p.offset)
        assert ps[0].offset == 0 and all(b.offset == a.offset + a.length for a, b in pairwise(ps)) and ps[-1].offset + ps[-1].length <= 4096
    assert packing.pack_documents(none, queries.TOKENIZER).count() == 0


def test_settings_of_other_tokenizers_are_kept(tmp_path):
    """The same vocabulary without lower-casing is not looked up by chunks."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(queries.TOKENIZER)) as f:
        settings = json.load(f)
    settings["normalizer"]["normalizers"].pop()
    path = tmp_path / "own.json"
    path.write_text(json.dumps(settings))
    encoder, library = packing.WordEncoder(str(path)), Tokenizer.from_file(str(path))
    assert not encoder.by_chunks
    assert np.frombuffer(encoder.encode("Hello World"), "<u4").tolist() == library.encode("Hello World", add_special_tokens=False).ids


def test_level_choice_against_brute_force():
    """Each placement has the least sum of squares, the fullest window among ties."""
    rng = random.Random(3)
    for _ in range(300):
        packer = packing.SquareSumPacker(20)
        for h in range(1, 20):
            packer.levels[h] = rng.choice([0, 0, 1, 2, 3])
        n = rng.randint(1, 19)

        def cost(level):
            counts = packer.levels.astype(int).tolist()
            if level:
                counts[level] -= 1
            if level + n < 20:
                counts[level + n] += 1
            return sum(c * c for c in counts[1:20])

        options = [0] + [h for h in range(1, 21 - n) if packer.levels[h]]
        best = min(options, key=lambda h: (cost(h), -h))
        assert packer._level(n) == best


def test_packer_leaves_one_open_window():
    rng = random.Random(1)
    packer, out = packing.SquareSumPacker(64, gap=6, most_open=8), []
    for i in range(500):
        out += packer.add(i, b"abcd" * rng.randint(1, 150))
    out += packer.finish()
    fill = Counter()
    for p in out:
        fill[p[5]] += p[2]
    assert sum(n < 64 for n in fill.values()) <= 1 and max(fill.values()) == 64


# 8
def classes_of(rows, percent=85):
    sets = []
    for i, t in rows:
        w = BLANK.findall((t or "").translate(AZ))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets)


def test_minhash(spark, rough, none):
    got = minhash.near_duplicates(rough)
    assert Counter(tuple(r) for r in got.collect()) == classes_of(ROWS)
    assert minhash.near_duplicates(none).count() == 0


def test_minhash_chains(spark):
    """Chains of copies that drift: neighbours are linked, ends are not."""
    rng, rows = random.Random(2), []
    for g in range(6):
        words = [f"w{g}x{rng.randrange(400)}" for _ in range(260)]
        for k in range(12):
            for _ in range(rng.choice([1, 2, 3])):
                words[rng.randrange(len(words))] = f"n{g}y{rng.randrange(10**6)}"
            rows.append((g * 100 + k, " ".join(words)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in minhash.near_duplicates(docs).collect()) == classes_of(rows)


def test_minhash_with_a_bad_hub(spark):
    """One text in 120 versions, the smallest id the farthest one: links by rare shingles, and versions linked with nothing."""
    rng, rows = random.Random(6), []
    base = [f"w{k}" for k in range(150)]
    for i in range(120):
        words, changes = list(base), 6 if i == 0 else i % 5
        for k in rng.sample(range(150), changes):
            words[k] = f"n{i // 4 if i % 8 == 3 else i}y{k}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in minhash.near_duplicates(docs).collect()) == classes_of(rows)


def test_minhash_joins_rare_shingles_exactly(spark):
    rng, sets = random.Random(8), []
    for i in range(150):
        own = {rng.randrange(200) for _ in range(rng.randint(1, 30))} if i % 5 == 0 else {x for x in sets[i - i % 5][2] if rng.random() > 0.1} | {200 + i}
        sets.append((i, i % 3, sorted(own - ({200 + i} if rng.random() > 0.5 and len(own) > 1 else set()))))
    for percent in (60, 80, 85):
        want = {(j, i) for i, p, a in sets for j, q, b in sets if i < j and p != q and 100 * len({*a} & {*b}) >= percent * len({*a} | {*b})}
        got = minhash.prefix_pairs(spark.createDataFrame(sets, "id long, part long, shingles array<long>"), percent)
        assert want and want <= {(r.src, r.dst) for r in got.collect()}


def test_minhash_with_one_id_on_two_texts(spark):
    text = [f"a{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    rows = [(1, " ".join(text[0])), (2, " ".join(text[1])), (3, " ".join(text[0])), (3, " ".join(text[1])), (3, " ".join(text[1])), (4, ""), (4, " ".join(text[1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs.repartition(n)).collect()) for n in (1, 3)]
    third = {c for i, c, _ in got[0] if i == 3}
    assert got[0] == got[1] and third in ({1}, {2}) and {(1, 1, True), (2, 2, True), (4, 4, True), (4, 2, False)} <= {*got[0]}


def test_signature_estimates():
    words = [f"w{i}".encode() for i in range(2000)]
    a = minhash.shingle_set(b" ".join(words), minhash.WordHashes())
    b = minhash.shingle_set(b" ".join(words[200:]), minhash.WordHashes())
    x, y = (np.unpackbits(minhash.packed(minhash.minima(s)).view(np.uint8)).reshape(-1, 2) for s in (a, b))
    match = (x == y).all(axis=1).mean()
    assert abs((match - 0.25) / 0.75 - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.15


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1080)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# 9
def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (600, 3)).astype(float)
    y = np.clip((x[:, 0] + x[:, 1]).astype(int), 0, 2)
    w, cuts = toxicity.fit_ordinal(x, y, 3)
    assert w[0] > 1 and w[1] > 1 and abs(w[2]) < 0.5 and cuts[0] < cuts[1]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.xxhash64("doc_id") % 2 == 0
    got = toxicity.toxicity(docs, marks.where(half)).join(marks.where(~half).withColumnRenamed("toxic", "y"), "doc_id")
    counts = {(r.y, r.toxic): r["count"] for r in got.groupBy("y", "toxic").count().collect()}
    assert counts.get((0, True), 0) <= 0.005 * counts[(0, False)]
    # three in ten marked documents of these tables hold no telling word
    assert counts[(1, True)] >= 0.6 * (counts[(1, True)] + counts.get((1, False), 0))


def test_toxicity_scores_against_brute_force(spark):
    """Severity, grade and verdict of every row, from the model's weights by plain sums over words."""
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(toxicity.labelled_sample(docs, marks, "toxic", 10_000, "doc_id", "text"))
    want = []
    for i, text in texts(spark):
        counts = Counter(f for w in ALNUM.findall((text or "").translate(AZ)) for f in toxicity.features_of(w.encode()) if f in model.vocabulary)
        x = sum(model.weights[model.vocabulary[f]] * (1 + np.log(n)) for f, n in counts.items())
        above = [1 / (1 + np.exp(-(x - cut))) if abs(x - cut) < 40 else float(x > cut) for cut in model.cuts]
        each = [1 - above[0], above[0] - above[1], above[1]]
        want.append((i, int(np.argmax(each)), bool(above[0] >= 0.3), float(sum(above))))
    got = sorted((r.doc_id, r.grade, r.toxic, r.severity) for r in queries.op9_toxicity(spark, SF).collect())
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)] and model.vocabulary
    assert max(abs(a[3] - b[3]) for a, b in zip(got, sorted(want), strict=True)) < 1e-5


def test_toxicity_on_rough_rows(spark, rough, none, labels):
    got = toxicity.toxicity(rough, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ROWS)
    by_text = defaultdict(set)
    for (i, t), r in zip(sorted(ROWS, key=str), sorted(got, key=lambda r: str((r.doc_id, None))), strict=True):
        by_text[i].add((r.severity, r.grade, r.toxic))
    assert all(len(v) == 1 for i, v in by_text.items() if i is not None)
    for marks in (labels.where("false"), labels.where("toxic = 1"), labels.where("toxic = 0")):
        assert toxicity.toxicity(rough, marks).where("toxic").count() == 0
    assert toxicity.toxicity(none, labels).count() == 0


def test_toxicity_takes_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (1, "c d"), (2, "e"), (3, None), (None, "f")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (3, 1), (None, 1)], "doc_id long, toxic int")
    found = [sorted((r.i, r.y, bytes(r.t)) for r in toxicity.labelled_sample(docs.repartition(n), marks, "toxic", 10, "doc_id", "text").collect()) for n in (1, 4)]
    assert found[0] == found[1] and [(i, y) for i, y, _ in found[0]] == [(1, 1), (2, 0)]
    assert toxicity.labelled_sample(docs, marks, "toxic", 1, "doc_id", "text").count() <= 1


def test_telling_features_against_brute_force(spark):
    rng, rows = random.Random(5), []
    for i in range(300):
        y = i % 3 == 0
        words = [rng.choice(["common", "plain", "every"]) for _ in range(8)] + ([f"nasty{rng.randrange(9)}", "vile"][: rng.randint(0, 2)] if y else [f"kind{rng.randrange(9)}"])
        rows.append((i, int(y), " ".join(words).encode()))
    strong, marks = toxicity.telling_features(spark.createDataFrame(rows, "i long, y int, t binary"), 50, 4, 3)
    a, b = Counter(), Counter()
    for _, y, t in rows:
        (a if y else b).update({f for w in t.split() for f in toxicity.features_of(w)})
    n1, n0, want = sum(y for _, y, _ in rows), sum(not y for _, y, _ in rows), []
    for f in a:
        p, q = a[f], b[f]
        odds = np.log((p + 0.5) / (n1 - p + 0.5)) - np.log((q + 0.5) / (n0 - q + 0.5))
        error = (1 / (p + 0.5) + 1 / (n1 - p + 0.5) + 1 / (q + 0.5) + 1 / (n0 - q + 0.5)) ** 0.5
        if p + q >= 4 and p >= q and round(odds / error, 9) >= 3:
            want.append((-round(odds / error, 9), f))
    assert strong == [f for _, f in sorted(want)] and {b"nast*", b"nasty*"} <= {*strong} and b"nasty" not in strong
    assert marks == {f for f in a if b[f] == 0 and a[f] >= 3 and not f.endswith(b"*")}


# 10
def test_licenses(spark, rough, none):
    rows = [(1, "x Under the MIT License, y under the mit license"), (2, "This work is licensed under the GNU General Public License, version 3."),
            (3, "CC BY-NC 4.0 and Apache License, Version 2.0"), (4, "gnu public thing"), (5, None)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 6, ["mit"])
    assert got[2].labels == ["gpl-3"] and got[2].n_base == 0 and got[2].score == 1.0
    assert got[3].base_labels == ["apache-2", "cc-by-nc"] and got[4].labels == [] and got[4].score == 0.0 and got[5].n_words == 0
    assert licenses.scan_licenses(rough).count() == len(ROWS) and licenses.scan_licenses(none).count() == 0


def test_wrapped_notices(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal"""
    bsd = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:"""
    far = "released\n" + "under the\n" + "word " * 14 + "\nmit license"
    rows = [(1, mit), (2, bsd), (3, "head\n" * 50 + mit.replace(" ", "\n")), (4, far)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (["mit"], 1.0), 2: (["bsd"], 1.0), 3: (["mit"], 1.0), 4: ([], 0.0)}


def test_windows_against_brute_force():
    rng = random.Random(10)
    vocabulary = [f"t{i}".encode() for i in range(30)]
    for threshold in (0.5, 0.9):
        templates = [(str(k), b" ".join(rng.sample(vocabulary, rng.randint(1, 9))).decode()) for k in range(12)]
        index = licenses.TemplateIndex(templates, {}, threshold)
        span = max(len(t.split()) for _, t in templates)
        for _ in range(100):
            words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
            want = set()
            for label, t in templates:
                tokens = set(t.encode().split())
                share = max(len(tokens & set(words[i : i + span])) for i in range(len(words))) / len(tokens)
                if share >= threshold - 1e-9:
                    want.add((label, share))
            assert set(index.search_windows(words, set(words))) == want


def test_template_index_is_exact():
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(25)]
    for threshold in (0.5, 0.8, 0.9, 1.0):
        templates = [(str(k), " ".join(rng.sample(vocabulary, rng.randint(1, 9)))) for k in range(12)]
        index = licenses.TemplateIndex(templates, {w.encode(): rng.randrange(50) for w in vocabulary}, threshold)
        for _ in range(150):
            block = {w.encode() for w in rng.sample(vocabulary, rng.randint(0, 18))}
            want = set()
            for label, t in templates:
                words = set(t.encode().split())
                if len(words & block) / len(words) >= threshold - 1e-9:
                    want.add((label, len(words & block) / len(words)))
            assert set(index.search(block)) == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(cursor.fetchall()) == Counter(tuple(r[n] for n in names) for r in df.collect())


def test_sha_of_items(spark):
    r = queries.op3_decontamination(spark, SF).where("n_items = 0").first()
    assert r.items_sha256 == hashlib.sha256(b"").hexdigest()
