"""The stages of the pipeline on rough rows and on a small scale."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P

from . import test_operators as brute

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_whole_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for number, (_, stage) in enumerate(P.STAGES):
        before = docs
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        if number < len(P.STAGES) - 1:
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
            assert docs.count() >= 0.7 * before.count()
    assert docs.groupBy("doc_id").agg(F.sum("length").alias("a"), F.max("doc_tokens").alias("b")).where("a <> b").count() == 0


def test_stages_on_rough_rows(spark, rough, tmp_path):
    docs = rough.withColumn("n_chars", F.length("text").cast("long"))
    for number, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, number
        rows = Counter(r.doc_id for r in out.collect())
        assert all(n <= Counter(r.doc_id for r in docs.collect())[i] for i, n in rows.items())
        empty = stage(spark, docs.where("false"), SF)
        assert empty.count() == 0 and empty.columns == docs.columns


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (3, text), (3, text), (9, text + " more"), (7, "another text altogether"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = P.minhash_stage(spark, docs, SF)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 7), (True, 0)]


def test_near_copies_at_0_82_are_one_group(spark):
    a = [f"w{i}" for i in range(200)]
    b = a[:181] + [f"x{i}" for i in range(19)]  # 177 of 215 shingles are common
    docs = spark.createDataFrame([(2, " ".join(b)), (1, " ".join(a))], "doc_id long, text string")
    assert [r.doc_id for r in P.minhash_stage(spark, docs, SF).collect()] == [1]


def test_every_stage_against_brute_force(spark):
    """Each stage on what the one before it kept, text by text."""
    rows = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    done = {}
    for name, stage in P.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = P.materialise(stage(spark, docs, SF), "test-stage")
        done[name] = (before, rows(docs))

    before, after = done["quality rules"]
    base = {i for i, t in before for s in [brute.base_statistics(t)] if s[0] >= 10 and 100 * s[4] <= 20 * s[0]}
    judged = {r.doc_id for r in P.quality.quality_rules(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert after == Counter((i, t) for i, t in before if i in judged) and judged <= base and len(judged) > 0.8 * len(base)

    before, after = done["line dedup"]
    want = Counter()
    for (i, gone), (j, text) in zip(brute.removed_lines(before, as_list=True), before, strict=True):
        assert i == j
        left = "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in set(gone))
        if not gone or left.strip():
            want[(i, text if not gone else left)] += 1
    assert after == want

    before, after = done["minhash near-dedup"]
    kept = {i for (i, _, _, k), _ in brute.classes_of(before, 80).items() if k}
    assert after == Counter((i, t) for i, t in before if i in kept)

    before, after = done["benchmark decontamination"]
    items = [(str(r.item_id), brute.ALNUM.findall(r.text.translate(brute.AZ))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = Counter()
    for i, t in before:
        words = brute.ALNUM.findall(t.translate(brute.AZ))
        hit, _ = brute.marked(words, items)
        if not (any(hit) and 20 * sum(hit) >= len(words)):
            clean[(i, t if not any(hit) else None)] += 1
    assert Counter(i for i, _ in clean.elements()) == Counter(i for i, _ in after.elements())
    assert all(after[(i, t)] == n for (i, t), n in clean.items() if t is not None)


def near_copies(rng, k, words=220):
    """One text of several lines in ``k`` versions with a changed word in a line or two each."""
    base = [[f"t{rng.randrange(10**6)}" for _ in range(words // 20)] for _ in range(20)]
    out = []
    for _ in range(k):
        lines = [list(x) for x in base]
        for _ in range(rng.randint(1, 2)):
            x = rng.choice(lines)
            x[rng.randrange(len(x))] = f"u{rng.randrange(10**6)}"
        out.append("\n".join(" ".join(x) for x in lines))
    return out


def test_near_copies_leave_the_corpus_once(spark):
    """Of planted near copies one whole text is left: what line dedup leaves of the others is their changed lines at most."""
    rng, rows = random.Random(1), []
    for g in range(30):
        rows += [(g * 10 + k, t) for k, t in enumerate(near_copies(rng, 4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    out = P.minhash_stage(spark, P.materialise(P.line_stage(spark, docs, SF), "test-lines"), SF).collect()
    whole = Counter(r.doc_id // 10 for r in out if len(r.text) > 0.5 * len(rows[0][1]))
    assert whole == Counter({g: 1 for g in range(30)})
    again = Counter(x for r in out for x in r.text.split("\n"))
    assert max(again.values()) == 1
