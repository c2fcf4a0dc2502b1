"""Stored responses as a batch and as a stream source."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import rules
from tessera.sources import responses
from tessera.sources.html import html_elements

KIND = "url string, status int, content_type string, body string"


def stored(spark, folder, *rows):
    return responses.write_responses(spark.createDataFrame(list(rows), KIND).coalesce(1), folder)


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(responses.StoredResponses)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield str(tmp_path / "responses")
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_filter_on_the_host_reads_its_files_only(spark, folder):
    rows = [(f"https://{h}.example/{k}", 200, "text/html", f"<p>{h}{k}") for h in "abc" for k in range(4)]
    odd = [("https://A.example:80/x", 404, None, None), ("no address", 200, "text/html", "x"), ("https://u@c.example/big", 200, "text/html", "x" * 5_000_001)]
    assert stored(spark, folder, *rows, *odd) == 1
    read = spark.read.format("stored_responses").option("pieceBytes", 1).load(folder)
    assert sorted(r.url for r in read.collect()) == sorted([r[0] for r in rows] + [odd[0][0]])
    one = read.where("host = 'b.example' and status = 200")
    assert read.rdd.getNumPartitions() == 4 and one.rdd.getNumPartitions() == 1
    assert {r.body for r in one.collect()} == {f"<p>b{k}" for k in range(4)}
    some = read.where(F.col("host").isin("a.example", "c.example", "absent"))
    assert some.rdd.getNumPartitions() == 2 and some.count() == 8
    assert read.where("host = 'absent'").count() == 0
    # files that the filter leaves out are not opened: a broken one does no harm
    with open(f"{folder}/batch=1/host=a.example/broken.parquet", "w") as f:
        f.write("no table")
    assert one.count() == 4


def test_rules_run_on_the_source(spark, folder):
    stored(spark, folder, ("https://a.example/1", 200, "text/html", '<img src="x">'), ("https://a.example/2", 200, "text/html", "<h1>x</h1>"))
    pages = spark.read.format("stored_responses").load(folder).select(F.col("url").alias("page_id"), "url", F.col("body").alias("html"))
    found = rules.find_all(html_elements(pages).cache(), pages)
    assert [r.page_id for r in found.where("rule_id = 'img-alt'").collect()] == ["https://a.example/1"]


def test_the_stream_goes_on_behind_the_last_file(spark, folder, tmp_path):
    page = lambda k: (f"https://a.example/{k}", 200, "text/html", f"<p>{k}")

    def run():
        seen = []
        rows = spark.readStream.format("stored_responses").option("batchesPerTrigger", 1).load(folder)
        query = rows.writeStream.foreachBatch(lambda b, n: seen.append([r.url[-1] for r in b.collect()])).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return [x for x in seen if x]

    stored(spark, folder, page(1))
    stored(spark, folder, page(2))
    assert run() == [["1"], ["2"]]
    assert run() == []
    stored(spark, folder, page(3))
    (tmp_path / "responses" / "batch=4" / "host=a.example").mkdir(parents=True)  # a batch that is being written
    assert run() == [["3"]]
    assert stored(spark, folder, page(4)) == 4 and run() == [["4"]]
