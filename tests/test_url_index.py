"""The index of stored URLs against the plain join, over several runs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gazette.operators import ingest, url_index
from gazette.sources import tables

T0 = datetime(2024, 3, 1)
COLS = "source_url string, title string, created_at timestamp_ntz"


def stored_rows(spark, urls, day=0):
    return spark.createDataFrame([(u, "t", T0 + timedelta(days=day)) for u in urls], COLS)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path, index = (str(tmp_path_factory.mktemp(n)) for n in ("stored", "urls"))
    runs = [stored_rows(spark, [f"https://n.com/{day}/{i}" for i in range(700)] + [None, "", "ଖବର " * 5000], day) for day in range(3)]
    for rows in runs:
        tables.append_articles(rows, path)
        url_index.append_url_index(rows, index)
    return spark.read.parquet(path), index


def batch_of(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


@pytest.mark.parametrize("urls", [
    [], [None], ["new"], ["", "ଖବର " * 5000, None], [f"https://n.com/{d}/{i}" for d in range(4) for i in range(0, 900, 7)] * 2,
])
def test_known_urls_through_the_index(spark, stored, urls):
    articles, index = stored
    batch = batch_of(spark, urls)
    got = [r[0] for r in url_index.known_urls_indexed(batch, articles, index).collect()]
    want = {r[0] for r in articles.collect()} & set(urls) - {None}
    assert len(got) == len(want) and set(got) == want


def test_filters_pass_every_stored_url_and_few_others(spark, stored):
    _, index = stored
    wanted = url_index.placed(spark.range(20_000).select(F.concat(F.lit("https://n.com/1/"), "id").alias("url")).withColumn("print", F.xxhash64("url")))
    passed = {r["url"] for r in url_index.passing(spark, index, wanted).collect()}
    assert {f"https://n.com/1/{i}" for i in range(700)} <= passed and len(passed) < 900


def test_a_full_filter_passes_about_one_in_a_hundred(spark, tmp_path):
    """3,000 URLs of one bucket; the upper bits are set by hand."""
    head = F.lit(5 << 44).cast("long")
    low = lambda seed: F.xxhash64("id", F.lit(seed)).bitwiseAND(F.lit((1 << 44) - 1))
    prints = spark.range(3_000).select((head + low(1)).alias("print"), F.lit(T0).cast("date").alias("created_date"))
    url_index._write(prints, str(tmp_path))
    others = url_index.placed(spark.range(5_000).select((head + low(2)).alias("print")))
    passed = url_index.passing(spark, str(tmp_path), others).count()
    assert others.select("part", "bucket").distinct().count() == 1 and passed < 150
    assert url_index.passing(spark, str(tmp_path), url_index.placed(prints)).count() == 3_000


def test_reads_the_parts_and_days_of_the_batch_only(spark, stored):
    articles, index = stored
    known = url_index.known_urls_indexed(batch_of(spark, ["https://n.com/1/5", "unknown"]), articles, index)
    plan = known._jdf.queryExecution().toString()
    assert "2024-03-02" in plan.split("PartitionFilters: [")[1].split("]")[0]
    wanted = url_index.placed(batch_of(spark, ["https://n.com/1/5"]).withColumn("print", F.xxhash64("url")))
    read = url_index._in_parts(url_index._prints(spark, index), wanted)
    assert len(read.inputFiles()) >= 1 and read.select("part").distinct().count() == 1
    assert "part" in read._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_compacted_index_forgets_days(spark, stored, tmp_path):
    articles, index = stored
    url_index.compact_url_index(spark, index, str(tmp_path / "new"), "2024-03-02")
    batch = batch_of(spark, ["https://n.com/0/1", "https://n.com/1/1", "https://n.com/2/1"])
    got = sorted(r[0] for r in url_index.known_urls_indexed(batch, articles, str(tmp_path / "new")).collect())
    assert got == ["https://n.com/1/1", "https://n.com/2/1"]


def test_a_print_without_its_article_is_no_duplicate(spark, stored):
    articles, index = stored
    left = articles.filter("source_url <> 'https://n.com/1/5'")
    assert url_index.known_urls_indexed(batch_of(spark, ["https://n.com/1/5"]), left, index).collect() == []
    assert ingest.known_urls(batch_of(spark, ["https://n.com/1/5"]), left).collect() == []
