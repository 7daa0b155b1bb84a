"""One small test per finding of the third review round, each on rows of its own."""

import random
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gazette.functions.similarity import token_set_ratio
from gazette.llm import pieces, simhash, toxicity
from gazette.operators import dedupe, enrich, ingest, retention, search, seen_bits
from gazette.plans.queries import QUERIES
from gazette.session import shared_dir
from gazette.sources import feeds
from gazette.streaming import titles

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, path, rows, files=2):
    spark.createDataFrame(rows, DOCUMENTS).repartition(files).write.parquet(f"{path}/documents.parquet")


def test_stream_reads_a_table_in_a_folder(spark, tmp_path):
    documents(spark, tmp_path, [(i, "Text", ["en", "fr"][i % 2], ["a", "b", "b"][i % 3], 4) for i in range(12)])
    rows = QUERIES["stream_url_dedupe"](spark, str(tmp_path)).collect()
    assert sorted(r.url for r in rows) == [f"https://{s}.example.com/{lang}" for s in "ab" for lang in ("en", "fr")]


def stored_mb(spark):
    return sum(f.stat().st_size for f in Path(shared_dir(spark)).rglob("*") if f.is_file()) / 1e6


def test_long_titles_are_not_stored_once_per_element(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(6)) for _ in range(3_000)]
    titles = [" ".join(sorted(set(rng.sample(words, 600)))) for _ in range(3)]
    titles.append(" ".join(sorted({*titles[0].split()[:-40], *(f"z{i}" for i in range(30))})))
    rows, before = spark.createDataFrame([(t,) for t in titles], "k string"), stored_mb(spark)
    got = {(r.k_a, r.k_b) for r in dedupe.similar_keys(dedupe.two_sides(rows, rows)).collect()}
    want = {(a, b) for a in titles for b in titles if a < b and token_set_ratio(a, b) >= 85}
    assert got == want and len(want) == 1
    assert stored_mb(spark) - before < 5  # four titles of 4 kB; the elements with their title took 10 times that


def test_seen_rows_of_a_day_lie_in_few_files(spark, tmp_path):
    articles = spark.range(40).select("id", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id % 10 as int))").alias("published_at"))
    seen = spark.range(800).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("user_auth_id"), (F.col("id") % 40).alias("article_id"))
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")
    try:
        retention.append_seen_by_day(seen, articles, str(tmp_path / "seen"))
    finally:
        spark.conf.unset(merged)
    days = list((tmp_path / "seen").glob("published_date=*"))
    assert len(days) == 10 and spark.read.parquet(str(tmp_path / "seen")).count() == 800
    assert len(list((tmp_path / "seen").rglob("*.parquet"))) <= 2 * len(days)


def test_retention_may_leave_no_row(spark, tmp_path):
    documents(spark, tmp_path, [(i, "Text", "en", "a", 4) for i in (0, 1, 5_000)])
    spark.createDataFrame([(0, 7, "view")], "event_id long, user_id long, event_type string").withColumn(
        "ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["retention_by_days"](spark, str(tmp_path)).collect()] == [("article", 5_000, "")]


def rows_at_once(spark, run):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    run()
    return int(spark.conf.get(name))


def test_pages_go_to_python_in_small_batches(spark):
    pages = spark.createDataFrame([("http://a.b/c", "<article><p>" + "word " * 60 + "</p></article>")], "url string, html string")
    assert rows_at_once(spark, lambda: ingest.html_article(pages).collect()) <= 500


def test_requests_go_to_python_in_small_batches(spark):
    requests = spark.createDataFrame([("en", 0, "i", "p", "r")], "language string, batch_no long, instruction string, provider string, request string")
    assert rows_at_once(spark, lambda: enrich.enrich_batches(requests, lambda p, i, r: r).collect()) <= 500


def test_nearly_empty_bitmaps_are_sorted_in_many_tasks(spark):
    """20,000 bitmaps of 4 KB that shrink to next to nothing in a shuffle: by their stored bytes one task would sort all."""
    one = F.concat(F.lit(b"\x01"), F.lit(bytes(4_095)))
    bits = spark.range(20_000).select((F.col("id") % 10_000).cast("string").alias("user_auth_id"), F.lit(1).cast("long").alias("bucket"), one.alias("bits"))
    merged = seen_bits.merged_bits(bits)
    tasks = merged.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert sum(r["count"] for r in tasks) == 10_000 and max(r["count"] for r in tasks) <= 6_000
    users = spark.createDataFrame([("7",), ("none",)], "user_auth_id string")
    assert [(r.user_auth_id, r.bucket) for r in seen_bits.merged_bits(bits, users).collect()] == [("7", 1)]


def test_trigrams_are_grouped_where_they_arise(spark, tmp_path):
    """The index is written without a staged copy of (gram, id) rows, and a trigram of a day is one row with its articles."""
    rows = [(i, "Storm over Porto" if i % 2 else None, "x" * (i % 4), "2024-01-0%d 10:00:00" % (1 + i % 2)) for i in range(20)]
    articles = spark.createDataFrame(rows, "id long, title string, content string, at string").withColumn("created_at", F.col("at").cast("timestamp_ntz"))
    before = len(list(Path(shared_dir(spark)).glob("postings-*")))
    search.append_search_index(articles, str(tmp_path))
    assert len(list(Path(shared_dir(spark)).glob("postings-*"))) == before
    postings = spark.read.parquet(f"{tmp_path}/postings")
    got = {(str(r.created_date), i) for r in postings.filter("gram = 'sto'").collect() for i in r.ids}
    assert got == {("2024-01-02", i) for i in range(1, 20, 2)} and postings.filter("gram = 'sto'").count() < 10
    assert postings.filter("gram = 'xxx'").agg(F.sum("articles")).first()[0] == 5
    assert [(r.id) for r in search.candidates(spark, str(tmp_path), ["sto", "xxx"]).orderBy("id").collect()] == [3, 7, 11, 15, 19]


def pages_table(spark, path, n):
    html = "<html><title>T</title><body><h1>A</h1><article><p>" + "word " * 60 + "</p></article></body></html>"
    spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.com/"), F.col("id")).alias("url"), F.lit(html).alias("html")).write.parquet(f"{path}/pages.parquet")


def test_feed_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """The files of a tick are many and tiny: merged by their bytes, they were all written by one task."""
    pages_table(spark, tmp_path, 600)
    seen = []
    monkeypatch.setattr(feeds, "write_feed", lambda items, path, mode="": seen.append(items.select(F.spark_partition_id().alias("p")).distinct().count()) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        QUERIES["ingest_stream"](spark, str(tmp_path))
    assert seen[0] > 2


def test_titles_of_a_third_land_in_many_files(spark, tmp_path, monkeypatch):
    """A third of the stored titles is written by the tasks that hold it, each run takes all of its files, and the result is that of one file."""
    documents(spark, tmp_path, [(i, f"Title {i % 70}\nText", ["fr", "de"][i % 2], "a", 9) for i in range(400)], files=6)
    pages_table(spark, tmp_path, 5)
    starts, start = [], titles.start_title_memory

    def run(articles, changes, log):
        starts.append(len(list(Path(shared_dir(spark)).glob("stored-titles-*/*.parquet"))))
        return start(articles, changes, log)

    before = len(list(Path(shared_dir(spark)).glob("stored-titles-*/*.parquet")))
    monkeypatch.setattr(titles, "start_title_memory", run)
    got = {r.norm for r in QUERIES["stream_title_lookback"](spark, str(tmp_path)).collect()}
    assert {t for t in got if t.startswith("title")} == {f"title {i % 70}" for i in range(400) if i * 13 >= 399 * 13 - 24 * 60}
    assert len(starts) == 3 and starts[-1] - before > 3


def test_toxicity_scores_of_texts_do_not_depend_on_each_other(monkeypatch):
    """Chains of several texts go through the field at once; results are those of each text alone, also where blocks end inside."""
    field = toxicity.Field(np.array([0, 4, 2, 1]))
    field.word[1:], field.move[:] = [3.0, 1.0, 0.5], [[0.5, 0], [0, 0.5]]
    scorer = toxicity.Scorer({"bad": 1, "poor": 2, "odd": 3}, vars(field), (0.4, 0.6, -1.0))
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["bad", "poor", "odd", "fine", "day", "."], k=rng.randrange(200))) for _ in range(60)]
    alone = [scorer.score(t) for t in texts]
    calls = []
    monkeypatch.setattr(scorer.field, "marginals", lambda *a: calls.append(1) or toxicity.Field.marginals(scorer.field, *a))
    assert list(scorer.scores(texts)) == alone and len(calls) < 5
    monkeypatch.setattr(toxicity, "AT_ONCE", 7)
    assert [s[3] for s in scorer.scores(texts)] == [s[3] for s in alone]
    assert np.allclose([s[:3] for s in scorer.scores(texts)], [s[:3] for s in alone])


def test_line_breaks_are_segmented_once(monkeypatch):
    """The ids of a line break are remembered like those of words, and all ids are the library's."""
    proto = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    model = pieces.Model(proto)
    model.newline = None
    asked, segment = [], model.segment
    monkeypatch.setattr(model, "segment", lambda text: asked.append(text) or segment(text))
    whole = sentencepiece.SentencePieceProcessor(model_proto=proto)
    for text in ["a\nb", "c\nd e\n\nf", "a  b\n\n c", " ", "\n", "  \nx  y z ", "ß\n🙂 Σ\n"]:
        assert np.frombuffer(model.encode(text), np.int32).tolist() == whole.encode(text)
    assert asked.count("\n") <= 1


def test_only_rows_of_repeated_ids_are_printed_again(spark, monkeypatch):
    printed = spark.sparkContext.accumulator(0)
    plain = simhash._print_column

    def counted(column, shingle, seed):
        @F.pandas_udf("string")
        def passed(texts: pd.Series) -> pd.Series:
            printed.add(len(texts))
            return texts

        return plain(passed(column), shingle, seed)

    monkeypatch.setattr(simhash, "_print_column", counted)
    texts = [" ".join(f"w{i * j % 97}x{i}" for j in range(9)) for i in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (None, "alone here")]
    kept = simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.text, r.doc_id) for r in kept if r.doc_id is not None) == sorted((t, i) for i, t in enumerate(texts))
    assert [r.text for r in kept if r.doc_id is None] == ["alone here"]
    assert printed.value == len(rows) + 4
