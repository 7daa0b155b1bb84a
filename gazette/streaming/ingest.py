"""The ingest run as a stream: landed feed files or scraped items in, new article rows and outbox rows out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gazette import schemas
from gazette.constants import MAX_ARTICLE_AGE_DAYS, MAX_ITEMS_PER_FEED
from gazette.functions.dates import parse_publish_date
from gazette.functions.text import strip
from gazette.operators.dedupe import dedupe_articles
from gazette.operators.enrich import Ask, answers_of, ask_with_retry, batch_of_5, summary_merge
from gazette.operators.ingest import (
    feed_row_validity, feed_take_n, feed_url_filter, filter_by_date, html_article, ingest_insert, ingest_stats, source_join,
)
from gazette.operators.notifications import last_saved, notification_outbox
from gazette.operators.ranking import first_per_group, ordered_index
from gazette.session import cut_lineage

STORED = T.StructType([
    *schemas.ARTICLES.fields,
    T.StructField("created_date", T.DateType()),
    T.StructField("run_id", T.LongType()),
    T.StructField("out_pos", T.StructType([
        T.StructField("batch_no", T.LongType()),
        T.StructField("fallback", T.BooleanType()),
        T.StructField("pos", T.LongType()),
    ])),
])


@dataclass
class Run:
    """Folders of a stream, the model callable, and the clock (UTC, per run). Numbers of each run go to ``stats``."""

    articles: str
    outbox: str
    ask: Ask
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc).replace(tzinfo=None)
    stats: str | None = None


def stored_articles(spark: SparkSession, path: str) -> DataFrame:
    """The articles written so far; an empty table before the first run."""
    try:
        return spark.read.schema(STORED).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


def process_articles(scraped: DataFrame, stored: DataFrame, as_of: Column, ask: Ask) -> DataFrame:
    """New article rows of one run: recent rows, without duplicates, summarised, not stored yet.

    ``scraped`` holds the first items of each feed already; taking them comes before the other filters, so known
    items at the head of a feed use up its places.
    """
    recent = filter_by_date(scraped, as_of, MAX_ARTICLE_AGE_DAYS)
    unique = cut_lineage(dedupe_articles(recent, stored, as_of))
    batched = cut_lineage(batch_of_5(unique, ["language"]))
    merged = summary_merge(batched, answers_of(ask_with_retry(batched, ask)), as_of)
    # Insertion order, for the last article of a run: batch by batch, answered rows first.
    inserted = ingest_insert(merged, stored, order="out_pos")
    return inserted


def run_once(run: Run, scraped: DataFrame, run_id: int) -> None:
    """One run over a micro-batch. Running it again for the same ``run_id`` changes nothing.

    Rows are stamped with the run, and the outbox is made from the stamped rows of the table: if a run stops between
    the two writes, the repeated one inserts nothing but still finds its articles.
    """
    spark = scraped.sparkSession
    rows = cut_lineage(scraped)
    if rows.isEmpty():
        return
    as_of = F.lit(run.clock()).cast("timestamp_ntz")
    new = process_articles(rows, stored_articles(spark, run.articles), as_of, run.ask)
    stamped = new.withColumn("run_id", F.lit(run_id).cast("long")).withColumn("created_date", F.to_date("created_at"))
    stamped.select(*STORED.fieldNames()).write.mode("append").partitionBy("created_date").parquet(run.articles)
    saved = stored_articles(spark, run.articles).filter(F.col("run_id") == run_id)
    runs = rows.select(F.lit(run_id).cast("long").alias("run_id"), "language").distinct()
    box = notification_outbox(runs, last_saved(saved, ["run_id", "language"], "out_pos"), ["run_id", "language"])
    # One folder per run: a repeated run replaces its own rows.
    box.drop("run_id").write.mode("overwrite").parquet(f"{run.outbox.rstrip('/')}/run_id={run_id}")
    if run.stats:
        placed = rows.withColumn("source_position", F.col("pos"))
        numbers = ingest_stats(placed, saved.select("language"), ["language"])
        numbers.write.mode("overwrite").parquet(f"{run.stats.rstrip('/')}/run_id={run_id}")


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, html, fetched_at) of the pages that have landed so far."""
    return spark.read.schema("url string, html string, fetched_at timestamp_ntz").parquet(path)


def scraped_items(items: DataFrame, sources: DataFrame, pages: DataFrame, as_of: Column, take: int = MAX_ITEMS_PER_FEED) -> DataFrame:
    """The items of landed feed files as scraped rows: each with its source and page, the first ``take`` valid ones of a file.

    ``items`` comes from ``feed_scan`` or ``feed_stream``, ``sources`` has key, language, position, source_name and
    url_patterns. A file is one look at a feed. Items without a position stand in the order of the file. Of several
    pages with the link's URL the newest counts; an item whose page has not landed, or holds too little text, is skipped.
    """
    numbered = items.withColumn("position", F.coalesce("position", F.monotonically_increasing_id()))
    dim = sources.select(F.col("key").alias("feed"), "language", F.col("position").alias("source_position"), "source_name", "url_patterns")
    wanted = feed_url_filter(source_join(numbered, dim)).filter((F.col("link") != "") & (strip(F.col("title")) != ""))
    wanted = cut_lineage(wanted.select(
        "file", "position", "link", strip(F.col("title")).alias("title"), "language", "source_position", "source_name",
        parse_publish_date("published", "updated", "created", "pubDate", as_of=as_of).alias("publish_date"),
    ))
    links = wanted.select(F.col("link").alias("url")).distinct()
    newest = first_per_group(pages.join(links, "url", "left_semi"), ["url"], [F.desc("fetched_at"), F.col("html")])
    read = html_article(newest.select("url", "html")).drop("html", "page_date")
    valid = feed_row_validity(wanted.join(read.withColumnRenamed("url", "link"), "link"), "link")
    first = feed_take_n(valid, take, feed="file")
    placed = ordered_index(first, [F.col(c) for c in ("language", "source_position", "file", "position", "link")], name="pos")
    return placed.select(
        "pos", F.col("link").alias("url"), "source_name", F.col("title").alias("original_title"), strip(F.col("content")).alias("original_content"),
        "image_url", "authors", "publish_date", "language",
    )


def run_feeds(run: Run, items: DataFrame, sources: DataFrame, pages: str, run_id: int, take: int = MAX_ITEMS_PER_FEED) -> None:
    """One run over the feed files of a micro-batch, from the items to the outbox."""
    spark = items.sparkSession
    as_of = F.lit(run.clock()).cast("timestamp_ntz")
    run_once(run, scraped_items(items, sources, landed_pages(spark, pages), as_of, take), run_id)


def ingest_feed_stream(items: DataFrame, sources: DataFrame, pages: str, run: Run, checkpoint: str, take: int = MAX_ITEMS_PER_FEED) -> StreamingQuery:
    """Start the stream over all feed files that have landed (``feed_stream``); it stops when they are done.

    ``pages`` is the folder in which fetched pages land; each run reads the ones that its links name.
    """
    return (
        items.writeStream.foreachBatch(lambda batch, run_id: run_feeds(run, batch, sources, pages, run_id, take))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_stream(scraped: DataFrame, run: Run, checkpoint: str) -> StreamingQuery:
    """Start the stream over all items that have landed; it stops when they are done."""
    return (
        scraped.writeStream.foreachBatch(lambda batch, run_id: run_once(run, batch, run_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_url_dedupe(items: DataFrame, url: str = "url", arrival: str = "ingested_at", delay: str = "2 days") -> DataFrame:
    """Drop repeated URLs early. Event time is the arrival, so items with old or no dates are not late.

    URLs beyond the delay are caught by the join with the stored URLs in the run.
    """
    return items.withWatermark(arrival, delay).dropDuplicatesWithinWatermark([url])


def stream_late_drop(items: DataFrame, as_of: Column, date: str = "publish_date") -> DataFrame:
    """Drop old items by the clock of the run: a filter, not a watermark, and undated items stay."""
    return filter_by_date(items, as_of, MAX_ARTICLE_AGE_DAYS, date)
