"""Substring search through an index of trigrams, so that a search reads the articles it may find and no others.

The index of a table of articles is a folder with the table ``postings`` (gram, ids, articles) in folders per creation
day, sorted by trigram; ``articles`` counts the ids, and a trigram may have several rows in a day. A search takes the rarest
trigrams of its pattern by their counts, intersects their postings and verifies the articles left. Row groups and day
folders without them are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.constants import DEFAULT_LIMIT
from gazette.functions.text import contains_pattern
from gazette.operators.serving import by_filters, check_page, fetch_page, newest
from gazette.session import text_batches, written
from gazette.sources.tables import drop_folders

GRAM = 3
#: The rarest trigrams of a pattern whose postings are intersected. What they let pass is verified.
PROBES = 4
#: Days that are named in the filter of the articles; for more of them only the oldest and the newest are.
DAYS = 1_000


#: Bits of a code point in the number of a trigram.
POINT = 21


def grams(*texts: str | None) -> np.ndarray:
    """The distinct trigrams of some texts, by code points, as ascending numbers."""
    found = [np.zeros(0, np.uint64)]
    for text in texts:
        points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = max(len(points) - GRAM + 1, 0)
        found.append(sum((points[k:k + size] << np.uint64(POINT * (GRAM - 1 - k)) for k in range(GRAM)), np.zeros(size, np.uint64)))
    return np.unique(np.concatenate(found))


def spelled(numbers: np.ndarray) -> list[str]:
    """Trigrams as text."""
    points = np.stack([numbers >> np.uint64(POINT * (GRAM - 1 - k)) & np.uint64((1 << POINT) - 1) for k in range(GRAM)], axis=1)
    text = points.astype(np.uint32).tobytes().decode("utf-32-le")
    return [text[i:i + GRAM] for i in range(0, len(text), GRAM)]


def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(created_date, gram, ids, articles) of the rows of each batch (created_date, id, title, content in lower case)."""
    for batch in batches:
        dates, ids = batch.column("created_date"), batch.column("id")
        day = np.unique(dates.cast(pa.int32()).fill_null(-(1 << 31)).to_numpy(zero_copy_only=False), return_inverse=True)[1]
        own = [grams(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("title", "content")), strict=True)]
        row = np.repeat(np.arange(len(own)), [len(g) for g in own])
        gram = np.concatenate([np.zeros(0, np.uint64), *own])
        order = np.lexsort((gram, day[row]))
        row, gram = row[order], gram[order]
        start = np.flatnonzero(np.concatenate((np.ones(min(len(row), 1), bool), (gram[1:] != gram[:-1]) | (day[row[1:]] != day[row[:-1]]))))
        ends = np.append(start, len(row))
        yield pa.RecordBatch.from_arrays(
            [dates.take(pa.array(row[start])), pa.array(spelled(gram[start]), pa.string()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.take(pa.array(row))), pa.array(np.diff(ends), pa.int64())],
            ["created_date", "gram", "ids", "articles"])


def pattern_grams(spark: SparkSession, query: str) -> list[str]:
    """The trigrams that every text holding the query has; none if no run of fixed characters is long enough."""
    pattern = spark.range(1).select(F.lower(F.lit(contains_pattern(query)))).first()[0]  # as Spark lowers it for ILIKE
    runs, i = [""], 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
            runs[-1] += pattern[i]
        elif pattern[i] in "%_":
            runs.append("")
        else:
            runs[-1] += pattern[i]
        i += 1
    return sorted({run[i:i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)})


def append_search_index(articles: DataFrame, path: str) -> None:
    """Add the trigrams of new articles, as of one run of the ingest, to the index at ``path``.

    Null titles and contents have none. Articles are dealt by day and id, so that a day of many articles is spread; their
    trigrams, hundreds of times as many rows, are grouped where they arise and not shuffled.
    """
    spark = articles.sparkSession
    text_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = [F.lower(F.col(c)).alias(c) for c in ("title", "content")]  # as Spark lowers it for ILIKE
    rows = articles.select(F.to_date("created_at").alias("created_date"), "id", *low)
    parted = rows.repartitionByRange(tasks, "created_date", "id").sortWithinPartitions("created_date")
    schema = T.StructType([
        T.StructField("created_date", T.DateType()), T.StructField("gram", T.StringType()),
        T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("articles", T.LongType()),
    ])
    postings = parted.mapInArrow(posted, schema).sortWithinPartitions("created_date", "gram")
    postings.write.mode("append").partitionBy("created_date").parquet(f"{path}/postings")


def expire_search_index(spark: SparkSession, path: str, before: str) -> None:
    """Drop the days before the date ``before`` (YYYY-MM-DD) by their folders, as retention does with their articles."""
    drop_folders(spark, f"{path}/postings", "created_date", lambda day: day < before)


def candidates(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """(created_date, id) of the articles that have the rarest of the wanted trigrams."""
    postings = spark.read.parquet(f"{path}/postings")
    sizes = postings.filter(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("articles").alias("articles"))
    found = {r["gram"]: r["articles"] for r in sizes.collect()}  # a row per trigram of the pattern
    rarest = sorted(wanted, key=lambda g: (found.get(g, 0), g))[:PROBES]
    rows = postings.filter(F.col("gram").isin(rarest)).select("created_date", "gram", F.explode("ids").alias("id"))
    hits = rows.groupBy("created_date", "id").agg(F.count_distinct("gram").alias("n"))
    return hits.filter(F.col("n") == len(rarest)).select("created_date", "id")


def search_indexed(
    articles: DataFrame, path: str, query: str, limit: int = DEFAULT_LIMIT, offset: int = 0,
    category: str | None = None, language: str | None = None,
) -> DataFrame:
    """``search_articles`` over stored articles (in folders per ``created_date``) with their index at ``path``.

    A query without three fixed characters in a row reads all articles, as no trigram tells them apart.
    """
    check_page(limit, offset)
    if not query:
        raise ValueError("the search query must not be empty")
    spark, pattern = articles.sparkSession, contains_pattern(query)
    wanted, rows = pattern_grams(spark, query), by_filters(articles, category, language)
    if wanted:
        kept = written(candidates(spark, path, wanted), "candidates")
        rows = in_days(rows, kept).join(kept.select("id"), "id", "left_semi")
    hits = rows.filter(F.col("title").ilike(pattern) | F.col("content").ilike(pattern))
    page = hits.select("id", "created_at").orderBy(*newest()).offset(offset).limit(limit)
    return fetch_page(articles, page)


def in_days(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of the days in ``kept``; the filter prunes folders."""
    days = [r[0] for r in kept.select("created_date").distinct().limit(DAYS + 1).collect()]
    if len(days) <= DAYS:
        return rows.filter(F.col("created_date").isin(days))
    span = kept.agg(F.min("created_date"), F.max("created_date")).first()
    return rows.filter(F.col("created_date").between(*span))
