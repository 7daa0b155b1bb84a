"""Landed RSS files as rows, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.text import strip
from gazette.schemas import FEED_ITEM

_OPTIONS = {"rowTag": "item", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "true"}


def _rows(raw: DataFrame) -> DataFrame:
    """Add the file and the feed: the name of the feed's folder (``feed=...``) or else of the file."""
    folder = F.nullif(F.regexp_extract("file", r"/feed=([^/]+)/", 1), F.lit(""))
    name = F.regexp_extract("file", r"([^/]+?)(?:\.xml)?$", 1)
    return raw.withColumn("file", F.col("_metadata.file_path")).withColumn("feed", F.coalesce(folder, name))


def feed_scan(spark: SparkSession, *paths: str) -> DataFrame:
    """Items of landed feed files. A file without items, or one that is no XML, gives no row."""
    raw = spark.read.format("xml").options(**_OPTIONS).schema(FEED_ITEM).load(",".join(paths))
    return drop_empty(_rows(raw))


def feed_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream over a folder in which feed files land."""
    raw = (
        spark.readStream.format("xml")
        .options(**_OPTIONS)
        .option("maxFilesPerTrigger", files_per_trigger)
        .schema(FEED_ITEM)
        .load(path)
    )
    return drop_empty(_rows(raw))


def drop_empty(items: DataFrame) -> DataFrame:
    present: Column = F.coalesce(*[F.col(c) for c in ("link", "title", "description")]).isNotNull()
    return items.filter(present)


def union_sources(*feeds: DataFrame) -> DataFrame:
    """Rows of several feeds together; columns are matched by name."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out


def write_feed(items: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write items as RSS-like XML files, one folder per feed; with ``append`` they land beside earlier ones."""
    for_xml = items.withColumn("title", strip(F.col("title")))
    for_xml.write.format("xml").option("rootTag", "channel").option("rowTag", "item").partitionBy("feed").mode(mode).save(path)
