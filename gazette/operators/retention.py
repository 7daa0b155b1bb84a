"""Retention over tables in folders per publication day: whole days are dropped, one day is rewritten.

Articles lie in folders of their ``published_date``, seen rows in folders of the day of their article. A run counts the
older days by the row counts in their file footers, drops their folders, and rewrites only the day that the cutoff falls
into. Rows without a day (undated articles, seen rows whose article was not stored) are not touched.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.constants import RETENTION_DAYS
from gazette.operators.skew import skew_join
from gazette.session import written
from gazette.sources.tables import drop_folders

DAY = "published_date"


def append_by_day(articles: DataFrame, path: str) -> None:
    articles.withColumn(DAY, F.to_date("published_at")).write.mode("append").partitionBy(DAY).parquet(path)


def append_seen_by_day(seen: DataFrame, articles: DataFrame, path: str) -> None:
    """Append seen rows of a run; ``articles`` needs the days of the articles shown only, not the whole history."""
    days = articles.select(F.col("id").alias("article_id"), F.to_date("published_at").alias(DAY))
    rows = skew_join(seen, days, "article_id", "left", spread=F.xxhash64("user_auth_id"))
    # Each day goes to one task, or a few that share a large one: else every task writes a file into every day's folder.
    rows = rows.select(*seen.columns, DAY).repartitionByRange(DAY, "article_id", "user_auth_id")
    rows.write.mode("append").partitionBy(DAY).parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as its folders are now; None if it has no files."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _rewrite(kept: DataFrame, path: str, day: date) -> None:
    """Replace the folder of ``day`` by ``kept``, which lies elsewhere; the other folders stay as they are."""
    if kept.isEmpty():
        drop_folders(kept.sparkSession, path, DAY, lambda name: name == str(day))
    else:
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def retention_by_days(spark: SparkSession, articles: str, seen: str, as_of: datetime, days: int | None = None) -> tuple[int, int]:
    """Remove articles published before ``as_of`` less ``days`` and their seen rows from the folders; how many of both.

    Seen rows go before the articles that name them, so a run that breaks off is completed by repeating it; the numbers are
    those of what the repeated run still found.
    """
    cutoff = as_of - timedelta(days=RETENTION_DAYS if days is None else days)
    day, at = cutoff.date(), F.lit(cutoff).cast("timestamp_ntz")
    all_articles, all_seen = _stored(spark, articles), _stored(spark, seen)
    removed = [0, 0]
    if all_articles is not None:
        boundary = all_articles.filter(F.col(DAY) == F.lit(day))
        expired = written(boundary.filter(F.col("published_at") < at).select("id"), "expired")
        n = expired.count()
        if n:
            if all_seen is not None:
                shown = all_seen.filter(F.col(DAY) == F.lit(day))
                gone = expired.select(F.col("id").alias("article_id"))
                kept = written(skew_join(shown, gone, "article_id", "left_anti", spread=F.xxhash64("user_auth_id")).select(*all_seen.columns), "seen-kept")
                removed[1] += shown.count() - kept.count()
                _rewrite(kept, seen, day)
            _rewrite(written(boundary.filter(F.col("published_at") >= at), "articles-kept"), articles, day)
            removed[0] += n
    for i, (table, path) in reversed(list(enumerate(((all_articles, articles), (all_seen, seen))))):
        if table is not None:
            removed[i] += table.filter(F.col(DAY) < F.lit(day)).count()
            drop_folders(spark, path, DAY, lambda name: name < str(day))
    return removed[0], removed[1]
