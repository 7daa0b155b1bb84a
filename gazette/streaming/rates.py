"""Streams over events: seen articles and arrival rates."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gazette.constants import TICK_MINUTES
from gazette.operators.state import new_pairs
from gazette.schemas import SEEN
from gazette.session import cut_lineage


def arrival_rate(articles: DataFrame, watermark: str | None = None) -> DataFrame:
    """Articles per quarter hour and language, over a table or a stream (UTC session)."""
    # Watermarks exist for timestamps with a time zone only.
    at = F.col("created_at").cast("timestamp") if watermark else F.col("created_at")
    rows = articles.select(at.alias("created_at"), "language")
    rows = rows.withWatermark("created_at", watermark) if watermark else rows
    window = F.window("created_at", f"{TICK_MINUTES} minutes")
    counts = rows.groupBy(window.alias("w"), "language").agg(F.count(F.lit(1)).alias("arrivals"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("tick_start"), "language", "arrivals")


def append_seen(events: DataFrame, path: str) -> None:
    """Append the pairs of a micro-batch that the table does not hold yet. Repeating a batch appends nothing."""
    spark = events.sparkSession
    try:
        seen = spark.read.schema(SEEN).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        seen = spark.createDataFrame([], SEEN)
    first = cut_lineage(events.groupBy("user_auth_id", "article_id").agg(F.min("seen_at").alias("seen_at")))
    cut_lineage(new_pairs(first, seen)).write.mode("append").parquet(path)


def seen_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append (user_auth_id, article_id, seen_at) events to the seen table, each pair once for ever.

    The table itself is the memory, so no state grows with it.
    """
    return (
        events.writeStream.foreachBatch(lambda batch, _: append_seen(batch, path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
