"""The notification hand-over: one outbox row per run and language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.notify import notification_body, notification_image, notification_payload, topic_name
from gazette.schemas import ARTICLE_COLS


def last_saved(saved: DataFrame, group: list[str], order: Column | str = "pos") -> DataFrame:
    """The last inserted article of each run, by insertion order, which is unique in a run.

    Only the order is ranked; the few articles that are last are then looked up, so no contents are sorted or shuffled.
    ``saved`` is read twice and should be a stored table.
    """
    placed = saved.withColumn("_place", F.col(order) if isinstance(order, str) else order)
    last = placed.groupBy(*group).agg(F.max("_place").alias("_place"))
    return placed.join(last, [*group, "_place"]).select(*group, *[c for c in ARTICLE_COLS if c not in group])


def notification_outbox(runs: DataFrame, last: DataFrame, group: list[str]) -> DataFrame:
    """Outbox rows (group, status, topic, title, body, image, payload); ``group`` ends with the language.

    A run that saved nothing gives a row with status no_article.
    """
    language = F.col(group[-1])
    article = F.when(F.col("_a.source_url").isNotNull(), F.col("_a"))
    rows = last.select(*group, F.struct(
        "id", "source_name", "source_url", "title", "author", "image_url", "content", "category",
        "published_at", "created_at",
    ).alias("_a"))
    joined = runs.select(*group).distinct().join(rows, group, "left")
    found = article.isNotNull()
    return joined.select(
        *group,
        F.when(found, F.lit("ready")).otherwise(F.lit("no_article")).alias("status"),
        F.when(found, topic_name(language)).alias("topic"),
        F.col("_a.source_name").alias("title"),
        notification_body(F.col("_a.title")).alias("body"),
        F.when(found, notification_image(F.col("_a.image_url"))).alias("image"),
        F.when(found, F.to_json(notification_payload(F.col("_a")))).alias("payload"),
    )
