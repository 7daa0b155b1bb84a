"""Notification texts, and the token rules of refresh sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.constants import (
    BODY_CUT,
    BODY_LIMIT,
    CLICK_ACTION,
    DEFAULT_CATEGORY,
    NOTIFICATION_TYPE,
    PLACEHOLDER_IMAGE,
    REFRESH_TOKEN_DAYS,
)
from gazette.functions.dates import iso_text
from gazette.functions.text import empty_to_null


def topic_name(language: Column) -> Column:
    return F.concat(F.lit("news_"), F.lower(language))


def notification_body(title: Column) -> Column:
    return F.when(F.length(title) > BODY_LIMIT, F.concat(F.substring(title, 1, BODY_CUT), F.lit("..."))).otherwise(title)


def notification_image(image_url: Column) -> Column:
    return F.coalesce(empty_to_null(image_url), F.lit(PLACEHOLDER_IMAGE))


def notification_payload(article: Column) -> Column:
    """The twelve string fields of a push message for an article struct."""
    return F.struct(
        F.lit(NOTIFICATION_TYPE).alias("type"),
        article["id"].cast("string").alias("id"),
        article["source_name"].alias("source_name"),
        article["source_url"].alias("source_url"),
        article["title"].alias("title"),
        F.coalesce(article["author"], F.lit("")).alias("author"),
        notification_image(article["image_url"]).alias("image_url"),
        F.coalesce(empty_to_null(article["category"]), F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.coalesce(article["content"], F.lit("")).alias("content"),
        iso_text(article["published_at"]).alias("published_at"),
        iso_text(article["created_at"]).alias("created_at"),
        F.lit(CLICK_ACTION).alias("click_action"),
    )


def sha256_token(token: Column) -> Column:
    return F.sha2(token, 256)


def session_expiry(created_at: Column) -> Column:
    return created_at + F.make_dt_interval(F.lit(REFRESH_TOKEN_DAYS))
