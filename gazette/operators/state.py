"""Users, seen articles and retention as new table versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.constants import RETENTION_DAYS
from gazette.functions.text import empty_to_null
from gazette.operators.skew import skew_join
from gazette.session import written


def notification_tokens(users: DataFrame) -> DataFrame:
    """Push tokens of users who want notifications; a token that several users share comes several times."""
    return users.filter(F.col("is_notification_enabled") & (F.col("fcm_token") != "")).select("fcm_token")


def user_apply_changes(users: DataFrame, events: DataFrame) -> DataFrame:
    """The users after a set of change events (auth_id, kind, fcm_token, is_enabled, event_at, seq), applied by ``seq``.

    Kind ``create`` adds a missing user, ``token`` sets the push token, ``preference`` sets the notification flag
    and the token if one is given. Any kind adds a missing user.
    """
    given = F.when(F.col("kind") == "preference", empty_to_null(F.col("fcm_token"))).otherwise(F.col("fcm_token"))
    sets_token = (F.col("kind") == "token") | ((F.col("kind") == "preference") & given.isNotNull())
    is_preference = F.col("kind") == "preference"
    # Folded before the shuffle, so a user with very many events is no more work than any other.
    folded = events.groupBy("auth_id").agg(
        F.min("event_at").alias("_first_at"),
        F.max_by(given, F.when(sets_token, F.col("seq"))).alias("_token"),
        F.max(F.when(sets_token, F.lit(True))).alias("_sets_token"),
        F.max_by("is_enabled", F.when(is_preference, F.col("seq"))).alias("_flag"),
    )
    return users.join(folded, "auth_id", "full_outer").select(
        "auth_id",
        F.coalesce("created_at", "_first_at").alias("created_at"),
        F.when(F.col("_sets_token"), F.col("_token")).otherwise(F.col("fcm_token")).alias("fcm_token"),
        F.coalesce("_flag", "is_notification_enabled", F.lit(False)).alias("is_notification_enabled"),
    )


def clear_tokens(users: DataFrame, invalid_tokens: DataFrame) -> DataFrame:
    """Users after push tokens were reported invalid: every holder loses the token and the flag."""
    bad = invalid_tokens.select("fcm_token").filter(F.col("fcm_token").isNotNull()).distinct()
    marked = skew_join(users, bad.withColumn("_bad", F.lit(True)), "fcm_token", "left", spread=F.xxhash64("auth_id"))
    return marked.select(
        "auth_id",
        "created_at",
        F.when(F.col("_bad").isNull(), F.col("fcm_token")).alias("fcm_token"),
        (F.col("is_notification_enabled") & F.col("_bad").isNull()).alias("is_notification_enabled"),
    )


def new_pairs(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """The (user_auth_id, article_id) rows, unique in ``pairs``, that the seen table does not hold.

    The table is read through once against the pairs, which are the smaller side, and is not shuffled for them when
    they are few.
    """
    keys = ["user_auth_id", "article_id"]
    known = seen.select(*keys).join(pairs.select(*keys), keys, "left_semi").distinct()
    return pairs.join(known, keys, "left_anti")


def mark_seen(seen: DataFrame, page: DataFrame, as_of: Column) -> DataFrame:
    """Rows to append for articles shown to users (auth_id, id); pairs that are there already are left out."""
    shown = page.select(F.col("auth_id").alias("user_auth_id"), F.col("id").alias("article_id")).distinct()
    return new_pairs(written(shown, "shown"), seen).withColumn("seen_at", as_of)


def expired_articles(articles: DataFrame, as_of: Column, days: int | None = None) -> DataFrame:
    cutoff = as_of - F.make_dt_interval(F.lit(RETENTION_DAYS if days is None else days))
    return articles.filter(F.col("published_at") < cutoff)


def kept_articles(articles: DataFrame, as_of: Column, days: int | None = None) -> DataFrame:
    """The next version of the articles: a pure filter, no join."""
    cutoff = as_of - F.make_dt_interval(F.lit(RETENTION_DAYS if days is None else days))
    return articles.filter(F.col("published_at") >= cutoff)


def cascade_delete_seen(
    seen: DataFrame, articles: DataFrame, as_of: Column, days: int | None = None, kept: bool = False
) -> DataFrame:
    """Seen rows of expired articles; with ``kept`` all others, the next version of the table."""
    gone = expired_articles(articles, as_of, days).select(F.col("id").alias("article_id"))
    how = "left_anti" if kept else "left_semi"
    return skew_join(seen, gone, "article_id", how, spread=F.xxhash64("user_auth_id")).select(*seen.columns)


def retention_counts(articles: DataFrame, seen: DataFrame, as_of: Column, days: int | None = None) -> DataFrame:
    """One row: how many articles and seen rows retention removes."""
    gone = expired_articles(articles, as_of, days)
    # Seen rows are counted per article first, so the join meets each article once.
    per_article = seen.groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))
    hit = per_article.join(gone.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    return gone.agg(
        F.count(F.lit(1)).alias("articles_deleted"),
    ).select(
        "articles_deleted",
        F.coalesce(hit.agg(F.sum("n")).scalar(), F.lit(0)).cast("long").alias("seen_articles_deleted"),
    )


def retention_delete(
    articles: DataFrame, seen: DataFrame, as_of: Column, days: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles kept, seen rows kept, counts of what was removed)."""
    return (
        kept_articles(articles, as_of, days),
        cascade_delete_seen(seen, articles, as_of, days, kept=True),
        retention_counts(articles, seen, as_of, days),
    )
