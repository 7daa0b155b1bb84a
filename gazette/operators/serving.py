"""Queries over stored articles: latest, by category, search, unseen, bundles, top article per category."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.constants import CATEGORIES, DEFAULT_LIMIT, DEFAULT_PER_CATEGORY, MAX_LIMIT, MAX_PER_CATEGORY
from gazette.functions.text import contains_pattern
from gazette.operators.ranking import first_per_group, ordered_index
from gazette.operators.skew import skew_join
from gazette.schemas import ARTICLE_COLS
from gazette.session import cut_lineage, written
from gazette.sources.dimensions import categories


def newest() -> list[Column]:
    """Newest first; equal times are ordered by id."""
    return [F.desc("created_at"), F.asc("id")]


def check_page(limit: int, offset: int = 0, maximum: int = MAX_LIMIT) -> None:
    if not 1 <= limit <= maximum:
        raise ValueError(f"limit must be between 1 and {maximum}, not {limit}")
    if offset < 0:
        raise ValueError(f"offset must not be negative, not {offset}")


def article_projection(articles: DataFrame) -> DataFrame:
    return articles.select(*ARTICLE_COLS)


def by_filters(articles: DataFrame, category: str | None = None, language: str | None = None) -> DataFrame:
    """Equality filters; an empty or missing value filters nothing."""
    wanted = {"category": category, "language": language}
    return reduce(lambda df, kv: df.filter(F.col(kv[0]) == kv[1]) if kv[1] else df, wanted.items(), articles)


_NARROW = ["id", "created_at"]


def fetch(articles: DataFrame, page: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The whole rows of the articles on a page (id, created_at, extra columns).

    Ranking reads only narrow columns. The contents are then read only from the oldest article of the page on, which
    skips the other row groups and day folders, instead of carrying every content through the ranking. The page is
    kept, so that the ranking runs once.
    """
    extra = extra or []
    kept = written(page.select(*_NARROW, *extra), "page")
    oldest = kept.agg(F.min("created_at")).scalar()
    rows = articles.filter(F.col("created_at") >= oldest)
    if "created_date" in articles.columns:
        rows = rows.filter(F.col("created_date") >= F.to_date(oldest))
    keys = kept.select("id", *extra)
    columns = [c for c in ARTICLE_COLS if c not in extra]
    return article_projection(rows).select(*columns).join(keys, "id").select(*ARTICLE_COLS, *[
        c for c in extra if c not in ARTICLE_COLS
    ])


def fetch_page(articles: DataFrame, page: DataFrame) -> DataFrame:
    """``fetch`` for a page, newest first."""
    return fetch(articles, page).orderBy(*newest())


def latest_articles(
    articles: DataFrame, limit: int = DEFAULT_LIMIT, category: str | None = None, language: str | None = None
) -> DataFrame:
    check_page(limit)
    page = by_filters(articles, category, language).select(*_NARROW).orderBy(*newest()).limit(limit)
    return fetch_page(articles, page)


def articles_by_category(
    articles: DataFrame, category: str, limit: int = DEFAULT_LIMIT, offset: int = 0, language: str | None = None
) -> DataFrame:
    """One page of a category. The category is mandatory, so an empty one matches no article."""
    check_page(limit, offset)
    rows = by_filters(articles.filter(F.col("category") == category), language=language).select(*_NARROW)
    return fetch_page(articles, rows.orderBy(*newest()).offset(offset).limit(limit))


def search_articles(
    articles: DataFrame,
    query: str,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    category: str | None = None,
    language: str | None = None,
) -> DataFrame:
    """Articles whose title or content contains the query, ignoring case; ``%`` and ``_`` are wildcards."""
    check_page(limit, offset)
    if not query:
        raise ValueError("the search query must not be empty")
    pattern = contains_pattern(query)
    hit = F.col("title").ilike(pattern) | F.col("content").ilike(pattern)
    rows = by_filters(article_projection(articles), category, language).filter(hit)
    return rows.orderBy(*newest()).offset(offset).limit(limit)


def recent_window(articles: DataFrame, as_of: Column, minutes_back: int) -> DataFrame:
    """The newest article created in the last minutes, both ends included; no row or one."""
    start = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes_back))
    rows = articles.filter((F.col("created_at") >= start) & (F.col("created_at") <= as_of)).select(*_NARROW)
    return fetch_page(articles, rows.orderBy(*newest()).limit(1))


def unseen_articles(
    articles: DataFrame,
    seen: DataFrame,
    auth_id: str,
    limit: int = DEFAULT_LIMIT,
    category: str | None = None,
    language: str | None = None,
) -> DataFrame:
    """Newest articles that one user has not seen."""
    check_page(limit)
    mine = seen.filter(F.col("user_auth_id") == auth_id).select(F.col("article_id").alias("id"))
    rows = by_filters(articles, category, language).select(*_NARROW).join(mine, "id", "left_anti")
    return fetch_page(articles, rows.orderBy(*newest()).limit(limit))


def unseen_all_users(
    articles: DataFrame,
    seen: DataFrame,
    users: DataFrame,
    limit: int = DEFAULT_LIMIT,
    category: str | None = None,
    language: str | None = None,
    width: int = 1024,
) -> DataFrame:
    """``unseen_articles`` for every user at once: (auth_id, position, id, created_at).

    Users are never paired with articles. Articles get their place in the order, newest first; places are cut
    into blocks of ``width``. Counting a user's seen places per block tells by arithmetic in which block the
    page is full, and only the places of the few blocks up to there that still hold unseen articles are listed.
    """
    check_page(limit, maximum=min(MAX_LIMIT, width))
    rows = by_filters(articles, category, language).select(*_NARROW)
    ranked = cut_lineage(ordered_index(rows, newest(), name="place"))
    total = ranked.agg(F.max("place")).scalar()

    # One user may have read a third of everything and one article may be read by a third of the users.
    read = seen.select(F.col("user_auth_id").alias("auth_id"), F.col("article_id").alias("id")).distinct()
    places = cut_lineage(
        skew_join(read, ranked.select("id", "place"), "id").select(
            "auth_id", "place", F.floor((F.col("place") - 1) / width).alias("block")
        )
    )

    counts = places.groupBy("auth_id", "block").agg(F.count(F.lit(1)).alias("n"))
    per_user = Window.partitionBy("auth_id")
    in_order = per_user.orderBy("block")
    # From a counted block on, the first block by whose end `limit` unseen places have gone by. It is the right one
    # when the next counted block comes later.
    full = F.greatest(F.col("block"), F.ceil((F.lit(limit) + F.sum("n").over(in_order)) / width) - 1)
    following = F.lead("block").over(in_order)
    walk = counts.withColumn("full", F.when(following.isNull() | (full < following), full))
    last = F.when(F.min("block").over(per_user) > 0, F.lit(0)).otherwise(F.min("full").over(per_user))
    still_open = (F.col("n") < width) & (F.col("block") <= F.col("last"))
    # At most `limit` blocks per user are open before the last one.
    pages = walk.withColumn("last", last.cast("long")).groupBy("auth_id").agg(
        F.collect_set(F.when(still_open, F.col("block"))).alias("open"), F.max("last").alias("last")
    )
    none = F.array().cast("array<bigint>")
    wanted = users.select("auth_id").distinct().join(pages, "auth_id", "left").select(
        "auth_id",
        F.explode(F.array_union(F.coalesce("open", none), F.array(F.coalesce("last", F.lit(0))))).alias("block"),
    )

    # A user and block hold at most `width` places.
    there = wanted.join(places, ["auth_id", "block"], "left").groupBy("auth_id", "block").agg(
        F.collect_list("place").alias("read")
    )
    start = F.col("block") * width + 1
    stop = F.least((F.col("block") + 1) * width, F.coalesce(total, F.lit(0)))
    listed = F.when(stop >= start, F.sequence(start, stop)).otherwise(none)
    free = F.slice(F.array_except(listed, F.col("read")), 1, limit)
    page = Window.partitionBy("auth_id").orderBy("place")
    shown = (
        there.select("auth_id", F.explode(free).alias("place"))
        .withColumn("position", F.row_number().over(page))
        .filter(F.col("position") <= limit)
    )
    # Nearly every user is shown some of the newest articles. Those are a fixed number of rows and are broadcast; the
    # other places are looked up by a shuffle, in which the rows already served are spread by user.
    newest_places = ranked.filter(F.col("place") <= width).select(
        "place", F.col("id").alias("near_id"), F.col("created_at").alias("near_at")
    )
    served = shown.join(F.broadcast(newest_places), "place", "left").withColumn(
        "far", F.when(F.col("place") > width, F.col("place")).otherwise(-1 - F.pmod(F.xxhash64("auth_id"), F.lit(4096)))
    )
    older = ranked.filter(F.col("place") > width).withColumnRenamed("place", "far")
    return served.join(older, "far", "left").select(
        "auth_id", "position", F.coalesce("near_id", "id").alias("id"),
        F.coalesce("near_at", "created_at").alias("created_at"),
    )


def _top_narrow(articles: DataFrame, k: int, language: str | None) -> DataFrame:
    """(id, created_at, category, position) of the newest ``k`` per category. Hot categories are cut before the shuffle."""
    w = Window.partitionBy("category").orderBy(*newest())
    rows = by_filters(articles, language=language).select("id", "created_at", "category")
    return rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def topk_per_category(
    articles: DataFrame, k: int = DEFAULT_PER_CATEGORY, language: str | None = None
) -> DataFrame:
    """The newest ``k`` articles of each category with their position."""
    check_page(k, maximum=MAX_PER_CATEGORY)
    return fetch(articles, _top_narrow(articles, k, language), ["position"])


def category_counts(articles: DataFrame, language: str | None = None) -> DataFrame:
    """Articles per permanent category, zero for a category without any."""
    counts = by_filters(articles, language=language).groupBy("category").agg(F.count(F.lit(1)).alias("total"))
    dim = F.broadcast(categories(articles.sparkSession))
    return (
        counts.join(dim, "category", "right")
        .select("category", "position", F.coalesce("total", F.lit(0)).cast("long").alias("total"))
    )


def bundled_rows(
    articles: DataFrame, limit_per_category: int = DEFAULT_PER_CATEGORY, language: str | None = None
) -> DataFrame:
    """The bundle in long form: one row per category and article, one row without article for an empty category."""
    check_page(limit_per_category, maximum=MAX_PER_CATEGORY)
    top = topk_per_category(articles, limit_per_category, language).withColumnRenamed("position", "rn")
    totals = category_counts(articles, language).withColumn("limit", F.lit(limit_per_category))
    return totals.join(top, "category", "left").withColumn("total_categories", F.lit(len(CATEGORIES)))


def trending_articles(articles: DataFrame, language: str | None = None) -> DataFrame:
    """The newest article of each permanent category that has one, in category order."""
    dim = F.broadcast(categories(articles.sparkSession))
    # One row per permanent category at most.
    top = _top_narrow(articles, 1, language).drop("position").join(dim, "category")
    return fetch(articles, top, ["position"]).select("position", *ARTICLE_COLS).orderBy("position")


def bundled_articles(
    articles: DataFrame, limit_per_category: int = DEFAULT_PER_CATEGORY, language: str | None = None
) -> DataFrame:
    """The whole response in one row: categories as a map of payloads, trending list, number of categories."""
    article = F.struct(*ARTICLE_COLS)
    rows = bundled_rows(articles, limit_per_category, language)
    listed = F.sort_array(F.collect_list(F.when(F.col("rn").isNotNull(), F.struct("rn", article.alias("article")))))
    payloads = rows.groupBy("category", "total", "limit").agg(
        F.transform(listed, lambda r: r["article"]).alias("articles")
    )
    bundle = payloads.agg(
        F.map_from_entries(
            F.collect_list(F.struct("category", F.struct("articles", "total", "limit")))
        ).alias("categories"),
        F.count(F.lit(1)).cast("int").alias("total_categories"),
    )
    trending = trending_articles(articles, language).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", article.alias("article")))), lambda r: r["article"]
        ).alias("trending")
    )
    # Two one-row results side by side.
    return bundle.withColumn("_one", F.lit(1)).join(trending.withColumn("_one", F.lit(1)), "_one").select(
        "categories", "trending", "total_categories", F.lit(limit_per_category).alias("limit_per_category")
    )


def write_bundles(
    articles: DataFrame, path: str, limit_per_category: int = DEFAULT_PER_CATEGORY
) -> None:
    """Store the bundle rows of every language and of all languages together, partitioned by scope.

    The all-language bundle has a scope of its own, ``all``. One pass ranks each language; the newest of all
    languages are among the newest of each.
    """
    check_page(limit_per_category, maximum=MAX_PER_CATEGORY)
    dim = F.broadcast(categories(articles.sparkSession))
    rows = articles.select("id", "created_at", "language", "category")
    per_language = first_per_group(rows, ["language", "category"], newest(), limit_per_category)
    overall = first_per_group(per_language, ["category"], newest(), limit_per_category)
    ranked = per_language.withColumn("scope", F.col("language")).unionByName(overall.withColumn("scope", F.lit("all")))
    place = F.row_number().over(Window.partitionBy("scope", "category").orderBy(*newest()))
    top = fetch(articles, ranked.withColumn("rn", place), ["scope", "rn"])
    counts = rows.groupBy("language", "category").agg(F.count(F.lit(1)).alias("n"))
    totals = (
        counts.withColumn("scope", F.explode(F.array("language", F.lit("all"))))
        .groupBy("scope", "category").agg(F.sum("n").alias("total"))
    )
    # Every scope lists every category: the categories are a fixed list, so this is one row times seven.
    every = totals.select("scope").distinct().withColumn(
        "category", F.explode(F.array(*[F.lit(c) for c in CATEGORIES]))
    )
    shown = every.join(dim, "category").join(totals, ["scope", "category"], "left").join(
        top, ["scope", "category"], "left"
    )
    out = shown.withColumn("total", F.coalesce("total", F.lit(0))).withColumn("limit", F.lit(limit_per_category))
    out.write.mode("errorifexists").partitionBy("scope").parquet(path)
