"""The registered queries: each operator over the given tables, with the DuckDB text of the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.constants import CATEGORIES, LANGUAGE_CYCLE, PROMPTS, RETRY_SUFFIX, SOURCES
from gazette.functions import answers as fa
from gazette.functions import dates as fd
from gazette.functions import html as fh
from gazette.functions import notify as fn
from gazette.functions import text as ft
from gazette.operators import dedupe, enrich, ingest, notifications, retention, rotation, search, seen_bits, serving, sessions, state, url_index
from gazette.plans import views as v
from gazette.schemas import ARTICLE_COLS
from gazette.session import cut_lineage, scratch_path
from gazette.sources import dimensions, feeds, tables
from gazette.streaming import ingest as stream_ingest
from gazette.streaming import rates, titles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

COLS = ", ".join(ARTICLE_COLS)


def values(rows: list[tuple]) -> str:
    def one(x) -> str:
        return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(one(x) for x in row) + ")" for row in rows)


CATEGORIES_SQL = f"dim(position, category) as (values {values(list(enumerate(CATEGORIES, start=1)))})"
_PLACES = [
    (s[0], [o[1] for o in SOURCES if o[0] == s[0]].index(s[1]), s[1], s[2], s[3], s[4], len(s[5])) for s in SOURCES
]
SOURCES_SQL = (
    "sources(language, position, key, source_name, base_url, rss_url, n_patterns) as "
    f"(values {values(_PLACES)})"
)
LANGUAGES_SQL = "languages(turn, language, n_sources) as (values " + values(
    [(i, lang, sum(s[0] == lang for s in SOURCES)) for i, lang in enumerate(LANGUAGE_CYCLE)]
) + ")"


def register(name: str, oracle: str | None = None, ctes: list[str] | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            head = "with " + ",".join(c.strip() for c in ctes) + "\n" if ctes else ""
            ORACLES[name] = head + oracle.strip()
        return query

    return add


A, U, S, R = v.ARTICLES_SQL, v.USERS_SQL, v.SEEN_SQL, v.SESSIONS_SQL


# --- scans ----------------------------------------------------------------------------------------------------


@register("table_scan", f"select cast(id as varchar) as id, {', '.join(ARTICLE_COLS[1:])}, "
          "cast(created_at as date) as created_date from articles", [A])
def _(spark, sf):
    path = scratch_path(spark, "articles")
    tables.append_articles(v.articles(spark, sf).withColumn("id", F.col("id").cast("string")), path)
    return tables.table_scan(spark, path, "articles")


@register("feed_scan", "select feed, position, link, title, publish_raw as published from feed_items", [v.FEED_SQL])
def _(spark, sf):
    path = scratch_path(spark, "feeds")
    items = v.feed_items(spark, sf).select("feed", "position", "link", "title", F.col("publish_raw").alias("published"))
    feeds.write_feed(items, path)
    rows = feeds.feed_scan(spark, path)
    return rows.select(
        "feed", "position", "link",
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("published", F.lit("")).alias("published"),
    )


@register("source_dim", """
select language, position, key, source_name, base_url, rss_url, n_patterns, articles
from sources join (select language, count(*) as articles from articles group by language) using (language)
""", [A, SOURCES_SQL])
def _(spark, sf):
    per_language = v.articles(spark, sf).groupBy("language").agg(F.count(F.lit(1)).alias("articles"))
    dim = dimensions.sources(spark).withColumn("n_patterns", F.size("url_patterns")).drop("url_patterns")
    return per_language.join(F.broadcast(dim), "language")


@register("category_dim", """
select position, category, max(created_at) as newest, count(distinct language) as languages
from dim left join articles using (category) group by all
""", [A, CATEGORIES_SQL])
def _(spark, sf):
    stats = v.articles(spark, sf).groupBy("category").agg(
        F.max("created_at").alias("newest"), F.count_distinct("language").alias("languages")
    )
    return stats.join(F.broadcast(dimensions.categories(spark)), "category", "right").fillna(0, ["languages"])


ARTICLE_TEXT_SQL = v.visible_sql("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)")


def _body_sql() -> str:
    body = "regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1)"
    for tag in ("script", "style", "nav", "header", "aside", "footer"):
        body = f"regexp_replace({body}, '<{tag}[^>]*>.*?</{tag}>', ' ', 'gis')"
    return v.visible_sql(body)


@register("html_article", f"""
select page_id, url, {v.PAGE_TITLE_SQL} as title, content, concat('Ann P', cast(page_id % 7 as varchar), '; Bo Q') as authors,
       concat(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1), '/i/', cast(page_id as varchar), '.jpg') as image_url
from pages join page_content using (page_id)
""", [v.RICH_PAGES_SQL, v.page_content_sql("rich_pages")])
def _(spark, sf):
    return ingest.html_article(v.rich_pages(spark, sf)).select(
        "page_id", "url", fh.page_title(F.col("html")).alias("title"), "content", F.array_join("authors", "; ").alias("authors"), "image_url",
    )


# --- projections and filters ----------------------------------------------------------------------------------


@register("article_projection", f"select {COLS} from articles", [A])
def _(spark, sf):
    return serving.article_projection(v.articles(spark, sf))


@register("filter_category", f"select {COLS} from articles where category = 'Sports'", [A])
def _(spark, sf):
    return serving.by_filters(serving.article_projection(v.articles(spark, sf)), category="Sports")


@register("filter_language", f"select {COLS} from articles where language = 'odia'", [A])
def _(spark, sf):
    return serving.by_filters(serving.article_projection(v.articles(spark, sf)), category="", language="odia")


@register("search_articles", f"""
select {COLS} from articles where title ilike '%the_of%' escape '\\' or content ilike '%the_of%' escape '\\'
order by created_at desc, id offset 5 limit 50
""", [A])
def _(spark, sf):
    return serving.search_articles(v.articles(spark, sf), "the_of", limit=50, offset=5)


@register("search_indexed", f"""
select {COLS} from articles where title ilike '%THORre%' escape '\\' or content ilike '%THORre%' escape '\\'
order by created_at desc, id offset 2 limit 60
""", [A])
def _(spark, sf):
    """Stored and indexed in two runs, then searched through the trigrams."""
    path, index = scratch_path(spark, "articles"), scratch_path(spark, "search-index")
    articles = v.articles(spark, sf)
    for run in (0, 1):
        rows = articles.filter(F.col("id") % 2 == run)
        tables.append_articles(rows, path)
        search.append_search_index(rows, index)
    return search.search_indexed(spark.read.parquet(path), index, "THORre", limit=60, offset=2)


@register("feed_url_filter", f"select feed, position, link from feed_items where {v.FEED_MATCH_SQL}", [v.FEED_SQL])
def _(spark, sf):
    return ingest.feed_url_filter(_sourced(spark, sf)).select("feed", "position", "link")


def _sourced(spark: SparkSession, sf: str) -> DataFrame:
    """Feed items with their source row."""
    dim = dimensions.with_usable_patterns(spark, v.FEED_SOURCES).select(
        F.col("key").alias("domain"), "language", F.col("position").alias("source_position"), "source_name",
        "url_patterns",
    )
    return ingest.source_join(v.feed_items(spark, sf), dim, "domain")


@register("feed_row_validity", """
select feed, position, link, title from feed_items join page_content on page_id = position where link <> '' and title <> ''
""", [v.FEED_SQL, v.page_content_sql("pages")])
def _(spark, sf):
    return _valid_items(v.feed_items(spark, sf)).select("feed", "position", "link", "title")


def _valid_items(items: DataFrame) -> DataFrame:
    return ingest.feed_row_validity(ingest.html_article(items, url="link"), url="link")


@register("filter_by_date", """
select feed, position, publish_raw from feed_items, feed_clock
where publish_date is null or publish_date >= as_of - interval 2 day
""", [v.FEED_SQL])
def _(spark, sf):
    items = v.feed_items(spark, sf).select("feed", "position", "publish_raw")
    return ingest.filter_by_date(items, v.feed_clock(spark, sf), date="publish_raw")


@register("recent_window", f"""
select {COLS} from articles, clock where created_at between as_of - interval 15 minute and as_of
order by created_at desc, id limit 1
""", [A])
def _(spark, sf):
    articles = v.articles(spark, sf)
    return serving.recent_window(articles, v.clock(articles), 15)


@register("notification_tokens",
          "select fcm_token from users where is_notification_enabled and fcm_token is not null and fcm_token <> ''", [U])
def _(spark, sf):
    return state.notification_tokens(v.users(spark, sf))


@register("user_sessions", "select * from sessions where user_auth_id = 'guest_7'", [R])
def _(spark, sf):
    return sessions.user_sessions(v.sessions(spark, sf), "guest_7")


# --- joins ----------------------------------------------------------------------------------------------------


@register("unseen_articles", f"""
select {COLS} from articles where language = 'english'
  and not exists (select 1 from seen where user_auth_id = 'guest_7' and article_id = articles.id)
order by created_at desc, id limit 100
""", [A, S])
def _(spark, sf):
    return serving.unseen_articles(
        v.articles(spark, sf), v.seen(spark, sf), "guest_7", limit=100, language="english"
    )


UNSEEN_ALL_SQL = """
select auth_id, row_number() over (partition by auth_id order by created_at desc, id) as position, id, created_at
from users cross join (select id, created_at from articles) a
where not exists (select 1 from seen where user_auth_id = auth_id and article_id = a.id)
qualify position <= 10
""".replace("select auth_id, row", "select u.auth_id, row").replace("from users cross", "from (select auth_id from users) u cross")


@register("unseen_all_users", UNSEEN_ALL_SQL, [A, U, S])
def _(spark, sf):
    return serving.unseen_all_users(v.articles(spark, sf), v.seen(spark, sf), v.users(spark, sf))


@register("unseen_by_bits", UNSEEN_ALL_SQL, [A, U, S])
def _(spark, sf):
    """Places and seen bits stored in two runs each, the second run of pairs twice; then the pages of all users."""
    at, bits = scratch_path(spark, "places"), scratch_path(spark, "seen-bits")
    articles, seen = v.articles(spark, sf), v.seen(spark, sf)
    half = F.lit(articles.count() // 2)
    seen_bits.append_places(articles.filter(F.col("id") < half), at, first=True)
    seen_bits.append_places(articles.filter(F.col("id") >= half), at)
    places = spark.read.parquet(at)
    for run in (0, 1, 1):
        seen_bits.append_seen_bits(seen.filter(F.col("article_id") % 2 == run), places, bits)
    return seen_bits.unseen_by_bits(places, seen_bits.stored_bits(spark, bits), v.users(spark, sf), articles)


# The batch of the URL operators: every document again, and every page.
BATCH_SQL = """
batch as (
  select id as pos, source_url as url, title as original_title from articles
  union all
  select position + 1000000000, link, title from feed_items)"""
# Stored are the articles of the languages other than the default one, and the pages read without encryption.
STORED_SQL = """
stored as (
  select source_url, title, created_at from articles where language <> 'english'
  union all
  select link, title, as_of - to_minutes(17 * position % 2880) from feed_items, clock where starts_with(link, 'http://'))"""


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.articles(spark, sf).select(
        F.col("id").alias("pos"), F.col("source_url").alias("url"), F.col("title").alias("original_title")
    )
    pages = v.feed_items(spark, sf).select(
        (F.col("position") + 1_000_000_000).alias("pos"), F.col("link").alias("url"),
        F.col("title").alias("original_title"),
    )
    return feeds.union_sources(docs, pages)


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    articles = v.articles(spark, sf)
    back = F.make_dt_interval(F.lit(0), F.lit(0), ((17 * F.col("position")) % 2880).cast("int"))
    pages = v.feed_items(spark, sf).filter(F.col("link").startswith("http://")).select(
        F.col("link").alias("source_url"), "title", (v.clock(articles) - back).alias("created_at")
    )
    return articles.filter(F.col("language") != "english").select("source_url", "title", "created_at").unionByName(pages)


@register("union_sources", "select pos, url, original_title from batch", [A, v.FEED_SQL, BATCH_SQL])
def _(spark, sf):
    return _batch(spark, sf)


@register("known_urls", "select distinct url from batch where url in (select source_url from stored)",
          [A, v.FEED_SQL, BATCH_SQL, STORED_SQL])
def _(spark, sf):
    return ingest.known_urls(_batch(spark, sf), _stored(spark, sf))


def _stored_and_indexed(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """The stored articles in folders per day, and the index of their URLs; two runs, the second one repeated in the index."""
    path, index = scratch_path(spark, "stored"), scratch_path(spark, "url-index")
    stored = _stored(spark, sf)
    for run in (0, 1, 1):
        rows = stored.filter(F.pmod(F.hash("source_url"), F.lit(2)) == run)
        url_index.append_url_index(rows, index)
    tables.append_articles(stored, path)
    return spark.read.parquet(path), index


@register("known_urls_indexed", "select distinct url from batch where url in (select source_url from stored)",
          [A, v.FEED_SQL, BATCH_SQL, STORED_SQL])
def _(spark, sf):
    return url_index.known_urls_indexed(_batch(spark, sf), *_stored_and_indexed(spark, sf))


@register("batch_minus_duplicates",
          "select pos, url, original_title from batch where url not in (select source_url from stored)",
          [A, v.FEED_SQL, BATCH_SQL, STORED_SQL])
def _(spark, sf):
    batch = _batch(spark, sf)
    return ingest.batch_minus_duplicates(batch, ingest.known_urls(batch, _stored(spark, sf)))


INSERT_SQL = f"""
select {COLS}, pos from (
  select {", ".join("replace(source_url, '/a/', '/b/') as source_url" if c == "source_url" else c for c in ARTICLE_COLS)},
         id as pos from articles
  union all
  select {COLS}, id + 1000000000 from articles) twice
where source_url not in (select source_url from stored)
qualify row_number() over (partition by source_url order by pos) = 1
"""


def _twice(spark: SparkSession, sf: str) -> DataFrame:
    """Each article under a new URL and under its own."""
    articles = v.articles(spark, sf)
    moved = articles.withColumn("source_url", F.replace("source_url", F.lit("/a/"), F.lit("/b/")))
    return moved.withColumn("pos", F.col("id")).unionByName(articles.withColumn("pos", F.col("id") + 1_000_000_000))


@register("ingest_insert", INSERT_SQL, [A, v.FEED_SQL, STORED_SQL])
def _(spark, sf):
    return ingest.ingest_insert(_twice(spark, sf), _stored(spark, sf))


@register("ingest_insert_indexed", INSERT_SQL, [A, v.FEED_SQL, STORED_SQL])
def _(spark, sf):
    return url_index.ingest_insert_indexed(_twice(spark, sf), *_stored_and_indexed(spark, sf))


@register("source_join", """
select feed, position, link, domain, language, source_position, source_name
from feed_items join feed_sources using (domain)
""", [v.FEED_SQL, v.FEED_SOURCES_SQL])
def _(spark, sf):
    return _sourced(spark, sf).select(
        "feed", "position", "link", "domain", "language", "source_position", "source_name"
    )


@register("token_lookup", """
select token, use_id, sha256(token) as token_hash, s.id, s.user_auth_id, s.expires_at
from tokens left join sessions s on s.token_hash = sha256(token)
""", [R, v.TOKENS_SQL])
def _(spark, sf):
    found = sessions.token_lookup(v.tokens(spark, sf), v.sessions(spark, sf))
    return found.select("token", "use_id", "token_hash", "id", "user_auth_id", "expires_at")


@register("session_state", """
select token, use_id, case when s.id is null then 'unknown' when s.revoked_at is not null then 'revoked'
  when s.expires_at <= as_of then 'expired' else 'valid' end as state
from tokens cross join (select as_of + interval 20 day as as_of from event_clock)
left join sessions s on s.token_hash = sha256(token)
""", [R, v.TOKENS_SQL, v.EVENT_CLOCK_SQL])
def _(spark, sf):
    as_of = v.event_clock(spark, sf) + F.make_dt_interval(F.lit(20))
    return sessions.session_state(v.tokens(spark, sf), v.sessions(spark, sf), as_of).select("token", "use_id", "state")


@register("session_chain", """
select s.id, s.user_auth_id, s.revoked_at, s.replaced_by_session_id, r.created_at as replacement_created_at,
       r.revoked_at as replacement_revoked_at
from sessions s left join sessions r on s.replaced_by_session_id = r.id
""", [R])
def _(spark, sf):
    return sessions.session_chain(v.sessions(spark, sf)).select(
        "id", "user_auth_id", "revoked_at", "replaced_by_session_id", "replacement_created_at",
        "replacement_revoked_at",
    )


# --- aggregations and windows ---------------------------------------------------------------------------------


@register("category_counts", """
select category, position, count(id) as total from dim left join (select * from articles where language = 'english')
using (category) group by all
""", [A, CATEGORIES_SQL])
def _(spark, sf):
    return serving.category_counts(v.articles(spark, sf), "english")


BUNDLE_SQL = f"""
select d.category, coalesce(t.total, 0) as total, 5 as "limit", 7 as total_categories, a.rn, {", ".join(
    "a." + c for c in ARTICLE_COLS if c != "category")}
from dim d
left join (select category, count(*) as total from articles group by category) t using (category)
left join (select *, row_number() over (partition by category order by created_at desc, id) as rn from articles
           qualify rn <= 5) a using (category)
"""


@register("bundled_articles", BUNDLE_SQL, [A, CATEGORIES_SQL])
def bundled(spark, sf):
    return serving.bundled_rows(v.articles(spark, sf)).drop("position")


@register("bundle_response", """
select d.category, coalesce(t.total, 0) as total, 3 as "limit",
       (select string_agg(cast(id as varchar), ',' order by created_at desc, id) from (
          select * from articles a where a.category = d.category and language = 'odia'
          order by created_at desc, id limit 3)) as ids
from dim d left join (select category, count(*) as total from articles where language = 'odia' group by 1) t
using (category)
""", [A, CATEGORIES_SQL])
def _(spark, sf):
    row = serving.bundled_articles(v.articles(spark, sf), 3, "odia")
    return row.select(F.explode("categories").alias("category", "p")).select(
        "category", "p.total", "p.limit",
        F.nullif(F.array_join(F.transform("p.articles", lambda a: a["id"].cast("string")), ","), F.lit("")).alias("ids"),
    )


@register("topk_per_category", f"""
select {COLS}, row_number() over (partition by category order by created_at desc, id) as position from articles
qualify position <= 20
""", [A])
def _(spark, sf):
    return serving.topk_per_category(v.articles(spark, sf), 20)


@register("trending_articles", f"""
select position, {COLS} from articles join dim using (category) where language = 'bengali'
qualify row_number() over (partition by category order by created_at desc, id) = 1
""", [A, CATEGORIES_SQL])
def _(spark, sf):
    return serving.trending_articles(v.articles(spark, sf), "bengali")


@register("feed_take_n", f"""
select feed, position, link from feed_items join page_content on page_id = position
where link <> '' and title <> '' and {v.FEED_MATCH_SQL}
qualify row_number() over (partition by feed order by position) <= 5
""", [v.FEED_SQL, v.page_content_sql("pages")])
def _(spark, sf):
    valid = _valid_items(ingest.feed_url_filter(_sourced(spark, sf)))
    return ingest.feed_take_n(valid.select("feed", "position", "link"))


@register("batch_of_5", "select pos, url, language, batch_no from batched", [A, v.SCRAPED_SQL])
def _(spark, sf):
    return enrich.batch_of_5(v.scraped(spark, sf).select("pos", "url", "language"), ["language"])


@register("latest_articles", f"""
select {COLS} from articles where language = 'english' and category = 'Politics' order by created_at desc, id limit 30
""", [A])
def _(spark, sf):
    return serving.latest_articles(v.articles(spark, sf), 30, "Politics", "english")


@register("articles_by_category", f"""
select {COLS} from articles where category = 'Crime' order by created_at desc, id offset 10 limit 20
""", [A])
def _(spark, sf):
    return serving.articles_by_category(v.articles(spark, sf), "Crime", 20, 10)


@register("retention_counts", """
select (select count(*) from articles, clock where published_at < as_of - interval 7 day) as articles_deleted,
       (select count(*) from seen where article_id in (
          select id from articles, clock where published_at < as_of - interval 7 day)) as seen_articles_deleted
""", [A, S])
def _(spark, sf):
    articles = v.articles(spark, sf)
    return state.retention_counts(articles, v.seen(spark, sf), v.clock(articles))


@register("cascade_delete_seen", """
select * from seen where article_id in (select id from articles, clock where published_at < as_of - interval 7 day)
""", [A, S])
def _(spark, sf):
    articles = v.articles(spark, sf)
    return state.cascade_delete_seen(v.seen(spark, sf), articles, v.clock(articles))


@register("retention_delete", f"""
select {COLS} from articles, clock where published_at >= as_of - interval 7 day
""", [A])
def _(spark, sf):
    articles = serving.article_projection(v.articles(spark, sf))
    return state.retention_delete(articles, v.seen(spark, sf), v.clock(articles))[0]


@register("retention_seen_kept", """
select * from seen where article_id not in (select id from articles, clock where published_at < as_of - interval 7 day)
""", [A, S])
def _(spark, sf):
    articles = v.articles(spark, sf)
    return state.retention_delete(articles, v.seen(spark, sf), v.clock(articles))[1]


def _kept_by_days(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """Both tables in folders per publication day after retention, which may leave none, and the numbers of removed rows."""
    articles, seen = v.articles(spark, sf), v.seen(spark, sf)
    paths = scratch_path(spark, "articles-by-day"), scratch_path(spark, "seen-by-day")
    retention.append_by_day(articles, paths[0])
    retention.append_seen_by_day(seen, articles, paths[1])
    as_of = articles.select(v.clock(articles).alias("as_of")).first()[0]
    removed = retention.retention_by_days(spark, *paths, as_of)
    return *[spark.read.schema(t.schema).parquet(path) for t, path in zip((articles, seen), paths, strict=True)], removed


@register("retention_by_days", """
select 'article' as kind, id, '' as user_auth_id from articles, clock where published_at >= as_of - interval 7 day
union all
select 'seen', article_id, user_auth_id from seen
where article_id not in (select id from articles, clock where published_at < as_of - interval 7 day)
""", [A, S])
def _(spark, sf):
    """What is left of articles and seen rows where retention drops day folders."""
    articles, seen, _ = _kept_by_days(spark, sf)
    kept = articles.select(F.lit("article").alias("kind"), "id", F.lit("").alias("user_auth_id"))
    return kept.unionByName(seen.select(F.lit("seen").alias("kind"), F.col("article_id").alias("id"), "user_auth_id"))


@register("retention_by_days_counts", """
select (select count(*) from articles, clock where published_at < as_of - interval 7 day) as articles_deleted,
       (select count(*) from seen where article_id in (
          select id from articles, clock where published_at < as_of - interval 7 day)) as seen_articles_deleted
""", [A, S])
def _(spark, sf):
    removed = _kept_by_days(spark, sf)[2]
    return spark.range(1).select(*[F.lit(n).cast("long").alias(c) for n, c in zip(removed, ("articles_deleted", "seen_articles_deleted"), strict=True)])


@register("ingest_stats", """
select tick, language, string_agg(source_name, ', ' order by place) as sources,
       cast(sum(n) as bigint) as scraped_articles, cast(sum(saved) as bigint) as saved_articles
from (select position // 10 as tick, language, source_name, min(position) as place, count(*) as n,
             count(*) filter (starts_with(link, 'https:')) as saved
      from feed_items join feed_sources using (domain) group by 1, 2, 3)
group by tick, language
""", [v.FEED_SQL, v.FEED_SOURCES_SQL])
def _(spark, sf):
    items = _sourced(spark, sf).select(
        F.floor(F.col("position") / 10).alias("tick"), "language", "source_name", "link",
        F.col("position").alias("source_position"),
    )
    return ingest.ingest_stats(items, items.filter(F.col("link").startswith("https:")), ["tick", "language"])


@register("arrival_rate", """
select time_bucket(interval 15 minute, created_at, timestamp '2024-01-01') as tick_start, language,
       count(*) as arrivals
from articles group by 1, 2
""", [A])
def _(spark, sf):
    return rates.arrival_rate(v.articles(spark, sf))


# --- enrichment -----------------------------------------------------------------------------------------------


def _batched(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.batch_of_5(v.scraped(spark, sf), ["language"])


def _answers(batched: DataFrame) -> DataFrame:
    return enrich.answers_of(v.responses(batched))


@register("first_answer", "select language, batch_no, source_url, title, content, category from answers",
          [A, v.SCRAPED_SQL])
def _(spark, sf):
    answers = _answers(_batched(spark, sf))
    # Every answer twice, the second time with another title: the first one counts.
    again = answers.withColumn("answer_pos", F.col("answer_pos") + 100).withColumn("title", F.lit("second"))
    return enrich.first_answer(answers.unionByName(again)).select(
        "language", "batch_no", "source_url", "title", "content", "category"
    )


@register("missing_answers", """
select language, batch_no, url from batched
where not exists (select 1 from answers where source_url = url)
""", [A, v.SCRAPED_SQL])
def _(spark, sf):
    batched = _batched(spark, sf)
    return enrich.missing_answers(batched, _answers(batched))


@register("answer_fallback", "select pos, url, language, batch_no from batched where batch_no % 6 >= 4",
          [A, v.SCRAPED_SQL])
def _(spark, sf):
    batched = _batched(spark, sf)
    return enrich.answer_fallback(batched, _answers(batched)).select("pos", "url", "language", "batch_no")


@register("answer_retry_set", "select distinct language, batch_no from batched where batch_no % 6 = 5",
          [A, v.SCRAPED_SQL])
def _(spark, sf):
    return enrich.answer_retry_set(v.responses(_batched(spark, sf))).select("language", "batch_no")


def _strip(column: str) -> str:
    return v.strip_sql(column)


MERGED_SQL = f"""
merged as (
  select sha256(url) as id, b.source_name, url as source_url,
         case when a.pos is not null then coalesce(a.title, original_title)
              else coalesce(nullif({_strip('original_title')}, ''), 'Untitled article') end as title,
         b.author_line as author, nullif(b.image_url, '') as image_url,
         case when a.pos is not null then coalesce(a.content, original_content)
              else coalesce(nullif({_strip('original_content')}, ''),
                            'Summary unavailable. Original content could not be summarized.') end as content,
         case when a.pos is not null then coalesce(a.category, 'General') else 'General' end as category,
         b.language, publish_date as published_at, as_of as created_at, b.batch_no, a.pos is not null as answered, b.pos
  from batched b cross join clock left join answers a on a.pos = b.pos)"""


@register("summary_merge", f"select {COLS}, batch_no, answered, pos from merged", [A, v.SCRAPED_SQL, MERGED_SQL])
def _(spark, sf):
    return _merged(spark, sf).drop("out_pos")


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    batched = cut_lineage(_batched(spark, sf))
    return enrich.summary_merge(batched, _answers(batched), v.clock(v.articles(spark, sf)))


@register("with_fallbacks", """
select language, batch_no, source_url, title, category,
       row_number() over (partition by language, batch_no order by not answered, pos) as place
from merged
""", [A, v.SCRAPED_SQL, MERGED_SQL])
def _(spark, sf):
    from pyspark.sql import Window

    # A batch holds at most five rows.
    place = F.row_number().over(Window.partitionBy("language", "batch_no").orderBy("out_pos"))
    return _merged(spark, sf).select("language", "batch_no", "source_url", "title", "category", place.alias("place"))


@register("last_saved", f"""
select {COLS} from merged
qualify row_number() over (partition by language order by batch_no desc, answered, pos desc) = 1
""", [A, v.SCRAPED_SQL, MERGED_SQL])
def _(spark, sf):
    return notifications.last_saved(cut_lineage(_merged(spark, sf)), ["language"], "out_pos").select(*ARTICLE_COLS)


def _echo(provider: str, instruction: str, request: str) -> str:
    """A stand-in model: titles marked as new, the first article of a batch left out, one language refused."""
    import json

    rows = json.loads(request)
    if provider == "sarvam" and len(rows) == 4:
        raise RuntimeError("request failed")
    return json.dumps({"articles": [
        {"source_url": r["url"], "title": "New: " + r["original_title"], "content": f"{len(r['original_content'])}"}
        for r in rows[1:]
    ]}, ensure_ascii=False)


ENRICHED_SQL = """
select language, batch_no, pos, concat('New: ', original_title) as title, cast(length(original_content) as varchar) as content
from (select *, row_number() over (partition by language, batch_no order by pos) as nth,
             count(*) over (partition by language, batch_no) as n from batched)
where nth > 1 and not (language <> 'english' and n = 4)
"""


def _answered(batched: DataFrame, responses: DataFrame) -> DataFrame:
    answers = enrich.first_answer(enrich.answers_of(responses)).withColumnRenamed("source_url", "url")
    return batched.select("language", "batch_no", "pos", "url").join(
        answers.select("language", "batch_no", "url", "title", "content"), ["language", "batch_no", "url"]
    ).drop("url")


@register("enrich_batches", ENRICHED_SQL, [A, v.SCRAPED_SQL])
def _(spark, sf):
    batched = cut_lineage(_batched(spark, sf))
    return _answered(batched, enrich.enrich_batches(enrich.batch_requests(batched), _echo))


def _silent(provider: str, instruction: str, request: str) -> str:
    """A model that has nothing more to say: whatever it is asked is lost."""
    raise RuntimeError("asked again")


@register("enrich_with_ledger", ENRICHED_SQL, [A, v.SCRAPED_SQL])
def _(spark, sf):
    """A run over some of the batches, one over all, and a third that has to find every answer in the table."""
    batched, path = cut_lineage(_batched(spark, sf)), scratch_path(spark, "ledger")
    requests = enrich.batch_requests(batched)
    enrich.enrich_with_ledger(requests.filter("batch_no % 3 = 0"), _echo, path)
    enrich.enrich_with_ledger(requests, _echo, path, waves=2)
    return _answered(batched, enrich.enrich_with_ledger(requests, _silent, path))


# --- duplicates -----------------------------------------------------------------------------------------------


@register("fuzzy_title_join")
def _(spark, sf):
    return dedupe.fuzzy_title_join(_batch(spark, sf), _stored(spark, sf), v.clock(v.articles(spark, sf)))


@register("dedupe_urls")
def _(spark, sf):
    return dedupe.dedupe_urls(_batch(spark, sf), _stored(spark, sf), v.clock(v.articles(spark, sf)))


@register("dedupe_articles")
def _(spark, sf):
    return dedupe.dedupe_articles(_batch(spark, sf), _stored(spark, sf), v.clock(v.articles(spark, sf)))


@register("stream_title_lookback", """
select distinct trim(regexp_replace(lower(title), '[\\s\\x1c-\\x1f\\x{85}\\p{Z}\\x0b]+', ' ', 'g')) as norm
from stored, (select max(created_at) as newest from stored) where created_at >= newest - interval 24 hour and trim(title) <> ''
""", [A, v.FEED_SQL, STORED_SQL])
def _(spark, sf):
    """The stored titles as a stream of three batches by time; the titles of the first are forgotten on the way."""
    stored = cut_lineage(_stored(spark, sf).select("title", "created_at"))
    first, last = stored.agg(F.min("created_at"), F.max("created_at")).first()
    landed, changes, log = scratch_path(spark, "stored-titles"), scratch_path(spark, "title-changes"), scratch_path(spark, "title-log")
    third = (last - first) / 3
    for part in range(3):
        since, until = F.col("created_at") >= first + part * third, F.col("created_at") < first + (part + 1) * third
        stored.filter(since & (until if part < 2 else F.lit(True))).write.mode("append").parquet(landed)
        # All files that have landed since the run before are one batch, so that they may be many.
        articles = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1_000_000).parquet(landed)
        titles.start_title_memory(articles, changes, log).awaitTermination()
    return titles.remembered_titles(spark, changes)


# --- state ----------------------------------------------------------------------------------------------------


@register("mark_seen", """
select u.auth_id as user_auth_id, a.id as article_id, as_of as seen_at
from (select auth_id from users) u cross join (select id, created_at from articles) a cross join clock
where not exists (select 1 from seen where user_auth_id = u.auth_id and article_id = a.id)
qualify row_number() over (partition by u.auth_id order by a.created_at desc, a.id) <= 10
""", [A, U, S])
def _(spark, sf):
    articles, seen = v.articles(spark, sf), v.seen(spark, sf)
    page = serving.unseen_all_users(articles, seen, v.users(spark, sf))
    return state.mark_seen(seen, page, v.clock(articles))


USER_CHANGES_SQL = """
select auth_id, coalesce(u.created_at, e.first_at) as created_at,
       case when e.token_seq is not null then e.token else u.fcm_token end as fcm_token,
       coalesce(e.flag, u.is_notification_enabled, false) as is_notification_enabled
from users u full join (
  select auth_id, min(event_at) as first_at,
         max(case when kind = 'token' or kind = 'preference' and fcm_token <> '' then seq end) as token_seq,
         arg_max(fcm_token, seq) filter (kind = 'token' or kind = 'preference' and fcm_token <> '') as token,
         arg_max(is_enabled, seq) filter (kind = 'preference') as flag
  from user_events group by auth_id) e using (auth_id)
"""


@register("user_apply_changes", USER_CHANGES_SQL, [U, v.USER_EVENTS_SQL])
def _(spark, sf):
    return state.user_apply_changes(v.users(spark, sf), v.user_events(spark, sf))


@register("clear_tokens", """
select auth_id, created_at, case when bad then null else fcm_token end as fcm_token,
       is_notification_enabled and not bad as is_notification_enabled
from (select *, coalesce(fcm_token in (select distinct concat('tok', cast(length(props) % 40 as varchar))
                                       from events where event_type = 'error'), false) as bad from users)
""", [U])
def _(spark, sf):
    errors = v.load(spark, sf, "events").filter(F.col("event_type") == "error")
    invalid = errors.select(F.concat(F.lit("tok"), (F.length("props") % 40).cast("string")).alias("fcm_token"))
    return state.clear_tokens(v.users(spark, sf), invalid)


# Outcomes in SQL: a token of a signup has one successful use at most; the tokens issued on the way are used by runs
# of views, which succeed as long as the use before the run did.
SESSION_OUTCOMES_SQL = """
first_uses as (
  select e.token_hash, min(e.seq) as won_seq
  from session_events e join sessions s on s.token_hash = e.token_hash
  join session_history h on h.event_id = e.seq
  where h.event_type <> 'view' and e.kind in ('rotate', 'revoke') and s.revoked_at is null and e.event_at < s.expires_at
  group by e.token_hash),
used as (
  select e.*, h.user_id, h.event_type, s.id as known_id, s.revoked_at, s.expires_at, f.won_seq,
         sum(case when h.event_type <> 'view' then 1 else 0 end)
           over (partition by h.user_id order by h.ts, h.event_id) as run,
         lag(e.event_at) over (partition by h.user_id order by h.ts, h.event_id) as before_at
  from session_events e join session_history h on h.event_id = e.seq
  left join sessions s on s.token_hash = e.token_hash and h.event_type <> 'view'
  left join first_uses f on f.token_hash = e.token_hash and h.event_type <> 'view'),
rooted as (
  select *, first_value(event_type in ('click', 'purchase') and won_seq = seq) over w as root_ok,
         coalesce(bool_and(event_type <> 'view' or event_at < before_at + interval 30 day)
           over (partition by user_id, run order by seq rows between unbounded preceding and 1 preceding), true)
           as way_ok
  from used window w as (partition by user_id, run order by seq rows unbounded preceding)),
outcomes as (
  select seq, kind, event_at, token_hash, new_id, new_token_hash, user_auth_id, event_type, user_id,
         case when kind = 'create' then 'valid'
              when event_type = 'view' then
                case when not coalesce(root_ok and run > 0, false) or not way_ok then 'unknown'
                     when event_at >= before_at + interval 30 day then 'expired' else 'valid' end
              when known_id is null then 'unknown'
              when revoked_at is not null or won_seq < seq then 'revoked'
              when event_at >= expires_at then 'expired' else 'valid' end as outcome
  from rooted)"""


@register("session_event_outcomes", "select seq, kind, outcome from outcomes",
          [R, v.SESSION_EVENTS_SQL, SESSION_OUTCOMES_SQL])
def _(spark, sf):
    return sessions.session_apply_events(v.sessions(spark, sf), v.session_events(spark, sf))[1]


@register("session_apply_events", """
select s.id, s.user_auth_id, s.token_hash, s.expires_at, s.created_at, coalesce(o.event_at, s.revoked_at) as revoked_at,
       coalesce(o.new_id, s.replaced_by_session_id) as replaced_by_session_id
from (select id, user_auth_id, token_hash, expires_at, created_at, revoked_at, replaced_by_session_id from sessions
      union all
      select new_id, coalesce(user_auth_id, concat('guest_', cast(user_id as varchar))), new_token_hash,
             event_at + interval 30 day, event_at, null, null
      from outcomes where outcome = 'valid' and kind in ('create', 'rotate')) s
left join (select token_hash, event_at, new_id from outcomes where outcome = 'valid' and kind in ('rotate', 'revoke')) o
using (token_hash)
""", [R, v.SESSION_EVENTS_SQL, SESSION_OUTCOMES_SQL])
def _(spark, sf):
    return sessions.session_apply_events(v.sessions(spark, sf), v.session_events(spark, sf))[0]


ISO = "concat(strftime({0}, '%Y-%m-%dT%H:%M:%S'), '+00:00')"


@register("notification_outbox", f"""
select language, case when id is null then 'no_article' else 'ready' end as status,
       case when id is not null then concat('news_', lower(language)) end as topic, source_name as title,
       case when length(title) > 150 then concat(title[1:147], '...') else title end as body,
       case when id is not null then coalesce(image_url, 'https://placehold.co/600x400') end as image,
       id as payload_id, published as payload_published
from (select distinct language from articles) left join (
  select id, source_name, title, image_url, language, {ISO.format('published_at')} as published from merged
  where answered qualify row_number() over (partition by language order by pos desc) = 1) using (language)
""", [A, v.SCRAPED_SQL, MERGED_SQL])
def _(spark, sf):
    saved = _merged(spark, sf).filter("answered")
    runs = v.articles(spark, sf).select("language")
    box = notifications.notification_outbox(runs, notifications.last_saved(saved, ["language"]), ["language"])
    return box.withColumn("payload_id", F.get_json_object("payload", "$.id")).withColumn(
        "payload_published", F.get_json_object("payload", "$.published_at")
    ).drop("payload")


@register("bundle_snapshot", f"""
select s.scope, d.category, d.position, count(a.id) over (partition by s.scope, d.category) as total,
       row_number() over (partition by s.scope, d.category order by a.created_at desc, a.id) as rn, 5 as "limit",
       {", ".join(f"a.{c} as {c}" for c in ARTICLE_COLS if c != "category")}
from dim d cross join (select distinct language as scope from articles union all select 'all') s
left join articles a on a.category = d.category and (s.scope = 'all' or a.language = s.scope)
qualify rn <= 5
""", [A, CATEGORIES_SQL])
def _(spark, sf):
    path = scratch_path(spark, "bundles")
    serving.write_bundles(v.articles(spark, sf), path)
    columns = ["scope", "category", "position", "total", "rn", "limit", *[c for c in ARTICLE_COLS if c != "category"]]
    return spark.read.parquet(path).select(*columns).withColumn("rn", F.coalesce("rn", F.lit(1)))


@register("rotation_assign", """
select tick, turn, language, slot, position, source_name, rss_url, events from (
  select *, turn % 3 as lang_turn, (turn // 3 * 2 + slot) as place from (
    select tick, tick - min(tick) over () as turn, events from (
      select epoch_us(ts) // 900000000 as tick, count(*) as events from events group by 1))
  cross join (values (0), (1)) s(slot)) t
join languages l on l.turn = lang_turn
join sources using (language)
where position = place % n_sources
""".replace("select tick, turn, language", "select tick, t.turn, language"), [SOURCES_SQL, LANGUAGES_SQL])
def _(spark, sf):
    per_tick = v.load(spark, sf, "events").groupBy(rotation.tick_of(F.col("ts")).alias("tick")).agg(
        F.count(F.lit(1)).alias("events")
    )
    first = v.load(spark, sf, "events").agg(rotation.tick_of(F.min("ts"))).scalar()
    return rotation.rotation_assign(per_tick.withColumn("turn", F.col("tick") - first)).drop("url_patterns")


# --- scalar functions -----------------------------------------------------------------------------------------


@register("title_scalars", f"""
select doc_id, trim(regexp_replace(lower(text), '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}\\x0b]+', ' ', 'g')) as normalised,
       {_strip('text')} as stripped, length(text) as chars
from documents
""")
def _(spark, sf):
    text = F.col("text")
    return v.load(spark, sf, "documents").select(
        "doc_id", ft.normalize_title(text).alias("normalised"), ft.strip(text).alias("stripped"),
        ft.text_length(text).alias("chars"),
    )


@register("date_scalars", f"""
select position, publish_raw, publish_date, coalesce(publish_date, as_of) as used_date,
       {ISO.format('coalesce(publish_date, as_of)')} as iso
from feed_items, feed_clock
""", [v.FEED_SQL])
def _(spark, sf):
    raw = F.col("publish_raw")
    used = fd.parse_publish_date(F.lit(""), raw, as_of=v.feed_clock(spark, sf))
    return v.feed_items(spark, sf).select(
        "position", "publish_raw", fd.parse_date(raw).alias("publish_date"), used.alias("used_date")
    ).withColumn("iso", fd.iso_text(F.col("used_date")))


@register("html_scalars", f"""
select page_id, {ARTICLE_TEXT_SQL} as article_text, {_body_sql()} as body_text,
       concat(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1), '/img/', cast(page_id as varchar), '.png') as image_url
from pages
""")
def _(spark, sf):
    html = F.col("html")
    image = F.concat(F.lit("<img class=a src='data:x'><img src='/img/"), F.col("page_id").cast("string"), F.lit(".png'>"))
    return v.load(spark, sf, "pages").select(
        "page_id", fh.article_element_text(html).alias("article_text"), fh.body_text(html).alias("body_text"),
        fh.resolve_image(F.concat(html, image), F.col("url")).alias("image_url"),
    )


@register("author_scalars", """
select pos, author_line as author, nullif(image_url, '') as image_url from scraped
""", [A, v.SCRAPED_SQL])
def _(spark, sf):
    return v.scraped(spark, sf).select(
        "pos", ft.author_line(F.col("authors")).alias("author"), ft.empty_to_null(F.col("image_url")).alias("image_url")
    )


@register("response_scalars", """
select conv_id, turn, case turn % 3 when 0 then text when 1 then concat('{"a": "', cast(conv_id as varchar), '"}')
         else cast(turn as varchar) end as response,
       case turn % 3 when 1 then concat('{"a": "', cast(conv_id as varchar), '"}') end as payload
from conversations
""")
def _(spark, sf):
    # The text comes as content, as fenced JSON in a tool call, or as a refusal.
    own = F.concat(F.lit('{"a": "'), F.col("conv_id").cast("string"), F.lit('"}'))
    call = F.struct(F.struct(F.concat(F.lit("```json "), own, F.lit(" ```")).alias("arguments")).alias("function"))
    kind = F.col("turn") % 3
    message = F.struct(
        F.when(kind == 0, F.col("text")).otherwise(F.lit(" ")).alias("content"),
        F.when(kind == 2, F.col("turn").cast("string")).alias("refusal"),
        F.when(kind == 1, F.array(call)).alias("tool_calls"),
    )
    response = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    text = fa.response_text(response)
    return v.load(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.when(kind == 1, fa.clean_json_fence(text)).otherwise(text).alias("response"),
        F.when(kind == 1, fa.extract_json_payload(text)).alias("payload"),
    )


_PROMPT_ROWS = [
    (name, text.replace("{categories}", ", ".join(CATEGORIES)), text.replace("{categories}", ", ".join(CATEGORIES)) + RETRY_SUFFIX)
    for name, text in [*PROMPTS.items(), ("", PROMPTS["english"])]
]


@register("prompt_scalars", f"""
select language, articles, case when lower(language) = 'english' then 'openrouter' else 'sarvam' end as provider, p.instruction, p.stricter
from (select language, count(*) as articles from asked group by language)
join prompts p on p.name = case when language in ('english', 'odia', 'bengali') then language else '' end
""", [A, "asked as (select language from articles union all select upper(language) from articles where id % 2 = 0)",
      f"prompts(name, instruction, stricter) as (values {values(_PROMPT_ROWS)})"])
def _(spark, sf):
    articles = v.articles(spark, sf)
    asked = articles.select("language").unionByName(articles.filter(F.col("id") % 2 == 0).select(F.upper("language").alias("language")))
    language = F.col("language")
    return asked.groupBy("language").agg(F.count(F.lit(1)).alias("articles")).select(
        "language", "articles", fa.provider_for_language(language).alias("provider"),
        fa.prompt_for_language(language).alias("instruction"), fa.prompt_for_language(language, retry=True).alias("stricter"),
    )


@register("notification_scalars", f"""
select concat('news_', lower(language)) as topic,
       case when length(content) > 150 then concat(content[1:147], '...') else content end as body,
       'new_article' as type, cast(id as varchar) as id, source_name, source_url, title, coalesce(author, '') as author,
       coalesce(image_url, 'https://placehold.co/600x400') as image_url, coalesce(nullif(category, ''), 'General') as category,
       coalesce(content, '') as content, {ISO.format('published_at')} as published_at, {ISO.format('created_at')} as created_at,
       'FLUTTER_NOTIFICATION_CLICK' as click_action
from articles
""", [A])
def _(spark, sf):
    rows = v.articles(spark, sf).withColumn("p", fn.notification_payload(F.struct(*ARTICLE_COLS)))
    return rows.select(fn.topic_name(F.col("language")).alias("topic"), fn.notification_body(F.col("content")).alias("body"), "p.*")


@register("session_scalars", """
select event_id, sha256(concat('t', cast(event_id as varchar))) as token_hash, ts + interval 30 day as expires_at
from events
""")
def _(spark, sf):
    token = F.concat(F.lit("t"), F.col("event_id").cast("string"))
    return v.load(spark, sf, "events").select(
        "event_id", fn.sha256_token(token).alias("token_hash"), fn.session_expiry(F.col("ts")).alias("expires_at")
    )


# --- streams --------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """The table as a stream, be it one file or a folder of files: a path that is a pattern may name either."""
    schema = v.load(spark, sf, table).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}.parque[t]")


@register("seen_stream", "select user_auth_id, cast(article_id as varchar) as article_id, seen_at from seen", [S])
def _(spark, sf):
    size = v.load(spark, sf, "documents").count()
    views = _stream(spark, sf, "events").filter(F.col("event_type") == "view").select(
        v.guest(F.col("user_id")).alias("user_auth_id"),
        (F.col("event_id") % size).cast("string").alias("article_id"),
        F.col("ts").alias("seen_at"),
    )
    path = scratch_path(spark, "seen")
    rates.seen_stream(views, path, scratch_path(spark, "seen-log")).awaitTermination()
    return spark.read.parquet(path)


@register("seen_bits_stream", "select user_auth_id, count(*) as n_seen from seen group by user_auth_id", [S])
def _(spark, sf):
    """The views as a stream into bitmaps: distinct articles per user."""
    places, path = scratch_path(spark, "places"), scratch_path(spark, "seen-bits")
    articles = v.articles(spark, sf)
    seen_bits.append_places(articles, places, first=True)
    size = articles.count()
    views = _stream(spark, sf, "events").filter(F.col("event_type") == "view").select(
        v.guest(F.col("user_id")).alias("user_auth_id"), (F.col("event_id") % size).alias("article_id"),
    )
    seen_bits.seen_bits_stream(views, places, path, scratch_path(spark, "seen-log")).awaitTermination()
    return seen_bits.seen_counts(seen_bits.stored_bits(spark, path))


@register("stream_url_dedupe", """
select 'https://' || source || '.example.com/' || lang as url, count(*) > 0 as found from documents group by 1
""")
def _(spark, sf):
    items = _stream(spark, sf, "documents").select(
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang").alias("url"),
        F.current_timestamp().alias("ingested_at"),
    )
    path = scratch_path(spark, "urls")
    query = (
        stream_ingest.stream_url_dedupe(items).select("url").writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", scratch_path(spark, "urls-log")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(path).withColumn("found", F.lit(True))


@register("stream_late_drop", f"""
select id, published_at from articles, clock where published_at >= as_of - interval 2 day
""", [A])
def _(spark, sf):
    articles = cut_lineage(v.articles(spark, sf).select("id", "created_at", "published_at"))
    landed, path = scratch_path(spark, "dated"), scratch_path(spark, "recent")
    rows = articles.select("id", "published_at")
    rows.write.parquet(landed)
    items = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(landed)
    recent = stream_ingest.stream_late_drop(items, v.clock(articles), date="published_at")
    query = (
        recent.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "recent-log"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


@register("ingest_stream", " union all ".join(f"select * exclude (stored_key) from saved_{t}" for t in range(v.TICKS)), v.tick_sql())
def _(spark, sf):
    """Feed files of three ticks through the whole run, each when it lands; the result is what the runs stored."""
    from datetime import datetime, timedelta

    items, pages, sources = v.tick_tables(spark, sf)
    landed, page_folder, log = scratch_path(spark, "feeds"), scratch_path(spark, "pages"), scratch_path(spark, "ingest-log")
    pages.write.parquet(page_folder)
    path, box, stats = scratch_path(spark, "articles"), scratch_path(spark, "outbox"), scratch_path(spark, "ingest-stats")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a file per feed takes time, but few bytes to merge tasks by
    for tick in range(v.TICKS):
        now = datetime.fromisoformat(v.TICK_BASE) + timedelta(hours=v.TICK_HOURS * tick)
        files = items.filter(F.col("tick") == tick).drop("tick", "page_id").repartition(tasks, "feed").sortWithinPartitions("feed", "position")
        feeds.write_feed(files, landed, mode="append")
        run = stream_ingest.Run(path, box, _echo, lambda now=now: now, stats)
        stream = feeds.feed_stream(spark, landed, files_per_trigger=1_000_000)
        stream_ingest.ingest_feed_stream(stream, sources, page_folder, run, log).awaitTermination()
    return stream_ingest.stored_articles(spark, path).drop("out_pos")
