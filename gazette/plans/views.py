"""News tables as views over the given test tables, each with its DuckDB text next to the Spark form.

Articles come from documents, users, seen rows and sessions from events, feed items and pages from pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.html import page_title

BASE = "2024-01-01 00:00:00"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _base_plus(minutes: Column, hours: Column | None = None) -> Column:
    hours = F.lit(0) if hours is None else hours.cast("int")
    day = 24 * 60  # days and minutes of the day, as minutes alone do not fit an int at 165 million documents
    days, rest = F.floor(minutes / day).cast("int"), F.pmod(minutes, F.lit(day)).cast("int")
    return F.lit(BASE).cast("timestamp_ntz") + F.make_dt_interval(days, hours, rest)


# --- articles -------------------------------------------------------------------------------------------------

ARTICLES_SQL = """
articles as (
  select doc_id as id, source as source_name,
         concat('https://', source, '.example.com/a/', cast(doc_id as varchar)) as source_url,
         split_part(text, chr(10), 1) as title,
         case when doc_id % 5 = 0 then null else concat('Author ', cast(doc_id % 11 as varchar)) end as author,
         case when doc_id % 3 = 0 then null
              else concat('https://img.example.com/', cast(doc_id as varchar), '.png') end as image_url,
         text as content,
         case doc_id % 6 when 0 then 'Politics' when 1 then 'Crime' when 2 then 'Technology' when 3 then 'Sports'
              when 4 then 'Entertainment' else 'Business' end as category,
         case lang when 'en' then 'english' when 'fr' then 'odia' when 'de' then 'bengali' else lang end as language,
         timestamp '2024-01-01 00:00:00' + to_minutes(13 * doc_id - 60 * ((doc_id * 37) % 96)) as published_at,
         timestamp '2024-01-01 00:00:00' + to_minutes(13 * doc_id) as created_at
  from documents),
clock as (select max(created_at) - interval 30 minute as as_of from articles)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    names = ["Politics", "Crime", "Technology", "Sports", "Entertainment"]
    category = F.lit("Business")
    for i, name in enumerate(names):
        category = F.when(doc % 6 == i, F.lit(name)).otherwise(category)
    language = (
        F.when(F.col("lang") == "en", "english").when(F.col("lang") == "fr", "odia")
        .when(F.col("lang") == "de", "bengali").otherwise(F.col("lang"))
    )
    number = doc.cast("string")
    return load(spark, sf_dir, "documents").select(
        doc.alias("id"),
        F.col("source").alias("source_name"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/a/"), number).alias("source_url"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        F.when(doc % 5 != 0, F.concat(F.lit("Author "), (doc % 11).cast("string"))).alias("author"),
        F.when(doc % 3 != 0, F.concat(F.lit("https://img.example.com/"), number, F.lit(".png"))).alias("image_url"),
        F.col("text").alias("content"),
        category.alias("category"),
        language.alias("language"),
        _base_plus(13 * doc, -((doc * 37) % 96)).alias("published_at"),
        _base_plus(13 * doc).alias("created_at"),
    )


def clock(articles_view: DataFrame) -> Column:
    """Half an hour before the newest article, so that a few rows lie in the future."""
    newest = articles_view.agg(F.max("created_at")).scalar()
    return newest - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(30))


# --- users, seen rows, sessions -------------------------------------------------------------------------------

USERS_SQL = """
users as (
  select concat('guest_', cast(user_id as varchar)) as auth_id, min(ts) as created_at,
         case when user_id % 3 = 0 then null when user_id % 7 = 0 then ''
              else concat('tok', cast(user_id % 40 as varchar)) end as fcm_token,
         user_id % 2 = 0 as is_notification_enabled
  from events group by user_id)"""

SEEN_SQL = """
seen as (
  select concat('guest_', cast(user_id as varchar)) as user_auth_id,
         event_id % (select count(*) from documents) as article_id, min(ts) as seen_at
  from events where event_type = 'view' group by 1, 2)"""

SESSIONS_SQL = """
sessions as (
  select event_id as id, concat('guest_', cast(user_id as varchar)) as user_auth_id,
         sha256(concat('t', cast(event_id as varchar))) as token_hash, ts as created_at,
         ts + interval 30 day as expires_at,
         case when event_id % 4 = 0 then ts + interval 1 day end as revoked_at,
         case when event_id % 4 = 0 then lead(event_id) over (partition by user_id order by ts, event_id) end
           as replaced_by_session_id
  from events where event_type = 'signup')"""


def guest(user_id: Column) -> Column:
    return F.concat(F.lit("guest_"), user_id.cast("string"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    token = (
        F.when(user % 3 == 0, F.lit(None)).when(user % 7 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("tok"), (user % 40).cast("string")))
    )
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("created_at")).select(
        guest(user).alias("auth_id"), "created_at", token.alias("fcm_token"),
        (user % 2 == 0).alias("is_notification_enabled"),
    )


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = load(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
    return (
        load(spark, sf_dir, "events").filter(F.col("event_type") == "view")
        .groupBy(guest(F.col("user_id")).alias("user_auth_id"), (F.col("event_id") % size).alias("article_id"))
        .agg(F.min("ts").alias("seen_at"))
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").filter(F.col("event_type") == "signup").selectExpr(
        "event_id as id",
        "concat('guest_', cast(user_id as string)) as user_auth_id",
        "sha2(concat('t', cast(event_id as string)), 256) as token_hash",
        "ts as created_at",
        "ts + interval 30 days as expires_at",
        "case when event_id % 4 = 0 then ts + interval 1 days end as revoked_at",
        "case when event_id % 4 = 0 then lead(event_id) over (partition by user_id order by ts, event_id) end"
        " as replaced_by_session_id",
    )


# --- presented tokens and change events -----------------------------------------------------------------------

# Tokens that clients present: those of signups are known, the others are not.
TOKENS_SQL = "tokens as (select concat('t', cast(event_id as varchar)) as token, event_id as use_id from events)"
EVENT_CLOCK_SQL = "event_clock as (select max(ts) - interval 5 day as as_of from events)"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("token"), F.col("event_id").alias("use_id")
    )


def event_clock(spark: SparkSession, sf_dir: str) -> Column:
    newest = load(spark, sf_dir, "events").agg(F.max("ts")).scalar()
    return newest - F.make_dt_interval(F.lit(5))


# Clicks create, purchases set a token, errors set the preference; half of the users are new.
USER_EVENTS_SQL = """
user_events as (
  select concat('guest_', cast(user_id * 2 as varchar)) as auth_id,
         case event_type when 'click' then 'create' when 'purchase' then 'token' else 'preference' end as kind,
         case when event_type = 'purchase' then concat('new', cast(event_id as varchar))
              when event_type = 'error' and event_id % 3 = 0 then concat('pref', cast(event_id as varchar))
              when event_type = 'error' and event_id % 3 = 1 then '' end as fcm_token,
         case when event_type = 'error' then event_id % 2 = 0 end as is_enabled,
         ts as event_at, event_id as seq
  from events where event_type in ('click', 'purchase', 'error'))"""


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, event = F.col("event_type"), F.col("event_id")
    named = event.cast("string")
    return load(spark, sf_dir, "events").filter(kind.isin("click", "purchase", "error")).select(
        guest(F.col("user_id") * 2).alias("auth_id"),
        F.when(kind == "click", "create").when(kind == "purchase", "token").otherwise("preference").alias("kind"),
        F.when(kind == "purchase", F.concat(F.lit("new"), named))
        .when((kind == "error") & (event % 3 == 0), F.concat(F.lit("pref"), named))
        .when((kind == "error") & (event % 3 == 1), F.lit("")).alias("fcm_token"),
        F.when(kind == "error", event % 2 == 0).alias("is_enabled"),
        F.col("ts").alias("event_at"),
        event.alias("seq"),
    )


# Session events: each click and purchase rotates, and each error revokes, the token of the signup before it in the
# user's history; a rotation issues the token 'r<event>', which the user's next event may use if it is a view.
SESSION_EVENTS_SQL = """
session_history as (
  select *, max(case when event_type = 'signup' then event_id end) over h as last_signup,
         lag(event_id) over (partition by user_id order by ts, event_id) as before_id
  from events window h as (partition by user_id order by ts, event_id rows unbounded preceding)),
session_events as (
  select event_id as seq, ts as event_at,
         case event_type when 'signup' then 'create' when 'error' then 'revoke' else 'rotate' end as kind,
         case when event_type = 'signup' then null
              when event_type = 'view' then sha256(concat('r', cast(before_id as varchar)))
              else sha256(concat('t', cast(last_signup as varchar))) end as token_hash,
         case when event_type = 'signup' then concat('fresh_', cast(event_id as varchar)) end as user_auth_id,
         case when event_type <> 'error' then 1000000000 + event_id end as new_id,
         case when event_type = 'signup' then sha256(concat('n', cast(event_id as varchar)))
              when event_type <> 'error' then sha256(concat('r', cast(event_id as varchar))) end as new_token_hash
  from session_history)"""


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr(
        "ts", "event_id", "user_id", "event_type",
        "max(case when event_type = 'signup' then event_id end) over (partition by user_id order by ts, event_id"
        " rows unbounded preceding) as last_signup",
        "lag(event_id) over (partition by user_id order by ts, event_id) as before_id",
    ).selectExpr(
        "event_id as seq",
        "ts as event_at",
        "case event_type when 'signup' then 'create' when 'error' then 'revoke' else 'rotate' end as kind",
        "case when event_type = 'signup' then null"
        " when event_type = 'view' then sha2(concat('r', cast(before_id as string)), 256)"
        " else sha2(concat('t', cast(last_signup as string)), 256) end as token_hash",
        "case when event_type = 'signup' then concat('fresh_', cast(event_id as string)) end as user_auth_id",
        "case when event_type <> 'error' then 1000000000 + event_id end as new_id",
        "case when event_type = 'signup' then sha2(concat('n', cast(event_id as string)), 256)"
        " when event_type <> 'error' then sha2(concat('r', cast(event_id as string)), 256) end as new_token_hash",
    )


# --- feeds ----------------------------------------------------------------------------------------------------

# White space as Unicode knows it, for the pattern language of DuckDB.
SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}\x0b]"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def decode_sql(text: str) -> str:
    from gazette.functions.html import ENTITIES

    text = f"regexp_replace({text}, '&amp([^;]|$)', '&amp;\\1', 'g')"  # titles are cut anywhere
    for entity, char in ENTITIES:
        text = "replace({}, '{}', '{}')".format(text, entity.replace("'", "''"), char.replace("'", "''"))
    return text


def visible_sql(markup: str) -> str:
    bare = f"regexp_replace({markup}, '<[^>]*>', ' ', 'g')"
    return strip_sql(decode_sql(f"regexp_replace({bare}, '[ \\t\\r\\n\\f]+', ' ', 'g')"))


PAGE_TITLE_SQL = visible_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")



def page_content_sql(pages: str) -> str:
    """page_content: the article text of each page, from the depth of elements at each ``<``."""
    def depth(*tags: str) -> str:
        opens, closes = (", ".join(f"'{slash}{t}'" for t in tags) for slash in ("", "/"))
        return f"sum((tag in ({opens}))::int - (tag in ({closes}))::int) over (partition by page_id order by i)"

    def joined(where: str) -> str:
        return visible_sql(f"coalesce(string_agg(txt, ' ' order by i) filter ({where}), '')")

    return f"""
page_tokens as (
  select page_id, i, regexp_extract(part, '^/?[a-zA-Z][a-zA-Z0-9]*') as tag,
         case when i = 1 then part when contains(part, '>') then substr(part, strpos(part, '>') + 1) else '' end as txt
  from (select page_id, unnest(string_split(html, '<')) as part, generate_subscripts(string_split(html, '<'), 1) as i from {pages})),
page_depths as (
  select page_id, i, txt, {depth('article')} as articles, {depth('head', 'nav', 'footer')} as around, {depth('span')} as byline from page_tokens),
page_texts as (
  select page_id, {joined('articles = 1 and byline = 0')} as main, {joined('around = 0 and byline = 0')} as every
  from page_depths group by page_id),
page_content as (
  select page_id, case when length(main) >= 100 then main else every end as content
  from page_texts where length(main) >= 100 or length(every) >= 100)"""


#: Pages with a byline, an image and, on each third one, a teaser in an article element of its own inside the article.
RICH_PAGES_SQL = """
rich_pages as (
  select page_id, url, replace(html, '</h1>', concat(
      '</h1><span class="byline">By Ann P', cast(page_id % 7 as varchar), ' and Bo Q</span><img src="/i/', cast(page_id as varchar), '.jpg">',
      case when page_id % 3 = 0 then '<article class="box"><a href="/x">More news of this kind for all of our readers</a></article>' else '' end)) as html
  from pages)"""


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    teaser = F.when(page % 3 == 0, F.lit('<article class="box"><a href="/x">More news of this kind for all of our readers</a></article>')).otherwise("")
    added = F.concat(
        F.lit('</h1><span class="byline">By Ann P'), (page % 7).cast("string"), F.lit(' and Bo Q</span><img src="/i/'), page.cast("string"), F.lit('.jpg">'), teaser)
    return load(spark, sf_dir, "pages").select("page_id", "url", F.replace("html", F.lit("</h1>"), added).alias("html"))


FEED_SQL = f"""
feed_items as (
  select regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) as feed,
         regexp_extract(url, '^[a-zA-Z]+://[^/?#]+[.]([^./?#]+)', 1) as domain,
         page_id as position, url as link, {PAGE_TITLE_SQL} as title, html,
         case page_id % 4
           when 0 then strftime(timestamp '{BASE}' + to_minutes(17 * page_id), '%Y-%m-%dT%H:%M:%SZ')
           when 1 then concat('Mon, ', strftime(timestamp '{BASE}' + to_minutes(17 * page_id), '%d %b %Y %H:%M:%S'),
                              ' +0530')
           when 2 then '' else 'soon' end as publish_raw,
         case page_id % 4
           when 0 then timestamp '{BASE}' + to_minutes(17 * page_id)
           when 1 then timestamp '{BASE}' + to_minutes(17 * page_id - 330) end as publish_date
  from pages),
feed_clock as (select timestamp '{BASE}' + to_minutes(17 * max(page_id)) as as_of from pages)"""


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    at = _base_plus(17 * page)
    raw = (
        F.when(page % 4 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(page % 4 == 1, F.concat(F.lit("Mon, "), F.date_format(at, "dd MMM yyyy HH:mm:ss"), F.lit(" +0530")))
        .when(page % 4 == 2, F.lit(""))
        .otherwise(F.lit("soon"))
    )
    return load(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1).alias("feed"),
        F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+[.]([^./?#]+)", 1).alias("domain"),
        page.alias("position"),
        F.col("url").alias("link"),
        page_title(F.col("html")).alias("title"),
        "html",
        raw.alias("publish_raw"),
    )


def feed_clock(spark: SparkSession, sf_dir: str) -> Column:
    last = load(spark, sf_dir, "pages").agg(F.max("page_id")).scalar()
    return _base_plus(17 * last)


# One source per domain ending: plain patterns, none at all, and one that is no regular expression.
FEED_SOURCES = [
    ("english", "com", "Commercial pages", "https://com.example", "com", ["/EN/", "page=[0-9]"]),
    ("odia", "net", "Network pages", "https://net.example", "net", []),
    ("bengali", "org", "Public pages", "https://org.example", "org", ["/de/", "?utm_source=("]),
]
FEED_SOURCES_SQL = """
feed_sources(domain, language, source_position, source_name) as (
  values ('com', 'english', 0, 'Commercial pages'), ('net', 'odia', 0, 'Network pages'),
         ('org', 'bengali', 0, 'Public pages'))"""
FEED_MATCH_SQL = """(domain = 'net'
   or domain = 'com' and (regexp_matches(link, '/EN/', 'i') or regexp_matches(link, 'page=[0-9]', 'i'))
   or domain = 'org' and (regexp_matches(link, '/de/', 'i') or contains(lower(link), '?utm_source=(')))"""


# --- feed files and pages of three ticks ----------------------------------------------------------------------

TICKS, TICK_HOURS = 3, 16
TICK_BASE = "2024-01-10 00:00:00"
#: One item per page. Some links repeat those of another tick, pairs of pages share a title, and dates are old or unreadable.
TICK_ITEMS = """
select page_id, page_id % 3 as tick, concat('f', cast(page_id div 30 as string)) as feed, page_id as position,
       concat('https://news.example.com/', element_at(array('india', 'sport', 'city', 'film'), cast(other % 4 as int) + 1), '/', cast(other as string)) as link,
       case when page_id % 17 = 8 then ' ' else concat('Report ', md5(cast(page_id div 2 as string))) end as title,
       case when page_id % 8 = 6 then 'soon' when page_id % 2 = 0 then date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'") end as published,
       case when page_id % 8 = 6 then '' when page_id % 2 = 1 then concat('Mon, ', date_format(at, 'dd MMM yyyy HH:mm:ss'), ' +0530') end as pubDate
from (select page_id, case when page_id % 10 = 9 then page_id - 4 else page_id end as other,
             timestamp_ntz '{base}' + make_dt_interval(case when page_id % 9 = 4 then -5 else 0 end, -(page_id % 24)) as at from pages)
"""
#: Landed pages: some never land, some are too short, some landed before in a shorter form.
TICK_PAGES = """
select concat('https://news.example.com/', element_at(array('india', 'sport', 'city', 'film'), cast(page_id % 4 as int) + 1), '/', cast(page_id as string)) as url,
       case when version = 0 or page_id % 11 = 3 then '<p>short</p>' else html end as html,
       timestamp_ntz '{base}' + make_dt_interval(0, version) as fetched_at
from (select page_id, html, explode(case when page_id % 7 = 2 then array(0, 1) else array(1) end) as version from rich_pages) where page_id % 13 <> 5
"""
TICK_SOURCES = """
select feed as key, element_at(array('english', 'odia', 'bengali'), number % 3 + 1) as language, number div 3 as position,
       concat('Source ', cast(number as string)) as source_name,
       case number % 3 when 0 then array('/INDIA/', '/sport/') when 1 then array() else array('sport', 'city', 'film') end as url_patterns
from (select distinct concat('f', cast(page_id div 30 as string)) as feed, cast(page_id div 30 as int) as number from pages)
"""


def tick_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feed items, landed pages and sources of the ticks."""
    rich = rich_pages(spark, sf_dir)
    items, pages, sources = (text.replace("{base}", TICK_BASE) for text in (TICK_ITEMS, TICK_PAGES, TICK_SOURCES))
    return (
        spark.sql(items.replace("from pages)", "from {pages})"), pages=rich), spark.sql(pages.replace("from rich_pages)", "from {pages})"), pages=rich),
        spark.sql(sources.replace("from pages)", "from {pages})"), pages=rich),
    )


def tick_sql() -> list[str]:
    """The stored articles after each tick, one run after the other. Titles of two items are equal or far from similar."""
    section = "(['india', 'sport', 'city', 'film'])[{0} % 4 + 1]"
    link = f"concat('https://news.example.com/', {section}, '/', cast({{0}} as varchar))"
    out = [RICH_PAGES_SQL, page_content_sql("rich_pages"), f"""
tick_items as (
  select page_id, page_id % 3 as tick, page_id // 30 as number, {link.format('other')} as link, other,
         concat('Report ', md5(cast(page_id // 2 as varchar))) as title,
         case when page_id % 8 <> 6 then timestamp '{TICK_BASE}' - to_days(case when page_id % 9 = 4 then 5 else 0 end) - to_hours(page_id % 24)
              - to_minutes(case when page_id % 2 = 1 then 330 else 0 end) end as published
  from (select page_id, case when page_id % 10 = 9 then page_id - 4 else page_id end as other from pages) where page_id % 17 <> 8),
tick_valid as (
  select i.*, c.content, (['english', 'odia', 'bengali'])[number % 3 + 1] as language, concat('https://news.example.com/i/', cast(other as varchar), '.jpg') as image_url,
         concat('Ann P', cast(other % 7 as varchar), ', Bo Q') as author
  from tick_items i join page_content c on c.page_id = i.other
  where other % 13 <> 5 and other % 11 <> 3
    and (number % 3 = 1 or number % 3 = 0 and other % 4 in (0, 1) or number % 3 = 2 and other % 4 in (1, 2, 3))
  qualify row_number() over (partition by tick, number order by i.page_id) <= 5),
stored_0 as (select null::varchar as url, null::varchar as stored_key, null::timestamp as created_at where false)"""]
    for t in range(TICKS):
        now = f"(timestamp '{TICK_BASE}' + to_hours({TICK_HOURS * t}))"
        out.append(f"""
open_{t} as (
  select *, row_number() over (partition by language order by number // 3, page_id) as pos
  from (select * from tick_valid where tick = {t} and coalesce(published, {now}) >= {now} - interval 2 day
        qualify row_number() over (partition by link order by language, number // 3, page_id) = 1)
  where link not in (select url from stored_{t}) and title not in (select stored_key from stored_{t} where created_at >= {now} - interval 24 hour)),
first_{t} as (select * exclude (pos) from open_{t} qualify row_number() over (partition by title order by language, pos) = 1),
batched_{t} as (
  select *, count(*) over (partition by language, batch_no) as n, row_number() over (partition by language, batch_no order by number // 3, page_id) as nth
  from (select *, (row_number() over (partition by language order by number // 3, page_id) - 1) // 5 as batch_no from first_{t})),
saved_{t} as (
  select sha256(link) as id, concat('Source ', cast(number as varchar)) as source_name, link as source_url, title as stored_key,
         case when answered then concat('New: ', title) else title end as title, author, image_url,
         case when answered then cast(length(content) as varchar) else content end as content, 'General' as category, language,
         coalesce(published, {now}) as published_at, {now} as created_at, cast({now} as date) as created_date, {t}::bigint as run_id
  from (select *, nth > 1 and not (language <> 'english' and n = 4) as answered from batched_{t})),
stored_{t + 1} as (select * from stored_{t} union all select source_url, stored_key, created_at from saved_{t})""")
    return out


# --- scraped batch and model answers --------------------------------------------------------------------------

SCRAPED_SQL = """
scraped as (
  select id as pos, source_url as url, source_name, title as original_title, content as original_content,
         coalesce(image_url, '') as image_url, author,
         case when id % 5 = 0 then null when id % 11 = 3 then concat(author, ', Desk') else author end as author_line,
         published_at as publish_date, language
  from articles),
batched as (
  select *, (row_number() over (partition by language order by pos) - 1) // 5 as batch_no from scraped),
answers as (
  select language, batch_no, pos, url as source_url,
         case when pos % 4 = 1 then null else concat('New: ', original_title) end as title,
         case when pos % 10 = 3 then null else concat('Summary of ', original_title) end as content,
         case when pos % 7 = 0 then null else 'Sports' end as category
  from batched where pos % 9 <> 0 and batch_no % 6 < 4)"""


def scraped(spark: SparkSession, sf_dir: str) -> DataFrame:
    author = F.col("author")
    return articles(spark, sf_dir).select(
        F.col("id").alias("pos"),
        F.col("source_url").alias("url"),
        "source_name",
        F.col("title").alias("original_title"),
        F.col("content").alias("original_content"),
        F.coalesce("image_url", F.lit("")).alias("image_url"),
        F.when(author.isNull(), F.array().cast("array<string>"))
        .when(F.col("id") % 11 == 3, F.array(author, F.lit("Desk")))
        .otherwise(F.array(author)).alias("authors"),
        F.col("published_at").alias("publish_date"),
        "language",
    )


def responses(batched: DataFrame) -> DataFrame:
    """A model text per batch: plain, fenced, wrapped in prose, a bare list, broken, or empty."""
    answer = F.struct(
        F.col("url").alias("source_url"),
        F.when(F.col("pos") % 4 != 1, F.concat(F.lit("New: "), "original_title")).alias("title"),
        F.when(F.col("pos") % 10 != 3, F.concat(F.lit("Summary of "), "original_title")).alias("content"),
        F.when(F.col("pos") % 7 != 0, F.lit("Sports")).alias("category"),
    )
    kept = F.when(F.col("pos") % 9 != 0, F.struct("pos", answer.alias("a")))
    lists = batched.groupBy("language", "batch_no").agg(F.sort_array(F.collect_list(kept)).alias("_l"))
    items = F.to_json(F.transform("_l", lambda x: x["a"]))
    plain = F.concat(F.lit('{"articles": '), items, F.lit("}"))
    shape = F.col("batch_no") % 6
    text = (
        F.when(shape == 0, plain)
        .when(shape == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("Here you are: "), plain, F.lit(" Thanks.")))
        .when(shape == 3, items)
        .when(shape == 4, F.lit("Sorry, no summary {today"))
        .otherwise(F.lit(" "))
    )
    return lists.select("language", "batch_no", text.alias("response"), F.lit(None).cast("string").alias("error"))
