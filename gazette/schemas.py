"""Schemas of the stored tables and of the rows in flight."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


ARTICLES = _struct(
    id=S, source_name=S, source_url=S, title=S, author=S, image_url=S, content=S,
    category=S, language=S, published_at=TS, created_at=TS,
)
ARTICLE_COLS = ARTICLES.fieldNames()

USERS = _struct(auth_id=S, created_at=TS, fcm_token=S, is_notification_enabled=B)

SEEN = _struct(user_auth_id=S, article_id=S, seen_at=TS)

SESSIONS = _struct(
    id=S, user_auth_id=S, token_hash=S, expires_at=TS, created_at=TS, revoked_at=TS, replaced_by_session_id=S,
)

FEED_ITEM = _struct(
    link=S, title=S, description=S, published=S, updated=S, created=S, pubDate=S, position=L,
)

SCRAPED = _struct(
    pos=L, url=S, source_name=S, original_title=S, original_content=S, image_url=S,
    authors=T.ArrayType(S), publish_date=TS, language=S,
)

SOURCES = _struct(
    language=S, position=I, key=S, source_name=S, base_url=S, rss_url=S, url_patterns=T.ArrayType(S),
)

CATEGORIES = _struct(position=I, category=S)

ANSWER = _struct(source_url=S, title=S, content=S, category=S)
ANSWERS = T.ArrayType(ANSWER)

_CALL = _struct(arguments=S)
RESPONSE = _struct(
    choices=T.ArrayType(_struct(message=_struct(
        content=S, refusal=S, function_call=_CALL, tool_calls=T.ArrayType(_struct(function=_CALL)),
    )))
)
