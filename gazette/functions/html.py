"""Expressions over page HTML and links."""

from __future__ import annotations

from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.functions.text import strip

# Entities that occur in running text; the ampersand is last so that nothing is decoded twice.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"),
]


#: An entity, or the start of one, that is none of the fixed ones.
OTHER_ENTITY = r"&(?!(?:lt|gt|quot|#39|nbsp|middot|copy|amp);)(?:#[0-9xX]|[a-zA-Z])"


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    blank = dict(ENTITIES)["&nbsp;"]
    return pd.Series([None if t is None else unescape(t.replace("&nbsp;", blank)) for t in texts], dtype=object)


def decode_entities(text: Column, page: Column | None = None) -> Column:
    """Entities as characters, each once. Texts with other than the fixed ones, named or numeric, go through Python.

    ``page``: what ``text`` was taken from. It is looked at in place of the text, which is then extracted only once.
    """
    hard = (text if page is None else page).rlike(OTHER_ENTITY)
    plain = text
    for entity, char in ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.coalesce(_unescape(F.when(hard, text)), plain)


def visible_text(markup: Column, page: Column | None = None) -> Column:
    """Text of a piece of HTML: tags become blanks, blanks are collapsed, entities decoded, ends stripped."""
    bare = F.regexp_replace(markup, r"<[^>]*>", " ")
    return strip(decode_entities(F.regexp_replace(bare, r"[ \t\r\n\f]+", " "), page))


def page_title(html: Column) -> Column:
    return visible_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), html)


def article_element_text(html: Column) -> Column:
    """The text of the first article element."""
    return visible_text(F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1), html)


def body_text(html: Column) -> Column:
    """The body without navigation, scripts, styles and footer."""
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1)
    for tag in ("script", "style", "nav", "header", "aside", "footer"):
        body = F.regexp_replace(body, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return visible_text(body, html)


@F.pandas_udf(T.StringType())
def _join_reference(base: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or r is None else urljoin(b, r) for b, r in zip(base, ref)])


def url_join(base: Column, ref: Column) -> Column:
    """A reference resolved against the page URL; one that starts with ``http`` is taken as it is.

    The common forms are plain expressions. Only relative paths and dot segments go through Python.
    """
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    dotted = ref.contains("/.") | ref.contains("//") | ref.contains(";")
    simple = (
        F.when(ref.startswith("http"), ref)
        .when(ref.startswith("//") & ~ref.contains("/.") & ref.rlike(r"^//[^/?#]+/"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("/") & ~dotted & ~ref.contains("#") & ~ref.contains("?"), F.concat(origin, ref))
    )
    hard = ref.isNotNull() & simple.isNull()
    return F.coalesce(simple, _join_reference(F.when(hard, base), F.when(hard, ref)))


def _first_source(html: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    usable = F.filter(found, lambda m: (m != "") & ~m.startswith("data:") & ~m.startswith("#"))
    return F.get(usable, F.lit(0))


def image_reference(html: Column) -> Column:
    """The first usable image link of a page as written there, null when there is none."""
    return F.coalesce(
        _first_source(html, r"""(?i)<img[^>]+src=["']([^"']+)["']"""),
        _first_source(html, r"""(?i)<img[^>]+data-src=["']([^"']+)["']"""),
    )


def resolve_image(html: Column, base_url: Column) -> Column:
    """The first usable image of a page as an absolute link, '' when there is none."""
    return F.coalesce(url_join(base_url, image_reference(html)), F.lit(""))
