"""The main text of a page by the density of its text blocks, with authors, image and date, in one pass over the HTML.

A page is cut into tags and texts from left to right, without building a tree. Texts between block tags are one block,
which knows its length, its share of link text, the article element it stands in and whether it belongs to navigation.
The main text is the run of blocks with the greatest sum: text adds, link text and blocks of navigation take away.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.constants import MIN_CONTENT_CHARS

#: Elements that are never article text, and those that only frame it; the latter count inside an article.
CHROME, FRAME = {"nav", "footer", "aside", "form", "menu", "dialog"}, {"header"}
UNSEEN = {"noscript", "template", "svg", "select", "button", "iframe", "object", "canvas", "audio", "video", "math"}
RAW = {"script", "style", "title", "textarea", "xmp"}
CONTAINERS = CHROME | FRAME | UNSEEN | {"article", "main", "section", "div", "figure", "table", "ul", "ol", "dl", "blockquote", "body", "center", "details"}
LEAVES = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "td", "th", "tr", "dt", "dd", "figcaption", "hr", "caption", "summary", "address", "legend", "option"}
#: Words in class and id that mark what surrounds an article.
AROUND = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|menu|newsletter|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|teaser|widget)(?:$|[\s_-])", re.I)
BYLINE = re.compile(r"(?:^|\s)(?:author|byline|author-name|byline-name)(?:$|\s)", re.I)
META_AUTHOR = {"author", "article:author", "dc.creator", "byl"}
META_DATE = {"article:published_time", "datepublished", "date", "dc.date", "pubdate"}

#: What a block outside an article costs, but for a heading, so that menus of short texts do not add up.
BLOCK_COST = 20
#: A tag that is longer is taken to end at its first ``>``, quoted or not; a byline that is longer is none.
TAG_CHARS, BYLINE_CHARS = 8_192, 200

_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']+|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_BLANKS = re.compile(r"[ \t\r\n\f]+")
_PARTED = re.compile(r"[,;|\x1e]|\s(?:and|&)\s", re.I)
_BY = re.compile(r"(?:written\s+)?by\b:?\s*", re.I)


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    article: int
    chrome: bool
    around: bool
    heading: bool

    def value(self) -> float:
        if self.chrome or self.around:
            return -max(len(self.text), BLOCK_COST)
        return len(self.text) - 2 * self.linked - (0 if self.article or self.heading else BLOCK_COST)


def tokens(html: str):
    """(kind, name, text) from left to right: ``open`` and ``close`` tags with their attributes, and ``text``.

    Each character is looked at a bounded number of times, whatever is left open.
    """
    at, n, last_end = 0, len(html), html.rfind(">")
    while at < n:
        if html[at] != "<":
            end = html.find("<", at)
            end = n if end < 0 else end
            yield "text", "", html[at:end]
            at = end
        elif html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = n if end < 0 else end + 3
        elif (tag := _TAG.match(html, at, min(n, at + TAG_CHARS))) is not None:
            name = tag[2].lower()
            yield "close" if tag[1] else "open", name, tag[3]
            at = tag.end()
            if name in RAW and not tag[1]:
                end = re.compile(f"</{name}(?![a-z0-9])", re.I).search(html, at)
                end = end.start() if end else n
                yield "raw", name, html[at:end]
                at = end
        elif (name := _NAME.match(html, at)) or html.startswith(("<!", "<?", "</"), at):
            if at > last_end:
                return  # a tag that never ends
            end = html.find(">", at)
            if name:
                yield "close" if html[at + 1] == "/" else "open", name[1].lower(), html[name.end():end]
            at = end + 1
        else:
            yield "text", "", "<"
            at += 1


def attributes(text: str) -> dict[str, str]:
    found = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


def visible(text: str) -> str:
    return unescape(_BLANKS.sub(" ", text).replace("&nbsp;", " ")).strip()


def names(found: list[str]) -> list[str]:
    """Names out of texts that list them: once each, without ``By``, links left out."""
    parts = (_BY.sub("", p.strip(), count=1) if _BY.match(p.strip()) else p.strip() for text in found for p in _PARTED.split(visible(text)))
    return list(dict.fromkeys(p for p in parts if p and not p.lower().startswith(("http:", "https:", "www."))))


def linked_data(text: str) -> tuple[list[str], str | None]:
    """Authors and publish date in a JSON-LD script; nothing if it is not well formed."""
    try:
        waiting = [json.loads(text)]
    except (ValueError, RecursionError):
        return [], None
    authors, published = [], None
    while waiting:
        item = waiting.pop(0)
        if isinstance(item, list):
            waiting += item
        elif isinstance(item, dict):
            named = item.get("author")
            for a in named if isinstance(named, list) else [named]:
                a = a.get("name") if isinstance(a, dict) else a
                authors += [a] if isinstance(a, str) else []
            date = item.get("datePublished")
            published = published or (date if isinstance(date, str) and date else None)
            graph = item.get("@graph")
            waiting += graph if isinstance(graph, list) else []
    return authors, published


class Page:
    """Blocks and marks of a page, gathered in one pass."""

    def __init__(self, html: str) -> None:
        self.blocks: list[Block] = []
        self.meta, self.linked_names, self.bylines = [], [], []
        self.top_image = self.image = self.published = None
        self.stack: list[tuple[str, int, bool, bool]] = []  # name, article, chrome, around
        self.open: dict[str, int] = {}
        self.articles = self.unseen = 0
        self.parts: list[str] = []
        self.linked, self.in_link = 0, False
        self.around_leaf = self.heading = False
        self.byline: tuple[str, list[str]] | None = None
        for kind, name, text in tokens(html):
            getattr(self, kind if kind != "open" else "opened")(name, text)
        self.end_block()

    def end_block(self) -> None:
        if self.byline is not None:
            self.end_byline()
        text = visible("".join(self.parts))
        if text and not self.unseen:
            _, article, chrome, around = self.stack[-1] if self.stack else ("", 0, False, False)
            self.blocks.append(Block(text, min(self.linked, len(text)), article, chrome, around or self.around_leaf, self.heading))
        self.parts, self.linked, self.around_leaf, self.heading = [], 0, False, False

    def end_byline(self) -> None:
        text = "".join(self.byline[1])
        self.byline = None
        if len(text) <= BYLINE_CHARS:
            self.bylines.append(text)
        else:
            self.parts.append(text)

    def text(self, _: str, text: str) -> None:
        if self.unseen:
            return
        (self.parts if self.byline is None else self.byline[1]).append(text)
        if self.in_link and self.byline is None:
            self.linked += len(_BLANKS.sub(" ", text))

    json_script = False

    def raw(self, name: str, text: str) -> None:
        if name == "script" and self.json_script:
            authors, published = linked_data(text)
            self.linked_names += authors
            self.published = self.published or published

    def opened(self, name: str, text: str) -> None:
        if name in ("meta", "img", "time", "script"):
            getattr(self, f"{name}_tag")(attributes(text))
        elif name == "a":
            self.in_link = True
        elif name == "br":
            self.text("", " ")
        if name in CONTAINERS or name in LEAVES:
            self.end_block()
        marks = attributes(text) if "=" in text and name not in ("meta", "img", "script") else {}
        hint = f"{marks.get('class', '')} {marks.get('id', '')}"
        around = bool(AROUND.search(hint)) if len(hint) > 1 else False
        if name in CONTAINERS:
            if text.endswith("/"):
                return
            _, article, chrome, inside = self.stack[-1] if self.stack else ("", 0, False, False)
            if name == "article":
                self.articles += 1
                article, inside = self.articles, False
            chrome = chrome or name in CHROME or name in FRAME and not article
            self.stack.append((name, article, chrome, inside or around and name != "body"))
            self.open[name] = self.open.get(name, 0) + 1
            self.unseen += name in UNSEEN
        elif name in LEAVES:
            self.around_leaf, self.heading = around, name in ("h1", "h2")
        is_byline = marks and (marks.get("rel", "").lower() == "author" or any(BYLINE.search(marks.get(k, "")) for k in ("class", "itemprop")))
        if is_byline and self.byline is None and not self.unseen and name in ("a", "span", "div", "p", "address", "strong", "li"):
            self.byline = (name, [])

    def close(self, name: str, _: str) -> None:
        if name == "a":
            self.in_link = False
        if self.byline is not None and name == self.byline[0]:
            self.end_byline()
        if name in LEAVES:
            self.end_block()
        elif name in CONTAINERS:
            self.end_block()
            if self.open.get(name):
                while True:
                    top = self.stack.pop()[0]
                    self.open[top] -= 1
                    self.unseen -= top in UNSEEN
                    if top == name:
                        break

    def meta_tag(self, marks: dict[str, str]) -> None:
        kinds = {marks.get(k, "").lower() for k in ("name", "property", "itemprop")}
        content = marks.get("content", "").strip()
        if kinds & META_AUTHOR:
            self.meta.append(content)
        if kinds & {"og:image", "og:image:url"} and content:
            self.top_image = self.top_image or content
        if kinds & META_DATE and content:
            self.published = self.published or content

    def img_tag(self, marks: dict[str, str]) -> None:
        # The last attribute counts: a small picture often stands before the one that is loaded later.
        ref = next((v for k, v in reversed(marks.items()) if k.endswith("src")), "")
        if self.image is None and ref and not ref.startswith(("data:", "#")):
            self.image = ref

    def time_tag(self, marks: dict[str, str]) -> None:
        self.published = self.published or marks.get("datetime") or None

    def script_tag(self, marks: dict[str, str]) -> None:
        self.json_script = marks.get("type", "").lower().startswith("application/ld+json")

    def main_text(self) -> str | None:
        """The best run of blocks that stand in the same article element, or in none; without one that is long enough
        all text outside navigation; null if that is short, too."""
        runs: dict[int, list] = {}  # article -> [best sum, its first and last block, sum of the run that is open, its first block]
        for i, block in enumerate(self.blocks):
            run = runs.setdefault(block.article, [0.0, 0, -1, 0.0, i])
            if run[3] <= 0:
                run[3], run[4] = 0.0, i
            run[3] += block.value()
            if run[3] > run[0]:
                run[:3] = run[3], run[4], i
        article, (total, first, last, _, _) = max(runs.items(), key=lambda r: r[1][0], default=(0, (0.0, 0, -1, 0.0, 0)))
        inside = [b for b in self.blocks[first:last + 1] if b.article == article and not (b.chrome or b.around) and 2 * b.linked <= len(b.text)]
        for kept in (inside, [b for b in self.blocks if not b.chrome]):
            text = " ".join(b.text for b in kept)
            if len(text) >= MIN_CONTENT_CHARS:
                return text
        return None

    def authors(self) -> list[str]:
        return next((found for texts in (self.meta, self.linked_names, self.bylines) if (found := names(texts))), [])


PARTS = T.StructType([
    T.StructField("content", T.StringType()), T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("image", T.StringType()), T.StructField("published", T.StringType()),
])


def parts_of(html: str | None) -> tuple[str | None, list[str], str | None, str | None]:
    if not html:
        return None, [], None, None
    page = Page(html)
    return page.main_text(), page.authors(), page.top_image or page.image, page.published


@F.pandas_udf(PARTS)
def page_parts(pages: pd.Series) -> pd.DataFrame:
    """Main text (null if it is too short), authors, image link as written there and publish date of each page."""
    return pd.DataFrame([parts_of(html) for html in pages], columns=["content", "authors", "image", "published"])
