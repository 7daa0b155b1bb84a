"""Main texts, authors, images and dates of pages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gazette.functions import blocks
from gazette.operators import ingest

STORY = "This is a sentence of the story, and it goes on for a while. "
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Menu entry number {i}</a>" for i in range(30)) + "</ul>"


def content(page):
    return blocks.parts_of(page)[0]


@pytest.mark.parametrize("page, expected", [
    (f"<body><nav>menu</nav><article><p>{STORY * 3}</p></article></body>", (STORY * 3).strip()),
    # a teaser inside the article neither ends it nor belongs to it
    (f"<article><p>{STORY * 2}</p><article><a href=x>{STORY}</a></article><p>{STORY * 2}</p></article>", f"{(STORY * 2).strip()} {(STORY * 2).strip()}"),
    # of several articles the longest; an article around them all counts by its own text
    (f"<article>{STORY * 2}</article><article>{STORY * 5}</article><article>{STORY * 3}</article>", (STORY * 5).strip()),
    (f"<article><article><p>{STORY * 4}</p></article></article>", (STORY * 4).strip()),
    # no article element: menus of links outside nav stay away, and so does the small print
    (f"<body><div>{MENU}</div><div><h1>Head line</h1><p>{STORY * 3}</p><p>{STORY}</p></div><div>{MENU}</div><div>(c) x</div>", f"Head line {(STORY * 3).strip()} {STORY.strip()}"),
    (f"<body><div class='related'><p>{STORY * 9}</p></div><div><p>{STORY * 3}</p></div>", (STORY * 3).strip()),
    (f"<body><article><header><h1>Title</h1></header><p>{STORY * 3}</p><footer>{STORY}</footer></article>", f"Title {(STORY * 3).strip()}"),
    # what is in no run counts if nothing else is long enough
    (f"<body><nav>menu</nav><article>short</article><div class=ad>{STORY * 2}&amp; more</div><script>x</script></body>", f"short {STORY * 2}& more"),
    ("<body><article>short</article></body>", None), ("", None), (None, None), ("<", None),
    # open ends
    (f"<article><p>{STORY * 3}<p>{STORY}<foo", f"{(STORY * 3).strip()} {STORY.strip()}"),
    (f"<article><p>{STORY * 3}<!-- {STORY}", (STORY * 3).strip()),
    (f"<article><p>{STORY * 3}<script>{STORY}", (STORY * 3).strip()),
    (f"<article><p title='a > b'>{STORY * 3}</p></nav></div></p></article>", (STORY * 3).strip()),
    (f"<article><p title='a{'x' * 9000}'>{STORY * 3}1 < 2</p>", STORY * 3 + "1 < 2"),
    (f"<article>{STORY * 2}w<b>or</b>d<br>line &lt;b&gt;&nbsp;&eacute;</article>", STORY * 2 + "word line <b> é"),
])
def test_main_text(page, expected):
    assert content(page) == expected


@pytest.mark.parametrize("page, authors", [
    ('<meta name="author" content="Ren&eacute;e O\'Hara"><a rel="author">x</a>', ["Renée O'Hara"]),
    ("<META content='A B and C D' property='article:author'/>", ["A B", "C D"]),
    ('<p class="small byline">By <a href="/x">Ann Lee</a>, Bo Li</p>', ["Ann Lee", "Bo Li"]),
    ('<meta property="article:author" content="https://f.com/x"><a rel="author" href="/a">Jo</a><a rel=author>Jo</a>', ["Jo"]),
    ('<meta name="author" content=""><p>By nobody</p>', []), ("", []), (None, []),
    ('<script type="application/ld+json">{"@graph": [{"author": [{"name": "Ann B"}, "Cy"]}, {"author": "Di"}]}</script><p class=byline>No', ["Ann B", "Cy", "Di"]),
    ('<script type="application/ld+json">{"author": broken</script><p class=byline>By Yes</p>', ["Yes"]),
    ('<script>{"author": "no data"}</script>', []), ('<p class="byline">' + "long " * 100, []),
])
def test_authors(page, authors):
    assert blocks.parts_of(page)[1] == authors


@pytest.mark.parametrize("page, image, date", [
    ('<img src="/a.png"><meta property="og:image" content="/top.png">', "/top.png", None),
    ('<img src="data:x"><img src="#y"><IMG SRC=b.png>', "b.png", None), ('<img src="small.png" data-src="big.png">', "big.png", None),
    ('<time datetime="2024-01-02T03:04">x</time>', None, "2024-01-02T03:04"), ('<meta property="article:published_time" content="2024-05-06">', None, "2024-05-06"),
    ('<script type="application/ld+json">[{"datePublished": "2024-07-08"}]</script><time datetime="2025-01-01">', None, "2024-07-08"),
])
def test_image_and_date(page, image, date):
    assert blocks.parts_of(page)[2:] == (image, date)


def test_any_markup_is_read_in_linear_time():
    rng = random.Random(1)
    parts = ["<p>", "</p>", "<article>", "</article>", "<div class='", "\"", "'", "<", ">", "<!--", "-->", "<a href=x>", "</a>", "<script>", "</script>", "<nav>", "</nav>", "text ", "&amp", "<svg>", "="]
    for _ in range(300):
        blocks.parts_of("".join(rng.choice(parts) for _ in range(rng.randint(0, 60))))
    for part in ["<a ", "<a \"", "<!--", "<p><b", "</div>", "<div>", "<script", "<", "<a href='", "<a\" \"", "&", "<svg><div>", "<p class=byline>", "<b>"]:
        took = []
        for size in (50_000, 400_000):
            start = time.process_time()
            blocks.parts_of(part * (size // len(part)))
            took.append(time.process_time() - start)
        assert took[1] < 30 * took[0] + 1, part


def test_the_operator_keeps_rows_with_enough_text(spark):
    rows = [(1, "http://h.com/x/", f"<meta property='og:image' content='i.png'><article>{STORY * 3}</article>"), (2, "http://h.com/", "<p>short"), (3, "http://h.com/", None),
            (4, "http://h.com/", f"<p class=byline>By Ann</p><time datetime=2024-01-01><p>{STORY * 3}")]
    got = ingest.html_article(spark.createDataFrame(rows, "id int, url string, html string")).orderBy("id").collect()
    text = (STORY * 3).strip()
    assert [tuple(r)[:1] + tuple(r)[3:] for r in got] == [(1, text, [], "http://h.com/x/i.png", None), (4, text, ["Ann"], "", "2024-01-01")]
    renamed = spark.createDataFrame(rows, "id int, link string, page string")
    assert ingest.html_article(renamed, "page", "link").filter(F.col("content") == text).count() == 2
