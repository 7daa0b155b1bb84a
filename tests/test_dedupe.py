"""Fuzzy duplicate removal against a plain walk over all pairs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gazette.functions.similarity import token_set_ratio
from gazette.operators import dedupe

AS_OF = datetime(2024, 5, 1)


def walk(batch, stored_urls, stored_titles, threshold=85):
    """The sequential rule, written down row by row."""
    duplicates = {url for _, url, _ in batch if url in stored_urls}
    known = {" ".join(t.lower().split()) for t in stored_titles}
    for _, url, title in batch:
        title = " ".join((title or "").lower().split())
        if not url or not title or url in duplicates:
            continue
        if any(token_set_ratio(title, other) >= threshold for other in known):
            duplicates.add(url)
        else:
            known.add(title)
    return duplicates


def frames(spark, batch, stored):
    b = spark.createDataFrame(batch, "pos long, url string, original_title string")
    a = spark.createDataFrame(stored, "source_url string, title string, created_at timestamp_ntz")
    return b, a


def mutate(rng, title):
    words = title.split()
    for _ in range(rng.randint(0, 3)):
        what = rng.random()
        i = rng.randrange(len(words)) if words else 0
        if what < 0.3 and len(words) > 1:
            words.pop(i)
        elif what < 0.5:
            words.insert(i, rng.choice(VOCABULARY))
        elif words and words[i]:
            j = rng.randrange(len(words[i]))
            words[i] = words[i][:j] + rng.choice("abcde") + words[i][j + (rng.random() < 0.6):]
    return " ".join(words)


_RNG = random.Random(3)
VOCABULARY = ["".join(_RNG.choice("abcdeinorst") for _ in range(_RNG.randint(1, 8))) for _ in range(120)]
VOCABULARY += ["ভারত", "খবর", "ଓଡ଼ିଆ", "ଖବର", "the", "of"]


def random_titles(rng, n, low=1, high=8):
    titles = []
    for _ in range(n):
        if titles and rng.random() < 0.6:
            titles.append(mutate(rng, rng.choice(titles)))
        else:
            titles.append(" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(low, high))))
    return titles


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_keys_finds_every_pair(spark, seed):
    rng = random.Random(seed)
    titles = sorted({" ".join(sorted(set(t.split()))) for t in random_titles(rng, 500)} - {""})
    rows = spark.createDataFrame([(t,) for t in titles], "k string")
    keys = dedupe.two_sides(rows, rows)
    got = {(r.k_a, r.k_b) for r in dedupe.similar_keys(keys).collect()}
    want = {(a, b) for i, a in enumerate(titles) for b in titles[i + 1:] if token_set_ratio(a, b) >= 85}
    assert len(want) > 200
    assert got == want


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_duplicate_urls_equal_the_walk(spark, seed):
    rng = random.Random(seed)
    titles = random_titles(rng, 260)
    # Some URLs come several times, one holds many rows, and one title is copied often.
    urls = [f"u{rng.randrange(200)}" if rng.random() < 0.4 else f"v{i}" for i in range(len(titles))]
    for i in range(0, 60):
        if rng.random() < 0.5:
            urls[rng.randrange(len(urls))] = "hot"
            titles[rng.randrange(len(titles))] = "one hot title of many copies"
    titles[5], titles[9] = "", None
    batch = [(i, u, t) for i, (u, t) in enumerate(zip(urls, titles))]
    stored = [(f"s{i}", t, AS_OF - timedelta(hours=rng.randint(0, 40))) for i, t in enumerate(random_titles(rng, 40, 3))]
    stored += [("u3", "unlike anything else here", AS_OF - timedelta(days=90))]
    recent = [t for _, t, at in stored if at >= AS_OF - timedelta(hours=24) and t]
    b, a = frames(spark, batch, stored)
    rows = dedupe.dedupe_urls(b, a, F.lit(AS_OF).cast("timestamp_ntz")).collect()
    got = {r.url for r in rows}
    assert len(rows) == len(got)
    assert got == walk(batch, {u for u, _, _ in stored}, recent)


def test_one_large_group_of_near_copies(spark):
    """A third of the rows are variants of one title; a burst of another comes late. Few pairs are kept of them."""
    rng = random.Random(5)
    titles = [f"daily horoscope for {rng.choice(VOCABULARY)} readers edition {i}" for i in range(150)]
    titles += random_titles(rng, 150, 3) + [f"live updates number {i} from the match tonight" for i in range(150)]
    batch = [(i, f"u{i}", t) for i, t in enumerate(titles)]
    b, a = frames(spark, batch, [])
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    assert {r.url for r in dedupe.dedupe_urls(b, a, as_of).collect()} == walk(batch, set(), [])

    keys = dedupe.buckets_of(dedupe.with_signatures(spark.createDataFrame(
        [(" ".join(sorted(set(t.split()))), i) for i, t in enumerate(titles[300:])], "k string, first long")))
    assert dedupe.near_leaders(keys, keys, 85, earlier=True).count() > 140


def test_surviving_rows_keep_the_first_row_of_a_url(spark):
    batch = [(0, "a", "Storm hits the coast tonight"), (1, "a", "Storm hits the coast"), (2, "b", "Other news entirely")]
    b, a = frames(spark, batch, [])
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    assert {r.url for r in dedupe.dedupe_urls(b, a, as_of).collect()} == {"a"}
    assert sorted(r.pos for r in dedupe.dedupe_articles(b, a, as_of).collect()) == [0, 2]


def test_stored_url_is_a_duplicate_whatever_its_title(spark):
    b, a = frames(spark, [(0, "x", "Brand new words")], [("x", "Old title", AS_OF - timedelta(days=400))])
    assert [r.url for r in dedupe.dedupe_urls(b, a, F.lit(AS_OF).cast("timestamp_ntz")).collect()] == ["x"]


def test_best_stored_match(spark):
    b, a = frames(
        spark,
        [(0, "x", "Governer opens the bridge"), (1, "y", "Nothing like it"), (2, "z", "india")],
        [("s1", "governor opens the bridge", AS_OF), ("s2", "India wins the cup", AS_OF),
         ("s3", "nothing like it", AS_OF - timedelta(hours=25))],
    )
    rows = {r.pos: (r.match, round(r.score, 2)) for r in dedupe.fuzzy_title_join(
        b, a, F.lit(AS_OF).cast("timestamp_ntz")).collect()}
    assert rows == {0: ("governor opens the bridge", 96.0), 2: ("india wins the cup", 100.0)}


@pytest.mark.parametrize("a, b, score", [
    ("governor", "governer", 87.5),
    ("india", "india wins", 100.0),
    ("", "x", 0.0),
    ("new york mets", "new york mets", 100.0),
    ("fuzzy was a bear", "fuzzy fuzzy was a bear", 100.0),
])
def test_scores(a, b, score):
    assert token_set_ratio(a, b) == score
