"""Serving queries on small rows: ties, bounds, wildcards, unseen pages."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gazette.constants import CATEGORIES
from gazette.operators import ranking, search, seen_bits, serving, skew, state
from gazette.schemas import ARTICLES
from gazette.sources import tables

T0 = datetime(2024, 3, 1)


def article(i, category="Politics", language="english", title=None, content=None, minutes=0, url=None):
    return (
        f"a{i:04d}", "Source", url or f"https://example.com/{i}", title or f"Title {i}", None, None,
        content or f"Content {i}", category, language, T0, T0 + timedelta(minutes=minutes),
    )


@pytest.fixture(scope="module")
def articles(spark):
    rows = [
        article(1, title="Politics headline", content="Election and assembly coverage"),
        article(2, "Sports", title="Sports headline"),
        article(3, title="Political search match", content="the keyword election", minutes=5),
        article(4, "General", "odia", "ଓଡ଼ିଆ ଶୀର୍ଷ ଖବର", minutes=5),
        article(5, "General", "bengali", "বাংলা সংবাদ শিরোনাম", "100% sure_thing\\end", minutes=5),
    ]
    return spark.createDataFrame(rows, ARTICLES)


def ids(frame):
    return [row.id for row in frame.collect()]


def test_latest_breaks_ties_by_id(articles):
    assert ids(serving.latest_articles(articles, 4)) == ["a0003", "a0004", "a0005", "a0001"]


def test_filters(articles):
    assert ids(serving.latest_articles(articles, language="odia")) == ["a0004"]
    assert ids(serving.latest_articles(articles, language="tamil")) == []
    assert len(ids(serving.latest_articles(articles, category="", language=""))) == 5
    assert ids(serving.articles_by_category(articles, "General")) == ["a0004", "a0005"]
    assert ids(serving.articles_by_category(articles, "General", limit=1, offset=1)) == ["a0005"]
    assert ids(serving.articles_by_category(articles, "")) == []


@pytest.mark.parametrize("query, found", [
    ("ELECTION", ["a0003", "a0001"]), ("%", None), ("100\\%", ["a0005"]), ("sure\\_thing", ["a0005"]),
    ("thing\\end", ["a0005"]), ("sure_thing", ["a0005"]), ("ଖବର", ["a0004"]), ("zzz", []),
])
def test_search(articles, query, found):
    got = ids(serving.search_articles(articles, query))
    assert got == found if found is not None else len(got) == 5


@pytest.fixture(scope="module")
def indexed(spark, articles, tmp_path_factory):
    """Small articles and articles of many days, stored and indexed in two runs."""
    rng, words = random.Random(3), ["election", "Straße", "ΟΔΟΣ", "🙂🙃🙂", "100%", "a_b", "c\\d", "vote", "", " ", "o", "x\ny"]
    rows = [
        article(i, rng.choice(CATEGORIES), title=rng.choice([None, "".join(rng.choices(words, k=3))]), minutes=rng.randrange(20_000),
                content=rng.choice(["x", " ".join(rng.choices(words, k=rng.randrange(40)))])) for i in range(100, 700)
    ]
    every = articles.unionByName(spark.createDataFrame(rows, ARTICLES))
    path, index = (str(tmp_path_factory.mktemp(n)) for n in ("stored", "index"))
    for part in (F.col("id") < "a0400", F.col("id") >= "a0400"):
        tables.append_articles(every.filter(part), path)
        search.append_search_index(every.filter(part), index)
    return tables.table_scan(spark, path, "articles"), index


@pytest.mark.parametrize("query", [
    "ELECTION", "%", "100\\%", "sure\\_thing", "thing\\end", "sure_thing", "ଖବର", "zzz", "election%vote", "lect_on", "straße", "οδος", "🙃🙂", "\\d ",
    "vote vote", "x\ny", "ab", "a_b", "votezzzvote",
])
def test_search_through_the_index(indexed, query):
    stored, index = indexed
    for page in ({"limit": 100}, {"limit": 7, "offset": 5, "category": "Sports"}):
        assert ids(search.search_indexed(stored, index, query, **page)) == ids(serving.search_articles(stored, query, **page))


def test_search_reads_postings_and_matched_days_only(spark, indexed):
    stored, index = indexed
    wanted = search.pattern_grams(spark, "political search")
    assert len(wanted) == len("political search") - 2 and search.pattern_grams(spark, "ab%cd_e\\%") == []
    found = search.candidates(spark, index, wanted)
    assert [r["id"] for r in found.collect()] == ["a0003"]
    assert "In(gram, [" in found._jdf.queryExecution().toString()
    plan = search.in_days(stored, found)._jdf.queryExecution().toString()
    assert "created_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_search_index_forgets_days(spark, articles, tmp_path):
    index = str(tmp_path / "index")
    later = articles.filter("id = 'a0002'").withColumns({"id": F.lit("late"), "created_at": F.col("created_at") + F.expr("interval 3 days")})
    search.append_search_index(articles.unionByName(later), index)
    search.expire_search_index(spark, index, "2024-03-02")
    assert [r["id"] for r in search.candidates(spark, index, ["hea", "ead"]).collect()] == ["late"]


@pytest.mark.parametrize("limit, offset", [(0, 0), (101, 0), (5, -1)])
def test_page_bounds(articles, limit, offset):
    with pytest.raises(ValueError):
        serving.articles_by_category(articles, "Sports", limit, offset)


def test_more_bounds(articles):
    with pytest.raises(ValueError):
        serving.bundled_articles(articles, 51)
    with pytest.raises(ValueError):
        serving.search_articles(articles, "")


def test_bundle_lists_every_category(articles):
    row = serving.bundled_articles(articles, 1).collect()[0]
    assert sorted(row.categories) == sorted(CATEGORIES)
    assert row.total_categories == 7 and row.limit_per_category == 1
    assert row.categories["Politics"].total == 2 and len(row.categories["Politics"].articles) == 1
    assert row.categories["Crime"].total == 0 and row.categories["Crime"].articles == []
    assert [a.id for a in row.trending] == ["a0003", "a0002", "a0004"]


def test_recent_window_includes_both_ends(articles):
    def at(minutes):
        return F.lit(T0 + timedelta(minutes=minutes)).cast("timestamp_ntz")

    assert ids(serving.recent_window(articles, at(0), 15)) == ["a0001"]
    assert ids(serving.recent_window(articles, at(20), 15)) == ["a0003"]
    assert ids(serving.recent_window(articles, at(21), 15)) == []


def test_unseen_twice(articles, spark):
    seen = spark.createDataFrame([], "user_auth_id string, article_id string, seen_at timestamp_ntz")
    first = serving.unseen_articles(articles, seen, "u", 2)
    assert ids(first) == ["a0003", "a0004"]
    now = F.lit(T0).cast("timestamp_ntz")
    seen = seen.unionByName(state.mark_seen(seen, first.withColumn("auth_id", F.lit("u")), now))
    assert ids(serving.unseen_articles(articles, seen, "u", 2)) == ["a0005", "a0001"]
    assert ids(serving.unseen_articles(articles, seen, "other", 2)) == ["a0003", "a0004"]


@pytest.mark.parametrize("width", [4, 16, 1024])
def test_unseen_for_all_users(spark, width):
    rng = random.Random(width)
    n, limit = 120, 4
    rows = [article(i, minutes=rng.randint(0, 40)) for i in range(n)]
    order = sorted(rows, key=lambda r: (-(r[-1] - T0).total_seconds(), r[0]))
    seen = {(f"u{u}", order[i][0]) for u in range(1, 8) for i in range(n) if rng.random() < u / 8}
    # One user has read all but the oldest two, one everything, one a long run at the top; unknown ids do no harm.
    seen |= {("hot", r[0]) for r in order[:-2]} | {("all", r[0]) for r in order}
    seen |= {("run", r[0]) for r in order[:37]} | {("run", "gone")}
    users = [f"u{u}" for u in range(0, 8)] + ["hot", "all", "run"]
    want = {
        (u, i + 1, r) for u in users
        for i, r in enumerate([r[0] for r in order if (u, r[0]) not in seen][:limit])
    }
    frame = serving.unseen_all_users(
        spark.createDataFrame(rows, ARTICLES),
        spark.createDataFrame([(*s, T0) for s in seen], "user_auth_id string, article_id string, seen_at timestamp_ntz"),
        spark.createDataFrame([(u,) for u in users], "auth_id string"), limit, width=width,
    )
    assert {(r.auth_id, r.position, r.id) for r in frame.collect()} == want


def test_ordered_index_per_group(spark):
    rows = [("hot", i) for i in range(500)] + [("cold", i) for i in range(20)] + [(None, 7)]
    random.Random(1).shuffle(rows)
    got = ranking.ordered_index(spark.createDataFrame(rows, "g string, v long"), [F.desc("v")], ["g"]).collect()
    assert {(r.g, r.v, r.idx) for r in got} == {
        (g, v, (500 if g == "hot" else 20 if g == "cold" else 8) - v) for g, v in rows
    }


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, how):
    rng = random.Random(4)
    left = [(i, rng.choice(["hot"] * 5 + [f"k{i % 90}", None])) for i in range(600)]
    a = spark.createDataFrame(left, "i long, k string")
    b = spark.createDataFrame([("hot", 1), ("k3", 2), ("k5", 3), ("none", 4)], "k string, x long")
    got = skew.skew_join(a, b, "k", how, spread=F.col("i"))
    want = a.join(b, "k", how)
    key = sorted(want.columns)
    rows = lambda f: sorted(str([r[c] for c in key]) for r in f.collect())
    assert rows(got) == rows(want)


def test_unseen_by_bits(spark, tmp_path):
    """Against plain lists, over several buckets, with full, empty and lost ones, and users who saw nothing."""
    rng, n = random.Random(9), 70_000
    order = list(range(1, n + 1))  # place p is article p
    gone = set(rng.sample(range(30_000, n), 40)) | set(range(1, 500))
    seen = {
        "none": set(), "all": set(order), "new": set(range(60_000, n + 1)), "old": set(range(1, 60_000)), "some": set(rng.sample(order, 50_000)),
        "first bucket left": set(range(32_769, n + 1)), "one left": set(order) - {rng.choice([p for p in order if p not in gone])}, "last": {n},
    }
    minutes = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int))")
    every = spark.range(1, n + 1).select("id", minutes.alias("created_at"))
    places, bits = str(tmp_path / "places"), str(tmp_path / "bits")
    seen_bits.append_places(every.filter("id <= 40000"), places, first=True)
    seen_bits.append_places(every.filter("id > 40000"), places)
    with pytest.raises(ValueError, match="cannot follow"):
        seen_bits.append_places(every.filter("id = 5"), places)
    at = spark.read.parquet(places)
    assert at.filter("place <> id").count() == 0 and at.count() == n
    pairs = spark.createDataFrame([(u, p) for u, ps in seen.items() for p in [*sorted(ps), -1]], "user_auth_id string, article_id long")
    for run in (0, 1, 1):
        seen_bits.append_seen_bits(pairs.filter(F.pmod("article_id", F.lit(2)) == run), at, bits)
    alive = every.filter(~F.col("id").isin(sorted(gone)))
    users = spark.createDataFrame([(u,) for u in seen], "auth_id string")
    for limit in (1, 7, 100):
        got = seen_bits.unseen_by_bits(at, seen_bits.stored_bits(spark, bits), users, alive, limit).collect()
        pages = {u: [r["id"] for r in sorted(got, key=lambda r: r["position"]) if r["auth_id"] == u] for u in seen}
        assert pages == {u: [p for p in reversed(order) if p not in ps and p not in gone][:limit] for u, ps in seen.items()}
    with pytest.raises(ValueError, match="anew"):
        seen_bits.unseen_by_bits(at, seen_bits.stored_bits(spark, bits), users, every.filter("id in (1, 70000)"), 5)
    nothing = seen_bits.unseen_by_bits(at, seen_bits.stored_bits(spark, bits), users, every.filter("id < 0"))
    assert nothing.collect() == []
