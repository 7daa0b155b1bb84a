"""Streams over landed files equal the batch form, and repeated runs change nothing."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gazette.schemas import SCRAPED
from gazette.streaming import ingest, rates

T0 = datetime(2024, 3, 1)


def model():
    def echo(provider, instruction, request):
        rows = json.loads(request)
        return json.dumps({"articles": [{"source_url": r["url"], "title": "T " + r["original_title"]} for r in rows]})

    return echo


def land(spark, path, rows):
    spark.createDataFrame(rows, SCRAPED).coalesce(1).write.mode("append").parquet(path)


def row(i, title, language="english", days=0):
    return (i, f"https://n.com/{i}", "S", title, f"Text {i}", "", [], T0 - timedelta(days=days), language)


def test_two_drops_and_a_replay(spark, tmp_path):
    landed, run = str(tmp_path / "in"), ingest.Run(str(tmp_path / "art"), str(tmp_path / "box"), model(), lambda: T0)

    def go():
        items = spark.readStream.schema(SCRAPED).parquet(landed)
        ingest.ingest_stream(items, run, str(tmp_path / "log")).awaitTermination()
        return ingest.stored_articles(spark, run.articles).orderBy("source_url").collect()

    land(spark, landed, [row(1, "Floods in the north"), row(2, "Floods in the north today"), row(3, "Too old", days=3),
                         row(4, "Cup final tonight", "odia")])
    first = go()
    assert [r.source_url[-1] for r in first] == ["1", "4"]
    # The second drop repeats a URL, a stored title, and brings one new item.
    land(spark, landed, [row(1, "Other words"), row(5, "T floods in the north"), row(6, "Budget passed by assembly")])
    second = go()
    assert [r.source_url[-1] for r in second] == ["1", "4", "6"]
    box = spark.read.parquet(run.outbox)
    assert {(r.run_id, r.language, r.status) for r in box.collect()} == {
        (0, "english", "ready"), (0, "odia", "ready"), (1, "english", "ready")}
    # The same micro-batch again: nothing is inserted, and its outbox rows are the same.
    before = sorted(box.filter("run_id = 1").select("payload").collect())
    again = spark.createDataFrame([row(1, "Other words"), row(5, "T floods in the north"), row(6, "Budget passed by assembly")], SCRAPED)
    ingest.run_once(run, again, 1)
    assert len(ingest.stored_articles(spark, run.articles).collect()) == 3
    assert sorted(spark.read.parquet(run.outbox).filter("run_id = 1").select("payload").collect()) == before


def test_empty_micro_batch(spark, tmp_path):
    run = ingest.Run(str(tmp_path / "art"), str(tmp_path / "box"), model(), lambda: T0)
    ingest.run_once(run, spark.createDataFrame([], SCRAPED), 7)
    assert ingest.stored_articles(spark, run.articles).count() == 0


def test_seen_pairs_are_stored_once(spark, tmp_path):
    path, schema = str(tmp_path / "seen"), "user_auth_id string, article_id string, seen_at timestamp_ntz"
    rows = spark.createDataFrame([("u", "a", T0), ("u", "a", T0 + timedelta(1)), ("v", "a", T0)], schema)
    rates.append_seen(rows, path)
    rates.append_seen(rows.unionByName(spark.createDataFrame([("u", "b", T0)], schema)), path)
    got = spark.read.parquet(path).collect()
    assert sorted((r.user_auth_id, r.article_id, r.seen_at) for r in got) == [("u", "a", T0), ("u", "b", T0), ("v", "a", T0)]


def test_arrival_rate_of_a_stream_equals_the_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(T0 + timedelta(minutes=m), "odia" if m % 2 else "english") for m in range(0, 120, 7)]
    frame = spark.createDataFrame(rows, "created_at timestamp_ntz, language string")
    frame.write.parquet(path)
    stream = rates.arrival_rate(spark.readStream.schema(frame.schema).parquet(path), "1 minute")
    query = stream.writeStream.format("memory").queryName("rate").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda f: sorted((r.tick_start, r.language, r.arrivals) for r in f.collect())
    assert key(spark.table("rate")) == key(rates.arrival_rate(frame))


def test_url_dedupe_in_the_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    frame = spark.createDataFrame([("a", T0), ("a", T0), ("b", T0)], "url string, ingested_at timestamp_ntz")
    frame.withColumn("ingested_at", F.col("ingested_at").cast("timestamp")).write.parquet(path)
    items = spark.readStream.schema("url string, ingested_at timestamp").parquet(path)
    query = ingest.stream_url_dedupe(items).writeStream.format("memory").queryName("urls").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.url for r in spark.table("urls").collect()) == ["a", "b"]


FEEDS = [("english", "a", "Paper A", "", "", ["/india/"]), ("odia", "b", "Paper B", "", "", [])]
WORDS = ["river", "budget", "cricket", "school", "harvest", "festival", "railway", "market", "temple", "cinema"]


def feed_file(folder, feed, tick, items):
    """A feed as servers write it: no positions, other elements, entities."""
    path = folder / f"feed={feed}"
    path.mkdir(parents=True, exist_ok=True)
    body = "".join(f"<item><guid>x</guid><title> {title} </title><link>{link}</link><pubDate>{date}</pubDate></item>" for link, title, date in items)
    (path / f"{tick}.xml").write_text(f'<?xml version="1.0"?><rss><channel><title>Feed</title>{body}</channel></rss>')


def test_feed_files_go_through_the_whole_run(spark, tmp_path):
    from gazette.sources import dimensions, feeds

    story = "A sentence of the story that is long enough. " * 4
    page = lambda text, at=T0: (f"<p class=byline>By Ann</p><article>{text}<img src=/i.png></article>", at)
    urls = {f"http://h.com/india/{w}": page(f"{w} {story}") for w in WORDS}
    urls["http://h.com/india/short"] = page("short")
    rows = [(u, *p) for u, p in urls.items()] + [("http://h.com/india/river", "<p>older</p>", T0 - timedelta(1))]
    rows += [(f"http://h.com/{w}", *page(story)) for w in WORDS]
    spark.createDataFrame(rows, "url string, html string, fetched_at timestamp_ntz").write.parquet(str(tmp_path / "pages"))
    new, old = "Fri, 01 Mar 2024 00:00:00 +0000", "Mon, 26 Feb 2024 00:00:00 +0000"
    india = lambda w, title=None, date=new: (f"http://h.com/india/{w}", title or f"{w} {w}s {w}ing", date)
    sources = dimensions.with_usable_patterns(spark, FEEDS)
    log, landed = str(tmp_path / "log"), tmp_path / "feeds"

    def go(hours):
        run = ingest.Run(str(tmp_path / "art"), str(tmp_path / "box"), model(), lambda: T0 + timedelta(hours=hours), str(tmp_path / "stats"))
        stream = feeds.feed_stream(spark, str(landed))
        ingest.ingest_feed_stream(stream, sources, str(tmp_path / "pages"), run, log).awaitTermination()
        return {(r.source_url.rsplit("/", 1)[1], r.language, r.run_id) for r in ingest.stored_articles(spark, run.articles).collect()}

    # No pattern, no title, no page and too little text take no place; of the five valid ones one is old, one a repeated URL, one a similar title.
    feed_file(landed, "a", 0, [
        ("http://h.com/river", "Elsewhere", new), india("river", " "), india("nowhere"), india("short"), india("river"), india("budget", date=old),
        india("river", "Other words"), india("cricket"), india("school", "Cricket crickets cricketing today"), india("harvest")])
    feed_file(landed, "b", 0, [("http://h.com/market", "Odia &amp; market news", "no date")])
    first = go(1)
    assert first == {("river", "english", 0), ("cricket", "english", 0), ("market", "odia", 0)}
    stored = spark.read.parquet(str(tmp_path / "art")).orderBy("source_url").collect()
    assert [(r.title, r.author, r.image_url, r.source_name) for r in stored] == [
        ("T cricket crickets cricketing", "Ann", "http://h.com/i.png", "Paper A"), ("T river rivers rivering", "Ann", "http://h.com/i.png", "Paper A"),
        ("T Odia & market news", "Ann", "http://h.com/i.png", "Paper B")]
    # Twenty hours later the titles are still known, thirty hours later only the URLs are.
    feed_file(landed, "a", 1, [india("river"), india("festival", "River rivers rivering"), india("railway")])
    assert go(21) - first == {("railway", "english", 1)}
    feed_file(landed, "a", 2, [india("river"), india("festival", "River rivers rivering"), india("temple", "railway railways railwaying now")])
    assert {x for x in go(31) if x[2] == 2} == {("festival", "english", 2)}
    stats = {(r.run_id, r.language): (r.sources, r.scraped_articles, r.saved_articles) for r in spark.read.parquet(str(tmp_path / "stats")).collect()}
    assert stats == {(0, "english"): ("Paper A", 5, 2), (0, "odia"): ("Paper B", 1, 1), (1, "english"): ("Paper A", 3, 1), (2, "english"): ("Paper A", 3, 1)}
    box = spark.read.parquet(str(tmp_path / "box"))
    assert {(r.run_id, r.language, r.status) for r in box.collect()} == {(0, "english", "ready"), (0, "odia", "ready"), (1, "english", "ready"), (2, "english", "ready")}


def test_titles_are_remembered_for_a_day_from_their_newest_article(spark, tmp_path):
    from gazette.streaming import titles

    landed, changes, log = (str(tmp_path / x) for x in ("in", "changes", "log"))
    schema = "title string, created_at timestamp_ntz"
    micro = timedelta(microseconds=1)

    def go(*rows):
        spark.createDataFrame([(t, T0 + h) for t, h in rows], schema).coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(schema).parquet(landed)
        titles.start_title_memory(stream, changes, log).awaitTermination()
        return sorted(r.norm for r in titles.remembered_titles(spark, changes).collect())

    hour = timedelta(hours=1)
    assert go(("Floods  in the NORTH", 0 * hour), ("floods in the north", 0 * hour), (" ", hour), (None, hour), ("cup final", hour), ("budget", 2 * hour)) == [
        "budget", "cup final", "floods in the north"]
    # At the 24th hour exactly a title is still known; a newer article keeps its title longer.
    assert go(("cup final", 5 * hour), ("rain", 24 * hour)) == ["budget", "cup final", "floods in the north", "rain"]
    assert go(("sun", 24 * hour + micro * 1000)) == ["budget", "cup final", "rain", "sun"]
    # An article beyond the look-back is late; a forgotten title may come again.
    assert go(("late", -1 * hour), ("snow", 28 * hour)) == ["cup final", "rain", "snow", "sun"]
    assert go(("Budget", 60 * hour)) == ["budget"]
    rows = [tuple(r) for r in spark.read.parquet(changes).groupBy("norm").sum("change").collect()]
    assert dict(rows)["budget"] == 1 and "late" not in dict(rows) and set(dict(rows).values()) == {0, 1}
    assert spark.conf.get(titles.STATE_STORE) != titles.ROCKSDB
