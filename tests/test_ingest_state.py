"""Ingest filters, enrichment, users, sessions, retention, rotation and outbox on small rows."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gazette.constants import SOURCES
from gazette.operators import enrich, ingest, notifications, rotation, sessions, state
from gazette.schemas import SCRAPED, SESSIONS
from gazette.sources import feeds, tables
from gazette.sources.dimensions import with_usable_patterns

T0 = datetime(2024, 3, 1)
NOW = lambda: F.lit(T0).cast("timestamp_ntz")


def scraped(spark, n=12, language="english"):
    rows = [
        (i, f"https://n.com/{i}", "S", f"Title {i}", f"Text {i}", "", [f"A{i}", "B"], T0 - timedelta(hours=i), language)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCRAPED)


def test_url_patterns(spark):
    dim = with_usable_patterns(spark, [("english", "a", "A", "", "", ["/India/", "story[0-9]"]),
                                       ("odia", "b", "B", "", "", []), ("odia", "c", "C", "", "", ["?id=("])])
    urls = [("a", "http://x/INDIA/1"), ("a", "http://x/story7"), ("a", "http://x/sport"), ("b", "anything"),
            ("c", "http://x?ID=(3"), ("c", "http://x?id=3")]
    items = spark.createDataFrame(urls, "key string, link string")
    kept = ingest.feed_url_filter(ingest.source_join(items, dim, "key")).collect()
    assert sorted(r.link for r in kept) == sorted(["http://x/INDIA/1", "http://x/story7", "anything", "http://x?ID=(3"])


@pytest.mark.parametrize("n, expected", [(3, [1, 3, 5]), (7, [1, 3, 5, 7, 9]), (0, [1, 3, 5, 7, 9])])
def test_take_n_counts_valid_items_only(spark, n, expected):
    items = spark.createDataFrame(
        [("f", i, f"http://x/{i}", f"t{i}" if i % 2 else " ", "c" * 100) for i in range(10)],
        "feed string, position long, url string, title string, content string")
    got = ingest.feed_take_n(ingest.feed_row_validity(items), n).collect()
    assert sorted(r.position for r in got) == expected


@pytest.mark.parametrize("days, expected", [(None, [1, 2, 4, 5, 6]), (0, [4, 5, 6]), (3, [1, 2, 3, 4, 5, 6])])
def test_filter_by_date(spark, days, expected):
    rows = [(1, "2024-02-28T00:00:00Z"), (2, "2024-02-28 00:00:00"), (3, "2024-02-27"), (4, None), (5, ""), (6, "soon")]
    items = spark.createDataFrame(rows, "i int, publish_date string")
    # Two days before 2024-03-01 is 2024-02-28, which is included.
    assert sorted(r.i for r in ingest.filter_by_date(items, NOW(), days).collect()) == expected


def test_insert_keeps_the_first_row_of_a_new_url(spark):
    def rows(*urls):
        frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "pos long, source_url string")
        for c in ("source_name", "title", "author", "image_url", "content", "category", "language", "published_at",
                  "created_at"):
            frame = frame.withColumn(c, F.lit("x"))
        return frame.withColumn("id", F.col("pos"))

    got = ingest.ingest_insert(rows("a", "b", "a", "c"), rows("b")).collect()
    assert sorted((r.pos, r.source_url) for r in got) == [(0, "a"), (3, "c")]


def test_feed_files(spark, tmp_path):
    (tmp_path / "good.xml").write_text(
        "<rss><channel><item><link>http://a/1</link><title> One &amp; two </title><pubDate>Mon, 05 Feb 2024 "
        "10:00:00 GMT</pubDate></item><item><link>http://a/2</link><title>Two</title></item></channel></rss>")
    (tmp_path / "empty.xml").write_text("<rss><channel></channel></rss>")
    (tmp_path / "broken.xml").write_text("this is no feed <<<")
    rows = feeds.feed_scan(spark, str(tmp_path)).collect()
    assert sorted((r.feed, r.link, r.title) for r in rows) == [("good", "http://a/1", "One & two"), ("good", "http://a/2", "Two")]


def test_ledger_asks_each_request_once(spark, tmp_path):
    """A run that dies between its two passes, its repetition, equal requests in one run, and calls that failed."""
    batched = enrich.batch_of_5(scraped(spark), ["language"]).persist()
    calls, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()

    def ask(provider, instruction, request, down=()):
        import uuid

        first, strict = json.loads(request)[0]["url"][-2:], "Return only valid JSON" in instruction
        (calls / uuid.uuid4().hex).write_text(f"{first} {strict}")
        if first in down:
            raise RuntimeError("no")
        return "" if first == "10" and not strict else json.dumps([{"source_url": first, "title": "T"}])

    asked = lambda: sorted(f.read_text() for f in calls.iterdir())
    requests = enrich.batch_requests(batched)
    failed = enrich.enrich_with_ledger(requests, lambda *a: ask(*a, down=("/5",)), ledger, waves=3).collect()
    assert asked() == ["/0 False", "/5 False", "10 False"]  # the first pass is over and the run dies
    assert {r.batch_no: (r.response is None, r.error) for r in failed} == {0: (False, None), 1: (True, "RuntimeError: no"), 2: (False, None)}
    for _ in range(2):
        done = {r.batch_no: r for r in enrich.ask_with_retry(batched, ask, ledger).collect()}
        assert all(r.error is None and "T" in r.response for r in done.values()) and len(done) == 3
        assert asked() == ["/0 False", "/5 False", "/5 False", "10 False", "10 True"]  # what failed, and the stricter one
    plain = {r.batch_no: r.response for r in enrich.ask_with_retry(batched, ask).collect()}
    assert plain == {n: r.response for n, r in done.items()}
    twice = requests.filter("batch_no = 0").withColumn("instruction", F.lit("new"))
    before = len(asked())
    both = enrich.enrich_with_ledger(twice.unionByName(twice.withColumn("batch_no", F.lit(9).cast("long"))), ask, ledger).collect()
    assert len(asked()) == before + 1 and sorted(r.batch_no for r in both) == [0, 9] and both[0].response == both[1].response


def test_batches_answers_and_merge(spark):
    batched = enrich.batch_of_5(scraped(spark), ["language"]).persist()
    assert sorted((r.batch_no, r["count"]) for r in batched.groupBy("batch_no").count().collect()) == [(0, 5), (1, 5), (2, 2)]

    def ask(provider, instruction, request):
        rows = json.loads(request)
        assert provider == "openrouter" and rows[0]["authors"][1] == "B"
        if rows[0]["url"].endswith("/5"):
            raise RuntimeError("no")
        if rows[0]["url"].endswith("/10"):
            # The first call comes back empty; the stricter one gets an answer.
            if "Return only valid JSON" not in instruction:
                return ""
            return json.dumps([{"source_url": rows[1]["url"], "title": "late"}])
        return "```json\n" + json.dumps({"articles": [
            {"source_url": r["url"], "title": "T", "content": "", "category": None} for r in rows[1:]
        ] + [{"source_url": rows[1]["url"], "title": "second"}]}) + "\n```"

    answers = enrich.answers_of(enrich.ask_with_retry(batched, ask))
    merged = enrich.summary_merge(batched, answers, NOW()).orderBy("out_pos").collect()
    assert [r.pos for r in merged] == [1, 2, 3, 4, 0, 5, 6, 7, 8, 9, 11, 10]
    by_pos = {r.pos: r for r in merged}
    assert (by_pos[1].title, by_pos[1].content, by_pos[1].category) == ("T", "Text 1", "General")
    assert (by_pos[0].title, by_pos[6].title, by_pos[11].title) == ("Title 0", "Title 6", "late")
    assert by_pos[1].author == "A1, B" and by_pos[1].image_url is None
    assert sorted(r.pos for r in enrich.answer_fallback(batched, answers).collect()) == [5, 6, 7, 8, 9]
    assert sorted(r.url[14:] for r in enrich.missing_answers(batched, answers).collect()) == ["0", "10", "5", "6", "7", "8", "9"]


def test_last_saved_and_outbox(spark):
    batched = enrich.batch_of_5(scraped(spark, 3, "odia"), ["language"])
    merged = enrich.summary_merge(batched, enrich.answers_of(spark.createDataFrame(
        [("odia", 0, '[{"source_url": "https://n.com/2"}]', None)],
        "language string, batch_no long, response string, error string")), NOW())
    last = notifications.last_saved(merged, ["language"], "out_pos")
    # Fallbacks are inserted after the answered rows, so the last one is a fallback.
    assert last.collect()[0].source_url == "https://n.com/1"
    runs = spark.createDataFrame([("odia",), ("bengali",)], "language string")
    box = {r.language: r for r in notifications.notification_outbox(runs, last, ["language"]).collect()}
    assert box["bengali"].status == "no_article" and box["bengali"].payload is None
    assert box["odia"].topic == "news_odia" and box["odia"].image == "https://placehold.co/600x400"
    payload = json.loads(box["odia"].payload)
    assert len(payload) == 12 and all(isinstance(v, str) for v in payload.values())
    assert payload["published_at"] == "2024-02-29T23:00:00+00:00" and payload["author"] == "A1, B"


def test_stats(spark):
    rows = [(1, "odia", "B", 1), (1, "odia", "A", 0), (1, "odia", "A", 0), (2, "english", "C", 0)]
    scraped_rows = spark.createDataFrame(rows, "run int, language string, source_name string, source_position int")
    saved = scraped_rows.filter("source_name = 'A'")
    got = {r.run: (r.sources, r.scraped_articles, r.saved_articles)
           for r in ingest.ingest_stats(scraped_rows, saved, ["run", "language"]).collect()}
    assert got == {1: ("A, B", 3, 2), 2: ("C", 1, 0)}


def test_user_changes(spark):
    users = spark.createDataFrame([("old", T0, "t0", True)], "auth_id string, created_at timestamp_ntz, "
                                  "fcm_token string, is_notification_enabled boolean")
    events = [
        ("old", "preference", "", False, T0, 1), ("new", "create", None, None, T0, 2), ("new", "token", "t1", None, T0, 3),
        ("new", "preference", "t2", True, T0, 5), ("new", "token", "t3", None, T0, 4), ("late", "preference", None, True, T0, 6),
    ]
    changes = spark.createDataFrame(events, "auth_id string, kind string, fcm_token string, is_enabled boolean, "
                                    "event_at timestamp_ntz, seq long")
    after = state.user_apply_changes(users, changes)
    got = {r.auth_id: (r.fcm_token, r.is_notification_enabled) for r in after.collect()}
    assert got == {"old": ("t0", False), "new": ("t2", True), "late": (None, True)}
    assert [r.fcm_token for r in state.notification_tokens(after).collect()] == ["t2"]
    bad = spark.createDataFrame([("t2",), ("zz",), (None,)], "fcm_token string")
    cleared = {r.auth_id: (r.fcm_token, r.is_notification_enabled) for r in state.clear_tokens(after, bad).collect()}
    assert cleared == {"old": ("t0", False), "new": (None, False), "late": (None, True)}


def test_retention(spark):
    articles = spark.createDataFrame([("a", T0 - timedelta(days=8)), ("b", T0 - timedelta(days=7)), ("c", T0)],
                                     "id string, published_at timestamp_ntz")
    seen = spark.createDataFrame([("u", "a", T0), ("v", "a", T0), ("u", "b", T0)],
                                 "user_auth_id string, article_id string, seen_at timestamp_ntz")
    kept, seen_kept, counts = state.retention_delete(articles, seen, NOW())
    assert sorted(r.id for r in kept.collect()) == ["b", "c"]
    assert [r.article_id for r in seen_kept.collect()] == ["b"]
    assert tuple(counts.collect()[0]) == (1, 2)
    nothing = state.retention_delete(articles, seen, NOW(), days=30)
    assert tuple(nothing[2].collect()[0]) == (0, 0) and nothing[0].count() == 3


def session_walk(stored, events):
    """The sessions after the events, and the outcomes, one event after the other."""
    table = {s[2]: dict(zip(SESSIONS.fieldNames(), s)) for s in stored}
    outcomes = {}

    def open_session(new_id, user, token, at):
        table[token] = dict(id=new_id, user_auth_id=user, token_hash=token, expires_at=at + timedelta(days=30),
                            created_at=at, revoked_at=None, replaced_by_session_id=None)

    for seq, at, kind, token, user, new_id, new_token in sorted(events):
        row = table.get(token)
        if kind == "create":
            open_session(new_id, user, new_token, at)
            outcomes[seq] = "valid"
        elif row is None:
            outcomes[seq] = "unknown"
        elif row["revoked_at"] is not None:
            outcomes[seq] = "revoked"
        elif row["expires_at"] <= at:
            outcomes[seq] = "expired"
        else:
            outcomes[seq] = "valid"
            row["revoked_at"] = at
            if kind == "rotate":
                row["replaced_by_session_id"] = new_id
                open_session(new_id, row["user_auth_id"], new_token, at)
    return sorted(str(list(r.values())) for r in table.values()), outcomes


@pytest.mark.parametrize("seed", range(3))
def test_session_events_equal_the_walk(spark, seed):
    import random

    rng = random.Random(seed)
    stored = [(f"s{i}", f"u{i}", f"t{i}", T0 + timedelta(days=rng.randint(-3, 30)), T0, T0 if rng.random() < 0.2 else None, None)
              for i in range(6)]
    tokens, events, at = [s[2] for s in stored], [], T0
    for seq in range(80):
        at += timedelta(hours=rng.choice([0, 1, 200]))
        kind = rng.choice(["create", "rotate", "rotate", "rotate", "revoke"])
        new = f"n{seq}" if kind != "revoke" else None
        # Mostly recent tokens, so that chains grow; some that are issued later or never.
        token = None if kind == "create" else rng.choice([*tokens[-3:], *tokens, f"n{seq + 5}", "never"])
        events.append((seq, at, kind, token, f"g{seq}" if kind == "create" else None, f"id{seq}" if new else None, new))
        if new:
            tokens.append(new)
    after, outcomes = sessions.session_apply_events(
        spark.createDataFrame(stored, SESSIONS),
        spark.createDataFrame(events, "seq long, event_at timestamp_ntz, kind string, token_hash string, "
                              "user_auth_id string, new_id string, new_token_hash string"))
    want_rows, want = session_walk(stored, events)
    assert {r.seq: r.outcome for r in outcomes.collect()} == want
    assert sorted(str(list(r.asDict().values())) for r in after.collect()) == want_rows


def test_session_state_order(spark):
    import hashlib

    def row(token, expires, revoked):
        return (token, "u", hashlib.sha256(token.encode()).hexdigest(), expires, T0, revoked, None)

    day = timedelta(days=1)
    rows = spark.createDataFrame([row("ok", T0 + day, None), row("end", T0, None), row("both", T0 - day, T0)], SESSIONS)
    tokens = spark.createDataFrame([("ok",), ("end",), ("both",), ("none",)], "token string")
    got = {r.token: r.state for r in sessions.session_state(tokens, rows, NOW()).collect()}
    assert got == {"ok": "valid", "end": "expired", "both": "revoked", "none": "unknown"}


def test_rotation_against_counters(spark):
    turns = 60
    got = {}
    for r in rotation.rotation_assign(spark.range(turns).withColumnRenamed("id", "turn")).collect():
        got.setdefault(r.turn, {})[r.slot] = (r.language, r.source_name)
    names = {}
    for s in SOURCES:
        names.setdefault(s[0], []).append(s[2])
    counters, cycle = dict.fromkeys(names, 0), ["english", "odia", "bengali"]
    for turn in range(turns):
        lang = cycle[turn % 3]
        start, counters[lang] = counters[lang], counters[lang] + 2
        assert got[turn] == {i: (lang, names[lang][(start + i) % len(names[lang])]) for i in range(2)}


def test_old_files_without_language(spark, tmp_path):
    path = str(tmp_path / "articles")
    rows = spark.createDataFrame([("a", T0)], "id string, created_at timestamp_ntz")
    tables.append_articles(rows, path)
    assert tables.table_scan(spark, path, "articles").collect()[0].language == "english"
