"""Retention over day folders against the plain filter, and what it leaves untouched."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gazette.operators import retention, state

T0 = datetime(2024, 3, 10, 12)


def tables_of(spark, hours):
    articles = spark.createDataFrame([(f"a{i}", None if h is None else T0 - timedelta(hours=h)) for i, h in enumerate(hours)],
                                     "id string, published_at timestamp_ntz")
    seen = spark.createDataFrame([(f"u{u}", f"a{i}", T0) for i in range(len(hours) + 1) for u in range(i % 3)],
                                 "user_auth_id string, article_id string, seen_at timestamp_ntz")
    return articles, seen


def stored(spark, tmp_path, hours):
    articles, seen = tables_of(spark, hours)
    paths = str(tmp_path / "articles"), str(tmp_path / "seen")
    retention.append_by_day(articles, paths[0])
    retention.append_seen_by_day(seen, articles, paths[1])
    return articles, seen, paths


def left(spark, path, column):
    table = retention._stored(spark, path)
    return [] if table is None else sorted(r[0] for r in table.select(column).collect())


@pytest.mark.parametrize("hours", [[0, 30, 168, 167, 169, 170, 180, 181, 300, 301, 900], [169, 400, 401], [1, 2], [168], [170, 171]])
def test_against_the_plain_filter(spark, tmp_path, hours):
    articles, seen, paths = stored(spark, tmp_path, hours)
    kept, seen_kept, counts = state.retention_delete(articles, seen, F.lit(T0).cast("timestamp_ntz"))
    assert retention.retention_by_days(spark, *paths, T0) == tuple(counts.first())
    assert left(spark, paths[0], "id") == sorted(r.id for r in kept.collect())
    assert left(spark, paths[1], "article_id") == sorted(r.article_id for r in seen_kept.collect())
    assert retention.retention_by_days(spark, *paths, T0) == (0, 0)


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_only_the_boundary_day_is_written(spark, tmp_path):
    _, _, paths = stored(spark, tmp_path, [0, 30, 167, 169, 300, None])
    before = [files(p) for p in paths]
    retention.retention_by_days(spark, *paths, T0)
    for path, old in zip(paths, before):
        new = files(path)
        assert all("published_date=2024-03-03" in f for f in new.keys() - old.keys())
        later = {f for f in old if not any(f"published_date=2024-{d}" in f for d in ("02", "03-03"))}
        assert later and all(new[f] == old[f] for f in later)
    assert "a5" in left(spark, paths[0], "id")  # undated
    assert left(spark, paths[1], "article_id").count("a5") == 2 and None not in left(spark, paths[1], "article_id")


def test_a_broken_run_is_completed(spark, tmp_path, monkeypatch):
    articles, seen, paths = stored(spark, tmp_path, [0, 167, 169, 300, 301])
    rewrite, calls = retention._rewrite, []

    def breaks(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("lost")
        rewrite(*args)

    monkeypatch.setattr(retention, "_rewrite", breaks)
    with pytest.raises(RuntimeError):
        retention.retention_by_days(spark, *paths, T0)
    monkeypatch.setattr(retention, "_rewrite", rewrite)
    retention.retention_by_days(spark, *paths, T0)
    kept, seen_kept, _ = state.retention_delete(articles, seen, F.lit(T0).cast("timestamp_ntz"))
    assert left(spark, paths[0], "id") == sorted(r.id for r in kept.collect())
    assert left(spark, paths[1], "article_id") == sorted(r.article_id for r in seen_kept.collect())


def test_empty_tables(spark, tmp_path):
    articles, seen = tables_of(spark, [1])
    paths = str(tmp_path / "articles"), str(tmp_path / "seen")
    retention.append_by_day(articles.limit(0), paths[0])
    retention.append_seen_by_day(seen.limit(0), articles, paths[1])
    assert retention.retention_by_days(spark, *paths, T0) == (0, 0)
