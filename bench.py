"""Time the headline queries; prints one JSON line.

Settings come from BENCH_SF_DIR and BENCH_CPUS. Each query runs in one session, once to warm up on the same data and
then timed; its result is written to the no-op sink, so all columns and rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gazette.plans.queries import QUERIES  # noqa: E402
from gazette.session import local_session  # noqa: E402

HEADLINE = [
    "bundled_articles", "latest_articles", "articles_by_category", "search_articles", "topk_per_category",
    "trending_articles", "category_counts", "unseen_articles", "unseen_all_users", "html_article", "feed_take_n",
    "filter_by_date", "known_urls", "ingest_insert", "summary_merge", "retention_counts", "retention_seen_kept",
    "user_apply_changes", "session_apply_events", "rotation_assign", "arrival_rate", "notification_outbox",
    "fuzzy_title_join", "dedupe_articles",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "gazette-bench")
    spark.sparkContext.setLogLevel("ERROR")
    warm_dir = os.environ.get("BENCH_WARM_DIR", sf_dir)
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
