"""The titles of the look-back as the state of a stream: remembered when they come, forgotten by a timer."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gazette.constants import TITLE_LOOKBACK_HOURS
from gazette.functions.text import normalize_title

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
CHANGES = "norm string, created_at timestamp, change int"


def title_memory(articles: DataFrame, hours: int = TITLE_LOOKBACK_HOURS) -> DataFrame:
    """Changes of the remembered titles of a stream of articles: (norm, created_at, change), 1 for new and -1 for forgotten.

    The clock is the newest ``created_at`` that has come. A normalised title is remembered while its newest article is not
    older than the look-back, to the millisecond; the watermark lies that far back, so a title's timer is just behind that article, and
    articles that come later than the look-back are dropped as they would be forgotten at once. The state holds one time
    and one timer per title, spread by title. Empty titles are left out.
    """

    class Memory(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.newest = handle, handle.getValueState("newest", "at long")

        # Rows, and not frames: most titles have one article in a batch, and a frame costs more than the state. Each call
        # of the state is a way to the JVM and back, so none is made twice.
        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            came = max(row.at for row in rows)  # microseconds since 1970
            held = self.newest.get()
            known = held[0] if held else None
            if known is None or came > known:
                if known is not None:
                    self.handle.deleteTimer(known // 1000 + 1)
                self.newest.update((came,))
                self.handle.registerTimer(came // 1000 + 1)
            if known is None:
                yield self.change(key, came, 1)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            at = self.newest.get()[0]
            self.newest.clear()
            yield self.change(key, at, -1)

        def change(self, key, at: int, by: int) -> Row:
            return Row(norm=key[0], created_at=datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=at), change=by)

        def close(self) -> None:
            pass

    titles = articles.select(normalize_title(F.col("title")).alias("norm"), F.col("created_at").cast("timestamp").alias("created_at"))
    titles = titles.filter((F.col("norm") != "") & F.col("created_at").isNotNull()).withWatermark("created_at", f"{hours} hours")
    return titles.withColumn("at", F.unix_micros("created_at")).groupBy("norm").transformWithState(
        statefulProcessor=Memory(), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime"
    )


def start_title_memory(articles: DataFrame, changes: str, checkpoint: str, hours: int = TITLE_LOOKBACK_HOURS) -> StreamingQuery:
    """Append the changes to the Parquet folder ``changes``; the stream stops when all articles that have landed are done."""
    conf = articles.sparkSession.conf
    before = conf.get(STATE_STORE)
    conf.set(STATE_STORE, ROCKSDB)  # timers need it; the stream keeps the setting of its start
    try:
        return (
            title_memory(articles, hours).writeStream.format("parquet").option("path", changes)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        conf.set(STATE_STORE, before)


def remembered_titles(spark: SparkSession, changes: str) -> DataFrame:
    """The titles (``norm``) that are remembered now."""
    rows = spark.read.schema(CHANGES).parquet(changes)
    return rows.groupBy("norm").agg(F.sum("change").alias("left")).filter("left > 0").select("norm")
