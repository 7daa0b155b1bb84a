"""Which sources are due at a tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.constants import LANGUAGE_CYCLE, SOURCES_PER_TICK, TICK_MINUTES
from gazette.sources.dimensions import languages, sources


def tick_of(ts: Column) -> Column:
    """Number of the quarter hour a UTC timestamp falls into, counted from 1970."""
    per_day = 24 * 60 // TICK_MINUTES
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    return (day * per_day + F.floor((F.hour(ts) * 60 + F.minute(ts)) / TICK_MINUTES)).cast("long")


def tick_start(tick: Column) -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), (tick * TICK_MINUTES).cast("int")
    )


def rotation_assign(ticks: DataFrame, turn: str = "turn", count: int = SOURCES_PER_TICK) -> DataFrame:
    """The sources due at each turn (0, 1, 2, ... since the start).

    Languages take turns; a language's own turns go on through its sources, ``count`` at a time, from the end back
    to the start.
    """
    spark = ticks.sparkSession
    cycle = len(LANGUAGE_CYCLE)
    # Both dimensions are configuration of a few rows.
    langs = F.broadcast(languages(spark).withColumnRenamed("turn", "_turn"))
    placed = (
        ticks.withColumn("_turn", F.pmod(F.col(turn), F.lit(cycle)).cast("int"))
        .join(langs, "_turn")
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        .withColumn("position", F.pmod(F.floor(F.col(turn) / cycle) * count + F.col("slot"), F.col("n_sources")).cast("int"))
    )
    dim = F.broadcast(sources(spark).select("language", "position", "source_name", "rss_url", "url_patterns"))
    return placed.join(dim, ["language", "position"]).drop("_turn", "n_sources")
