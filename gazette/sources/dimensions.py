"""Fixed dimension tables: categories and news sources. Both have a few rows, whatever the data size."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette import constants, schemas


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(constants.CATEGORIES, start=1)), schemas.CATEGORIES)


def sources(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Source rows (language, key, source_name, base_url, rss_url, url_patterns) with the 0-based place per language."""
    rows = constants.SOURCES if rows is None else rows
    place: dict[str, int] = {}
    out = []
    for language, key, name, base_url, rss_url, patterns in rows:
        out.append((language, place.get(language, 0), key, name, base_url, rss_url, list(patterns)))
        place[language] = place.get(language, 0) + 1
    return spark.createDataFrame(out, schemas.SOURCES)


def languages(spark: SparkSession) -> DataFrame:
    """Languages by turn, with their number of sources."""
    counts = {lang: sum(s[0] == lang for s in constants.SOURCES) for lang in constants.LANGUAGE_CYCLE}
    rows = [(turn, lang, counts[lang]) for turn, lang in enumerate(constants.LANGUAGE_CYCLE)]
    return spark.createDataFrame(rows, "turn int, language string, n_sources int")


def usable_pattern(pattern: str) -> str:
    """A pattern that is no valid regular expression becomes a literal one."""
    try:
        re.compile(pattern)
    except re.error:
        return "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in pattern)
    return pattern


def with_usable_patterns(spark: SparkSession, source_rows: list[tuple]) -> DataFrame:
    """``sources`` whose invalid patterns were replaced, for ``feed_url_filter``."""
    return sources(spark, [(*r[:5], [usable_pattern(p) for p in r[5]]) for r in source_rows])
