"""Stored URLs as hashes in hash-range parts with Bloom filters, so that a batch reads what its own URLs need.

The index of a table of articles is a folder with two tables, both in folders per part of the hash range:
``prints`` (print, created_date), sorted by print, and ``blooms`` (bucket, bits), Bloom filters of 32,768 bits. A URL belongs
to one bucket of one part and sets ``PROBES`` bits there. A batch reads the filters of its buckets; only URLs that pass are
looked up among the prints of their parts, and only what is found there is compared with the stored URLs, in the days
that the prints name. A URL that is stored always passes all three, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.operators.ingest import first_per_url, known_urls
from gazette.operators.search import in_days
from gazette.schemas import ARTICLE_COLS
from gazette.session import written

#: Folders of an index, Bloom filters in each, bits that a URL sets. With about 3,000 URLs a filter, one new URL in a
#: hundred passes; PARTS * BUCKETS * 3,000 is thus the number of URLs that the filters are meant for (3.2e9).
PARTS, BUCKETS, PROBES = 64, 16_384, 4
BITS = 32_768
PRINTS = T.StructType([T.StructField("print", T.LongType()), T.StructField("created_date", T.DateType()), T.StructField("part", T.IntegerType())])
BLOOMS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("bits", T.BinaryType()), T.StructField("part", T.IntegerType())])


def placed(prints: DataFrame) -> DataFrame:
    """Adds the part and the bucket that the upper bits of ``print`` name."""
    return prints.withColumns({
        "part": F.shiftrightunsigned("print", 58).cast("int"), "bucket": (F.shiftrightunsigned("print", 44) % BUCKETS).cast("int"),
    })


def probes(value: Column) -> list[Column]:
    """The places of a hash's bits in its filter, from the lower bits, which name neither part nor bucket."""
    first, step = value % BITS, F.shiftright(value, 15) % BITS
    return [F.pmod(first + i * step + i * i, F.lit(BITS)).cast("int") for i in range(PROBES)]


def append_url_index(articles: DataFrame, path: str) -> None:
    """Add the URLs of new articles, as of one run, to the index at ``path``; nothing of it is read, adding twice is harmless.

    Null URLs have no print.
    """
    new = articles.filter(F.col("source_url").isNotNull())
    new = new.select(F.xxhash64("source_url").alias("print"), F.to_date("created_at").alias("created_date")).distinct()
    _write(written(new, "prints"), path)


def _write(prints: DataFrame, path: str) -> None:
    rows = placed(prints)
    sorted_prints = rows.select("print", "created_date", "part").repartitionByRange("part", "print").sortWithinPartitions("part", "print")
    sorted_prints.write.mode("append").partitionBy("part").parquet(f"{path}/prints")
    bits = rows.select("part", "bucket", F.explode(F.array(*probes(F.col("print")))).alias("place"))
    blooms = bits.groupBy("part", "bucket").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits"))
    blooms = blooms.repartitionByRange("part", "bucket").sortWithinPartitions("part", "bucket")
    blooms.write.mode("append").partitionBy("part").parquet(f"{path}/blooms")


def compact_url_index(spark: SparkSession, path: str, to: str, since: str | None = None) -> None:
    """The index of many runs as one at a new path, without the days before the date ``since`` that retention has removed."""
    prints = _prints(spark, path).select("print", "created_date")
    _write(written((prints.filter(F.col("created_date") >= since) if since else prints).distinct(), "prints"), to)


def _prints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRINTS).parquet(f"{path}/prints")


def _in_parts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the parts in ``wanted``, at most PARTS numbers; the filter prunes folders."""
    return rows.filter(F.col("part").isin([r[0] for r in wanted.select("part").distinct().collect()]))


def passing(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (print, part, bucket, ...) whose bits are all set in the filters."""
    blooms = _in_parts(spark.read.schema(BLOOMS).parquet(f"{path}/blooms"), wanted)
    # Filters of several runs are merged for the buckets of the batch only.
    merged = blooms.join(wanted.select("part", "bucket").distinct(), ["part", "bucket"], "left_semi")
    merged = merged.groupBy("part", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    byte = lambda p: F.conv(F.hex(F.substring("bits", F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    test = F.lit(True)
    for place in probes(F.col("print")):
        test &= F.getbit(byte(place), place % 8) == 1
    return wanted.join(merged, ["part", "bucket"]).filter(test).drop("bits")


def known_urls_indexed(batch: DataFrame, articles: DataFrame, path: str, url: str = "url") -> DataFrame:
    """``known_urls`` over stored articles (in folders per ``created_date``) with their index at ``path``."""
    spark = batch.sparkSession
    urls = batch.select(F.col(url).alias("url")).filter(F.col("url").isNotNull()).distinct()
    wanted = written(placed(urls.withColumn("print", F.xxhash64("url"))), "wanted-urls")
    passed = written(passing(spark, path, wanted), "passed-urls")
    prints = _in_parts(_prints(spark, path), passed)
    hits = prints.join(passed.select("part", "print", "url"), ["part", "print"]).select("url", "created_date").distinct()
    hits = written(hits, "found-urls")
    return known_urls(hits.withColumnRenamed("url", url), in_days(articles, hits), url).distinct()


def ingest_insert_indexed(new_articles: DataFrame, articles: DataFrame, path: str, order: str = "pos") -> DataFrame:
    """``ingest_insert`` with the index of the stored URLs. What is then appended is added by ``append_url_index``."""
    first = first_per_url(new_articles, "source_url", order)
    known = known_urls_indexed(first, articles, path, "source_url")
    return first.join(known, "source_url", "left_anti").select(*ARTICLE_COLS, order)
