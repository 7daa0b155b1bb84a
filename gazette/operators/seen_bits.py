"""Seen articles as bitmaps: one bit per article place, in buckets of 32,768 places per user.

``places`` numbers the articles by their arrival, so the newest has the highest place. The stored form of what users have
seen is (user_auth_id, bucket, bits); a run appends the bits of its own pairs and reads nothing back, as bits set twice are
the same. A page of unseen articles comes from the highest zero bits of the few buckets that it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gazette.constants import DEFAULT_LIMIT
from gazette.operators.ranking import ordered_index
from gazette.operators.serving import check_page
from gazette.operators.skew import skew_join
from gazette.session import written

BUCKET, WORD = 32_768, 64
#: Bytes of bitmaps, as they are in memory, that one task sorts. Nearly empty ones are stored and shuffled in far fewer
#: bytes, so their number says how many tasks they need, and not their stored size.
TASK_BYTES = 32 << 20
BITS = T.StructType([
    T.StructField("user_auth_id", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("bits", T.BinaryType()),
])


def append_places(articles: DataFrame, path: str, first: bool = False) -> None:
    """Give the articles of a run their places (place, id, created_at), after those at ``path``.

    Runs follow each other in time: an article as old as a stored one is refused, as its place would contradict the order.
    """
    spark = articles.sparkSession
    rows = ordered_index(articles.select("id", "created_at"), [F.asc("created_at"), F.desc("id")], name="place")
    if not first:
        last = spark.read.parquet(path).agg(F.max("place").alias("place"), F.max("created_at").alias("at")).first()
        oldest = rows.agg(F.min("created_at")).first()[0]
        if None not in (oldest, last["at"]) and oldest <= last["at"]:
            raise ValueError(f"an article of {oldest} cannot follow one of {last['at']}")
        rows = rows.withColumn("place", F.col("place") + (last["place"] or 0))
    rows.select("place", "id", "created_at").write.mode("append").parquet(path)


def seen_bits(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """(user_auth_id, bucket, bits) of pairs (user_auth_id, article_id); pairs without an article leave no bit.

    Pairs count once before they meet by user and bucket, so a user with a third of all pairs brings at most 32,768 places
    into one task. Places are shuffled and sorted, bitmaps are not.
    """
    found = skew_join(pairs.select("user_auth_id", F.col("article_id").alias("id")), places.select("id", "place"), "id")
    found = found.select("user_auth_id", F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("at")).distinct()
    return found.repartition("user_auth_id", "bucket").groupBy("user_auth_id", "bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def append_seen_bits(pairs: DataFrame, places: DataFrame, path: str) -> None:
    """Append the bits of a run or micro-batch. The stored ones are not read; repeating a run changes no page."""
    seen_bits(pairs, places).write.mode("append").parquet(path)


def seen_bits_stream(events: DataFrame, places: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append the bits of (user_auth_id, article_id) events as they come. Articles have their place before they are shown.

    There is no state, and a micro-batch that is repeated after a failure sets the same bits again.
    """
    spark = events.sparkSession
    return (
        events.writeStream.foreachBatch(lambda batch, _: append_seen_bits(batch, spark.read.parquet(places), path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def seen_counts(bits: DataFrame) -> DataFrame:
    """(user_auth_id, n_seen): the distinct articles that each user has seen, by the bits."""
    return merged_bits(bits).groupBy("user_auth_id").agg(F.sum(F.bitmap_count("bits")).alias("n_seen"))


def merged_bits(bits: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """One bitmap per user and bucket, of all users or those in ``users`` (user_auth_id); written elsewhere, it is the
    compacted table. A task sorts about TASK_BYTES of bitmaps; a user's bitmaps meet in one task, bucket by bucket."""
    tasks = -(-bits.count() * BUCKET // 8 // TASK_BYTES) or 1
    spread = bits.repartition(tasks, "user_auth_id")
    if users is not None:
        spread = spread.join(users.hint("shuffle_hash"), "user_auth_id", "left_semi")  # no sort of the bitmaps by the user
    return spread.groupBy("user_auth_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def stored_bits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BITS).parquet(path)


def _free(bits: Column, size: Column, most: int) -> Column:
    """The highest positions below ``size`` whose bit is zero, descending: at least ``most``, if there are so many."""
    top = F.filter(F.sequence(size - 1, F.greatest(size - most, F.lit(0))), lambda p: p >= 0)
    # A word is eight bytes, read from the left; in a byte, the lowest bit comes first.
    word = lambda w: F.conv(F.hex(F.substring(bits, w * 8 + 1, F.lit(8))), 16, -10).cast("long")
    words = F.transform(F.sequence(F.floor((size - 1) / WORD).cast("int"), F.lit(0)), lambda w: F.struct(w.alias("at"), word(w).alias("word")))
    partly = F.slice(F.filter(words, lambda x: x["word"] != -1), 1, most + 1)
    shift = lambda o: 56 - 8 * F.floor(o / 8).cast("int") + o % 8
    zeros = F.flatten(F.transform(partly, lambda x: F.transform(
        F.filter(F.sequence(F.lit(WORD - 1), F.lit(0)), lambda o: F.getbit(x["word"], shift(o)) == 0), lambda o: x["at"] * WORD + o)))
    return F.when(bits.isNull(), top).otherwise(F.filter(zeros, lambda p: p < size))


def unseen_by_bits(places: DataFrame, bits: DataFrame, users: DataFrame, articles: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The newest unseen articles of every user: (auth_id, position, id, created_at), as ``unseen_all_users`` without filters.

    ``articles`` says which articles still exist. The places of others between the oldest and the newest one that exists are
    passed over; if there are more than a bucket holds, the places have to be numbered anew.
    """
    check_page(limit)
    alive = written(places.join(articles.select("id"), "id", "left_semi"), "places")
    total, first, n = alive.agg(F.max("place"), F.min("place"), F.count("*")).first()
    most = limit + (total - first + 1 - n if n else 0)
    if most > BUCKET:
        raise ValueError("too many places without an article: number the places anew")
    last = (total - 1) // BUCKET + 1 if n else 0
    wanted = users.select(F.col("auth_id").alias("user_auth_id")).distinct()
    have = merged_bits(bits.filter(F.col("bucket") <= last), wanted)
    have = written(have.withColumn("n", F.bitmap_count("bits")), "bits")
    # Below a bucket with bits there may be one without any. Such a one has enough zeros to end the walk, so that
    # the ones below the newest two and below each stored one are all that a page can need.
    newest = F.array(*[F.lit(b).cast("long") for b in range(max(last - 1, 1), last + 1)]).cast("array<bigint>")
    pads = wanted.withColumn("bucket", F.explode(newest)).unionByName(have.select("user_auth_id", (F.col("bucket") - 1).alias("bucket")).filter("bucket > 0"))
    # The walk knows buckets by their counts; only the bitmaps of those that a page needs are taken from the table.
    rows = have.select("user_auth_id", "bucket", "n").unionByName(pads.withColumn("n", F.lit(None).cast("long")))
    rows = rows.groupBy("user_auth_id", "bucket").agg(F.max("n").alias("n"))
    size = F.least(F.lit(BUCKET), F.lit(total or 0) - (F.col("bucket") - 1) * BUCKET).cast("int")
    rows = rows.withColumn("size", size).withColumn("zeros", F.col("size") - F.coalesce("n", F.lit(0)))
    before = Window.partitionBy("user_auth_id").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    needed = rows.withColumn("before", F.coalesce(F.sum("zeros").over(before), F.lit(0))).filter((F.col("before") < most) & (F.col("zeros") > 0))
    needed = written(needed.select("user_auth_id", "bucket", "size", "n"), "needed")
    keys = ["user_auth_id", "bucket"]
    stored = have.select(*keys, "bits").join(needed.filter("n is not null").hint("shuffle_hash"), keys)
    without = needed.filter("n is null").withColumn("bits", F.lit(None).cast("binary"))
    free = F.slice(_free(F.col("bits"), F.col("size"), most), 1, most)
    place = F.explode(F.transform(free, lambda p: (F.col("bucket") - 1) * BUCKET + p + 1)).alias("place")
    shown = stored.select("user_auth_id", place).unionByName(without.select("user_auth_id", place))
    found = skew_join(written(shown, "shown"), alive, "place")
    page = Window.partitionBy("user_auth_id").orderBy(F.desc("place"))
    found = found.withColumn("position", F.row_number().over(page)).filter(F.col("position") <= limit)
    return found.select(F.col("user_auth_id").alias("auth_id"), "position", "id", "created_at")
