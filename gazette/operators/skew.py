"""Equi-joins whose left side may hold a few very frequent keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 64
SALTS = 16


def hot_keys(df: DataFrame, key: str, limit: int = HOT_KEYS) -> DataFrame:
    """The ``limit`` most frequent keys: one row per key, so never more than ``limit`` rows.

    A key that is not among them holds at most 1 / (limit + 1) of the rows. Counting combines before it shuffles.
    """
    return df.groupBy(key).count().orderBy(F.desc("count"), key).limit(limit).select(key)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    spread: Column | None = None,
    condition: Column | None = None,
    salts: int = SALTS,
    partitions: int | None = None,
) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, the hot keys of ``left`` spread over ``salts`` partitions.

    Only the right rows of hot keys are repeated, once per salt; each left row meets exactly one copy, so every
    join type that keeps left rows (inner, left, left_semi, left_anti) gives the plain result. ``spread`` is the
    left expression that picks the salt and must be deterministic; the default hashes the whole row.
    ``condition`` is an extra join condition over the columns of both sides. ``partitions`` fixes the number of join
    partitions, for joins that compute much on few bytes and must not be merged into few tasks.
    """
    hot = F.broadcast(hot_keys(left.filter(F.col(key).isNotNull()), key).withColumn("_hot", F.lit(True)))
    spread = F.xxhash64(*left.columns) if spread is None else spread
    salted_left = left.join(hot, key, "left").withColumn(
        # Null keys match nothing, so they may go anywhere.
        "_salt", F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(spread, F.lit(salts)).cast("int")).otherwise(0)
    ).drop("_hot")
    salted_right = right.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    if partitions:
        salted_left = salted_left.repartition(partitions, key, "_salt")
        salted_right = salted_right.repartition(partitions, key, "_salt")
    if condition is None:
        return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")
    renamed = salted_right.withColumnRenamed(key, "_rkey").withColumnRenamed("_salt", "_rsalt")
    on = (F.col(key) == F.col("_rkey")) & (F.col("_salt") == F.col("_rsalt")) & condition
    return salted_left.join(renamed, on, how).drop("_salt", "_rkey", "_rsalt")
