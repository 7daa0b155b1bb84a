"""Positions in an order, and first rows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.session import cut_lineage


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every group. Spark limits each group before the shuffle, so hot groups stay small."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def ordered_index(df: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "idx") -> DataFrame:
    """Add the 1-based position of each row in ``order``, over the table or per group.

    A window over the whole table or over a hot group would put it into one task. Instead the rows are range
    partitioned by group and order, numbered inside each range, and shifted by the sizes of the ranges before.
    The order must be total. The ranges are written to the checkpoint folder, so the numbering cannot change when
    a task runs again.
    """
    group = list(group or [])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(parts, *[F.col(g) for g in group], *order).withColumn("_range", F.spark_partition_id())
    )
    sizes = ranged.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per range and group: as many as there are partitions plus groups.
    offsets = sizes.select("_range", *group, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range", *group).orderBy(*order)
    keys = ["_range", *group]
    numbered = ranged.withColumn("_rn", F.row_number().over(inside))
    same = [numbered[k].eqNullSafe(offsets[k]) for k in keys]
    joined = numbered.join(offsets, same, "inner")
    return joined.select(
        *[numbered[c] for c in df.columns], (F.col("_rn") + F.col("_offset")).cast("long").alias(name)
    )
