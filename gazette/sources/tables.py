"""Stored tables as Parquet folders with fixed schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette import schemas
from gazette.constants import DEFAULT_LANGUAGE

SCHEMAS = {
    "articles": schemas.ARTICLES,
    "users": schemas.USERS,
    "seen_articles": schemas.SEEN,
    "refresh_sessions": schemas.SESSIONS,
}


def table_scan(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table. Files written before articles had a language count as the default language."""
    rows = spark.read.schema(_with_partition(table)).parquet(path)
    if table == "articles":
        rows = rows.withColumn("language", F.coalesce("language", F.lit(DEFAULT_LANGUAGE)))
    return rows


def _with_partition(table: str) -> T.StructType:
    schema = SCHEMAS[table]
    return T.StructType([*schema.fields, T.StructField("created_date", T.DateType())]) if table == "articles" else schema


def append_articles(rows: DataFrame, path: str) -> None:
    """Append articles in folders per creation day, which the look-back and the newest-first queries can skip by."""
    days = rows.withColumn("created_date", F.to_date("created_at"))
    days.write.mode("append").partitionBy("created_date").parquet(path)


def drop_folders(spark: SparkSession, path: str, column: str, gone: Callable[[str], bool]) -> None:
    """Delete the folders ``column=value`` of a stored table whose value is ``gone``; rows without a value stay."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder) if files.exists(folder) else ():
        name, _, value = status.getPath().getName().partition("=")
        if name == column and value != "__HIVE_DEFAULT_PARTITION__" and gone(value):
            files.delete(status.getPath(), True)
