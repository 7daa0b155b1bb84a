"""Helpers that the operators of this package share."""

from __future__ import annotations

import gc
import sys
import time
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.session import scratch_path

KEY = ["doc_id", "_digest", "_chars"]


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that go to a Python worker at once. Whole texts are long; Spark's default of 10,000 is for narrow rows.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Has the session send rows to Python workers in batches that whole texts allow; a smaller setting stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: no lineage, columns prunable, size known."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of queries that have ended; else they stay until the driver happens to collect garbage."""
    for _ in range(2):  # what Python lets go of is garbage to the driver's JVM only then
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def file_bytes(path: str) -> bytes:
    """A vocabulary file as the driver sees it; executors get it as a broadcast, not by its path."""
    with open(path, "rb") as f:
        return f.read()


def worker_state() -> dict:
    """A dictionary that outlives a task inside one Python worker, for caches that are costly to fill."""
    return sys.modules.setdefault("gazette_worker_state", types.ModuleType("gazette_worker_state")).__dict__


def once(name: str, make: Callable):
    """``make()`` at the first call in a Python worker, its result at each later one."""
    state = worker_state()
    if name not in state:
        state[name] = make()
    return state[name]


def row_key(text: Column) -> list[Column]:
    """What tells a row from others, repeated and null doc_ids included: equal keys mean equal results.

    doc_id stays as it is; joins on the key compare nulls as equal.
    """
    return [F.xxhash64(text).alias(KEY[1]), F.length(text).alias(KEY[2])]


def join_on_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left outer join on the row key, where null equals null; the key of the right side is dropped."""
    right = right.withColumnsRenamed({k: f"_right{k}" for k in KEY})
    on = [left[k].eqNullSafe(right[f"_right{k}"]) for k in KEY]
    return left.join(right, on, "left").drop(*[f"_right{k}" for k in KEY])


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of doc_id as text falls in the fold; a null doc_id is held out, so nothing is learned from it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(True))


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
