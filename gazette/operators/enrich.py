"""Summaries by a model: batches to a callable, and its answers merged back into article rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.constants import DEFAULT_CATEGORY, DEFAULT_LANGUAGE, MODEL_BATCH_SIZE, NO_SUMMARY, UNTITLED
from gazette.functions.answers import (
    clean_json_fence,
    parse_answers,
    prompt_for_language,
    provider_for_language,
)
from gazette.functions.dates import iso_text
from gazette.functions.text import author_line, empty_to_null, strip
from gazette.operators.ranking import first_per_group, ordered_index
from gazette.session import cut_lineage, text_batches

Ask = Callable[[str, str, str], str]
LEDGER = "key string, response string, error string"


def batch_of_5(
    rows: DataFrame, group: list[str] | None = None, order: str = "pos", size: int = MODEL_BATCH_SIZE
) -> DataFrame:
    """Add ``batch_no`` (from 0): the rows of each group, in order, in batches of ``size``."""
    numbered = ordered_index(rows, [F.col(order)], group, name="_place")
    return numbered.withColumn("batch_no", F.floor((F.col("_place") - 1) / size)).drop("_place")


def batch_requests(batched: DataFrame, retry: bool = False) -> DataFrame:
    """One row per batch: instruction, provider and the JSON list of its articles."""
    article = F.struct(
        "pos", "original_title", "original_content", "image_url", "url", "source_name", "authors",
        iso_text(F.col("publish_date")).alias("publish_date"),
    )
    # A batch has at most MODEL_BATCH_SIZE rows.
    lists = batched.groupBy("language", "batch_no").agg(F.sort_array(F.collect_list(article)).alias("_rows"))
    return lists.select(
        "language",
        "batch_no",
        prompt_for_language(F.col("language"), retry).alias("instruction"),
        provider_for_language(F.col("language")).alias("provider"),
        F.to_json(F.transform("_rows", lambda r: r.dropFields("pos"))).alias("request"),
    )


def enrich_batches(requests: DataFrame, ask: Ask, concurrency: int | None = None) -> DataFrame:
    """Send each request to ``ask(provider, instruction, request)`` inside the tasks.

    Gives (language, batch_no, response, error). A call that raises leaves a null response and its message, and the
    other batches go on. Calls run in ``concurrency`` partitions, by default as many as a shuffle has.
    """
    return _asked(requests, ["language", "batch_no"], ask, concurrency)


def _asked(requests: DataFrame, keys: list[str], ask: Ask, concurrency: int | None) -> DataFrame:
    """(keys, response, error) of the calls for requests that ``keys`` tell apart."""
    text_batches(requests.sparkSession)  # a request holds the whole texts of its articles
    calls = concurrency or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            responses, errors = [], []
            for row in frame.itertuples(index=False):
                try:
                    responses.append(ask(row.provider, row.instruction, row.request))
                    errors.append(None)
                except Exception as problem:  # noqa: BLE001 - any failure of the callable is a failed batch
                    responses.append(None)
                    errors.append(f"{type(problem).__name__}: {problem}")
            yield frame[keys].assign(response=responses, error=errors)

    schema = T.StructType([*[requests.schema[k] for k in keys], *[T.StructField(n, T.StringType()) for n in ("response", "error")]])
    return requests.repartition(calls, *keys).mapInPandas(call, schema)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(key, response, error) of all calls noted at ``path``; none if there is no such table yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def enrich_with_ledger(requests: DataFrame, ask: Ask, path: str, waves: int = 1, concurrency: int | None = None) -> DataFrame:
    """``enrich_batches`` that notes every call in a table and asks nothing that has an answer there.

    A request is known by the hash of its provider, instruction and text, so a repeated run, a run after a failure and
    equal requests of one run are answered from the table. Each of ``waves`` is a job of its own whose answers are there for
    good once it ends: what a lost driver costs is at most one wave, what a lost task costs its requests of one wave. Calls
    that raised are noted with their message and asked again by the next run.
    """
    spark = requests.sparkSession
    key = F.sha2(F.to_json(F.struct("provider", "instruction", "request"), {"ignoreNullFields": "false"}), 256)
    keyed = cut_lineage(requests.withColumn("key", key))
    for wave in range(waves):
        part = keyed.filter(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave).dropDuplicates(["key"])
        known = read_ledger(spark, path).filter(F.col("error").isNull()).select("key")
        _asked(part.join(known, "key", "left_anti"), ["key"], ask, concurrency).write.mode("append").parquet(path)
    # An answer goes before the failures of earlier runs; a key may be noted twice if two runs met.
    noted = read_ledger(spark, path).groupBy("key").agg(
        F.min(F.when(F.col("error").isNull(), F.struct("response"))).alias("_answer"), F.max("error").alias("_error"))
    return keyed.select("key", "language", "batch_no").join(noted, "key", "left").select(
        "language", "batch_no", F.col("_answer.response").alias("response"), F.when(F.col("_answer").isNull(), F.col("_error")).alias("error"))


def answer_retry_set(responses: DataFrame) -> DataFrame:
    """Batches that came back without any text: they are asked once more with a stricter instruction."""
    return responses.filter(F.col("error").isNull() & (clean_json_fence(F.coalesce("response", F.lit(""))) == ""))


def ask_with_retry(batched: DataFrame, ask: Ask, ledger: str | None = None) -> DataFrame:
    """Responses of all batches; empty ones are replaced by the answer to the stricter instruction.

    With a ``ledger`` the calls go through ``enrich_with_ledger``.
    """
    def asked(requests: DataFrame) -> DataFrame:
        return enrich_with_ledger(requests, ask, ledger) if ledger else enrich_batches(requests, ask)

    # The calls are the costly part, so their results are kept before they are read twice.
    first = cut_lineage(asked(batch_requests(batched)))
    again = answer_retry_set(first).select("language", "batch_no")
    stricter = batch_requests(batched.join(again, ["language", "batch_no"], "left_semi"), retry=True)
    second = cut_lineage(asked(stricter))
    return first.join(again, ["language", "batch_no"], "left_anti").unionByName(second)


def answers_of(responses: DataFrame) -> DataFrame:
    """(language, batch_no, batch_status, pos_in_answer, answer fields), one row per answer item.

    ``batch_status`` is ok, or failed when the call failed or the text holds no answer list; a failed batch, and an
    empty list, give one row with null answer fields.
    """
    parsed = responses.withColumn("_answers", parse_answers(F.col("response")))
    status = F.when(F.col("_answers").isNull(), F.lit("failed")).otherwise(F.lit("ok"))
    return parsed.select(
        "language", "batch_no", status.alias("batch_status"), F.posexplode_outer("_answers").alias("answer_pos", "_a")
    ).select("language", "batch_no", "batch_status", "answer_pos", "_a.*")


def first_answer(answers: DataFrame) -> DataFrame:
    """The first answer per batch and URL."""
    named = answers.filter(F.col("source_url").isNotNull())
    return first_per_group(named, ["language", "batch_no", "source_url"], [F.col("answer_pos")])


def missing_answers(batched: DataFrame, answers: DataFrame) -> DataFrame:
    """URLs of a batch that its answers leave out."""
    answered = answers.select("language", "batch_no", F.col("source_url").alias("url")).distinct()
    return (
        batched.select("language", "batch_no", "url").distinct()
        .join(answered, ["language", "batch_no", "url"], "left_anti")
    )


def answer_fallback(batched: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows of batches that failed as a whole."""
    good = answers.filter(F.col("batch_status") == "ok").select("language", "batch_no").distinct()
    return batched.join(good, ["language", "batch_no"], "left_anti").select(*batched.columns)


def fallback_title(title: Column) -> Column:
    return F.coalesce(F.nullif(strip(title), F.lit("")), F.lit(UNTITLED))


def fallback_content(content: Column) -> Column:
    return F.coalesce(F.nullif(strip(content), F.lit("")), F.lit(NO_SUMMARY))


def _article_id(url: Column) -> Column:
    return F.sha2(url, 256)


def _fallback_columns(as_of: Column, language: Column) -> dict[str, Column]:
    """The columns of an article that has no model answer, out of a scraped row."""
    return {
        "id": _article_id(F.col("url")),
        "source_name": F.col("source_name"),
        "source_url": F.col("url"),
        "title": fallback_title(F.col("original_title")),
        "author": author_line(F.col("authors")),
        "image_url": empty_to_null(F.col("image_url")),
        "content": fallback_content(F.col("original_content")),
        "category": F.lit(DEFAULT_CATEGORY),
        "language": language,
        "published_at": F.col("publish_date"),
        "created_at": as_of,
    }


def fallback_article(rows: DataFrame, as_of: Column, language: Column | None = None) -> DataFrame:
    """Scraped rows as article rows without a model answer."""
    language = F.coalesce(F.col("language"), F.lit(DEFAULT_LANGUAGE)) if language is None else language
    return rows.select(*[c.alias(name) for name, c in _fallback_columns(as_of, language).items()], "pos")


def summary_merge(batched: DataFrame, answers: DataFrame, as_of: Column) -> DataFrame:
    """Article rows of all batches: model texts where there are any, the scraped ones otherwise.

    ``answered`` tells whether the row had an answer and ``out_pos`` gives the insertion order: per batch the
    answered rows come first, then the fallbacks.
    """
    best = first_answer(answers).select(
        "language", "batch_no", F.col("source_url").alias("url"),
        F.col("title").alias("a_title"), F.col("content").alias("a_content"), F.col("category").alias("a_category"),
        F.lit(True).alias("_answered"),
    )
    joined = batched.join(best, ["language", "batch_no", "url"], "left")
    has = F.coalesce("_answered", F.lit(False))

    columns = _fallback_columns(as_of, F.col("language"))
    for name in ("title", "content"):
        answer = F.coalesce(empty_to_null(F.col(f"a_{name}")), F.col(f"original_{name}"), F.lit(""))
        columns[name] = F.when(has, answer).otherwise(columns[name])
    columns["category"] = F.when(has, F.coalesce("a_category", columns["category"])).otherwise(columns["category"])
    return joined.select(
        *[c.alias(name) for name, c in columns.items()], "batch_no", has.alias("answered"), "pos",
    ).withColumn("out_pos", F.struct("batch_no", (~F.col("answered")).alias("fallback"), "pos"))
