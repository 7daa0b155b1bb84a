"""A corpus in five stages: languages, near copies, benchmark leaks, personal data, piece ids.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept. All but the last return the
columns of documents. Between stages the rows are a Parquet table, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import decontaminate, lang_id, pieces, pii, simhash
from gazette.llm.common import held_out, load, small_batches, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without letters or far from every learned language."""
    small_batches(spark)
    return lang_id.keep_identified(docs, learn_from=~held_out(F.col("doc_id"), 5, 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies."""
    return simhash.first_of_each(docs, shingle=3, seed=42, distance=2)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; n_chars is that of the masked text."""
    masked = pii.mask_personal_data(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids of each text."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data), ("piece_ids", piece_ids),
]

#: The stages learn, link and match within edit budgets, which SQL does not express; the tests compare them with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table."""
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = stored(docs, name)
    return docs
