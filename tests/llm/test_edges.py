"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gazette.llm import decontaminate, lang_id, lm_score, neighbours, pieces, pii, secrets, simhash, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that operators use themselves.
CLASH = ["rank", "score", "fp", "_id", "root", "row", "more", "spans", "kind", "part", "chunk", "lang_pred", "_row", "n_pieces", "_text"]

LONG = " ".join(f"word{i % 977} the of{i % 13}" for i in range(60_000))
ROWS = [
    (1, "The cat sat on the mat and the dog ran. token = \"abcdefgh12345678\"", "en", "a"),
    (2, "The cat sat on the mat and the dog ran. token = \"abcdefgh12345678\"", "en", "a"),
    (2, "The cat sat on the mat and the dog ran. token = \"abcdefgh12345678\"", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "a"),
    (5, " \n\t ", "fr", "a"),
    (None, "Le chat est sur la table et le chien court, jo@example.com ou +1 (555) 555-1234.", "fr", "b"),
    (None, "Le chat est sur la table et le chien court, jo@example.com ou +1 (555) 555-1234.", "fr", "b"),
    (6, "12345 67890 !!! 🙂 中文 \x1c  ", None, "b"),
    (7, LONG, "en", "c"),
    (8, "x" * 300_000, None, "c"),
    (-9, "Der Hund und die Katze sind in dem Haus 10.0.0.1.", "de", "c"),
    (1 << 60, "Der Hund", "de", "c"),
]


def docs(spark, rows=ROWS, extra=False):
    frame = spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows], SCHEMA)
    if extra:
        for c in CLASH:
            frame = frame.withColumn(c, F.lit("x"))
    return frame


def labels(spark, rows=((1, 0), (2, 1), (2, 0), (None, 1), (7, None), (99, 1))):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def benchmark(spark, rows=((1, "the dog ran. token"), (1, "the dog ran. token"), (2, None), (3, ""), (None, "le chien court"))):
    return spark.createDataFrame(rows, "item_id long, text string")


OPERATORS = {
    "tokens": lambda s, d: tokens.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    "pieces": lambda s, d: pieces.encode(d, public_tokenizers.path("piece_bpe_32k.model")),
    "language": lambda s, d: lang_id.identify(d, F.col("doc_id") > 0),
    "secrets": lambda s, d: secrets.scan_secrets(d),
    "lm": lambda s, d: lm_score.score_documents(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "pii": lambda s, d: pii.personal_data(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels(s)),
    "leaks": lambda s, d: decontaminate.benchmark_hits(d, benchmark(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row_whatever_it_holds(spark, name):
    plain = OPERATORS[name](spark, docs(spark))
    got = sorted(str(r["doc_id"]) for r in plain.select("doc_id").collect())
    assert got == sorted(str(r[0]) for r in ROWS)
    assert OPERATORS[name](spark, docs(spark, extra=True)).count() == len(ROWS)
    empty = OPERATORS[name](spark, docs(spark, []))
    assert empty.count() == 0 and empty.columns == plain.columns


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_the_columns(spark, tmp_path, name, stage):
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for extra in (False, True):
        for rows in (ROWS, []):
            frame = docs(spark, rows, extra)
            out = stage(spark, frame, str(tmp_path))
            assert set(frame.columns) <= set(out.columns)
            assert out.count() <= len(rows)
            if name != "piece_ids":
                assert out.schema == frame.schema or out.columns == frame.columns


def test_what_the_stages_decide(spark, tmp_path):
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    assert not {3, 4, 5} & set(ids(stages["language_id"](spark, docs(spark), str(tmp_path))))
    once = ids(stages["near_duplicates"](spark, docs(spark), str(tmp_path)))
    assert once == sorted([1, 3, None, 6, 7, 8, -9, 1 << 60], key=str)  # 3, 4 and 5 have no word
    clean = ids(stages["benchmark_leaks"](spark, docs(spark), str(tmp_path)))
    assert 1 not in clean and 2 not in clean and None not in clean and {3, 4, 5, 6, 7, 8, -9} <= set(clean)
    masked = {r["doc_id"]: r["text"] for r in stages["personal_data"](spark, docs(spark), str(tmp_path)).collect()}
    assert masked[None] == "Le chat est sur la table et le chien court, <EMAIL> ou <PHONE>." and masked[3] is None
    assert masked[-9] == "Der Hund und die Katze sind in dem Haus <IP>."


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]),
            (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (10, [1.0]), (11, []), (3, [1.0, 1.0]), (40, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = neighbours.nearest(frame, F.col("vec_id") % 20 == 0, k=2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 3, 1.0), (0, 2, 4, 1.0), (20, 1, 3, 2.0), (20, 2, 4, 2.0)]
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    alone = neighbours.nearest(frame.filter("vec_id = 0"), F.col("vec_id") % 20 == 0)
    assert alone.count() == 0


def test_a_repeated_neighbour_takes_one_place(spark):
    rows = [(0, [1.0, 0.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [0.9, 1.0]), (5, [0.8, 1.0]), *[(3, [1.0, 1.0 + i]) for i in range(30)]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, F.col("vec_id") == 0, k=2).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 3, 1.0), (0, 2, 4, 0.9)]
    got = neighbours.nearest(frame.union(frame), F.col("vec_id") == 0, k=20).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [3, 4, 5]


def test_labelled_sample_of_repeated_ids(spark):
    """One id on all rows brings them all along; the second draw is by row."""
    documents = spark.range(4_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 2_000).alias("text"))
    labels = spark.createDataFrame([(7, 1)], "doc_id long, toxic int")
    rows = toxicity.labelled_sample(documents, labels, 500)
    assert 400 < rows.count() < 600 and rows.count() == rows.distinct().count()
    assert toxicity.labelled_sample(documents.limit(300), labels, 500).count() == 300
    assert toxicity.labelled_sample(documents.limit(0), labels, 500).count() == 0


def test_without_labels_or_benchmark(spark):
    none = toxicity.score_toxicity(docs(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.count() == len(ROWS) and none.agg(F.max("score"), F.max("predicted")).first()[1] == 0
    hits = decontaminate.benchmark_hits(docs(spark), benchmark(spark).limit(0))
    assert hits.columns == decontaminate.benchmark_hits(docs(spark), benchmark(spark)).columns
    assert decontaminate.drop_contaminated(docs(spark), benchmark(spark).limit(0)).count() == len(ROWS)
