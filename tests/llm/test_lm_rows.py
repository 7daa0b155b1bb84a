"""Scores from rows dealt by the middle word: against joins, however words are coded and rows are dealt; and how many rows there are."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from gazette.llm import lm_score


def some_texts() -> list[str | None]:
    rng = random.Random(5)
    word = lambda: f"w{int(rng.paretovariate(0.6))}" if rng.random() < 0.95 else f"only{rng.randrange(10**9)}"
    drawn = [" ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 5, 20, 60]))) for _ in range(80)]
    return [*drawn, *drawn[3:6], None, "", "the of the of the of", "the of the of the of", "Ünï 🙂 a\x1cb　c", "ünï 🙂 a b c"]


@pytest.mark.parametrize("order,without_self,size,rows,hot", [
    (1, True, 20, 10**6, 30), (2, True, 0, 10**6, 5), (3, True, 20, 300, 30), (3, False, 0, 10**6, 5),
])
def test_dealing_changes_no_score(spark, order, without_self, size, rows, hot):
    documents = spark.createDataFrame([(i // 2 if i % 7 else None, t) for i, t in enumerate(some_texts())], "doc_id long, text string").repartition(3)
    key = lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_backoff"], r["log_score"])
    want = sorted(map(key, lm_score.by_joins(documents, order, 0.4, without_self).collect()))
    got = sorted(map(key, lm_score.score_documents(documents, order=order, leave_one_out=without_self, size=size, rows=rows, hot=hot).collect()))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9, abs_tol=1e-9)


def test_a_word_is_one_row_in_one_round():
    """All n-grams that end, start or lie at a word travel with it; there is no row for each of them."""
    texts = [t or "" for t in some_texts()]
    batch = pa.RecordBatch.from_pydict({"row": list(range(len(texts))), "doc_id": [None] * len(texts), "text": texts})
    found = [b.to_pydict() for b in lm_score.counted_words(iter([batch]))]
    several = [(w, n) for b in found for w, n, d in zip(b["word"], b["n"], b["docs"], strict=True) if d > 1]
    words = lm_score.Words(*(np.array(c, np.int64) for c in zip(*sorted(several), strict=True)), None)
    coded = list(lm_score.coded(iter([batch]), words, 3, 0.4, True))
    rounds = [sum(b.num_rows for b in lm_score.rows_of(iter(coded), words, 3, 10**6, turn, 3)) for turn in range(3)]
    assert all(rounds) and sum(rounds) <= sum(len(t.split()) for t in texts)


def test_hashes_of_words_are_those_of_split():
    texts = [(t or "").lower() for t in [*some_texts(), " lead", "trail ", "\x85a\xa0b c​d"]]
    hashes, sizes = lm_score.hashed(texts)
    words = [w for t in texts for w in t.split()]
    assert list(sizes) == [len(t.split()) for t in texts]
    assert len(set(hashes.tolist())) == len(set(words)) == len(set(zip(hashes.tolist(), words, strict=True)))


def test_texts_without_any_word(spark):
    got = lm_score.score_documents(spark.createDataFrame([(1, ""), (None, None), (2, " \n")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["log_score"], r["perplexity"]) for r in got) == [(i, 0, 0.0, None) for i in range(3)]
