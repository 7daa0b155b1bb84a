"""Pairs of titles of two blocks against a plain comparison, and how many pairs and titles are left to be scored."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gazette.functions.near_titles import near_pairs
from gazette.functions.similarity import containment_ratio, lcs_length, token_set_ratio
from gazette.operators import dedupe

_RNG = random.Random(4)
WORDS = ["".join(_RNG.choice("abcdeinorst") for _ in range(_RNG.randint(1, 9))) for _ in range(200)]
WORDS += ["ভারত", "খবর", "ଓଡ଼ିଆ", "é", "the", "of", "\U0001F600x"]


def key(words):
    return " ".join(sorted(set(words)))


def changed(rng, title):
    words = title.split()
    for _ in range(rng.randint(0, 6)):
        i = rng.randrange(len(words))
        if rng.random() < 0.4:
            words[i] = rng.choice(WORDS)
        else:
            j = rng.randrange(len(words[i]))
            words[i] = words[i][:j] + rng.choice("abcde") + words[i][j + 1:]
    return key(words)


def titles(rng, n, low, high):
    found = []
    for _ in range(n):
        fresh = not found or rng.random() < 0.4
        found.append(key(rng.choice(WORDS) for _ in range(rng.randint(low, high))) if fresh else changed(rng, rng.choice(found)))
    return sorted(set(found), key=len)


def pairs(left, right, loss, **more):
    return {(i, j) for one, other in near_pairs(left, right, loss, **more) for i, j in zip(one.tolist(), other.tolist())}


@pytest.mark.parametrize("low, high, n", [(1, 8, 250), (8, 60, 120), (60, 200, 50)])
@pytest.mark.parametrize("loss", [0, 15, 33])
def test_no_pair_within_the_distance_is_lost(low, high, n, loss):
    rng = random.Random(low + loss)
    left, right = titles(rng, n, low, high), titles(rng, n, low, high)
    right = sorted({*right, *left[::3]}, key=len)
    got, near = pairs(left, right, loss), 0
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            x, y = set(a.split()) - set(b.split()), set(b.split()) - set(a.split())
            x, y = " ".join(sorted(x)), " ".join(sorted(y))
            # The difference of two token sets says nothing if it is empty on one side: that is containment.
            if x and y and (len(x) + len(y) - 2 * lcs_length(x, y)) * 100 <= (len(a) + len(b)) * loss:
                near += 1
                assert (i, j) in got
    assert near or not loss or high == 8


def test_long_titles_that_are_not_alike_are_not_left_to_the_score():
    rng = random.Random(9)
    made = ["".join(rng.choice("thonaneringedesat") for _ in range(rng.randint(3, 12))) for _ in range(5_000)]
    texts = sorted((key(rng.choice(made) for _ in range(45)) for _ in range(150)), key=len)
    assert min(map(len, texts)) > 250
    # Their character pairs alone would leave most of these pairs.
    assert not pairs(texts, texts, 15, wanted=lambda i, found: found[found > i])


def test_containment_ratio_is_the_score_of_contained_titles():
    rng = random.Random(2)
    few = ["a", "bb", "the", "of", "word", "longer", "thing"]
    for _ in range(500):
        a, b = (key(rng.choice(few) for _ in range(rng.randint(1, 6))) for _ in range(2))
        assert containment_ratio(a, b) <= token_set_ratio(a, b)
        assert (containment_ratio(a, b) == 100) == (token_set_ratio(a, b) == 100)
    assert containment_ratio("a b", "c d") == 0


def test_titles_with_a_stored_title_of_one_word_are_not_matched(spark, monkeypatch):
    matched, similar_ids = [], dedupe.similar_ids

    def counted(keys, threshold):
        matched.append(keys.filter("in_left").count())
        return similar_ids(keys, threshold)

    monkeypatch.setattr(dedupe, "similar_ids", counted)
    titles = [f"storm number {i} of the year" for i in range(40)] + ["bridge opened again", "more on bridges"]
    batch = spark.createDataFrame([(i, f"u{i}", t) for i, t in enumerate(titles)], "pos long, url string, original_title string")
    as_of = datetime(2024, 5, 1)
    stored = spark.createDataFrame([("s0", "Storm", as_of), ("s1", "bridge", as_of)], "source_url string, title string, created_at timestamp_ntz")
    got = {r.url for r in dedupe.dedupe_urls(batch, stored, F.lit(as_of).cast("timestamp_ntz")).collect()}
    assert got == {f"u{i}" for i in range(41)}
    assert matched[0] == 1


def test_blocks_hold_about_as_many_characters(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "LEAST_CHARS", 1_000)
    rows = [(i, True, 10) for i in range(200)] + [(200 + i, True, 500) for i in range(20)] + [(220, True, 9_000)]
    profiles = spark.createDataFrame(rows, "id long, in_left boolean, len int")
    blocks = dedupe._blocks(profiles, "in_left", "_a").groupBy("block_a").agg(F.count("*").alias("n"), F.sum("len").alias("chars")).collect()
    most = max(1_000, 21_000 // int((8 * dedupe._partitions(profiles)) ** 0.5) + 1)
    assert sum(r.n for r in blocks) == len(rows)
    assert all(r.chars <= most or r.n == 1 for r in blocks)


def test_titles_that_share_a_rare_word_only_are_no_candidates(spark):
    """Each title of the right side has the rarest word of the left one, and all but two lack most of its other words."""
    left = key("zeppelin over the old harbour this summer morning".split())
    right = [key(["zeppelin", *[f"word{i}x{j}" for j in range(8)]]) for i in range(200)]
    right += [key([*left.split(), "once", "more"]), key([*left.split()[1:], "zeppelin", "again"])]
    one, others = spark.createDataFrame([(left,)], "k string"), spark.createDataFrame([(t,) for t in right], "k string")
    keys = dedupe.two_sides(one, others)
    found = dedupe.containment_candidates(dedupe._profiles(keys, 85), 85).select("id_a", "id_b").distinct()
    assert 2 <= found.count() < 20
    assert {r.k_a if r.k_b == left else r.k_b for r in dedupe.similar_keys(keys).collect()} >= set(right[-2:])
