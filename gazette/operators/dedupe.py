"""Duplicate removal by URL and by fuzzy title.

A batch is walked in order: a row whose title is similar (token-set ratio at least the threshold) to a recently
stored title, or to the title of an earlier row that was accepted, makes its URL a duplicate. The walk is expressed
as joins over distinct titles and a few rounds of aggregation.

Similar pairs are found without comparing everything with everything. Titles are first reduced to their distinct
token sets (equal sets score 100 and behave alike against all others), so copies cost nothing however many there
are. With W(t) = length of the joined tokens + 1 as the weight of a token set, and the threshold r in percent:

* containment: a score r reached by the containment ratio of A means that the tokens of A that are missing in B
  weigh less than (100 - r) * 2 / (200 - r) of A (6/23 for 85). Any tokens of A whose weight adds up to that share
  must include one that B has. So A is looked up by its rarest such tokens only.
* indel: a score r means at most d = (100 - r)% of the added lengths edits. An edit changes at most three of the
  character pairs of the blank-padded titles. So the counts of their pairs differ by 3d at most, and their lengths by d:
  titles are sorted by length, and the counts are compared block by block within the lengths that are near enough.

Both are exact bounds: no candidate is lost and none is capped. A pair by containment is emitted only when the lengths
and one bit per token, set for hashes, allow the score; the score itself decides afterwards. Pairs by edits are scored in the
task that found them, after a second bound (``functions/near_titles.py``), so only similar ones leave it.

A large group of near copies would still be all pairs of that group. So each title is first compared with the few
earliest titles of its hash buckets. A title that has a similar earlier one there is held back: it is not matched
with everything, only with the titles that are not held back. As soon as one of those is accepted, the copies
similar to it are duplicates and gone. Buckets only decide who is held back; titles that stay undecided go through
the next pass, so the result does not depend on them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.constants import TITLE_LOOKBACK_HOURS, TITLE_THRESHOLD
from gazette.functions.near_titles import near_pairs
from gazette.functions.similarity import containment_score_from, token_set_ratio, token_set_score_from
from gazette.functions.text import normalize_title
from gazette.operators.ingest import batch_minus_duplicates, first_per_url, known_urls
from gazette.operators.ranking import first_per_group, ordered_index
from gazette.operators.skew import skew_join
from gazette.session import cut_lineage, text_batches, written

# Elements beyond the most frequent ones count as equally rare; any total order of elements is correct.
RANKED_ELEMENTS = 10_000
# Character classes of the signature: Latin letters by frequency, digits and blanks, each together with a letter that
# takes the same place in the Bengali and the Odia block. All other characters are the last class.
_LATIN = [*"eatoinsrhldcumfpg", "wvj", "ykq", "bxz", "0123456789", " ", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
_INDIC = [0x3E, 0x3F, 0x40, 0x41, 0x47, 0x4B, 0x4D, 0x15, 0x24, 0x26, 0x28, 0x2A, 0x2C, 0x2E, 0x30, 0x32, 0x38]
CLASSES = [
    chars + "".join(chr(block + place) for place in _INDIC[i: i + 1] for block in (0x0980, 0x0B00))
    for i, chars in enumerate(_LATIN)
]
STEPS = 8
PER_WORD = 64 // STEPS
WORDS = (len(CLASSES) + PER_WORD) // PER_WORD
SIGNATURE = [f"sig{w}" for w in range(WORDS)]
# Titles of a bucket that the others are compared with first.
LEADERS = 2
# Bits that the tokens of a title are marked in, as longs.
MARKS = [f"mark{w}" for w in range(4)]
# The most titles of a block, and the least and the most characters that blocks are filled to.
BLOCK = 16_000
LEAST_CHARS, MOST_CHARS = 100_000, 4_000_000


def token_key(normalised_title: Column) -> Column:
    """The sorted distinct tokens of a normalised title as one string."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(normalised_title, " "))), " ")


@F.pandas_udf(T.StructType([T.StructField("len", T.IntegerType()), *[T.StructField(name, T.LongType()) for name in SIGNATURE]]))
def signature(keys: pd.Series) -> pd.DataFrame:
    """The length of each key, and eight classes of characters in each long: bit (class, step) is set when the class
    occurs more than ``step`` times.

    Classes do not overlap, so two texts differ in no more bits than they differ in character counts.
    """
    lens = keys.str.len().to_numpy("int64")
    codes = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), "uint32")
    kinds = len(CLASSES) + 1
    found = np.repeat(np.arange(len(lens)) * kinds, lens) + _class_table()[np.minimum(codes, 0xFFFF)]
    counts = np.bincount(found, minlength=len(lens) * kinds).reshape(-1, kinds)
    bits = (np.uint64(1) << np.minimum(counts, STEPS).astype("uint64")) - np.uint64(1)
    words = np.zeros((len(lens), WORDS), "uint64")
    for i in range(kinds):
        words[:, i // PER_WORD] |= bits[:, i] << np.uint64(i % PER_WORD * STEPS)
    return pd.DataFrame({"len": lens.astype("int32"), **{name: words[:, w].view("int64") for w, name in enumerate(SIGNATURE)}})


@cache
def _class_table() -> np.ndarray:
    """The class of each character code; those from 0xFFFF on have the last one."""
    table = np.full(0x10000, len(CLASSES), "int64")
    for i, chars in enumerate(CLASSES):
        table[[ord(char) for char in chars]] = i
    return table


def with_signatures(keys: DataFrame) -> DataFrame:
    """Token keys (k, ...) with a number each (``id``), their lengths and signatures, as a stored table.

    A title may be long, so all that follows works on its number and reads the text again where a pair is scored.
    It computes much per title and the titles are few bytes, so the number of partitions is fixed. Keys that are
    partitioned by themselves already would not be dealt again by ``k`` alone.
    """
    text_batches(keys.sparkSession)
    signed = keys.repartition(_partitions(keys), F.xxhash64("k")).withColumn("_s", signature.asNondeterministic()("k"))
    return written(signed.select(*keys.columns, "_s.*").withColumn("id", F.monotonically_increasing_id()), "titles")


def two_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """The keys of two sets, each once, with flags that tell where they are from."""
    both = left.select("k", F.lit(True).alias("in_left"), F.lit(False).alias("in_right")).unionByName(
        right.select("k", F.lit(False).alias("in_left"), F.lit(True).alias("in_right"))
    )
    merged = both.groupBy("k").agg(F.max("in_left").alias("in_left"), F.max("in_right").alias("in_right"))
    return with_signatures(merged)


def _frequencies(keys: DataFrame) -> dict[str, int]:
    """How many keys have a token: the ``RANKED_ELEMENTS`` most frequent ones."""
    counts = keys.select(F.explode(F.split("k", " ")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    # The first ones are taken per task, so at most RANKED_ELEMENTS rows come to the driver.
    return {r["t"]: r["n"] for r in counts.orderBy(F.desc("n"), "t").limit(RANKED_ELEMENTS).collect()}


def _profiles(keys: DataFrame, threshold: int) -> DataFrame:
    """The keys without their text, but with their tokens, rarest first, and a bit marked for each.

    The first ``lookups`` of the tokens are looked up for containment; at most ``spare`` of them may be missing then.
    """
    missing, whole = 2 * (100 - threshold), 200 - threshold
    keys = keys.repartition(_partitions(keys), "id")
    known = keys.sparkSession.sparkContext.broadcast(_frequencies(keys))

    @F.pandas_udf(", ".join(["tokens array<string>, lookups int, spare int", *[f"{name} long" for name in MARKS]]))
    def profile(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            tokens = sorted(text.split(" "), key=lambda t: (known.value.get(t, 0), t))
            most, before, lookups = (len(text) + 1) * missing, 0, 0
            for token in tokens:
                if before * whole >= most:
                    break
                before, lookups = before + len(token) + 1, lookups + 1
            lost = spare = marks = 0
            for weight in sorted(map(len, tokens)):
                lost += weight + 1
                if lost * whole >= most:
                    break
                spare += 1
            for token in tokens:
                marks |= 1 << zlib.crc32(token.encode("utf-8", "surrogatepass")) % (64 * len(MARKS))
            rows.append((tokens, lookups, spare, *np.frombuffer(marks.to_bytes(8 * len(MARKS), "little"), "int64").tolist()))
        return pd.DataFrame(rows, columns=["tokens", "lookups", "spare", *MARKS])

    made = keys.withColumn("_p", profile.asNondeterministic()("k"))
    return written(made.select("id", "in_left", "in_right", "len", "_p.*"), "profiles")


def _renamed(df: DataFrame, suffix: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else c + suffix) for c in df.columns])


def _bits(mask: Callable[[Column, Column], Column], words: list[str]) -> Column:
    return reduce(Column.__add__, [F.bit_count(mask(F.col(f"{s}_a"), F.col(f"{s}_b"))) for s in words])


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def containment_candidates(profiles: DataFrame, threshold: int) -> DataFrame:
    """Pairs (id_a, id_b, sure) in which the tokens of a may be contained in b to the share the threshold asks for.

    A title of one token is contained for sure where the token is.
    """
    missing, whole = 2 * (100 - threshold), 200 - threshold
    carried = ["id", "in_left", "in_right", "len", *MARKS]
    lookups = profiles.select(
        *carried, "spare", (F.size("tokens") == 1).alias("sure"), F.explode(F.slice("tokens", F.lit(1), F.col("lookups"))).alias("t")
    )
    a = _renamed(lookups, "_a", ["t", "sure"])
    b = _renamed(profiles.select(*carried, F.explode("tokens").alias("t")), "_b", ["t"])
    # A bit that only a has is a token of a that b has not, at least.
    lacking = _bits(lambda x, y: x.bitwiseAND(F.bitwise_not(y)), MARKS)
    possible = (
        (F.col("id_a") != F.col("id_b"))
        & ((F.col("in_left_a") & F.col("in_right_b")) | (F.col("in_right_a") & F.col("in_left_b")))
        & ((F.col("len_b") + 1) * whole >= (F.col("len_a") + 1) * (whole - missing))
        & (lacking <= F.col("spare_a"))
    )
    # Every title lists all its tokens, so the hot tokens are on the b side; the lookups are the small side.
    joined = skew_join(b, a, "t", condition=possible, spread=F.xxhash64("id_b"), partitions=_partitions(profiles))
    return joined.select("id_a", "id_b", "sure")


def _blocks(profiles: DataFrame, side: str, suffix: str) -> DataFrame:
    """The keys of a side with the block of each: its place in the order of lengths, ``BLOCK`` keys at most together.

    Blocks of long titles hold fewer, so that all hold about as many characters.
    """
    keys = ordered_index(profiles.filter(side).select("id", "len"), [F.col("len"), F.col("id")], name="place")
    # One row per length, so no more than the longest title has characters.
    lengths = sorted((r["len"], r["n"]) for r in keys.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect())
    # Comparing two blocks takes time by the product of their characters. About 8 pairs of blocks for each partition,
    # unless that makes blocks so small that preparing them takes the time.
    whole = sum(length * n for length, n in lengths) // int((8 * _partitions(profiles)) ** 0.5) + 1
    most = min(MOST_CHARS, max(LEAST_CHARS, whole))
    first, held, chars, place = [0], 0, 0, 0
    for length, n in lengths:
        while n:
            fits = min(n, BLOCK - held, max((most - chars) // max(length, 1), 0 if held else 1))
            held, chars, place, n = held + fits, chars + fits * length, place + fits, n - fits
            if n:
                first, held, chars = [*first, place], 0, 0
    begins = np.array(first)

    @F.pandas_udf(T.LongType())
    def block(places: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(begins, places.to_numpy() - 1, "right") - 1)

    return written(keys.select("id", block("place").alias(f"block{suffix}"), "len"), "blocks")


def indel_matches(profiles: DataFrame, titles: DataFrame, threshold: int) -> DataFrame:
    """Pairs (id_a, id_b, score), each once, whose score reaches the threshold by the edit distance of their titles.

    Blocks of titles of like length meet in one task each, so a task holds two blocks, however many titles there are.
    """
    loss = 100 - threshold
    a, b = _blocks(profiles, "in_left", "_a"), _blocks(profiles, "in_right", "_b")
    spans = [
        side.groupBy(f"block{x}").agg(F.min("len").alias(f"least{x}"), F.max("len").alias(f"most{x}"))
        for side, x in ((a, "_a"), (b, "_b"))
    ]
    near = (F.col("least_b") * (100 - loss) <= F.col("most_a") * (100 + loss)) & (
        F.col("least_a") * (100 - loss) <= F.col("most_b") * (100 + loss))
    # A row per pair of blocks: few, as a block holds thousands of titles.
    cells = written(spans[0].join(F.broadcast(spans[1]), near).select("block_a", "block_b"), "cells")
    held = titles.select("id", "k", "in_left", "in_right")
    sent = [
        held.join(side.drop("len"), "id").join(F.broadcast(cells), block).withColumn("is_a", F.lit(is_a))
        for side, block, is_a in ((a, "block_a", True), (b, "block_b", False))
    ]
    columns = ["block_a", "block_b", "is_a", *held.columns]

    def matched(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(len=frame["k"].str.len()).sort_values("len", kind="stable")
        left, right = frame[frame["is_a"]], frame[~frame["is_a"]]
        (id_a, k_a, twice_a), (id_b, k_b, twice_b) = (
            (x["id"].to_numpy("int64"), x["k"].tolist(), (x["in_left"] & x["in_right"]).to_numpy("bool")) for x in (left, right)
        )
        rows = []
        if not k_a or not k_b:
            return pd.DataFrame(rows, columns=["id_a", "id_b", "score"]).astype({"id_a": "int64", "id_b": "int64", "score": "float64"})

        def once(i: int, found: np.ndarray) -> np.ndarray:
            # A pair of titles that are on both sides would come twice.
            return found[(id_b[found] > id_a[i]) | ((id_b[found] != id_a[i]) & ~(twice_b[found] & twice_a[i]))]

        for one, other in near_pairs(k_a, k_b, loss, once):
            for i, j in zip(one.tolist(), other.tolist()):
                score = token_set_ratio(k_a[i], k_b[j], threshold)
                if score >= threshold:
                    rows.append((id_a[i], id_b[j], score))
        return pd.DataFrame(rows, columns=["id_a", "id_b", "score"]).astype({"id_a": "int64", "id_b": "int64", "score": "float64"})

    met = sent[0].select(*columns).unionByName(sent[1].select(*columns)).repartition(2 * _partitions(profiles), "block_a", "block_b")
    return met.groupBy("block_a", "block_b").applyInPandas(matched, "id_a long, id_b long, score double")


def similar_ids(keys: DataFrame, threshold: int = TITLE_THRESHOLD) -> DataFrame:
    """All pairs (id_a, id_b, score), each once, of a left and another, right key with at least that score.

    ``keys`` is a stored table (id, k, in_left, in_right, len and the signature).
    """
    if not 67 <= threshold <= 100:
        raise ValueError("the bounds hold for thresholds from 67 to 100")
    profiles = _profiles(keys, threshold)
    ordered = [F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")]
    # A pair may come from either side; once from a title of one token is enough.
    contained = containment_candidates(profiles, threshold).select(*ordered, "sure").groupBy("id_a", "id_b").agg(F.max("sure").alias("sure"))
    contained = written(contained, "contained")
    sure = contained.filter("sure").select("id_a", "id_b", F.lit(100.0).alias("score"))
    # Pairs that do not reach the threshold by containment do so by edits or not at all.
    asked = _scored(contained.filter(~F.col("sure")).drop("sure"), keys, threshold, containment_score_from(threshold))
    edited = indel_matches(profiles, keys, threshold).select(*ordered, "score")
    return sure.unionByName(asked.select("id_a", "id_b", "score")).unionByName(edited).dropDuplicates(["id_a", "id_b"])


def similar_keys(keys: DataFrame, threshold: int = TITLE_THRESHOLD) -> DataFrame:
    """The pairs of ``similar_ids`` as (k_a, k_b, score) with k_a < k_b; ``keys`` comes from ``two_sides``."""
    pairs = _with_texts(written(similar_ids(keys, threshold), "similar"), keys)
    return pairs.select(F.least("k_a", "k_b").alias("k_a"), F.greatest("k_a", "k_b").alias("k_b"), "score")


def _with_texts(pairs: DataFrame, titles: DataFrame) -> DataFrame:
    """Stored pairs (id_a, id_b) with the titles' texts."""
    parts = _partitions(pairs)
    for side in ("a", "b"):
        text = titles.select(F.col("id").alias(f"id_{side}"), F.col("k").alias(f"k_{side}"))
        # A leader of many near copies, or a title that resembles many, is a hot key.
        pairs = skew_join(pairs, text, f"id_{side}", spread=F.xxhash64("id_a", "id_b"), partitions=parts)
    return pairs


def _scored(pairs: DataFrame, titles: DataFrame, threshold: int, score: Callable[..., Column] | None = None) -> DataFrame:
    """The stored, distinct pairs (id_a, id_b) with the titles' texts and their score, if it reaches the threshold."""
    # A filter on a plain function would be evaluated twice.
    score = (score or token_set_score_from(threshold)).asNondeterministic()
    return _with_texts(pairs, titles).withColumn("score", score("k_a", "k_b")).filter(F.col("score") >= threshold)


def minimum_hashes(parts: set[str], seeds: range) -> np.ndarray:
    """The least hash of the parts for each seed."""
    hashes = np.fromiter((zlib.crc32(part.encode()) for part in parts), "uint64", len(parts))
    factors = np.array([0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64) for seed in seeds], "uint64")
    return ((hashes * factors[:, None] + (factors >> np.uint64(7))[:, None]) >> np.uint64(32)).min(axis=1)


@F.pandas_udf(T.ArrayType(T.LongType()))
def title_buckets(keys: pd.Series) -> pd.Series:
    def buckets(text: str) -> list[int]:
        padded = f" {text} "
        tokens = minimum_hashes(set(text.split(" ")), range(8))
        grams = minimum_hashes({padded[i:i + 2] for i in range(len(padded) - 1)}, range(8, 17))
        bands = [*tokens.reshape(4, 2), *grams.reshape(3, 3)]
        return [i << 32 | zlib.crc32(band.tobytes()) for i, band in enumerate(bands)]

    return keys.map(buckets)


def buckets_of(keys: DataFrame) -> DataFrame:
    """Hash buckets of each key: minimum hashes of its tokens, two at a time, and of its character pairs, three."""
    return keys.withColumn("_buckets", title_buckets.asNondeterministic()("k")).withColumn(
        "bucket", F.explode("_buckets")).drop("_buckets")


def near_leaders(
    rows: DataFrame, leaders: DataFrame, threshold: int, earlier: bool, titles: DataFrame | None = None
) -> DataFrame:
    """Numbers (id) of keys similar to one of the first ``LEADERS`` leaders of a bucket; with ``earlier`` to one of lower ``first``.

    Both sides come from ``buckets_of`` and have id, first, len and the signature; ``titles`` has the texts of all (id, k),
    if the rows do not. Each key meets at most a fixed number of leaders.
    """
    titles = rows.select("id", "k").distinct() if titles is None else titles
    cheap = ["bucket", "id", "first", "len", *SIGNATURE]
    top = first_per_group(leaders.select(*cheap), ["bucket"], [F.col("first"), F.col("id")], LEADERS)
    total, loss = F.col("len_a") + F.col("len_b"), 100 - threshold
    differing = _bits(lambda x, y: x.bitwiseXOR(y), SIGNATURE)
    missing_a = _bits(lambda x, y: x.bitwiseAND(F.bitwise_not(y)), SIGNATURE)
    missing_b = _bits(lambda x, y: y.bitwiseAND(F.bitwise_not(x)), SIGNATURE)
    share = F.lit(2 * loss)
    possible = (
        (differing * 100 <= total * loss)
        | (missing_a * (100 + loss) < (F.col("len_a") + 1) * share)
        | (missing_b * (100 + loss) < (F.col("len_b") + 1) * share)
    ) & (F.col("id_a") != F.col("id_b"))
    if earlier:
        possible = possible & (F.col("first_a") < F.col("first_b"))
    met = skew_join(
        _renamed(rows.select(*cheap), "_b", ["bucket"]), _renamed(top, "_a", ["bucket"]), "bucket",
        condition=possible, spread=F.xxhash64("id_b"),
    )
    pairs = written(met.select("id_a", "id_b").distinct(), "pairs")  # repeated pairs of a task go before the shuffle
    return _scored(pairs, titles, threshold).select(F.col("id_b").alias("id")).distinct()


def recent_titles(articles: DataFrame, as_of: Column, hours: int = TITLE_LOOKBACK_HOURS) -> DataFrame:
    """Normalised titles (``norm``) of stored articles created in the look-back, whatever their language."""
    start = as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
    recent = articles.filter(F.col("created_at") >= start)
    if "created_date" in articles.columns:
        recent = recent.filter(F.col("created_date") >= F.to_date(start))
    titles = recent.select(normalize_title(F.col("title")).alias("norm"))
    return titles.filter(F.col("norm") != "").distinct()


def fuzzy_title_join(
    batch: DataFrame, articles: DataFrame, as_of: Column, threshold: int = TITLE_THRESHOLD
) -> DataFrame:
    """For each batch row, the most similar recent stored title if it reaches the threshold: (pos, url, title, match, score)."""
    norm = normalize_title(F.col("original_title"))
    keyed = batch.select("pos", "url", norm.alias("norm")).filter(F.col("norm") != "").withColumn("k", token_key(F.col("norm")))
    # Read three times, and titles may take long to make.
    keyed = written(keyed, "keyed")
    # A stored key is represented by its first title.
    stored = cut_lineage(
        recent_titles(articles, as_of).groupBy(token_key(F.col("norm")).alias("k_stored"))
        .agg(F.min("norm").alias("match"))
    )
    same = stored.select(F.col("k_stored").alias("k"), "k_stored", F.lit(100.0).alias("score"))
    # A title that is stored word for word cannot find a better match.
    others = keyed.select("k").distinct().join(same.select("k"), "k", "left_anti")
    keys = two_sides(others, stored.select(F.col("k_stored").alias("k")))
    pairs = cut_lineage(similar_keys(keys, threshold))
    both_ways = pairs.select(F.col("k_a").alias("k"), F.col("k_b").alias("k_stored"), "score").unionByName(
        pairs.select(F.col("k_b").alias("k"), F.col("k_a").alias("k_stored"), "score")
    )
    scored = both_ways.unionByName(same).join(stored, "k_stored")
    best = first_per_group(scored, ["k"], [F.desc("score"), F.asc("match")])
    return skew_join(keyed, best.select("k", "match", "score"), "k").select(
        "pos", "url", F.col("norm").alias("title"), "match", "score"
    )


def _walk(rows: DataFrame, match: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """URLs that the walk over ``rows`` (pos, url, k, blocked, several) makes duplicates.

    ``blocked`` marks keys similar to a stored title, ``several`` URLs with more than one row. Rows of one URL matter
    only until the first of them is a duplicate; then the URL is one and the rest is skipped. ``match`` gives, for the
    open keys (k, first), whether each was matched with all others (k, full), and the similar keys (k, other) of those.
    """
    # A URL that occurs once: the first such row of a key is accepted or a duplicate, the others are duplicates then.
    # A URL that occurs again: two rows per key tell all, as the second is a duplicate of the first.
    # The limit of two rows applies before the shuffle, so many copies of a title are no hot group.
    numbered = rows.withColumn("group", F.when(F.col("several"), F.col("url"))).withColumn(
        "nth", F.row_number().over(Window.partitionBy("k", "group").orderBy("pos"))
    )
    kept = numbered.filter(F.col("nth") <= 2).filter(F.col("several") | (F.col("nth") == 1))
    status = F.when(F.col("blocked"), F.lit("hit")).otherwise(F.lit("open"))
    state = cut_lineage(kept.select("pos", "url", "k", "several", status.alias("status")))
    copies = rows.filter(~F.col("several")).join(state.select("pos"), "pos", "left_anti").select("url")
    hits = [copies, state.filter(F.col("status") == "hit").select("url")]
    while not state.filter(F.col("status") == "open").isEmpty():
        state, found = _pass(state, match)
        hits.append(found)
    return reduce(DataFrame.unionByName, hits).distinct()


def _pass(state: DataFrame, match: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(rows that are still undecided with their URL's other rows, URLs found to be duplicates)."""
    first = state.filter(F.col("status") == "open").groupBy("k").agg(F.min("pos").alias("first"))
    full, edges = match(first)
    # Rows without a similar key, in a URL of their own, are accepted and matter to nobody else.
    linked = edges.select("k").unionByName(state.filter("several").select("k")).distinct()
    busy = (
        state.join(linked.withColumn("_linked", F.lit(True)), "k", "left")
        .join(full, "k", "left")
        .withColumn("full", F.coalesce("full", F.lit(False)))
        .filter(F.col("_linked") | F.col("several") | ((F.col("status") == "open") & ~F.col("full")))
        .select(*state.columns, "full")
    )
    current = cut_lineage(busy)
    around = cut_lineage(edges.unionByName(current.select("k", F.col("k").alias("other")).distinct()))
    before, left = -1, current.filter(F.col("status") == "open").count()
    while left and left != before:
        current = cut_lineage(_round(current, around))
        before, left = left, current.filter(F.col("status") == "open").count()
    found = current.filter(F.col("status") == "hit").select("url")
    if not left:
        return current.drop("full").limit(0), found
    # A later pass needs the open rows, and what is known of their URLs.
    waiting = current.filter((F.col("status") == "open") & F.col("several")).select("url").distinct()
    rest = current.filter((F.col("status") == "open") & ~F.col("several")).unionByName(
        current.filter("several").join(waiting, "url", "left_semi")
    )
    return cut_lineage(rest.drop("full")), found


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("id_a").alias("k"), F.col("id_b").alias("other")).unionByName(
        pairs.select(F.col("id_b").alias("k"), F.col("id_a").alias("other"))
    )


def _match_in_passes(
    titles: DataFrame, bucketed: DataFrame, threshold: int
) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """Match the titles that no earlier one in their buckets is similar to with all open titles, by their numbers."""
    def match(first: DataFrame) -> tuple[DataFrame, DataFrame]:
        first = first.withColumnRenamed("k", "id")
        in_buckets = written(bucketed.join(first, "id"), "in-buckets")
        held = written(near_leaders(in_buckets, in_buckets, threshold, earlier=True, titles=titles), "held")
        open_titles = titles.drop("in_left", "in_right").join(first.select("id"), "id", "left_semi")
        flagged = written(
            open_titles.join(held.withColumn("held", F.lit(True)), "id", "left").repartition(_partitions(titles), "id")
            .select(*open_titles.columns, F.col("held").isNull().alias("in_left"), F.lit(True).alias("in_right")), "flagged"
        )
        pairs = cut_lineage(similar_ids(flagged, threshold).select("id_a", "id_b"))
        return flagged.select(F.col("id").alias("k"), F.col("in_left").alias("full")), _both_ways(pairs)

    return match


def _round(state: DataFrame, around: DataFrame) -> DataFrame:
    """Decide every row whose earlier neighbours, by key and by URL, allow it.

    Only keys matched with all open ones (``full``) can be accepted. ``state`` holds one row per key for URLs that
    occur once; adaptive execution splits what is left of skew.
    """
    is_open, accepted = F.col("status") == "open", F.col("status") == "accepted"
    per_key = state.groupBy("k").agg(
        F.min(F.when(accepted, F.col("pos"))).alias("taken"), F.min(F.when(is_open, F.col("pos"))).alias("waiting")
    )
    nearby = (
        around.join(per_key.withColumnRenamed("k", "other"), "other")
        .groupBy("k")
        .agg(F.min("taken").alias("taken"), F.min("waiting").alias("waiting"))
    )
    seen = state.join(nearby, "k", "left")
    hit = F.when(is_open & (F.col("taken") < F.col("pos")), F.lit("hit")).otherwise(F.col("status"))
    found = seen.withColumn("status", hit)
    ready = (F.col("status") == "open") & F.col("full") & (F.col("waiting") >= F.col("pos"))
    found = found.withColumn("ready", F.coalesce(ready, F.lit(False)))
    per_url = found.filter("several").groupBy("url").agg(
        F.min(F.when(F.col("status") == "hit", F.col("pos"))).alias("first_hit"),
        F.min(F.when((F.col("status") == "open") & ~F.col("ready"), F.col("pos"))).alias("first_wait"),
    )
    known = found.join(per_url, "url", "left")
    skipped = (F.col("status") == "open") & (F.col("first_hit") < F.col("pos"))
    free = F.col("ready") & (F.col("first_wait").isNull() | (F.col("first_wait") > F.col("pos")))
    status = F.when(skipped, F.lit("skipped")).when(free, F.lit("accepted")).otherwise(F.col("status"))
    return known.select("pos", "url", "k", "several", status.alias("status"), "full")


def dedupe_urls(batch: DataFrame, articles: DataFrame, as_of: Column, threshold: int = TITLE_THRESHOLD) -> DataFrame:
    """The duplicate URLs of a batch (pos, url, original_title): stored ones, and those the title walk finds.

    ``pos`` is the order of the walk and unique.
    """
    stored = written(known_urls(batch, articles), "known-urls")
    norm = normalize_title(F.col("original_title"))
    rows = batch.select("pos", "url", token_key(norm).alias("k")).filter((F.col("url") != "") & (F.col("k") != ""))
    new = written(rows.join(stored, "url", "left_anti"), "new")
    # The titles of the batch (left) and the stored ones (right) in one table; the walk knows them by their numbers.
    titles = two_sides(new, recent_titles(articles, as_of).select(token_key(F.col("norm")).alias("k")))
    numbered = skew_join(new, titles.select("k", "id"), "k", spread=F.col("pos"))
    new = cut_lineage(numbered.select("pos", "url", F.col("id").alias("k")))
    bucketed = written(_in_buckets(titles.filter("in_left")), "buckets")
    blocked = _blocked_ids(titles, bucketed, threshold).select(F.col("id").alias("k"))
    match = _match_in_passes(titles, bucketed, threshold)
    several = new.groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(
        "url", F.lit(True).alias("several")
    )
    marked = skew_join(new, blocked.withColumn("blocked", F.lit(True)), "k", "left", spread=F.col("pos"))
    marked = cut_lineage(skew_join(marked, several, "url", "left", spread=F.col("pos")).fillna(False))
    return stored.select("url").unionByName(_walk(marked, match)).distinct()


def _in_buckets(titles: DataFrame) -> DataFrame:
    return buckets_of(titles.repartition(_partitions(titles), "id")).select("bucket", "id", "len", *SIGNATURE)


def _blocked_ids(titles: DataFrame, bucketed: DataFrame, threshold: int) -> DataFrame:
    """The numbers of batch keys that are equal or similar to a stored key, with those of the stored keys."""
    stored = titles.filter("in_right")
    rest = titles.filter("in_left and not in_right")
    # A stored title of one token is contained in every title that has the token.
    single = written(stored.filter(~F.col("k").contains(" ")).select(F.col("k").alias("t")), "single")
    tokens = rest.select("id", F.explode(F.split("k", " ")).alias("t"))
    holding = written(skew_join(tokens, single, "t", "left_semi", spread=F.col("id")).select("id").distinct(), "holding")
    rest = rest.join(holding, "id", "left_anti")
    rows = bucketed.join(rest.select("id"), "id", "left_semi").withColumn("first", F.lit(0))
    leaders = _in_buckets(stored).withColumn("first", F.lit(0))
    quick = written(near_leaders(rows, leaders, threshold, earlier=False, titles=titles), "near-stored")
    # A stored key that the batch has, too, is blocked already: only its being stored counts for the others.
    both = rest.join(quick, "id", "left_anti").unionByName(stored.withColumn("in_left", F.lit(False)))
    pairs = similar_ids(written(both, "rest"), threshold)
    slow = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id"))
    return cut_lineage(stored.select("id").unionByName(holding).unionByName(quick).unionByName(slow).distinct())


def dedupe_articles(
    batch: DataFrame, articles: DataFrame, as_of: Column, threshold: int = TITLE_THRESHOLD
) -> DataFrame:
    """The batch rows that survive. The earliest row per URL is kept first, so a repeated URL does not drop itself."""
    single = first_per_url(batch.filter(F.col("url") != ""))
    return batch_minus_duplicates(single, dedupe_urls(single, articles, as_of, threshold))
