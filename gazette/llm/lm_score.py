"""Stupid-backoff scores of documents under the n-gram counts of the corpus, from trigrams dealt by their middle word.

Words become codes, kept as a table. Then each word is a row with its two neighbours. The rows are dealt by the hash of the
middle word, so one task has every occurrence of the trigram, of both pairs and of the middle word: it counts them, joins the
counts to its rows and sums the scores by document. Only the count of the last word is known from elsewhere, a broadcast
table of frequent words; a rarer last word has a second row, dealt by that word. A middle word with too many rows is dealt by
its pairs instead. The middle words are taken in rounds, so that a share of the rows is on disk at a time; a groupBy adds up
the sums of all tasks and rounds. Longer n-grams are counted by a groupBy on their hash and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import ARROW_ROWS, drop_shuffles, list_array, once, stored

ORDER, BACKOFF = 3, 0.4
#: Bits of a word's code in a row; rows of a task, about; rows of a middle word beyond which it is dealt by its pairs; rounds.
BITS, ROWS, HOT, ROUNDS = 20, 800_000, 800_000, 3
#: Codes of no word and of a word that no other document has. Frequent words have the next ones, rarer ones their hash.
NONE, ALONE = 0, 1
#: Bits of the set of words that are to be counted, by their hash; characters that a task hashes at once; documents and rows of a batch.
KNOWN_BITS, CHUNK, TEXTS, BATCH = 1 << 26, 2_000_000, 500, 5_000
#: Whether a character parts words; the last entry stands for all behind it. The factor of a word's hash by place, and its inverse.
SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
#: Kinds of rows: for all counts of the middle word, those of its left pairs, its right pairs, the last word; added if wide.
WHOLE, LEFT, RIGHT, LAST, WIDE = 0, 1, 2, 3, 4
#: The n-grams of the most documents whose totals are broadcast at most, and the documents that such a one is in at least.
FREQUENT, LEAST = 200_000, 64
#: Entries that are passed on at once, but for a longer document.
ENTRIES = 100_000
#: Words whose hashes a worker remembers.
CACHE = 1_000_000
#: The key of the empty context, whose count is the number of words.
EMPTY = 0
STEP = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        value = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(31))) * STEP
    return keys ^ (keys >> np.uint64(29))


def grams(words: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams of one document for n from 1 to ``order``; entry i of size n ends at word i + n - 1."""
    out = [mixed(words)]
    for n in range(2, order + 1):
        out.append(mixed(out[-1][:-1] * STEP + words[n - 1:] + np.uint64(n)) if len(words) >= n else words[:0])
    return out


def counted(words: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a document for n from 0 to ``order``, their counts, and the place of every n-gram among them."""
    keys = np.concatenate([np.full(len(words), EMPTY, np.uint64), *grams(words, order)]).view(np.int64)
    distinct, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return distinct, counts, place


def exploded(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["row", "key", "own"])


def words_of(text: str | None) -> np.ndarray:
    words = (text or "").lower().split()
    return np.fromiter(map(once("lm-hashes", Hashes).__getitem__, words), np.uint64, len(words))


def totals_of(keys: np.ndarray, sorted_keys: np.ndarray, totals: np.ndarray, none: np.ndarray) -> np.ndarray:
    """The total of each key where ``sorted_keys`` has it, else the value in ``none``."""
    if not len(sorted_keys):
        return none
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, totals[at], none)


SCORES = "doc_id long, n_words long, n_backoff long, log_score double"


def scored(words: np.ndarray, place: np.ndarray, seen: np.ndarray, order: int, backoff: float) -> tuple[int, float]:
    """Words that took a step down, and the sum of the scores; ``seen`` has the counts of the distinct n-grams, by ``place``."""
    n = len(words)
    ends = np.cumsum([0, n, *(max(n - k + 1, 0) for k in range(1, order + 1))])
    counts = [seen[place[ends[k]:ends[k + 1]]].astype(float) for k in range(order + 1)]
    # by position: the longest n-gram that was seen elsewhere, each step down at the price of the backoff
    score, steps = np.full(n, np.nan), np.zeros(n, np.int64)
    for k in range(order, 0, -1):
        here = np.flatnonzero(np.isnan(score) & (np.arange(n) >= k - 1))
        gram, context = counts[k][here - (k - 1)], counts[k - 1][here - (k - 1)]
        if k == 1:
            context, gram = np.maximum(context, 1.0), np.maximum(gram, 0.5)  # a word seen nowhere else counts half
        found = gram > 0
        score[here[found]] = np.log(gram[found] / context[found]) + steps[here[found]] * np.log(backoff)
        steps[here[~found]] += 1
    return int((steps > 0).sum()), float(score.sum())


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of lower-cased texts, and the number of words of each text.

    A word's hash is a polynomial in its characters, the difference of two running sums; numpy makes those of all words at once.
    """
    ends = np.cumsum([len(t) + 1 for t in texts])
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.append(False, ~SPACE[np.minimum(points, len(SPACE) - 1)])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    held = once("lm-powers", dict)
    if len(held.get("up", ())) < len(points):
        held["up"], held["down"] = (powers(base, 1 << len(points).bit_length()) for base in (BASE, INVERSE))
    up, down = held["up"], held["down"]
    sums = np.append(np.uint64(0), np.cumsum(mixed((points.astype(np.uint64) + np.uint64(1)) * STEP) * up[:len(points)]))
    words = mixed((sums[last] - sums[first]) * down[first]).view(np.int64)
    return words, np.diff(np.searchsorted(first, ends), prepend=0)


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Rows without their texts, hashes of words, and words of each row, about ``size`` characters at a time."""
    rows, texts, n = [], [], 0
    for batch in batches:
        for row, text in zip(batch.drop_columns(["text"]).to_pylist(), batch.column("text").to_pylist(), strict=True):
            rows.append(row)
            texts.append((text or "").lower())
            n += len(texts[-1])
            if n >= size:
                yield rows, *hashed(texts)
                rows, texts, n = [], [], 0
    if rows:
        yield rows, *hashed(texts)


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, docs) per chunk of documents; docs is 1 or, for more, 2."""
    for _, every, sizes in chunks(batches, CHUNK):
        document = np.repeat(np.arange(len(sizes)), sizes)
        words, place, n = np.unique(every, return_inverse=True, return_counts=True)
        first, last = np.zeros((2, len(words)), np.int64)
        first[place[::-1]], last[place] = document[::-1], document
        docs = 1 + (first != last)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n), pa.array(docs)], ["word", "n", "docs"])


class Words:
    """The table of frequent words, sorted by hash, their counts, and the set of the others that count; None: there are none."""

    def __init__(self, hashes: np.ndarray, totals: np.ndarray, others: np.ndarray | None) -> None:
        self.hashes, self.others = hashes, others
        self.totals = np.concatenate([[0, 0], totals])

    def codes(self, words: np.ndarray) -> np.ndarray:
        found = totals_of(words, self.hashes, np.arange(2, len(self.hashes) + 2), np.full(len(words), ALONE))
        if self.others is not None:
            at = (words & (8 * len(self.others) - 1)).astype(np.int64)
            rare = (found == ALONE) & (self.others[at >> 3] >> (at & 7) & 1 > 0)
            found = np.where(rare, np.where(words >> BITS == 0, ~words, words), found)
        return found


def is_rare(codes: np.ndarray) -> np.ndarray:
    return codes >> BITS != 0


def is_word(codes: np.ndarray) -> np.ndarray:
    """Whether it is a word that other documents may have."""
    return (codes != NONE) & (codes != ALONE)


def known_words(words: DataFrame, size: int, bits: int) -> Words:
    """At most ``size`` of the most frequent words, and one bit for each of the others; more bits set cost time only."""
    histogram = sorted((tuple(r) for r in words.groupBy("n").count().collect()), reverse=True)
    within = [n for (n, _), below in zip(histogram, np.cumsum([c for _, c in histogram]), strict=True) if below <= size]
    top = words.filter(F.col("n") >= min(within)).select("word", "n").toArrow() if within else None
    hashes, totals = (top.column(c).to_numpy() if top else np.zeros(0, np.int64) for c in ("word", "n"))
    order = np.argsort(hashes)
    others = None
    if len(within) < len(histogram):
        others = np.zeros(bits // 8, np.uint8)
        at = F.col("word").bitwiseAND(bits - 1) + 1
        rest = words.filter(F.col("n") < min(within)) if within else words
        parts = rest.groupBy(F.bitmap_bucket_number(at).alias("part"))
        for r in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect():
            begin = (r["part"] - 1) * len(r["bits"])
            others[begin:begin + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)[:len(others) - begin]
    return Words(hashes[order], totals[order], others)


CODED = "row long, doc_id long, n_words long, n_backoff long, n_last long, score double, codes array<int>, own array<int>, rare array<long>"
ROW = "row long, kind byte, own long, key long, sides array<long>"
SUMS = "row long, n_backoff long, n_last long, score double"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def moved(values: np.ndarray, by: int, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each word the value of the one ``by`` places on in its document, or 0."""
    out = np.zeros_like(values)
    if by < 0:
        out[-by:] = values[:by]
    else:
        out[:-by] = values[by:]
    return np.where((at + by >= 0) & (at + by < length), out, 0)


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words of documents of these sizes: the document, the place in it, and its size."""
    return np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return list_array(values, np.append(0, np.cumsum(sizes)))


def coded(batches: Iterator[pa.RecordBatch], words: Words, order: int, backoff: float, leave_one_out: bool) -> Iterator[pa.RecordBatch]:
    """Documents as codes, -1 for each of ``rare``, how often they have their words, and the sums that need no other document."""
    for documents, every, sizes in chunks(batches, CHUNK):
        document, at, length = places(sizes)
        distinct, place = np.unique(every, return_inverse=True)
        code = words.codes(distinct)[place]
        _, pair, n = np.unique(document * len(distinct) + place, return_inverse=True, return_counts=True)
        own, before, rare = n[pair], moved(code, -1, at, length), is_rare(code)

        # the last word decides where it begins the text, or where it or the one before it stands in no other document
        alone = ~rare & ((code == ALONE) | ~is_word(before) | (order == 1))
        elsewhere = words.totals[np.where(rare, ALONE, code)] - (own if leave_one_out else 0)
        steps = np.minimum(at, order - 1)
        score = np.where(alone, np.log(np.maximum(elsewhere, 0.5)) + steps * np.log(backoff), 0.0)
        sums = [np.bincount(document, x, len(sizes)) for x in (alone & (steps > 0), alone, score)]
        columns = [pa.array([d[c] for d in documents], pa.int64()) for c in ("row", "doc_id")]
        columns += [pa.array(sizes), *(pa.array(x.astype(np.int64)) for x in sums[:2]), pa.array(sums[2].astype(float))]
        columns += [lists(np.where(rare, -1, code).astype(np.int32), sizes), lists(own.astype(np.int32), sizes)]
        yield pa.RecordBatch.from_arrays([*columns, lists(code[rare], np.bincount(document[rare], minlength=len(sizes)))], names(CODED))


def trigram_rows(kind: int, row: np.ndarray, left: np.ndarray, middle: np.ndarray, right: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of one kind. Three codes fit one key, with a small ``own``; rows with the hash of a rare word are wide."""
    wide = is_rare(left) | is_rare(middle) | is_rare(right)
    for more, some in ((0, np.flatnonzero(~wide)), (WIDE, np.flatnonzero(wide))):
        if not len(some):
            continue
        key, n = middle[some], own[some]
        if more:
            sides = list_array(np.stack([left[some], right[some]], 1).ravel(), np.arange(len(some) + 1) * 2)
        else:
            key = (key << 2 * BITS | left[some] << BITS | right[some]) << 3 | np.where(n < 8, n, 0)
            n, sides = np.where(n < 8, 0, n), pa.nulls(len(some), pa.list_(pa.int64()))
        columns = [pa.array(row[some]), pa.array(np.full(len(some), kind + more, np.int8)), pa.array(n), pa.array(key), sides]
        yield pa.RecordBatch.from_arrays(columns, names(ROW))


def rows_of(batches: Iterator[pa.RecordBatch], words: Words, order: int, hot: int, turn: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """The rows whose turn it is, by the word that they are dealt by."""
    often = words.totals > hot
    for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
        column = {c: batch.column(c) for c in ("codes", "own", "rare")}
        code, own, hashes = (column[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in column)
        document, at, length = places(column["codes"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        row = batch.column("row").to_numpy()[document]
        code[code < 0] = hashes
        one, two = (moved(code, -k, at, length) if order > k else np.zeros_like(code) for k in (1, 2))
        rare, nothing = is_rare(code), np.zeros_like(code)
        now = (code.view(np.uint64) * STEP >> np.uint64(40)) % np.uint64(rounds) == turn

        def some(kind: int, which: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            which = np.flatnonzero(which & now)
            return trigram_rows(kind, row[which], *(c[which] for c in columns))

        yield from some(LAST, rare, two, one, code, nothing)
        if order > 1:
            after, after_own = (moved(x, 1, at, length) for x in (code, own))
            split = ~rare & often[np.where(rare, ALONE, code)]
            yield from some(WHOLE, (code != ALONE) & ~split, one if order > 2 else nothing, code, after, after_own)
            yield from some(RIGHT, split & is_word(after), one if order > 2 else nothing, code, after, own << 32 | after_own)
            if order > 2:
                yield from some(LEFT, split & is_word(one), one, code, after, nothing)


def dealt_by() -> list[Column]:
    """The word, and for a middle word with many rows also the other one of the pair, by which a row is dealt."""
    wide, kind, key = F.col("kind") >= WIDE, F.col("kind").bitwiseAND(3), F.col("key")
    code = lambda c, shift: F.when(wide, c).otherwise(F.shiftright(key, shift).bitwiseAND((1 << BITS) - 1))
    left, middle, right = code(F.col("sides")[0], BITS + 3), code(key, 2 * BITS + 3), code(F.col("sides")[1], 3)
    return [F.when(kind == LAST, right).otherwise(middle), F.when(kind == LEFT, left).when(kind == RIGHT, right).otherwise(0)]


def dense(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on that are equal where the values are."""
    order = np.argsort(values)
    ordered, out = values[order], np.empty(len(values), np.int64)
    out[order] = np.cumsum(ordered != np.append(ordered[:1], ordered[:-1]))
    return out


def elsewhere(group: np.ndarray, row: np.ndarray, leave_one_out: bool) -> np.ndarray:
    """How many rows each row's group has, in other documents only with ``leave_one_out``."""
    total = np.bincount(group)[group] if len(group) else group
    if leave_one_out:
        several = np.flatnonzero(total > 1)
        place = dense(group[several] * (int(row.max(initial=0)) + 1) + row[several])
        own = np.bincount(place)[place] if len(several) else 0
        total = np.where(total > 1, total, 0)
        total[several] -= own
    return total


def sums_of(batches: Iterator[pa.RecordBatch], words: Words, backoff: float, leave_one_out: bool) -> Iterator[pa.RecordBatch]:
    """The rows of a partition counted, the counts joined to them, and the scores summed by document."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    table = pa.Table.from_batches(held)
    del held
    row, kind, own, key = (table.column(c).to_numpy() for c in names(ROW)[:-1])
    sides = table.column("sides").combine_chunks().flatten().to_numpy()
    del table
    wide, mask = np.flatnonzero(kind >= WIDE), (1 << BITS) - 1
    own = np.where((own & 0xFFFFFFFF == 0) & (kind < WIDE), own | key & 7, own)
    left, middle, right = key >> BITS + 3 & mask, key >> 2 * BITS + 3, key >> 3 & mask
    left[wide], middle[wide], right[wide] = sides[::2], key[wide], sides[1::2]
    rare = [(x, np.flatnonzero(is_rare(x))) for x in (left, middle, right)]
    hashes = np.unique(np.concatenate([x[i] for x, i in rare]))
    for x, i in rare:
        x[i] = (1 << BITS) + np.searchsorted(hashes, x[i])
    several = pa.array(row).dictionary_encode()
    rows, row = several.dictionary.to_numpy(), several.indices.to_numpy().astype(np.int64)
    sums = [np.zeros(len(rows)) for _ in range(3)]

    def add(r: np.ndarray, steps: np.ndarray, last: bool, score: np.ndarray) -> None:
        for total, x in zip(sums, (steps > 0, np.full(len(r), last), score + steps * np.log(backoff)), strict=True):
            total += np.bincount(r, x, len(rows))

    del key, wide, sides
    for k in (WHOLE, LEFT, RIGHT, LAST):
        at = np.flatnonzero(kind & 3 == k)
        if not len(at):
            continue
        r, a, b, c = row[at], left[at], middle[at], right[at]
        middle_own, last_own = own[at] >> 32, own[at] & 0xFFFFFFFF
        count = lambda group: elsewhere(group, r, leave_one_out)  # noqa: E731, B023
        steps = (a != NONE).astype(np.int64)
        if k == LAST:
            unseen = ~is_word(b) | (count(dense(b << 32 | c)) == 0)
            score = np.log(np.maximum(count(dense(c)), 0.5))
            add(r[unseen], (steps + (b != NONE))[unseen], True, score[unseen])
            continue
        two = np.where(is_word(c), count(dense(b << 32 | c)), 0) if k != LEFT else 1
        before = dense(b << 32 | a)
        context = count(before) if k != RIGHT else 1
        # a trigram that others have has pairs that others have
        here = np.flatnonzero(is_word(c) & is_word(a) & (two > 0) & (context > 0))
        three = np.zeros(len(at), np.int64)
        three[here] = elsewhere(dense(before[here] << 32 | c[here]), r[here], leave_one_out)
        if k != RIGHT:
            here = np.flatnonzero(three)
            add(r[here], 0 * here, False, np.log(three[here] / context[here]))
        if k == LEFT:
            continue
        here = np.flatnonzero((three == 0) & (two > 0))
        context = count(b) if k == WHOLE else words.totals[b] - (middle_own if leave_one_out else 0)
        add(r[here], steps[here], False, np.log(two[here] / context[here]))
        here = np.flatnonzero((two == 0) & is_word(c) & (c >> BITS == 0))
        one = words.totals[c[here]] - (last_own[here] if leave_one_out else 0)
        add(r[here], steps[here] + 1, True, np.log(np.maximum(one, 0.5)))
    some = np.flatnonzero((sums[0] > 0) | (sums[1] > 0) | (sums[2] != 0))
    columns = [pa.array(rows[some]), *(pa.array(x[some].astype(np.int64)) for x in sums[:2]), pa.array(sums[2][some])]
    yield pa.RecordBatch.from_arrays(columns, names(SUMS))


def by_middle_word(documents: DataFrame, order: int, backoff: float, leave_one_out: bool, size: int, rows: int, hot: int) -> DataFrame:
    """(doc_id, n_words, n_backoff, log_score) per row; ``order`` is 3 at most, ``size`` the words of the broadcast table.

    A task returns one sum for each of its documents, so with more tasks the sums are more, up to one a word.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long"), "text")
    counts = texts.select("text").mapInArrow(counted_words, "word long, n long, docs long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = stored(counts, "lm-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # a word of one document has no count elsewhere, nor has what it is a part of
    words = known_words(counts.filter("docs > 1") if leave_one_out else counts, size, KNOWN_BITS)
    known = spark.sparkContext.broadcast(words)

    every = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    every = stored(every.mapInArrow(lambda batches: coded(batches, known.value, order, backoff, leave_one_out), CODED), "lm-codes")
    parts = max(1, -(-total // rows))
    rounds = min(ROUNDS, parts)
    add = [F.sum(c).alias(c) for c in ("n_backoff", "n_last", "score")]

    def scores(turn: int) -> DataFrame:
        found = every.select("row", "codes", "own", "rare").mapInArrow(lambda batches: rows_of(batches, known.value, order, hot, turn, rounds), ROW)
        found = found.repartition(-(-parts // rounds), *dealt_by())
        return found.mapInArrow(lambda batches: sums_of(batches, known.value, backoff, leave_one_out), SUMS).groupBy("row").agg(*add)

    sums = every.select("row", "doc_id", "n_words", "n_backoff", "n_last", "score")
    batch = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(max(int(batch), BATCH)))  # rows of the rounds are narrow
    try:
        for turn in range(rounds):
            if rounds > 1:
                drop_shuffles(spark)
            sums = sums.unionByName(stored(scores(turn), "lm-scores"), allowMissingColumns=True)
    finally:
        spark.conf.set(ARROW_ROWS, batch)
    if rounds > 1:
        drop_shuffles(spark)
    sums = sums.groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "n_words")), *add)
    others = F.greatest(F.lit(total) - (F.col("n_words") if leave_one_out else 0), F.lit(1))
    return sums.select("doc_id", "n_words", "n_backoff", (F.col("score") - F.col("n_last") * F.log(others)).alias("log_score"))


def by_joins(documents: DataFrame, order: int, backoff: float, leave_one_out: bool) -> DataFrame:
    """(doc_id, n_words, n_backoff, log_score) per row for any ``order``, with each n-gram a row of its own."""
    spark = documents.sparkSession
    rows = stored(documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text"), "lm-rows")

    def entries(frequent) -> DataFrame:
        """(row, key, own): the n-grams of each document, counted; without those in the broadcast ``frequent``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = frequent.value[0] if frequent else np.zeros(0, np.int64)
            nothing = np.zeros(1, bool)
            held, size = [], 0
            for batch in batches:
                for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    keys, own, _ = counted(words_of(text), order)
                    rare = ~totals_of(keys, known, np.ones(len(known), bool), np.repeat(nothing, len(keys)))
                    held.append((np.full(int(rare.sum()), row, np.int64), keys[rare], own[rare]))
                    size += len(held[-1][0])
                    if size >= ENTRIES:
                        yield exploded(held)
                        held, size = [], 0
            if held:
                yield exploded(held)

        return rows.select("row", "text").mapInArrow(run, "row long, key long, own long")

    # An n-gram of one document has no count elsewhere: only the others are kept.
    counts = entries(None).groupBy("key").agg(F.sum("own").alias("total"), F.count("*").alias("docs")).filter("docs > 1")
    counts = stored(counts, "lm-counts")
    top = counts.filter(F.col("docs") >= LEAST).orderBy(F.desc("docs"), "key").limit(FREQUENT).select("key", "total").orderBy("key").toArrow()
    frequent = spark.sparkContext.broadcast((top.column("key").to_numpy(), top.column("total").to_numpy()))
    rare = entries(frequent).select("row", "key").join(counts.select("key", "total"), "key")
    answers = rare.groupBy("row").agg(F.collect_list(F.struct("key", "total")).alias("known"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, known in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("known"), strict=True):
                words = words_of(text)
                keys, own, place = counted(words, order)
                total = totals_of(keys, *frequent.value, own)
                if known.is_valid:
                    own_keys, own_totals = (known.values.field(i).to_numpy() for i in (0, 1))
                    by_key = np.argsort(own_keys)
                    total = totals_of(keys, own_keys[by_key], own_totals[by_key], total)
                out.append((doc_id, len(words), *scored(words, place, total - own if leave_one_out else total, order, backoff)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_backoff", "log_score"])

    return rows.join(answers, "row", "left").select("doc_id", "text", "known").mapInArrow(score, SCORES)


def score_documents(documents: DataFrame, order: int = ORDER, backoff: float = BACKOFF, leave_one_out: bool = True,
                    size: int = (1 << BITS) - 2, rows: int = ROWS, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_backoff, log_score, mean_log_score, perplexity) per row of ``documents``.

    Words are runs without white space of the lower-cased whole text. A word's score is count(n-gram) / count(context) for
    the longest n-gram up to ``order`` that was seen, times ``backoff`` for each step down; a word seen nowhere counts half
    of once. Counts are over all rows; with ``leave_one_out`` less those of the row itself, as else every n-gram was seen.
    n_backoff counts the words that took a step down. Null and empty texts have no word: log_score 0, mean and perplexity
    null. Repeated rows and null doc_ids keep one row each; an empty table gives no rows; other columns are not read.
    doc_id is taken as a long.

    Up to an order of 3, ``size`` words have their counts broadcast, a task has about ``rows`` words and a middle word of more
    than ``hot`` is dealt by its pairs; these change no result.
    """
    if order > 3:
        scores = by_joins(documents, order, backoff, leave_one_out)
    else:
        scores = by_middle_word(documents, order, backoff, leave_one_out, size, rows, hot)
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scores.withColumn("mean_log_score", mean).withColumn("perplexity", F.exp(-mean))
