"""Phrases whose words occur together more often than apart, counted by a suffix tree that is built in parts.

Each word of a piece starts a suffix, cut off after three words. The suffixes are parted by their first word; a word with
more suffixes than the memory budget is parted further by its second one. Prefixes are dealt to groups of about that
budget, and each group builds its part of the tree on its own: the leaves are the distinct suffixes with their counts, and
what a phrase counts is the sum of the leaves below its node. Words that are too rare for any phrase cut suffixes short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import stored
from gazette.llm.words import WORD_BYTES, Numbered, bytes_of, slices, strings

LEAST, TOP, COVER = 10, 2_000, 50
#: Suffixes of a group of prefixes, about, and prefixes that are parted further at most.
BUDGET, PARTED = 400_000, 1_000_000
#: Words of a suffix; words that a task counts at once; bits of a word's number in a suffix.
DEPTH, POSITIONS, BITS = 3, 1_000_000, 21
#: Bits of the set of words that are frequent enough for a phrase, by a hash of theirs.
FREQUENT_BITS = 1 << 26
BREAK = b"."
#: Upper case becomes lower case, marks and line ends part pieces, tab and blank part words; other bytes belong to words.
PIECES = bytes(c + 32 if 0x41 <= c <= 0x5A else BREAK[0] if chr(c) in ".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))

WORDS = "lang string, word string, n long"
SUFFIXES = "lang string, group long, w1 string, w2 string, w3 string, n long"
NODES = "lang string, w1 string, w2 string, w3 string, a long, l1 long, l2 long"


class Buffer:
    """Words of a task by language as numbers, 0 for the end of a piece; the last ``open`` of ``lang`` start no suffix here."""

    def __init__(self) -> None:
        self.words, self.held, self.size, self.lang, self.open = Numbered(), {}, 0, None, 0

    def full(self) -> bool:
        return self.size >= POSITIONS or self.words.bytes >= WORD_BYTES or len(self.words) >> (BITS - 1) > 0

    def add(self, lang: str, ids: np.ndarray) -> None:
        self.held.setdefault(lang, []).append(ids)
        self.size += len(ids)

    def take(self, lang: str, part: bytes) -> None:
        ids = self.words.ids(part.replace(BREAK, b" . ").split())
        self.add(lang, np.where(ids == self.words[BREAK], 0, ids))

    def handed_on(self, lang: str) -> Buffer:
        """A new buffer that begins with the last words of the open piece, whose successors are still to come."""
        ids = np.concatenate(self.held[lang])
        tail = ids[1 - DEPTH:]
        tail = tail[np.flatnonzero(np.append(0, tail) == 0)[-1]:]
        names, self.lang, self.open = list(self.words), lang, len(tail)
        after = Buffer()
        after.add(lang, after.words.ids([names[i - 1] for i in tail]))
        return after

    def starts(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Per language its words, two breaks behind them, and the places at which a suffix starts."""
        for lang, parts in self.held.items():
            ids = np.concatenate(parts)
            at = np.flatnonzero(ids[:len(ids) - (self.open if lang == self.lang else 0)])
            yield lang, np.append(ids, [0, 0]), at


def buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[Buffer]:
    buffer, end = Buffer(), np.zeros(1, np.int64)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), bytes_of(batch.column("text")), strict=True):
            for part in slices(text.translate(PIECES)):
                buffer.take(lang, part)
                if buffer.full():
                    after = buffer.handed_on(lang)
                    yield buffer
                    buffer = after
            buffer.add(lang, end)
    if buffer.held:
        yield buffer


def repeated(value: str, n: int) -> pa.Array:
    return pa.repeat(pa.scalar(value, pa.string()), n)


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for buffer in buffers(batches):
        table = buffer.words.array()
        for lang, ids, at in buffer.starts():
            counts = np.bincount(ids[at], minlength=len(table))
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([repeated(lang, len(seen)), strings(table, seen), pa.array(counts[seen])], ["lang", "word", "n"])


def hashed(words: list[bytes], start: int = 0) -> np.ndarray:
    return np.fromiter((zlib.crc32(w, start) for w in words), np.uint64, len(words))


def frequent_words(words: DataFrame, least: int, bits: int = FREQUENT_BITS) -> bytes:
    """A set of the words with ``least`` occurrences as one bit each, of at most ``bits`` / 8 bytes whatever their number.

    It may hold other words too, which costs time and never changes a count.
    """
    at = F.crc32(F.concat("lang", F.lit("\0"), "word")) % bits + 1
    parts = words.filter(F.col("n") >= least).groupBy(F.bitmap_bucket_number(at).alias("part"))
    out = np.zeros(-(-bits // 8), np.uint8)
    for r in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect():
        begin = (r["part"] - 1) * len(r["bits"])
        out[begin:begin + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)[:len(out) - begin]
    return out.tobytes()


def counted_suffixes(batches: Iterator[pa.RecordBatch], frequent: bytes, parted: dict[tuple[str, str], int], groups: int) -> Iterator[pa.RecordBatch]:
    """The distinct suffixes of each buffer with their counts, and the group of prefixes that each belongs to.

    A word that is too rare for any phrase starts no suffix and ends those before it.
    """
    bits = np.frombuffer(frequent, np.uint8)
    mix = np.uint64(0x9E3779B97F4A7C15)
    for buffer in buffers(batches):
        names, table = list(buffer.words), buffer.words.array()
        code = np.append(np.uint64(0), hashed(names))
        for lang, ids, at in buffer.starts():
            where = hashed(names, zlib.crc32(lang.encode() + b"\0")) % np.uint64(8 * len(bits))
            often = np.append(False, bits[where >> np.uint64(3)] >> (where & np.uint64(7)) & np.uint64(1) > 0)
            at = at[often[ids[at]]]
            second = np.where(often[ids[at + 1]], ids[at + 1], 0)
            third = np.where((second > 0) & often[ids[at + 2]], ids[at + 2], 0)
            keys, n = np.unique(ids[at] << 2 * BITS | second << BITS | third, return_counts=True)
            w1, w2, w3 = keys >> 2 * BITS, keys >> BITS & ((1 << BITS) - 1), keys & ((1 << BITS) - 1)
            further = np.zeros(len(table), bool)
            for other, word in parted:
                if other == lang and (number := buffer.words.get(word.encode())):
                    further[number] = True
            prefix = code[w1] + np.uint64(zlib.crc32(lang.encode()) << 32)
            prefix = np.where(further[w1], (prefix * mix) ^ (code[w2] + np.uint64(1)), prefix) * mix
            group = ((prefix ^ (prefix >> np.uint64(32))) % np.uint64(groups)).astype(np.int64)
            for a in range(0, len(keys), 20_000):
                b = slice(a, a + 20_000)
                columns = [repeated(lang, len(keys[b])), pa.array(group[b]), *(strings(table, w[b]) for w in (w1, w2, w3)), pa.array(n[b])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "group", "w1", "w2", "w3", "n"])


def level(parent: np.ndarray, words: pa.ChunkedArray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes below ``parent`` by the next word: the node of each leaf, a leaf of each node, and the sum of its leaves."""
    codes = words.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    _, leaf, node = np.unique(parent * (int(codes.max()) + 1) + codes, return_index=True, return_inverse=True)
    return node, leaf, np.bincount(node, n).astype(np.int64)


def subtree(leaves: pa.Table, parted: dict[tuple[str, str], int], least: int) -> pa.RecordBatch:
    """Phrases of two and three words that a group counts at least ``least`` times, with the counts of their first words.

    A word that is parted further has leaves in other groups too; its count is known beforehand.
    """
    n = leaves.column("n").to_numpy()
    node0, _, _ = level(np.zeros(len(n), np.int64), leaves.column("lang"), n)
    node1, leaf1, sum1 = level(node0, leaves.column("w1"), n)
    node2, leaf2, sum2 = level(node1, leaves.column("w2"), n)
    node3, leaf3, sum3 = level(node2, leaves.column("w3"), n)
    first = leaves.select(["lang", "w1"]).take(pa.array(leaf1))
    for i, key in enumerate(zip(first.column("lang").to_pylist(), first.column("w1").to_pylist(), strict=True)) if parted else ():
        sum1[i] = parted.get(key, sum1[i])
    two = np.flatnonzero((sum2 >= least) & leaves.column("w2").take(pa.array(leaf2)).is_valid().to_numpy())
    three = np.flatnonzero((sum3 >= least) & leaves.column("w3").take(pa.array(leaf3)).is_valid().to_numpy())
    leaf = np.concatenate([leaf2[two], leaf3[three]])
    words = [leaves.column(c).take(pa.array(leaf)).combine_chunks() for c in ("lang", "w1", "w2")]
    is_three = np.arange(len(leaf)) >= len(two)
    third = leaves.column("w3").take(pa.array(np.where(is_three, leaf, 0), mask=~is_three)).combine_chunks()
    above = pa.array(sum2[node2[leaf]], mask=~is_three)
    counts = [pa.array(np.concatenate([sum2[two], sum3[three]])), pa.array(sum1[node1[leaf]]), above]
    return pa.RecordBatch.from_arrays([*words, third, *counts], ["lang", "w1", "w2", "w3", "a", "l1", "l2"])


def subtrees(batches: Iterator[pa.RecordBatch], parted: dict[tuple[str, str], int], least: int) -> Iterator[pa.RecordBatch]:
    """The groups of a partition, whose rows come group by group, one after the other."""
    held, rows, current = [], 0, None

    def merged() -> pa.Table:
        sums = pa.Table.from_batches(held).group_by(["group", "lang", "w1", "w2", "w3"]).aggregate([("n", "sum")])
        return sums.rename_columns({"n_sum": "n"})

    for batch in batches:
        group = batch.column("group").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                if held and group[a] != current:
                    yield subtree(merged(), parted, least)
                    held, rows = [], 0
                current, rows = group[a], rows + b - a
                held.append(batch.slice(a, b - a))
                if rows > 2 * BUDGET:  # equal suffixes of other tasks become one
                    held = merged().select(batch.schema.names).combine_chunks().to_batches()
                    rows = sum(x.num_rows for x in held) // 2
    if held:
        yield subtree(merged(), parted, least)


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two and three words of each language.

    Texts are lower-cased in A-Z and split at ``. , ; : ! ?`` and U+000A to U+000D into pieces, those at blank and tab into
    words. n is the number of words of the language, f(phrase) that of its occurrences within pieces, overlapping ones too.
    Phrases with a = f >= ``least`` count. A cut after the first k words gives l and r, the f of both parts, and the score
    floor(10^6 a^2 / (l r)); the lowest counts, at equal scores the one of the smallest k. A phrase is left out if a longer
    one that counts holds it and 100 f(longer) >= ``cover`` a. The first ``top`` of each language by score, a (both
    falling) and phrase (UTF-8 order). Null texts are empty, a null lang is ``und``. Repeated rows count as often as they
    stand; doc_id is not read; an empty table gives no rows; other columns are not read. Whole texts of any length count.

    ``budget`` is the number of suffixes of a group of prefixes, about; more prefixes than PARTED are never parted further.
    """
    spark = documents.sparkSession
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = stored(texts.mapInArrow(counted_words, WORDS).groupBy("lang", "word").agg(F.sum("n").alias("n")), "collocation-words")
    total = words.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // budget))
    # Fewer than total / limit words have more suffixes than the limit, so at most PARTED, and their bytes are at most
    # those of the texts over the limit.
    limit = max(budget, total // PARTED)
    parted = {(r["lang"], r["word"]): r["n"] for r in words.filter(F.col("n") > limit).collect()}
    shared = spark.sparkContext.broadcast(parted)

    frequent = spark.sparkContext.broadcast(frequent_words(words, least))

    suffixes = texts.mapInArrow(lambda batches: counted_suffixes(batches, frequent.value, shared.value, groups), SUFFIXES)
    suffixes = suffixes.repartition(F.col("group")).sortWithinPartitions("group")
    nodes = stored(suffixes.mapInArrow(lambda batches: subtrees(batches, shared.value, least), NODES), "collocation-nodes")

    two, three = F.concat_ws(" ", "w1", "w2"), F.concat_ws(" ", "w2", "w3")
    first_cut = F.struct(F.lit(1).alias("k"), F.col("l1").alias("l"), F.when(F.col("w3").isNull(), F.col("w2")).otherwise(three).alias("rest"))
    second_cut = F.struct(F.lit(2).alias("k"), F.col("l2").alias("l"), F.col("w3").alias("rest"))
    cuts = nodes.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.col("w3").isNull().alias("short"),
        F.explode(F.when(F.col("w3").isNull(), F.array(first_cut)).otherwise(F.array(first_cut, second_cut))).alias("cut"),
    ).select("lang", "phrase", "a", "short", "cut.*")
    known = words.filter(F.col("n") >= least).select("lang", F.col("word").alias("rest"), F.col("n").alias("r"))
    known = known.unionByName(nodes.filter("w3 is null").select("lang", two.alias("rest"), F.col("a").alias("r")))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    up = F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a"))
    cuts = cuts.join(known, ["lang", "rest"]).withColumn("score", F.call_function("div", up, exact("l") * exact("r")).cast("long"))
    scored = cuts.groupBy("lang", "phrase", "a", "short").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    longer = nodes.filter("w3 is not null").select("lang", F.explode(F.array(two, three)).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest")).withColumn("short", F.lit(True))
    left = scored.join(longer, ["lang", "phrase", "short"], "left").filter(F.col("longest").isNull() | (100 * F.col("longest") < cover * F.col("a")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase"))
    left = left.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return left.join(sizes, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")
