"""Benchmark decontamination: documents that hold a benchmark item within an edit budget.

An item of n characters may differ by floor(rate * n) edits. Split into one piece more than that, at least one piece is
found unchanged wherever the item occurs. An Aho-Corasick automaton over all pieces finds those hits. Myers' bit-parallel
distance verifies the text around a hit: first for the part of the item that the piece was split from, within that part's
share of the budget, then for larger parts, at last for the whole item, so that chance hits cost little.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 0.08
#: Distances that a task remembers.
KNOWN = 50_000
#: Bytes of items in one automaton, which is one broadcast; more items take more automata.
ITEM_BYTES = 16 << 20
#: Bytes of items in all. The benchmark is the stated query set and has to fit the driver; this is checked.
ALL_BYTES = 256 << 20


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: int) -> list[list[tuple[int, int, int]]]:
    """errors + 1 pieces of nearly equal length, each as its way from the piece up to the whole: (start, end, budget).

    A part with budget k is split into two whose budgets sum to k - 1, so one of them keeps to its own; at 0 a piece stays.
    """

    def split(a: int, b: int, k: int, above: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
        way = [(a, b, k), *above]
        if k == 0:
            return [way]
        left = k // 2
        cut = a + (b - a) * (left + 1) // (k + 1)
        return split(a, cut, left, way) + split(cut, b, k - 1 - left, way)

    return split(0, len(item), errors, [])


def bit_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def distance_within(masks: dict[str, int], m: int, text: str) -> int:
    """The least edit distance between a pattern of m characters, given by its masks, and any substring of ``text``."""
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = ones, 0, m, m
    get = masks.get
    for c in text:
        eq = get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (ones & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph, mh, xv = (ph << 1) & ones, (mh << 1) & ones, eq | mv
        pv = mh | (ones & ~(xv | ph))
        mv = ph & xv
    return best


class Finder:
    """Looks for the items in one text after the other."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        self.items = [(k, text, int(rate * len(text))) for k, text in items]
        self.masks: dict[str, dict[str, int]] = {}
        self.known: dict[tuple[str, str], int] = {}
        places: dict[str, list[tuple[int, list[tuple[int, int, int]]]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for way in pieces(text, errors):
                places.setdefault(text[way[0][0]:way[0][1]], []).append((n, way))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.any = bool(places)

    def distance(self, part: str, text: str) -> int:
        """Remembered, as chance hits are mostly the same few phrases."""
        known = self.known.get((part, text))
        if known is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            masks = self.masks.get(part)
            if masks is None:
                masks = self.masks[part] = bit_masks(part)
            known = self.known[part, text] = distance_within(masks, len(part), text)
        return known

    def verify(self, text: str, at: int, item: str, way: list[tuple[int, int, int]]) -> int | None:
        """The edits of the item that starts near ``at``, None if a part on the way or the whole is over its budget."""
        if text[max(at, 0):at + len(item)] == item:
            return 0
        edits = 0
        for a, b, k in way[1:]:
            edits = self.distance(item[a:b], text[max(at + a - k, 0):max(at + b + k, 0)])
            if edits > k:
                return None
        return edits if len(way) > 1 else 0

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item, edits) of the items within their budgets."""
        if not self.any or not text:
            return []
        text = normal(text)
        best: dict[int, int] = {}
        for end, (length, where) in self.automaton.iter(text):
            for n, way in where:
                if best.get(n) != 0:
                    edits = self.verify(text, end + 1 - length - way[0][0], self.items[n][1], way)
                    if edits is not None and edits < best.get(n, edits + 1):
                        best[n] = edits
        return sorted(((self.items[n][0], e) for n, e in best.items()), key=lambda x: (x[0] is None, x))


def item_blocks(benchmark: DataFrame, limit: int = ITEM_BYTES) -> list[list[tuple[int, str]]]:
    """The distinct items in blocks of at most ``limit`` bytes; an error beyond ``ALL_BYTES``, before they are fetched."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > ALL_BYTES:
        raise ValueError(f"{total} bytes of benchmark items; at most {ALL_BYTES} at once, so call this for parts of them")
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for row in benchmark.select("item_id", "text").distinct().toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        if size + 4 * len(text) > limit and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((row["item_id"], text))
        size += 4 * len(text)
    return blocks


def finder(spark: SparkSession, items: list[tuple[int, str]], rate: float):
    """A column function: text -> array of (item_id, edits)."""
    shared = spark.sparkContext.broadcast(items)

    @F.pandas_udf("array<struct<item_id: long, edits: int>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = Finder(shared.value, rate)
        for texts in batches:
            yield pd.Series([[{"item_id": k, "edits": e} for k, e in search.find(t)] for t in texts], dtype=object)

    return found


def hits_column(documents: DataFrame, benchmark: DataFrame, rate: float, limit: int) -> Column:
    """All (item_id, edits) found in column text; each block of items is a column function of its own."""
    blocks = item_blocks(benchmark, limit)
    return F.concat(*[finder(documents.sparkSession, b, rate)("text") for b in blocks])


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, limit: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, least_edits) per row of ``documents``.

    Texts and items are compared in lower case with runs of white space as one blank. An item is found if some substring
    of the whole text is within floor(rate * characters) edits of it. Null and empty texts hold nothing; null and empty
    items are never found; repeated items count once per item_id. least_edits is null without a hit. Repeated rows keep one
    row each; empty tables give no rows, or no hits; other columns are not read.
    """
    rows = documents.select("doc_id", hits_column(documents, benchmark, rate, limit).alias("hits"))
    ids = F.array_sort(F.array_distinct("hits.item_id"))
    return rows.select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), F.size(ids).alias("n_items"), ids.alias("item_ids"),
        F.array_min("hits.edits").alias("least_edits"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, limit: int = ITEM_BYTES) -> DataFrame:
    """``documents`` without rows that hold a benchmark item; all columns kept. See ``benchmark_hits``."""
    return documents.filter(F.size(hits_column(documents, benchmark, rate, limit)) == 0)
