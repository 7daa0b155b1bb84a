"""How the sources of a language differ in their terms, by ranking cells of equal counts.

A term matters to a source only through its count there and its count in the language (or in the other source). Terms are
therefore grouped into cells of equal counts; the measure is evaluated once per cell, cells are ranked by the running sum of
their sizes, and only the cells that reach the report are expanded into terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import stored
from gazette.llm.words import WORD_BYTES, Numbered, bytes_of, slices, strings

LEAST_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
#: Entries (a document's distinct terms) that a task adds up before it passes them on.
ENTRIES = 1_000_000
#: Upper case becomes lower case; every other byte below 0x80 parts terms.
TERMS = bytes((c + 32) if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"


def document_terms(text: bytes, words: Numbered) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a text's distinct terms, and how often each occurs."""
    parts = [np.unique(words.ids(part.split()), return_counts=True) for part in slices(text.translate(TERMS))]
    if len(parts) == 1:
        return parts[0]
    ids, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return ids, np.bincount(place, np.concatenate([p[1] for p in parts]), len(ids)).astype(np.int64)


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents that hold it, per language and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, groups, held, size = Numbered(), {}, [], 0

        def added_up() -> Iterator[pa.RecordBatch]:
            width = len(words) + 1
            keys = np.concatenate([g * width + ids for g, ids, _ in held])
            distinct, place = np.unique(keys, return_inverse=True)
            n = np.bincount(place, np.concatenate([c for _, _, c in held]), len(distinct)).astype(np.int64)
            docs = np.bincount(place, minlength=len(distinct))
            group, term = np.divmod(distinct, width)
            langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
            table = words.array()
            for a in range(0, len(distinct), 20_000):
                b = slice(a, a + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(group[b])), sources.take(pa.array(group[b])), strings(table, term[b]), pa.array(n[b]), pa.array(docs[b])],
                    ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            rows = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), bytes_of(batch.column("text")), strict=True)
            for lang, source, text in rows:
                ids, counts = document_terms(text, words)
                if len(ids):
                    held.append((groups.setdefault((lang, source), len(groups)), ids, counts))
                    size += len(ids)
                if size >= ENTRIES or words.bytes >= WORD_BYTES:
                    if held:
                        yield from added_up()
                    words, groups, held, size = Numbered(), {}, [], 0
        if held:
            yield from added_up()

    counted = documents.select("lang", "source", "text").mapInArrow(run, COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), in whole numbers of any size that occurs; total + terms > 0."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return F.call_function("div", up, F.greatest(total.cast("decimal(20,0)") + 2 * terms.cast("decimal(19,0)"), F.lit(1).cast("decimal(20,0)"))).cast("long") + 1


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most 10^9 + 1, so the square fits in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from its other sources and from all.

    Terms are runs of ASCII letters and characters from U+0080 on, with only A-Z lower-cased; null text, lang and source are
    ''. A language keeps the V terms in at least ``least_docs`` of its documents. With N a group's occurrences of kept
    terms, each kept term has there the share p = 1 + floor(10^9 (count + 2) / (N + 2 V)), count 0 included. Two shares
    differ by floor((p - q)^2 / (p + q)). Part ``pair`` has every other source of the language and the sum over all kept
    terms (0 without any). Part ``term`` has the kept terms that occur in the source with a share above the language's, the
    first ``top``. Ranks count from 1 by falling value, then by item in UTF-8 order. Repeated rows count as often as they
    stand; doc_id is not read; an empty table gives no rows; other columns are not read. Whole texts of any length count.
    """
    texts = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = stored(term_counts(texts), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    own = stored(
        counts.join(kept.drop("docs"), ["lang", "term"]).select("lang", "source", "term", F.col("n").alias("c"), F.col("all_n").alias("d")),
        "divergence-kept")

    by_lang = own.groupBy("lang", "term").agg(F.first("d").alias("d")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("d").alias("lang_total"))
    by_group = own.groupBy("lang", "source").agg(F.count("*").alias("held"), F.sum("c").alias("total"))
    groups = stored(
        texts.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0),
        "divergence-groups")

    # Part term: cells of (count in the source, count in the language); equal values of a group become one.
    cells = own.groupBy("lang", "source", "c", "d").agg(F.count("*").alias("m")).join(groups, ["lang", "source"])
    p, q = share(F.col("c"), F.col("total"), F.col("terms")), share(F.col("d"), F.col("lang_total"), F.col("terms"))
    cells = cells.withColumn("p", p).withColumn("q", q).filter("p > q").withColumn("value", difference(F.col("p"), F.col("q")))
    cells = stored(cells.select("lang", "source", "c", "d", "m", "value"), "divergence-cells")
    group = Window.partitionBy("lang", "source")
    values = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    values = values.withColumn("place", F.row_number().over(group.orderBy(F.desc("value")))).filter(F.col("place") <= top)
    before = F.coalesce(F.sum("m").over(group.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = values.withColumn("before", before).filter(F.col("before") < top).groupBy("lang", "source").agg(F.min("value").alias("least"))
    reported = cells.join(reached, ["lang", "source"]).filter(F.col("value") >= F.col("least")).select("lang", "source", "c", "d", "value")
    terms = own.join(reported, ["lang", "source", "c", "d"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = F.row_number().over(group.orderBy(F.desc("value"), "item"))
    terms = terms.withColumn("rank", ranked).filter(F.col("rank") <= top)

    # Part pair: the cells (c, 0), (0, c) and (0, 0) follow from each group's own counts as if no term were shared; each
    # shared term then moves from there to its cell (c, d).
    f = difference
    a = groups.select("lang", "source", F.col("total").alias("total_a"), F.col("held").alias("held_a"), "terms")
    b = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("total_b"), F.col("held").alias("held_b"))
    pairs = a.join(b, "lang").filter("source <> item")
    zero_a, zero_b = share(F.lit(0), F.col("total_a"), F.col("terms")), share(F.lit(0), F.col("total_b"), F.col("terms"))
    p, q = share(F.col("c"), F.col("total_a"), F.col("terms")), share(F.col("d"), F.col("total_b"), F.col("terms"))
    neither = pairs.withColumn("value", (F.col("terms") - F.col("held_a") - F.col("held_b")) * f(zero_a, zero_b))
    alone = own.groupBy("lang", "source", "c").agg(F.count("*").alias("m")).join(pairs, ["lang", "source"]).withColumn("value", F.col("m") * f(p, zero_b))
    both = lambda frame: frame.select("lang", F.explode(F.array(  # noqa: E731 - a pair of sources counts for both
        F.struct("source", "item", "value"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"))).alias("x")).select("lang", "x.*")
    other = own.select("lang", "term", F.col("source").alias("item"), F.col("c").alias("d"))
    shared = own.select("lang", "term", "source", "c").join(other, ["lang", "term"]).filter("source < item")
    shared = shared.groupBy("lang", "source", "item", "c", "d").agg(F.count("*").alias("m")).join(pairs, ["lang", "source", "item"])
    shared = shared.withColumn("value", F.col("m") * (f(p, q) - f(p, zero_b) - f(zero_a, q) + f(zero_a, zero_b)))
    columns = ["lang", "source", "item", "value"]
    sums = neither.select(columns).unionByName(both(alone)).unionByName(both(shared)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", ranked)
    return sums.unionByName(terms)
