"""Approximate nearest neighbours by inner product over balanced posting lists.

Centroids are the leaves of a tree whose nodes are cut in equal halves, so lists are balanced. Vectors near a boundary are put
on several lists. Lists of a vector are found by a search in a graph of the centroids that every task holds. A query reads the
lists whose centroid is at most a ratio farther than the nearest one; the ratio is fitted to a recall on a sample.

Inner products become distances by one more component, sqrt(largest norm^2 - norm^2), which is 0 for queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import stored

#: Vectors that centroids and ratio are fitted on at most, on average; centroids at most, which bounds the broadcast.
SAMPLE, CENTROIDS = 20_000, 8_192
#: Vectors per list that is aimed at, lists of a vector at most, and how much farther such a list may be.
LIST, COPIES, SPREAD = 400, 3, 1.1
#: Recall that the ratio is fitted to, with sample queries against the sample.
RECALL, TRIALS = 0.975, 300
#: Neighbours of a centroid in the graph.
DEGREE = 16
#: Vectors of a list in one block, in one shard, and queries in one cell, at most.
BLOCK, SHARD, QUERIES = 2_000, 20_000, 4_000


# --- the index ------------------------------------------------------------------------------------------------


def halves(vectors: np.ndarray, leaves: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Index sets of ``leaves`` leaves of nearly equal size: two means, then the median of the difference to both."""

    def cut(own: np.ndarray, n: int) -> list[np.ndarray]:
        if n <= 1 or len(own) < 2:
            return [own]
        x = vectors[own]
        a, b = x[rng.choice(len(own), 2, replace=False)]
        for _ in range(6):
            side = x @ (a - b)
            order = np.argsort(side, kind="stable")
            at = len(own) * (n // 2) // n
            a, b = x[order[at:]].mean(axis=0), x[order[:max(at, 1)]].mean(axis=0)
        return cut(own[order[:at]], n // 2) + cut(own[order[at:]], n - n // 2)

    return [leaf for leaf in cut(np.arange(len(vectors)), leaves) if len(leaf)]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0))


def make_graph(centres: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Half of a centroid's neighbours are the nearest, half lie at growing ranks, so that far ones are a few steps away."""
    n = len(centres)
    near = min(degree, n - 1)
    if near < 1:
        return np.zeros((n, 1), int)
    ranks = np.unique(np.concatenate([np.arange(1, near // 2 + 2), np.geomspace(near // 2 + 1, n - 1, near // 2 + 1).astype(int)]))
    return np.stack([np.argsort(distances(centres[i:i + 1], centres)[0], kind="stable")[ranks[ranks < n]] for i in range(n)])


def search(queries: np.ndarray, centres: np.ndarray, graph: np.ndarray, width: int) -> np.ndarray:
    """Distances of each query to the centroids that a best-first search over the graph visits, infinite for the others.

    A search ends when the ``width`` nearest centroids seen have all been expanded; all queries step together.
    """
    n, c = len(queries), len(centres)
    width = min(width, c)
    seen = np.full((n, c), np.inf)
    fresh = np.full((n, c), np.inf)  # seen but not expanded
    entry = np.unique(np.linspace(0, c - 1, min(c, 8)).astype(int))
    seen[:, entry] = fresh[:, entry] = distances(queries, centres[entry])
    active = np.arange(n)
    steps = 4
    while len(active):
        best = np.argpartition(fresh[active], min(steps, c) - 1, axis=1)[:, :steps]
        bound = np.partition(seen[active], width - 1, axis=1)[:, width - 1]
        gain = np.take_along_axis(fresh[active], best, axis=1) <= bound[:, None]
        gain &= np.isfinite(np.take_along_axis(fresh[active], best, axis=1))
        some = gain.any(axis=1)
        active, best, gain = active[some], best[some], gain[some]
        if not len(active):
            break
        fresh[active[:, None], best] = np.where(gain, np.inf, fresh[active[:, None], best])
        row = np.repeat(active, gain.sum(axis=1) * graph.shape[1])
        col = graph[best[gain]].ravel()
        new = np.isinf(seen[row, col])
        pair = np.unique(row[new] * c + col[new])
        row, col = pair // c, pair % c
        d = np.sqrt(np.maximum(((queries[row] - centres[col]) ** 2).sum(axis=1), 0))
        seen[row, col] = fresh[row, col] = d
    return seen


def chosen(seen: np.ndarray, ratio: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of lists at most ``ratio`` times as far as the nearest, ``most`` per row at most."""
    ok = seen <= ratio * seen.min(axis=1, keepdims=True) + 1e-12
    if most is not None and most < seen.shape[1]:
        ok &= seen <= np.partition(seen, most - 1, axis=1)[:, most - 1:most]
        ok &= np.cumsum(ok, axis=1) <= most  # ties
    return np.nonzero(ok)


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """With the component that makes the nearest the one of the largest inner product."""
    return np.column_stack([vectors, np.sqrt(np.maximum(top - (vectors * vectors).sum(axis=1), 0))])


def fit(vectors: np.ndarray, top: float, total: int, k: int) -> dict:
    """Centroids, graph, ratio and search width from a sample of the vectors; ``total`` of them are to be indexed."""
    rng = np.random.default_rng(7)
    points = lifted(vectors, top)
    leaves = int(np.clip(round(total / LIST), 1, min(CENTROIDS, max(len(points) // 4, 1))))
    centres = np.stack([points[leaf].mean(axis=0) for leaf in halves(points, leaves, rng)])
    graph = make_graph(centres)
    on = np.zeros((len(points), len(centres)), bool)
    for at in range(0, len(points), 512):
        row, lists = chosen(search(points[at:at + 512], centres, graph, 4 * COPIES), SPREAD, COPIES)
        on[at + row, lists] = True
    picks = rng.permutation(len(points))[:TRIALS]
    asks = np.column_stack([vectors[picks], np.zeros(len(picks))])
    score = vectors[picks] @ vectors.T
    score[np.arange(len(picks)), picks] = -np.inf
    k = min(k, len(points) - 1)
    if k < 1:
        return {"centres": centres, "graph": graph, "ratio": np.inf, "width": len(centres), "top": top}
    truth = np.argpartition(-score, k - 1, axis=1)[:, :k]
    far = distances(asks, centres)
    # the ratio that reaches a true neighbour: the nearest list that holds it
    reach = np.stack([np.where(on[t], f, np.inf).min(axis=1) / f.min() for t, f in zip(truth, far, strict=True)])
    ratio = float(np.quantile(reach, RECALL))
    width = int((far <= ratio * far.min(axis=1, keepdims=True)).sum(axis=1).max())
    return {"centres": centres, "graph": graph, "ratio": ratio, "width": width + width // 4 + 1, "top": top}


# --- the search -----------------------------------------------------------------------------------------------


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part: a vec_id, and a vector that is not null, empty or zero and holds only
    finite numbers. Vectors of another length than the most frequent one (the longest of equals) take no part."""
    v = F.col("vector")
    rows = embeddings.select("vec_id", F.col("embedding").alias("vector")).filter(
        F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("vector") == (sizes["n"] if sizes else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def lists_of(rows: DataFrame, model, query: bool) -> DataFrame:
    """(list, vec_id, vector): the lists that hold a vector, or that a query reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                vectors = matrix(part.column("vector"))
                points = np.column_stack([vectors, np.zeros(len(vectors))]) if query else lifted(vectors, m["top"])
                seen = search(points, m["centres"], m["graph"], m["width"] if query else 4 * COPIES)
                row, lists = chosen(seen, m["ratio"]) if query else chosen(seen, SPREAD, COPIES)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *taken.columns], ["list", "vec_id", "vector"])

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.mapInArrow(run, f"list int, vec_id {rows.schema['vec_id'].dataType.simpleString()}, vector {kind}")


def best_of(score: np.ndarray, asks: np.ndarray, holds: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, candidate) that may be among the k best vec_ids of a row; rounding cannot cost a place, so ties all stay.

    ``ids``: the vec_ids of the candidates, in order. A repeated one takes one of the k places, that of its best vector.
    """
    starts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
    best = score if len(starts) == len(ids) else np.maximum.reduceat(score, starts, axis=1)
    if best.shape[1] > k:
        least = np.partition(best, best.shape[1] - k, axis=1)[:, -k][:, None]
        scale = np.linalg.norm(asks, axis=1)[:, None] * np.linalg.norm(holds, axis=1).max()
        return np.nonzero(score >= least - 1e-9 * scale)
    return np.nonzero(score > -np.inf)


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row of ``embeddings`` that ``is_query`` holds for.

    Columns read: vec_id, embedding. Candidates are all usable rows but those with the query's own vec_id; nearness is the
    largest inner product in double precision, ties go to the smaller vec_id. A repeated vec_id counts once, by its best
    vector as candidate; as a query each of its vectors asks and the best answers are kept. Rows that ``usable`` leaves out
    take no part. Every usable row is on at least one list. Empty tables give no rows.
    """
    spark = embeddings.sparkSession
    rows = stored(usable(embeddings).distinct(), "vectors")  # a repeated row must not take part in the sample either
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, top = rows.agg(F.count("*"), F.max(norm)).first()
    share = min(1.0, sample / max(total, 1))
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("vector")
    vectors = matrix(drawn.toArrow().column("vector"))
    if not len(vectors):
        vectors = matrix(rows.limit(1).select("vector").toArrow().column("vector"))
    if not len(vectors):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = spark.sparkContext.broadcast(fit(vectors, top, total, k))

    holds = stored(lists_of(rows, model, query=False), "postings")
    asks = stored(lists_of(rows.filter(is_query), model, query=True), "asks")
    sizes = holds.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row a centroid at most
    n_lists = max(1, int(np.ceil(holds.count() / SHARD)))
    shard = F.pmod(F.xxhash64("list", "block"), F.lit(n_lists)).cast("int").alias("shard")
    holds = holds.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).cast("int")).select("list", "block", shard, "vec_id", "vector")
    asks = asks.join(sizes, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "block", shard, "vec_id", "vector")
    # many queries of one shard are dealt to cells; each cell has the shard's vectors
    many = asks.groupBy("shard").agg(F.ceil(F.approx_count_distinct("vec_id") / QUERIES).cast("int").alias("cells"))
    asks = asks.join(many, "shard").withColumn("cell", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("cells")).cast("int"))
    holds = holds.join(many, "shard").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    columns = ["shard", "cell", "list", "block", "vec_id", "vector"]
    both = asks.select(F.lit(True).alias("asks"), *columns).union(holds.select(F.lit(False), *columns))

    def compare(table: pa.Table) -> pa.Table:
        own = table.column("asks").to_numpy()
        place = table.column("list").to_numpy().astype(np.int64) << 32 | table.column("block").to_numpy()
        ids, vectors = table.column("vec_id").to_numpy(), matrix(table.column("vector"))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for p in np.unique(place[own]):
            q, h = np.flatnonzero(own & (place == p)), np.flatnonzero(~own & (place == p))
            h = h[np.argsort(ids[h], kind="stable")]
            for at in range(0, len(q) if len(h) else 0, 512):
                part = q[at:at + 512]
                score = vectors[part] @ vectors[h].T
                score[ids[part][:, None] == ids[h]] = -np.inf
                i, j = best_of(score, vectors[part], vectors[h], ids[h], k)
                keep = np.isfinite(score[i, j])
                i, j = part[i[keep]], h[j[keep]]
                found.append((ids[i], ids[j], (vectors[i] * vectors[j]).sum(axis=1)))
        query, vec, score = (np.concatenate(c) if found else np.zeros(0) for c in (zip(*found, strict=True) if found else ((), (), ())))
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        first = np.unique(np.stack([query, vec]), axis=1, return_index=True)[1] if len(query) else np.zeros(0, int)
        first.sort()
        query, vec, score = query[first], vec[first], score[first]
        rank = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        keep = rank < k
        return pa.table({"query_id": pa.array(query[keep], pa.int64()), "vec_id": pa.array(vec[keep], pa.int64()), "score": pa.array(score[keep], pa.float64())})

    pairs = both.groupBy("shard", "cell").applyInArrow(compare, "query_id long, vec_id long, score double")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
