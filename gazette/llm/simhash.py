"""Near-duplicate detection on 64-bit SimHash fingerprints by the generalised pigeonhole principle.

Bits that agree or disagree together are put into one partition. Partition i gets a threshold t_i of its own, -1 meaning
that it is not probed; if the sum of all t_i + 1 is at least distance + 1, two fingerprints within the distance are within
t_i in some partition. Thresholds come from dynamic programming over probes and estimated candidates. Candidates are
verified by the Hamming distance of the whole fingerprints.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import stored

BITS = 64
#: Shingles whose bits are counted at once.
BLOCK = 65_536
#: Larger buckets are not paired but go through shared neighbours, which finds the same links.
BUCKET = 256
#: Cost of a probe row against that of a candidate pair.
PROBE_COST, PAIR_COST = 4.0, 1.0


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """The fingerprint as a signed number; bit i is 1 if it is set in over half of the shingle hashes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = list(zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist(), strict=True))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans[at:at + BLOCK]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(documents: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) per row. Words are cut at ASCII white space after A-Z is lower-cased; a null text counts as empty.

    Fewer words than a shingle give one shingle of all words, no word gives 0.
    """

    return documents.select("doc_id", _print_column("text", shingle, seed).alias("fp"))


def _print_column(column: str, shingle: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle, seed) for t in texts], dtype="int64")

    return prints(column)


# --- partitions and thresholds --------------------------------------------------------------------------------


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and how often each pair of bits is set together, over all of them."""

    def counts(batches):
        total = np.zeros((BITS, BITS))
        seen = 0
        for batch in batches:
            hashes = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(hashes), BLOCK):
                part = np.ascontiguousarray(hashes[at:at + BLOCK]).astype("<i8")
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                seen += len(part)
        yield pa.RecordBatch.from_pydict({"seen": pa.array([seen]), "joint": pa.array([total.astype(np.int64).ravel()])})

    rows = nodes.select("fp").mapInArrow(counts, "seen long, joint array<long>")
    summed = (
        rows.select("seen", F.posexplode("joint").alias("at", "n")).groupBy("at")
        .agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")).toPandas()  # 4,096 rows at any size
    )
    joint = np.zeros(BITS * BITS)
    joint[summed["at"]] = summed["n"]
    return int(summed["seen"].iloc[0]) if len(summed) else 0, joint.reshape(BITS, BITS)


def correlated_groups(seen: int, joint: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` groups of bits of nearly equal width; a group grows by the bit most correlated with it."""
    p = np.diag(joint) / max(seen, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(joint / max(seen, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = list(range(BITS)), []
    for i in range(parts):
        width = math.ceil(len(left) / (parts - i))
        group = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda b: corr[b, group].sum()))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def within(width: int, threshold: int) -> int:
    """Values at most so many bits away from one."""
    return sum(math.comb(width, j) for j in range(threshold + 1))


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up that sum to ``total`` at the least cost; costs[i][t + 1] is that of threshold t in partition i."""
    best = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, own in enumerate(row, start=-1):
                if spent + t not in step or cost + own < step[spent + t][0]:
                    step[spent + t] = (cost + own, [*chosen, t])
        best = step
    return best[total]


def masked(fp: Column, bits: list[int]) -> Column:
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def flips(bits: list[int], threshold: int) -> list[int]:
    """The numbers that change at most so many of the bits, as signed 64-bit values."""
    out = [0]
    for j in range(1, threshold + 1):
        out += [sum(1 << b for b in some) for some in itertools.combinations(bits, j)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def plan_partitions(nodes: DataFrame, distance: int, layouts: tuple[int, ...] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """The cheapest partitioning: (bits, threshold) of each partition that is probed.

    Candidates at threshold 0 are counted over all fingerprints; those of larger thresholds follow from them and the
    share of pairs that differ in few of the partition's bits if bits were independent.
    """
    seen, joint = bit_statistics(nodes)
    if seen < 2:
        return []
    differ = 2 * (p := np.diag(joint) / seen) * (1 - p)
    by_layout = {m: correlated_groups(seen, joint, m) for m in layouts}
    flat = [(m, i, bits) for m, groups in by_layout.items() for i, bits in enumerate(groups)]
    values = F.array(*[F.struct(F.lit(k).alias("k"), masked(F.col("fp"), bits).alias("value")) for k, (_, _, bits) in enumerate(flat)])
    pairs = (
        nodes.select(F.inline(values)).groupBy("k", "value").count().groupBy("k")
        .agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1)).alias("pairs")).collect()  # one row a partition
    )
    same = {r["k"]: r["pairs"] for r in pairs}
    choices = []
    for m, groups in by_layout.items():
        costs = []
        for i, bits in enumerate(groups):
            near = np.array([1.0])  # chances of 0, 1, ... differing bits
            for b in bits:
                near = np.convolve(near, [1 - differ[b], differ[b]])[:distance + 1]
            row = [0.0]
            for t in range(distance + 1):
                found = max(same[flat.index((m, i, bits))], seen * (seen - 1) * near[0]) * near[:t + 1].sum() / max(near[0], 1e-300)
                row.append(PROBE_COST * seen * within(len(bits), t) + PAIR_COST * min(found, float(seen) ** 2))
            costs.append(row)
        cost, chosen = allocate(costs, distance - m + 1)
        choices.append((cost, [(bits, t) for bits, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


# --- links ----------------------------------------------------------------------------------------------------


def neighbour_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) that connect all of ``nodes`` within two bits, without pairs.

    Two values within two bits share a value at most one bit away from both. At most 65 values lie around one, so a group
    never holds more, and all in a group are within two bits of each other: a star from the smallest connects them.
    """
    around = F.array(*[F.lit(x) for x in flips(list(range(BITS)), 1)])
    spread = nodes.select("fp", F.explode(F.transform(around, lambda x: x.bitwiseXOR(F.col("fp")))).alias("centre"))
    groups = spread.groupBy("centre").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    star = groups.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v"))
    return star.filter("u <> v").distinct()


def _probe(part: int, bits: list[int]):
    return lambda flip: F.struct(F.lit(part).alias("part"), masked(F.col("fp"), bits).bitwiseXOR(flip).alias("value"))


def links(nodes: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v), u < v, between distinct fingerprints (column fp) that connect all within ``distance`` bits.

    Buckets of up to ``bucket`` values are probed pair by pair. What lies in or probes a larger one is linked through
    shared neighbours, an exact way for distances up to 2; for larger distances every bucket is probed.
    """
    parts = plan_partitions(nodes, distance)
    if not parts:
        return nodes.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    entries = F.array(*[
        F.struct(F.lit(i).alias("part"), masked(F.col("fp"), bits).alias("value")) for i, (bits, _) in enumerate(parts)
    ])
    probes = F.concat(*[
        F.transform(
            F.array(*[F.lit(x) for x in flips(bits, t)]),
            _probe(i, bits),
        ) for i, (bits, t) in enumerate(parts)
    ])
    data = nodes.select(F.col("fp").alias("v"), F.inline(entries))
    asks = nodes.select(F.col("fp").alias("u"), F.inline(probes))
    sizes = data.groupBy("part", "value").count()
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    if distance > 2:
        return asks.join(data, ["part", "value"]).filter(near & (F.col("u") < F.col("v"))).select("u", "v").distinct()
    large = stored(sizes.filter(F.col("count") > bucket).select("part", "value"), "large-buckets")
    crowd = nodes.join(asks.join(large, ["part", "value"], "left_semi").select(F.col("u").alias("fp")).distinct(), "fp", "left_semi")
    left, right = asks.join(large, ["part", "value"], "left_anti").alias("a"), data.alias("d")
    same = (F.col("a.part") == F.col("d.part")) & (F.col("a.value") == F.col("d.value"))
    verified = left.join(right, same & (F.col("u") < F.col("v")) & near).select("u", "v")
    return verified.union(neighbour_links(crowd)).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of the undirected edges (u, v); the root is the smallest node it can reach.

    Large-star and small-star rounds alternate; their number grows with the logarithm of the longest path. Each round is
    a written table. Stops with an error instead of a partial answer if ``max_rounds`` are not enough.
    """
    last = None
    edges = stored(edges.select("u", "v"), "edges")
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        met = down.join(least, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = stored(small.filter("u <> v").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = state
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")


def classified(documents: DataFrame, shingle: int = 3, seed: int = 42, distance: int = 2) -> DataFrame:
    """(doc_id, fp, root, component_id) per row, written; root is the smallest fingerprint of the component."""
    prints = stored(fingerprints(documents, shingle, seed), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, distance))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed, "placed")
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(placed.join(lowest, "root").select("fp", "root", "component_id"), "classes")
    return stored(prints.join(classes, "fp").select("doc_id", "fp", "root", "component_id"), "classified")


def near_duplicates(documents: DataFrame, shingle: int = 3, seed: int = 42, distance: int = 2) -> DataFrame:
    """One row per row of ``documents``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most ``distance`` differing bits, the row's own
    included; equal texts are linked. A null doc_id is never a component_id unless no other is reachable: then it is null.
    Null and empty texts share fingerprint zero. Repeated rows keep one row each; an empty table gives no rows. Other
    columns are not read.
    """
    return classified(documents, shingle, seed, distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_each(documents: DataFrame, shingle: int = 3, seed: int = 42, distance: int = 2) -> DataFrame:
    """``documents`` with one row of each component, all columns kept: that of the smallest doc_id.

    Of rows that share this doc_id, or of a component without any doc_id, the row of the smallest text hash stays, ties by
    text. Texts are not shuffled but for those rows: the doc_ids to leave out are joined to the documents.
    """
    classes = classified(documents, shingle, seed, distance)
    known = classes.filter("doc_id is not null")
    again = known.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_id"))
    later = known.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id"))
    out = stored(again.union(later).distinct(), "left-out")
    again = stored(again, "again")
    # rows as one column, so that no name of theirs meets another
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    own = F.col("_row.doc_id")
    single = rows.filter(own.isNotNull()).join(out, own == F.col("_id"), "left_anti")

    rest = rows.join(again, own == F.col("_id"), "left").filter(own.isNull() | F.col("_id").isNotNull())
    rest = rest.select("_row", F.col("_row.text").alias("_text")).withColumn("_fp", _print_column("_text", shingle, seed))
    firsts = classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "fp", "root").distinct()
    # null-safe, or else the optimizer asks for prints that are not null before the first join: those of all texts, once more
    rest = rest.join(firsts, F.col("_fp").eqNullSafe(F.col("fp")) & own.eqNullSafe(F.col("doc_id")))
    picked = rest.groupBy("root").agg(F.min_by("_row", F.struct(F.xxhash64("_text"), "_text")).alias("_row"))
    return single.select("_row.*").unionByName(picked.select("_row.*"))
