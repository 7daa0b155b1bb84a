"""Toxicity by a linear-chain conditional random field over the tokens of each sentence.

Labels belong to documents. A token of a labelled toxic document counts as labelled toxic if its word stands in
significantly more contexts of toxic documents than chance allows. The field learns word, association and neighbour weights and
transitions from such sentences. Forward-backward marginals of every token give the score of a document and its spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import stored

#: Labelled documents that the field is fitted on, about; drawn by a hash. Words it may know.
SAMPLE, WORDS = 20_000, 20_000
#: Association (signed log-likelihood ratio) from which a word is known, and from which its tokens are labelled toxic.
KNOWN, TOXIC = 12.0, 25.0
BINS = (16.0, 25.0, 40.0)
#: Distinct chains of the sample that the field is fitted on at most.
CHAINS = 8_000
#: A chain is a sentence, cut after so many tokens.
CHAIN = 64
#: Share of the chains without any known word that are trained on.
NEUTRAL = 0.02
THRESHOLD = 0.7
#: Chains that go through the field at once, and texts whose chains are gathered for it.
AT_ONCE = 2_048
TOKEN = re.compile(r"\w+|[.!?\n]")
ENDS = frozenset(".!?\n")


def chains(words: list[str]) -> Iterator[tuple[int, int]]:
    """(start, end) of the chains in a list of tokens; sentence ends belong to none."""
    start = 0
    for i, w in enumerate(words):
        if w in ENDS:
            if i > start:
                yield start, i
            start = i + 1
        elif i - start == CHAIN:
            yield start, i
            start = i
    if len(words) > start:
        yield start, len(words)


# --- the field ------------------------------------------------------------------------------------------------


def padded(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Chains of word codes (0: unknown) as rows with a zero in front and behind, and their lengths."""
    length = np.array([len(c) for c in found], int)
    rows = np.zeros((len(found), max(length, default=0) + 2), np.int32)
    for i, c in enumerate(found):
        rows[i, 1:len(c) + 1] = c
    return rows, length


class Field:
    """Weights of the field. The emission is that of the toxic state against the other one.

    Its own word, the association bins of the word and its two neighbours, and a constant add up.
    """

    def __init__(self, bins: np.ndarray) -> None:
        self.bins = bins  # of each code, 0 for the unknown word
        self.word = np.zeros(len(bins))
        self.own, self.before, self.after = (np.zeros(len(BINS) + 2) for _ in range(3))
        self.bias = np.array([-3.0])
        self.move = np.zeros((2, 2))

    def emission(self, rows: np.ndarray) -> np.ndarray:
        at = self.bins[rows]
        return self.bias[0] + self.word[rows[:, 1:-1]] + self.own[at[:, 1:-1]] + self.before[at[:, :-2]] + self.after[at[:, 2:]]

    def marginals(self, rows: np.ndarray, length: np.ndarray, pairs: bool = False):
        """Per token the probability of the toxic state, 0 beyond a chain's end; with ``pairs`` also those of transitions."""
        e = self.emission(rows)
        n, size = e.shape
        emit = np.stack([np.zeros_like(e), e], axis=2)
        alpha, beta = np.empty((n, size, 2)), np.zeros((n, size, 2))
        alpha[:, 0] = emit[:, 0]
        for t in range(1, size):
            step = alpha[:, t - 1, :, None] + self.move
            alpha[:, t] = np.logaddexp(step[:, 0], step[:, 1]) + emit[:, t]
        for t in range(size - 2, -1, -1):
            step = self.move + (emit[:, t + 1] + beta[:, t + 1])[:, None, :]
            inside = (t + 1 < length)[:, None]
            beta[:, t] = np.where(inside, np.logaddexp(step[..., 0], step[..., 1]), 0.0)
        z = np.logaddexp(*np.moveaxis(alpha[np.arange(n), length - 1], 1, 0))
        valid = np.arange(size) < length[:, None]
        toxic = np.where(valid, np.exp(np.minimum(alpha[..., 1] + beta[..., 1] - z[:, None], 0)), 0.0)
        if not pairs:
            return toxic
        joint = alpha[:, :-1, :, None] + self.move + (emit + beta)[:, 1:, None, :] - z[:, None, None, None]
        return toxic, np.where(valid[:, 1:, None, None], np.exp(np.minimum(joint, 0)), 0.0)

    def learn(self, batches: list[tuple], rounds: int = 80, rate: float = 0.3, decay: float = 1e-4) -> None:
        """Adagrad on the conditional likelihood. A batch: rows, lengths, labels and weights of chains of similar length."""
        params = [self.word, self.own, self.before, self.after, self.bias, self.move]
        past = [np.full_like(p, 1e-8) for p in params]
        total = sum(weight.sum() for *_, weight in batches)
        for _ in range(rounds):
            sums = [np.zeros_like(p) for p in params]
            for rows, length, labels, weight in batches:
                at = self.bins[rows]
                valid = (np.arange(labels.shape[1]) < length[:, None]) * weight[:, None]
                toxic, joint = self.marginals(rows, length, pairs=True)
                miss = (labels - toxic) * valid
                now = (labels[:, :-1, None, None] == np.arange(2)[:, None]) & (labels[:, 1:, None, None] == np.arange(2))
                sums[0] += np.bincount(rows[:, 1:-1].ravel(), miss.ravel(), len(self.word))
                for k, near in enumerate((at[:, 1:-1], at[:, :-2], at[:, 2:]), start=1):
                    sums[k] += np.bincount(near.ravel(), miss.ravel(), len(self.own))
                sums[4] += miss.sum()
                sums[5] += ((now - joint) * valid[:, 1:, None, None]).sum(axis=(0, 1))
            sums[0][0] = 0  # the unknown word is the constant
            for p, g, q in zip(params, sums, past, strict=True):
                g = g / total - decay * p
                q += g * g
                p += rate * g / np.sqrt(q)

    def neutral(self) -> tuple[np.ndarray, np.ndarray]:
        """Of a chain of n unknown words, the sum and the largest of the marginals."""
        rows = np.zeros((CHAIN, CHAIN + 2), np.int32)
        toxic = self.marginals(rows, np.arange(1, CHAIN + 1))
        return np.concatenate(([0.0], toxic.sum(axis=1))), np.concatenate(([0.0], toxic.max(axis=1)))


# --- learning -------------------------------------------------------------------------------------------------


def labelled_sample(documents: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of about ``sample`` labelled documents. A doc_id with several labels is toxic if one says so.

    doc_ids are drawn first. If those repeat in ``documents``, so that more than 5 / 4 of the sample came along, equal rows
    count once and the rows are drawn again, by id and text: each draw is then one row, and their number is near ``sample``.
    """
    labels = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    share = min(1.0, sample / max(labels.count(), 1))
    drawn = labels.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = stored(drawn.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    rows = documents.select(F.col("doc_id").alias("_id"), "text").join(drawn, F.col("_id") == F.col("doc_id"))
    rows = stored(rows.select("_id", "text", "toxic"), "labelled")
    n = rows.count()
    if 4 * n > 5 * sample:
        rows = rows.dropDuplicates()
        share = sample / max(rows.count(), 1)
        if share < 1:
            rows = rows.filter(F.pmod(F.xxhash64(F.lit("rows"), "_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
        rows = stored(rows, "labelled")
    return rows.select("text", "toxic")


def associations(sample: DataFrame, words: int = WORDS) -> pd.DataFrame:
    """word, ratio of at most ``words`` words that stand in more contexts of toxic documents than chance has it.

    A context is the word with those before and after it, and counts once however many copies of a text repeat it.
    """

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = ["", *(w.lower() for w in TOKEN.findall(text or "")), ""]
                out.update((w, a, b, toxic) for a, w, b in zip(found, found[1:], found[2:], strict=False) if w not in ENDS)
            yield pa.RecordBatch.from_pylist(
                [{"word": w, "a": a, "b": b, "toxic": t} for w, a, b, t in out],
                pa.schema([("word", pa.string()), ("a", pa.string()), ("b", pa.string()), ("toxic", pa.int32())]))

    seen = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(contexts, "word string, a string, b string, toxic int").distinct()
    counts = stored(seen.groupBy("word").agg(F.sum("toxic").cast("double").alias("p"), F.count("*").cast("double").alias("n")), "contexts")
    p_all, n_all = counts.agg(F.sum("p"), F.sum("n")).first()
    base = (p_all or 0) / max(n_all or 0, 1)
    if not 0 < base < 1:
        return pd.DataFrame({"word": [], "ratio": []})
    q = F.col("n") - F.col("p")
    term = lambda k, share: F.when(k > 0, k * F.log(k / (F.col("n") * share))).otherwise(0.0)
    scored = counts.select("word", "n", "p", (2 * (term(F.col("p"), base) + term(q, 1 - base))).alias("ratio"))
    return scored.filter((F.col("ratio") >= KNOWN) & (F.col("p") > base * F.col("n"))).orderBy(F.desc("ratio"), "word").limit(words).select(
        "word", F.when(2 * F.col("p") > F.col("n"), F.col("ratio")).otherwise(F.least("ratio", F.lit(TOXIC - 1))).alias("ratio")).toPandas()


def fit(
    documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS, most_chains: int = CHAINS, neutral: float = NEUTRAL,
) -> dict:
    """The field learned from the labelled rows given: codes of known words and their weights."""
    rows = labelled_sample(documents, labels, sample)
    known = associations(rows, words)
    codes = {w: i for i, w in enumerate(known["word"], start=1)}
    ratio = np.concatenate(([0.0], known["ratio"].to_numpy(float)))
    field = Field(np.where(ratio > 0, np.searchsorted(BINS, ratio, side="right") + 1, 0))
    if not codes:
        return {"codes": codes, "field": field, "scale": (0.0, 0.0, -6.0)}

    def training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = [w.lower() for w in TOKEN.findall(text or "")]
                for a, b in chains(found):
                    own = [codes.get(w, 0) for w in found[a:b]]
                    if any(own) or hash(" ".join(found[a:b])) % 1000 < 1000 * neutral:  # Spark fixes the seed of hash()
                        out.append((own, int(toxic)))
            yield pa.RecordBatch.from_pydict({"codes": pa.array([c for c, _ in out], pa.list_(pa.int32())), "toxic": pa.array([t for _, t in out], pa.int32())})

    found = rows.mapInArrow(training, "codes array<int>, toxic int").distinct()
    found = found.orderBy(F.xxhash64("codes", "toxic"), "codes", "toxic").limit(most_chains).toPandas()
    size = found["codes"].map(len)
    batches = []
    for a, b in ((0, 8), (8, 16), (16, 32), (32, CHAIN)):
        own, length = padded([np.array(c, int) for c in found["codes"][(size > a) & (size <= b)]])
        if len(own):
            toxic = found["toxic"].to_numpy()[(size > a) & (size <= b), None]
            target = ((ratio[own[:, 1:-1]] >= TOXIC) & (toxic == 1)).astype(float)
            batches.append((own, length, target, np.where((own > 0).any(axis=1), 1.0, 1 / neutral)))
    if batches:
        field.learn(batches)
    model = {"codes": codes, "field": field, "scale": (0.0, 0.0, -6.0)}
    run = scorer(documents.sparkSession, model)
    seen = rows.select("toxic", run("text").alias("found")).select("toxic", "found.strongest", "found.expected").toPandas()
    return model | {"scale": calibrated(seen)}


def calibrated(seen: pd.DataFrame) -> tuple[float, float, float]:
    """Weights of the strongest and the expected number of toxic tokens, both as logarithms, and the constant: a logistic
    regression on the labelled sample by Newton steps."""
    x = np.column_stack([seen["strongest"], seen["expected"], np.ones(len(seen))])
    y, w = seen["toxic"].to_numpy(float), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag([0.1, 0.1, 0.1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return tuple(w.tolist())


# --- scoring --------------------------------------------------------------------------------------------------


class Scorer:
    def __init__(self, codes: dict[str, int], weights: dict[str, np.ndarray], scale: tuple[float, float, float]) -> None:
        self.field, self.code = Field(weights["bins"]), (codes | dict.fromkeys(ENDS, -1)).get
        vars(self.field).update(weights)
        self.scale = scale
        self.neutral, self.most = self.field.neutral()

    def coded(self, text: str) -> np.ndarray:
        """The code of each token, 0 for unknown words, -1 for sentence ends.

        The text is lower-cased in one go where that cannot shift a token or change a letter by its neighbours outside the
        token. Few words are known, so their table stays in the processor's cache; unknown ones are not remembered.
        """
        low = text.lower()
        if not text.isascii() and (len(low) != len(text) or "\u03a3" in text):
            words = [w.lower() for w in TOKEN.findall(text)]
        else:
            words = TOKEN.findall(low)
        return np.fromiter(map(self.code, words, repeat(0)), np.int32, len(words))

    def score(self, text: str) -> tuple[float, float, float, list[tuple[int, int]]]:
        """The score, its two parts (log odds of the strongest token, log of the expected number of toxic tokens), and the
        tokens in the toxic state as (start, end)."""
        return next(self.scores([text]))

    def scores(self, texts: Iterable[str]) -> Iterator[tuple[float, float, float, list[tuple[int, int]]]]:
        """``score`` of each text. The chains of several texts go through the field at once, as most texts have few of them
        and a step costs about as much for one chain as for a hundred."""
        held, size = [], 0
        for text in texts:
            parted = self.parted(text)
            if size + len(parted[-1]) > AT_ONCE or len(held) == AT_ONCE:
                yield from self.joined(held)
                held, size = [], 0
            held.append((text, *parted))
            size += len(parted[-1])
        yield from self.joined(held)

    def parted(self, text: str) -> tuple[float, float, np.ndarray, list[np.ndarray]]:
        """Of chains of unknown words only the strongest and expected part; starts and codes of the chains with known words."""
        codes = self.coded(text)
        # chain lengths: between sentence ends, cut at CHAIN
        ends = np.concatenate((np.flatnonzero(codes < 0), [len(codes)]))
        starts = np.concatenate(([0], ends[:-1] + 1))
        length = ends - starts
        full = int((length // CHAIN).sum())
        rest = np.bincount(length % CHAIN, minlength=CHAIN + 1)
        rest[0] = 0
        rest[CHAIN] += full
        expected = float(rest @ self.neutral)
        strongest = float(self.most[rest > 0].max(initial=0.0))
        at = np.flatnonzero(codes > 0)
        if not len(at):
            return strongest, expected, at, []
        which = np.searchsorted(ends, at, side="left")
        first = starts[which] + (at - starts[which]) // CHAIN * CHAIN
        first = np.unique(first)
        last = np.minimum(first + CHAIN, ends[np.searchsorted(ends, first, side="left")])
        return strongest, expected, first, [codes[a:b] for a, b in zip(first, last, strict=True)]

    def joined(self, held: list[tuple]) -> Iterator[tuple[float, float, float, list[tuple[int, int]]]]:
        """The results of texts with at most AT_ONCE such chains in all, or of one with more."""
        found = [c for *_, own in held for c in own]
        blocks = (padded(found[k:k + AT_ONCE]) for k in range(0, len(found), AT_ONCE))
        blocks, done = ((length, self.field.marginals(rows, length)) for rows, length in blocks), AT_ONCE
        lengths = marginals = np.zeros(0)
        for text, strongest, expected, first, own in held:
            spans: list[tuple[int, int]] = []
            for k in range(0, len(own), AT_ONCE):
                if done >= len(lengths):
                    (lengths, marginals), done = next(blocks), 0
                length = lengths[done:done + len(own) - k]
                toxic = np.ascontiguousarray(marginals[done:done + len(length), :length.max()])
                done += len(length)
                expected += float(toxic.sum() - self.neutral[length].sum())
                strongest = max(strongest, float(toxic.max()))
                hit_row, hit_col = np.nonzero(toxic > 0.5)
                spans += (first[k + hit_row] + hit_col).tolist()
            if spans:
                places = [m.span() for m in TOKEN.finditer(text)]
                spans = [places[i] for i in sorted(spans)]
            strongest = min(max(strongest, 1e-6), 1 - 1e-6)
            parts = float(np.log(strongest / (1 - strongest))), float(np.log(max(expected, 1e-6)))
            raw = self.scale[0] * parts[0] + self.scale[1] * parts[1] + self.scale[2]
            yield float(1 / (1 + np.exp(-np.clip(raw, -30, 30)))), *parts, spans


def scorer(spark: SparkSession, model: dict):
    """A column function: text -> struct(score, strongest, expected, spans)."""
    shared = spark.sparkContext.broadcast((model["codes"], vars(model["field"]), model["scale"]))  # at most ``WORDS`` words and their weights

    @F.pandas_udf("score double, strongest double, expected double, spans array<struct<start: int, end: int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Scorer(*shared.value)
        for texts in batches:
            found = list(own.scores(t or "" for t in texts))
            spans = [[{"start": a, "end": b} for a, b in f[3]] for f in found]
            yield pd.DataFrame({"score": [f[0] for f in found], "strongest": [f[1] for f in found], "expected": [f[2] for f in found], "spans": spans})

    return run


def score_toxicity(
    documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, words: int = WORDS,
    most_chains: int = CHAINS, neutral: float = NEUTRAL,
) -> DataFrame:
    """(doc_id, score, predicted, spans) per row of ``documents``, learned from ``labels`` (doc_id, toxic) given.

    score is 0 to 1, predicted 1 from ``threshold`` on, spans are the (start, end) of tokens in the toxic state, in code
    points. Null and empty texts score as one without any toxic token. Labels without a document, null labels and null doc_ids teach nothing; without
    labels of both kinds no word is known and every score is near 0. Repeated rows keep one row each; an empty table gives
    no rows; other columns are not read.

    What is learned from is bounded, what is scored is not: about ``sample`` labelled documents; of their words the
    ``words`` of the strongest association; of their distinct sentences those with a known word and the share ``neutral``
    (above 0) of the others, which weigh the more for it, ``most_chains`` at most, drawn by a hash. In learning and scoring a
    sentence of more than CHAIN tokens counts as several, so a transition over such a cut is not seen.
    """
    run = scorer(documents.sparkSession, fit(documents, labels, sample, words, most_chains, neutral))
    rows = documents.select("doc_id", run("text").alias("found")).select("doc_id", "found.*")
    return rows.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
