"""Language identification by the nearest of several TF-IDF centroids per language.

Letters of a lower-cased text give n-grams of two and three, hashed to a fixed number of features. Vectors are normalised
TF-IDF; each language has several centroids (spherical k-means); the cosine to the nearest decides. A text that lies
farther from the nearest centroid than nearly all held-back texts of that language and length is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import once, stored

FEATURES = 1 << 13
CENTROIDS = 6
#: Labelled rows per language that the classifier is fitted on at most, on average; drawn by a hash of doc_id.
SAMPLE = 1_500
#: Share of a language's held-back texts of about the same length that may lie farther than the rejection distance.
REJECT = 0.002
#: Length classes (powers of two of letters), and held-back texts that a class must have for a distance of its own.
CLASSES, ENOUGH = 13, 20
#: Code points of a text that are counted at once.
BLOCK = 1 << 20
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """The code of each code point: 0 for all but letters."""
    return np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint32, 0x110000)


def features(text: str, letters: np.ndarray, size: int = FEATURES) -> tuple[np.ndarray, int]:
    """Counts per feature, and how many letters the text has. A word is a run of letters with a bound at each end."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    counts, n_letters = np.zeros(size, np.int64), 0
    for at in range(0, len(codes), BLOCK):
        part = letters[codes[max(at - 2, 0):at + BLOCK]]
        if at == 0:
            part = np.concatenate(([0], part))
        if at + BLOCK >= len(codes):
            part = np.concatenate((part, [0]))
        part = part.astype(np.uint32)
        n_letters += int(np.count_nonzero(letters[codes[at:at + BLOCK]]))
        two = part[:-1] * np.uint32(2654435761) ^ part[1:] * np.uint32(40503)
        three = two[:-1] * np.uint32(2246822519) ^ part[2:] * np.uint32(3266489917)
        # a blank in the middle, or two of them, tells nothing
        for grams, use in ((two, (part[:-1] > 0) | (part[1:] > 0)), (three, (part[1:-1] > 0))):
            mixed = grams ^ (grams >> np.uint32(15))
            counts += np.bincount((mixed % np.uint32(size))[use], minlength=size)
    return counts, n_letters


def normalised(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.log1p(counts, dtype=np.float32) * idf
    norm = np.linalg.norm(weights, axis=-1, keepdims=True)
    return (weights / np.where(norm > 0, norm, 1)).astype(np.float32)


def clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the vector nearest to the mean and those farthest from what is chosen."""
    chosen = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    nearest = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen]
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        members = (own == np.arange(len(centres))[:, None]).astype(np.float32)
        sums = np.where(members.any(axis=1)[:, None], members @ vectors, centres)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = sums / np.where(norm > 0, norm, 1)
    return centres.astype(np.float32)


def sample_of(labelled: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` rows per lang (all, if fewer), chosen by a hash of doc_id; counts of lang come from all rows."""
    sizes = labelled.groupBy("lang").count().collect()  # one row a language
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, sample / r["count"]))).otherwise(share)
    return labelled.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))


def unit_vectors(rows: pa.Table, idf: np.ndarray, size: int) -> np.ndarray:
    """Normalised TF-IDF of rows (at, n) of sparse counts; made in place, as one dense copy is the largest thing here."""
    lengths = pc.list_value_length(rows.column("at")).to_numpy()
    at = pc.list_flatten(rows.column("at")).to_numpy()
    out = np.zeros((rows.num_rows, size), np.float32)
    out[np.repeat(np.arange(rows.num_rows), lengths), at] = np.log1p(pc.list_flatten(rows.column("n")).to_numpy(), dtype=np.float32) * idf[at]
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    out /= np.where(norm > 0, norm, 1)
    return out


def length_class(n_letters: int) -> int:
    return min(n_letters.bit_length() - 1, CLASSES - 1)


def beginnings(text: str) -> Iterator[str]:
    """The text, and its beginnings of growing length, cut between words where there are any."""
    yield text
    n = 4
    while n < min(len(text), 1 << CLASSES):
        yield (text[:n].rsplit(None, 1) or [""])[0]
        n *= 2


def least_cosines(rows: DataFrame, names: list[str], halves: list, idf: np.ndarray, size: int, reject: float) -> np.ndarray:
    """Per language and length class the cosine that a share ``reject`` of held-back texts of the language lies below.

    Texts of one half, and their beginnings, are held against the centroids of the other half. A class with too few texts
    takes the value of the next shorter one, else of the next longer one; without any, nothing is too far.
    """
    shared = rows.sparkSession.sparkContext.broadcast((dict(zip(names, halves, strict=True)), idf))

    def held_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (centres, weights), letters = shared.value, once("letters", letter_table)
        for batch in batches:
            langs, classes, cosines = [], [], []
            for text, lang, half in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "half")), strict=True):
                other = centres[lang][1 - half]
                for part in beginnings(text) if len(other) else ():
                    counts, n_letters = features(part, letters, size)
                    if n_letters:
                        langs.append(lang), classes.append(length_class(n_letters))
                        cosines.append(float((other @ normalised(counts, weights)).max()))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(classes, pa.int32()), pa.array(cosines, pa.float64())], ["lang", "class", "cosine"])

    found = rows.select("text", "lang", "half").mapInArrow(held_back, "lang string, class int, cosine double")
    found = found.groupBy("lang", "class").agg(F.count("*").alias("n"), F.percentile("cosine", F.lit(reject)).alias("least"), F.stddev("cosine").alias("scale"))
    # too few texts for one to lie in the share: the tail is carried on as an exponential one of the class's scale
    found = found.withColumn("least", F.col("least") - F.col("scale") * F.greatest(F.lit(0.0), -F.log(F.col("n") * reject)))
    least = np.full((len(names), CLASSES), np.nan)
    thin = np.zeros(least.shape, bool)
    for r in found.filter(F.col("n") >= ENOUGH).collect():  # a row a language and class at most
        least[names.index(r["lang"]), r["class"]] = r["least"]
        thin[names.index(r["lang"]), r["class"]] = r["n"] * reject < 1
    # and such a class is not held to more than the next shorter one
    least[:, 1:] = np.where(thin[:, 1:], np.fmin(least[:, 1:], least[:, :-1]), least[:, 1:])
    for row in least:
        for step in (range(1, CLASSES), range(CLASSES - 2, -1, -1)):
            for c in step:
                if np.isnan(row[c]):
                    row[c] = row[c - 1 if step.step > 0 else c + 1]
    return np.nan_to_num(least, nan=0.0)


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, size: int = FEATURES, reject: float = REJECT) -> dict:
    """The classifier from (doc_id, text, lang) with a non-null lang: languages, centroids, idf, least cosines by length.

    Vectors of the bounded sample are counted in tasks and written as sparse counts; the driver reads one language at a
    time. Rows without letters teach nothing; without any row left the classifier knows no language.
    """

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = once("letters", letter_table)
        for batch in batches:
            keep, at, n = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                counts, n_letters = features(text or "", letters, size)
                if n_letters:
                    where = np.flatnonzero(counts)
                    keep.append(i), at.append(where), n.append(counts[where])
            kept = batch.take(pa.array(keep, pa.int32()))
            columns = [*kept.columns, pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["text", "lang", "half", "at", "n"])

    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("half")
    drawn = sample_of(labelled, sample).select("text", "lang", half)
    rows = stored(drawn.mapInArrow(vectors, "text string, lang string, half int, at array<int>, n array<long>"), "languages")
    total, names = rows.count(), sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # one row a language
    within = np.zeros(size)
    for r in rows.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # a row a feature at most
        within[r["at"]] = r["count"]
    idf = (np.log((1 + total) / (1 + within)) + 1).astype(np.float32)
    owner, centres, halves = [], [], []
    for i, name in enumerate(names):
        own = rows.filter(F.col("lang") == name).select("half", "at", "n").toArrow()
        side, own = own.column("half").to_numpy(), unit_vectors(own, idf, size)
        found = clusters(own, centroids)
        centres.append(found), owner.extend([i] * len(found))
        halves.append([clusters(own[side == h], centroids) if (side == h).any() else own[:0] for h in (0, 1)])
        del own
    return {
        "names": names, "owner": np.array(owner, int), "idf": idf, "size": size,
        "least": least_cosines(rows, names, halves, idf, size, reject),
        "centres": np.concatenate(centres) if centres else np.zeros((0, size), np.float32),
    }


def predictor(spark: SparkSession, model: dict):
    """A column function: text -> struct(lang_pred, score, rejected)."""
    shared = spark.sparkContext.broadcast(model)  # bounded: centroids x features

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, letters = shared.value, once("letters", letter_table)
        for texts in batches:
            out = []
            for text in texts:
                counts, n_letters = features(text or "", letters, m["size"])
                if not n_letters or not len(m["centres"]):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                near = m["centres"] @ normalised(counts, m["idf"])
                best = int(np.argmax(near))
                lang, score = int(m["owner"][best]), min(1.0, max(0.0, float(near[best])))
                out.append((m["names"][lang], score, score < m["least"][lang, length_class(n_letters)]))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    return predict


def identify(documents: DataFrame, learn_from: Column, reject: float = REJECT, **options) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) per row of ``documents``, learned from its rows where ``learn_from`` holds.

    lang_pred is a language with a learned centroid, `und` where the text is null or has no letter, or nothing was
    learned; score is the cosine to the nearest centroid, 0 to 1. rejected: `und`, or farther from the nearest centroid than
    all but a share ``reject`` of held-back texts of that language and about that length. Ties go to the first language by name. Rows with a null lang teach
    nothing. Repeated rows keep one row each; an empty table gives no rows; other columns are not read.
    """
    model = fit(documents.filter(learn_from & F.col("lang").isNotNull()).select("doc_id", "text", "lang"), reject=reject, **options)
    found = predictor(documents.sparkSession, model)("text").alias("found")
    return documents.select("doc_id", found).select("doc_id", "found.*")


def keep_identified(documents: DataFrame, learn_from: Column, reject: float = REJECT, **options) -> DataFrame:
    """``documents`` without the rejected rows; all columns kept. See ``identify``."""
    model = fit(documents.filter(learn_from & F.col("lang").isNotNull()).select("doc_id", "text", "lang"), reject=reject, **options)
    return documents.filter(~predictor(documents.sparkSession, model)("text")["rejected"])
