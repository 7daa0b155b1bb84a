"""Token-set similarity of two normalised titles.

With I the shared tokens, x and y the joined remaining tokens of either side and s the joined shared ones, the
score is the best of the indel ratio of ``s x`` against ``s y`` and the two containment ratios (``s`` against
``s x`` and against ``s y``). It is 100 as soon as one title's tokens all occur in the other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over one big integer (Hyyro 2004)."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, char in enumerate(a):
        where[char] = where.get(char, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for char in b:
        hits = row & where.get(char, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(a) - row.bit_count()


GRAM_PLACES = 2_048


def least_distance(a: str, b: str) -> int:
    """A lower bound of the indel distance of two texts: an edit changes at most three of their character pairs."""
    def counts(text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "uint32")
        return np.bincount((codes[:-1] * np.uint32(37) + codes[1:]) % GRAM_PLACES, minlength=GRAM_PLACES)

    # Pairs that share a place make the bound smaller, never larger.
    return -(-int(np.abs(counts(a) - counts(b)).sum()) // 3)


def token_set_ratio(left: str, right: str, least: float = 0.0) -> float:
    """The score; 0 where a bound tells that it is less than ``least``."""
    a, b = set(left.split()), set(right.split())
    if not a or not b:
        return 0.0
    shared = a & b
    if shared and (a <= b or b <= a):
        return 100.0
    x, y, s = " ".join(sorted(a - b)), " ".join(sorted(b - a)), " ".join(sorted(shared))
    gap = 1 if shared else 0
    len_a, len_b = len(s) + gap + len(x), len(s) + gap + len(y)

    def ratio(distance: int, total: int) -> float:
        return 100.0 - 100.0 * distance / total

    scores = [ratio(gap + len(x), len(s) + len_a), ratio(gap + len(y), len(s) + len_b)] if shared else [0.0]
    reach = max(least, *scores)
    if ratio(abs(len(x) - len(y)), len_a + len_b) >= reach and (
        min(len(x), len(y)) < 50 or ratio(least_distance(x, y), len_a + len_b) >= reach
    ):
        scores.append(ratio(len(x) + len(y) - 2 * lcs_length(x, y), len_a + len_b))
    return found if (found := max(scores)) >= least else 0.0


def containment_ratio(left: str, right: str) -> float:
    """The better one of the two containment ratios."""
    a, b = set(left.split()), set(right.split())
    shared = a & b
    if not shared:
        return 0.0
    # A token and the blank before it; the shared ones together have one blank less.
    own = sum(map(len, shared)) + len(shared) - 1
    rest = min(sum(map(len, some)) + len(some) for some in (a - shared, b - shared))
    return 100.0 - 100.0 * rest / (2 * own + rest)


def token_set_score_from(least: float):
    """A function of two columns of titles: their score, or 0 where it is less than ``least``."""
    @F.pandas_udf(T.DoubleType())
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(a, b, least) for a, b in zip(left, right)], dtype="float64")

    return score


def containment_score_from(least: float):
    """A function of two columns of titles: their score where a containment ratio is at least ``least``, else 0."""
    @F.pandas_udf(T.DoubleType())
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([
            token_set_ratio(a, b, least) if containment_ratio(a, b) >= least else 0.0 for a, b in zip(left, right)
        ], dtype="float64")

    return score


token_set_score = token_set_score_from(0.0)
