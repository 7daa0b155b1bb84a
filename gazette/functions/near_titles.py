"""Pairs of titles of two blocks that may be within an edit distance, for thousands of titles at once.

``near_pairs`` tells which pairs of a left and a right title may have an indel distance of at most ``loss`` percent of
their added lengths, shared tokens aside. Two bounds rule pairs out, both exact: no pair within the distance is lost.

* An edit changes at most three of a title's character pairs. The right titles hold a row of flags for each place of a
  pair and each count of it, so the pairs that a left title shares with all right ones are a sum of a few rows.
* What is left gets the longest common subsequence of the two titles without their shared tokens, bit-parallel (Hyyro
  2004) over many pairs at a time. Characters are told apart by ``SYMBOLS`` classes: that makes it longer, never shorter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Places in which the character pairs of a title are counted, and the most rows of flags of a block.
PLACES, ROWS = 512, 2_048
#: Classes of characters, one of which matches nothing; bits of a word, whose last one takes the carry.
SYMBOLS, BITS = 128, 63
#: Words of bits that the pairs of a chunk may have together, and bytes of its tables.
CHUNK_WORDS, CHUNK_BYTES = 16_384, 32_000_000


class Titles:
    """Normalised titles, sorted by length: their characters in one array and their tokens by number."""

    def __init__(self, texts: list[str], numbers: dict[str, int]):
        self.texts = texts
        self.lens = np.array([len(text) for text in texts], "int64")
        # Each title stands between two blanks.
        self.codes = np.frombuffer("".join([f" {text} " for text in texts]).encode("utf-32-le", "surrogatepass"), "uint32")
        self.starts = np.cumsum(self.lens + 2) - self.lens - 2
        words = [text.split(" ") for text in texts]
        self.n_tokens = np.array([len(w) for w in words], "int64")
        self.first_token = np.cumsum(self.n_tokens) - self.n_tokens
        self.tokens = np.array([numbers.setdefault(t, len(numbers)) for w in words for t in w], "int64")
        self.token_lens = np.array([len(t) for w in words for t in w], "int64")
        before = np.cumsum(self.token_lens + 1) - self.token_lens - 1
        self.token_starts = before - np.repeat(before[self.first_token], self.n_tokens) if len(texts) else before

    def grams(self) -> np.ndarray:
        """How often the character pairs of each title fall into each place, 255 at most."""
        out = np.empty((len(self.texts), PLACES), "uint8")
        for low in range(0, len(out), 1_000):
            lens = self.lens[low:low + 1_000]
            codes = self.codes[self.starts[low]:][: int((lens + 2).sum())]
            places = (codes[:-1] * np.uint32(37) + codes[1:]) % PLACES + np.repeat(np.arange(len(lens)) * PLACES, lens + 2)[:-1]
            inside = np.ones(len(places), bool)
            inside[np.cumsum(lens + 2)[:-1] - 1] = False  # from the last blank of a title to the first one of the next
            counts = np.bincount(places[inside], minlength=len(lens) * PLACES).reshape(-1, PLACES)
            out[low:low + 1_000] = np.minimum(counts, 255)
        return out


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _by_grams(left: Titles, right: Titles, loss: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each left title, the right ones that lengths and character pairs allow."""
    mine, theirs = left.grams(), right.grams()
    top = theirs.max(axis=0).astype("int64")
    cap = max([c for c in range(1, 256) if np.minimum(top, c).sum() <= ROWS], default=1)
    # Counts beyond the cap make two titles more alike, never less.
    top, mine, theirs = np.minimum(top, cap), np.minimum(mine, cap), np.minimum(theirs, cap)
    first_row = np.cumsum(top) - top
    flags = np.empty((int(top.sum()), len(theirs)), "uint8")
    for place in np.flatnonzero(top):
        column = np.ascontiguousarray(theirs[:, place])
        for count in range(int(top[place])):
            np.greater(column, count, out=flags[first_row[place] + count].view(bool))
    sizes, own_sizes = theirs.sum(axis=1, dtype="int64"), mine.sum(axis=1, dtype="int64")
    lows = np.searchsorted(right.lens * (100 + loss), left.lens * (100 - loss), "left")
    highs = np.searchsorted(right.lens * (100 - loss), left.lens * (100 + loss), "right")
    for i, (low, high) in enumerate(zip(lows.tolist(), highs.tolist())):
        if low >= high:
            continue
        used = np.flatnonzero(mine[i])
        counts = np.minimum(mine[i][used], top[used])
        rows = (np.repeat(first_row[used], counts) + _ragged(counts)).tolist()
        shared = np.zeros(high - low, "int64")
        for some in range(0, len(rows), 255):
            part = np.zeros(high - low, "uint8")
            for row in rows[some:some + 255]:
                np.add(part, flags[row, low:high], out=part)
            shared += part
        # A deletion destroys at most two character pairs and makes one, an insertion the other way round.
        apart = own_sizes[i] + sizes[low:high] - 2 * shared
        yield i, low + np.flatnonzero(apart * 100 <= (right.lens[low:high] + left.lens[i]) * loss * 3)


def _shared_tokens(left: Titles, right: Titles, some: np.ndarray, of: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The tokens that the pairs (some[of], b) share: numbers of the pair, of the left and of the right token."""
    held = np.repeat(left.first_token[some], left.n_tokens[some]) + _ragged(left.n_tokens[some])
    looked = np.repeat(right.first_token[b], right.n_tokens[b]) + _ragged(right.n_tokens[b])
    size = max(int(left.tokens.max()), int(right.tokens.max())) + 1
    known = np.repeat(np.arange(len(some)), left.n_tokens[some]) * size + left.tokens[held]
    order = np.argsort(known)
    known, held = known[order], held[order]
    pair = np.repeat(np.arange(len(b)), right.n_tokens[b])
    wanted = of[pair] * size + right.tokens[looked]
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    hit = known[at] == wanted
    return pair[hit], held[at[hit]], looked[hit]


def _low_bits(n: np.ndarray) -> np.ndarray:
    return (np.uint64(1) << np.clip(n, 0, BITS).astype("uint64")) - np.uint64(1)


def _by_subsequence(left: Titles, right: Titles, a: np.ndarray, b: np.ndarray, loss: int) -> np.ndarray:
    """Which of the pairs (a, b) their longest common subsequence without shared tokens allows. ``a`` is sorted."""
    order = np.argsort(-right.lens[b], kind="stable")  # so that the pairs that still have characters are the first ones
    a, b = a[order], b[order]
    some, of = np.unique(a, return_inverse=True)
    lens_a, lens_b = left.lens[a], right.lens[b]
    words = int(left.lens[some].max() + BITS - 1) // BITS
    # For each word of bits, left title and class: the places of the class in the title. Class 0 is nowhere.
    chars = left.lens[some]
    place, owner = _ragged(chars), np.repeat(np.arange(len(some)), chars)
    classes = 1 + left.codes[np.repeat(left.starts[some] + 1, chars) + place].astype("int64") % (SYMBOLS - 1)
    tables = np.zeros((words, len(some) * SYMBOLS), "uint64")
    np.bitwise_or.at(tables.reshape(-1), place // BITS * tables.shape[1] + owner * SYMBOLS + classes, np.uint64(1) << (place % BITS).astype("uint64"))
    # The classes of the right titles' characters, a row for each place.
    place, pair = _ragged(lens_b), np.repeat(np.arange(len(b)), lens_b)
    steps = np.zeros((int(lens_b[0]), len(b)), "uint8")
    steps[place, pair] = 1 + right.codes[np.repeat(right.starts[b] + 1, lens_b) + place] % (SYMBOLS - 1)
    # A shared token and the blank behind it match nothing, on either side.
    pair, one, other = _shared_tokens(left, right, some, of, b)
    wide = right.token_lens[other] + 1
    hidden = np.repeat(right.token_starts[other], wide) + _ragged(wide)
    hidden_in = np.repeat(pair, wide)
    steps[np.minimum(hidden, lens_b[hidden_in] - 1), hidden_in] = 0
    kept = np.full((words, len(b)), (1 << BITS) - 1, "uint64")
    begin, end = left.token_starts[one], left.token_starts[one] + wide
    for w in range(words):
        inside = np.flatnonzero((end > w * BITS) & (begin < (w + 1) * BITS))
        np.bitwise_and.at(kept[w], pair[inside], ~(_low_bits(end[inside] - w * BITS) ^ _low_bits(begin[inside] - w * BITS)))
    shared = np.bincount(pair, weights=wide, minlength=len(b)).astype("int64")

    full, top = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    base = of.astype("int64") * SYMBOLS
    state = np.full((words, len(b)), full, "uint64")
    active = np.searchsorted(-lens_b, -np.arange(1, int(lens_b[0]) + 1), "right").tolist()
    for step, n in zip(steps, active):
        where = base[:n] + step[:n]
        carry = None
        for w in range(words):
            row = state[w, :n]
            hits = tables[w].take(where, mode="clip")
            hits &= kept[w, :n]
            hits &= row
            total = row + hits
            if carry is not None:
                total += carry
            if w + 1 < words:
                carry = total >> top
            row ^= hits
            row |= total
            row &= full
    common = BITS * words - np.bitwise_count(state).sum(axis=0, dtype="int64")
    rest_a, rest_b = lens_a - shared, lens_b - shared
    apart = rest_a + rest_b - 2 * common
    # A title whose tokens are all shared is left to the score.
    good = (apart * 100 <= (lens_a + lens_b) * loss) | (rest_a <= 0) | (rest_b <= 0)
    out = np.empty(len(order), bool)
    out[order] = good
    return out


def near_pairs(
    left_texts: list[str], right_texts: list[str], loss: int, wanted=lambda i, found: found
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of the pairs that may be within the distance. Both lists are sorted by length, and not empty.

    A text is the sorted distinct tokens of a title. ``wanted`` takes a left place and right places, and gives those to look at.
    """
    numbers: dict[str, int] = {}
    left, right = Titles(left_texts, numbers), Titles(right_texts, numbers)
    a, b, waiting = [], [], 0

    def checked() -> tuple[np.ndarray, np.ndarray]:
        one, other = np.repeat(np.array([i for i, _ in a], "int64"), [len(f) for _, f in a]), np.concatenate(b)
        good = _by_subsequence(left, right, one, other, loss)
        return one[good], other[good]

    for i, found in _by_grams(left, right, loss):
        found = wanted(i, found)
        if not len(found):
            continue
        words = int(left.lens[i] + BITS - 1) // BITS
        most = max(64, CHUNK_WORDS // words)
        for low in range(0, len(found), most):
            part = found[low:low + most]
            a.append((i, part))
            b.append(part)
            waiting += len(part)
            if waiting >= most or len(a) * words * SYMBOLS * 8 >= CHUNK_BYTES:
                yield checked()
                a, b, waiting = [], [], 0
    if a:
        yield checked()
