"""Words of texts as numbers, for counting many of them in arrays inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a text that are taken apart at once, and bytes of distinct words that a task holds at most, but for one slice.
SLICE, WORD_BYTES = 1 << 20, 32 << 20


class Numbered(dict):
    """Word -> number from 1 on, in the order of first sight; 0 is kept for breaks."""

    def __init__(self) -> None:
        super().__init__()
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        self.bytes += len(word) + 64
        return n

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def array(self) -> pa.Array:
        """The words by number; entry 0 is null."""
        return pa.array([None, *self], pa.binary())


def slices(data: bytes, size: int = SLICE) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes, cut at blanks only."""
    start = 0
    while len(data) - start > size:
        end = data.find(b" ", start + size)
        if end < 0:
            break
        yield data[start:end]
        start = end
    yield data[start:] if start else data


def bytes_of(column: pa.Array) -> list[bytes | None]:
    """The strings of a column as UTF-8."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def strings(words: pa.Array, numbers: np.ndarray) -> pa.Array:
    """The words with these numbers as a string column."""
    return words.take(pa.array(numbers)).cast(pa.string())
