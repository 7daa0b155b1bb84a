"""Harmonic packing of tokenized documents into sequences of a fixed capacity, by each worker on its own.

A document is cut into whole sequences and a remainder. Remainders are classed by the reciprocal of the capacity: class k
holds the lengths in (capacity / (k + 1), capacity / k], and a bin of class k takes exactly k of them. What a bin has left is
topped up with pieces cut from the documents of the smallest classes, so every sequence is full. The last few tokens of a
task go into sequences whose lengths are powers of two, which are not padded. Nothing is shuffled or sorted across workers.
"""

from __future__ import annotations

import codecs
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gazette.llm.common import file_bytes, once
from gazette.llm.tokens import CACHE, KEPT_CHARS, SAFE, Counting

CAPACITY, END = 1024, 0
#: Ids of remainders that a task holds before it packs them, and finished pieces that it holds before it passes them on.
WAVE, HELD = 2_000_000, 50_000
#: Bits of a sequence's number below those of its partition.
PARTITION_SHIFT = 40

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> str:
    """The published byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return "".join(chr(b if b in printable else 256 + others.index(b)) for b in range(256))


class IdBytes(dict):
    """Pre-token -> its ids as little-endian 32-bit numbers, merged by the library's model and remembered.

    The words are pre-tokens already, so the model takes them in byte letters, without the library's own pre-tokenizer.
    """

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.merged, self.letters = tokenizer.model.tokenize, byte_letters()

    def __missing__(self, word: str) -> bytes:
        tokens = self.merged(codecs.charmap_decode(word.encode("utf-8", "surrogatepass"), "strict", self.letters)[0])
        ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        if len(word) <= KEPT_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids


class Ids:
    """The ids of texts as the tokenizer in ``data`` gives them, without added special tokens.

    Texts are looked up by pre-tokens. The pre-token rule always cuts before a blank behind a character that is none, whatever
    follows: a text with characters that `re` may class in another way is cut there, and only the chunks that hold such a
    character go to the library. Texts that hold a special string go there whole.
    """

    def __init__(self, data: bytes) -> None:
        self.counting = Counting(data, {})
        self.table = IdBytes(self.counting.tokenizer)
        self.cut = re.compile(f"(?<=[^\\t-\\r\\x20\\x85\\xa0{chr(SAFE)}-\U0010ffff])(?=\x20)").split

    def library(self, text: str) -> bytes:
        return np.array(self.counting.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def looked_up(self, text: str) -> bytes:
        return b"".join(map(self.table.__getitem__, self.counting.words(text)))

    def of(self, text: str) -> bytes:
        if self.counting.plain(text):
            return self.looked_up(text)
        if not self.counting.by_words or any(s in text for s in self.counting.special):
            return self.library(text)
        return b"".join([self.library(c) if self.counting.unsafe(c) else self.looked_up(c) for c in self.cut(text)])


class Packer:
    """The sequences of one task. Pieces are (row, start, length, crc, sequence, offset); rows are those added, in order."""

    def __init__(self, capacity: int, first_sequence: int, wave: int = WAVE) -> None:
        self.capacity, self.sequence, self.wave = capacity, first_sequence, wave
        self.pool: list[tuple[int, int, bytes]] = []  # remainders: row, start, ids
        self.pooled = 0
        self.out: list[tuple[np.ndarray, ...]] = []
        self.pieces = 0

    def emit(self, row, start, length, crc, sequence, offset) -> None:
        self.out.append(tuple(np.asarray(c, np.int64) for c in (row, start, length, crc, sequence, offset)))
        self.pieces += len(row)

    def add(self, row: int, ids: bytes) -> None:
        size = 4 * self.capacity
        whole = len(ids) // size
        if whole:
            view = memoryview(ids)
            crc = [zlib.crc32(view[i * size:(i + 1) * size]) for i in range(whole)]
            k = np.arange(whole)
            self.emit(np.full(whole, row), k * self.capacity, np.full(whole, self.capacity), crc, self.sequence + k, np.zeros(whole))
            self.sequence += whole
        if len(ids) > whole * size:
            self.pool.append((row, whole * self.capacity, ids[whole * size:]))
            self.pooled += len(ids) // 4 - whole * self.capacity
        if self.pooled >= self.wave:
            self.pack()

    def bins(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The remainders by class, and the bin of each: k of class k fill one; -1 where a class has fewer left."""
        kind = self.capacity // lengths
        order = np.argsort(kind, kind="stable")
        kind = kind[order]
        first = np.searchsorted(kind, kind, "left")
        count = np.searchsorted(kind, kind, "right") - first
        place = np.arange(len(kind)) - first
        complete = place < count // kind * kind
        opens = complete & (place % kind == 0)
        return order, np.where(complete, np.cumsum(opens) - 1, -1)

    def pack(self, last: bool = False) -> None:
        """Packs the pool into full sequences; fewer ids than a sequence stay in it, unless it is the last time."""
        if not self.pool:
            return
        rows = np.array([p[0] for p in self.pool], np.int64)
        starts = np.array([p[1] for p in self.pool], np.int64)
        lengths = np.array([len(p[2]) // 4 for p in self.pool], np.int64)
        order, at = self.bins(lengths)
        full = int(lengths.sum()) // self.capacity
        kept = (at >= 0) & (at < full)  # bins of the largest remainders; the others are cut to top them up
        whole, cut = order[kept], order[~kept]
        at = at[kept]
        filled = np.bincount(at, lengths[whole], full).astype(np.int64)
        before = np.cumsum(lengths[whole]) - lengths[whole]
        opening = np.searchsorted(at, at, "left")
        self.emit(rows[whole], starts[whole], lengths[whole], [zlib.crc32(self.pool[i][2]) for i in whole], self.sequence + at,
                  before - before[opening] if len(whole) else before)
        spare = self.capacity - filled
        rest = int(lengths[cut].sum() - spare.sum())
        if last:  # the binary digits of the rest are lengths that take no padding
            digits = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
            spare, filled = np.append(spare, digits).astype(np.int64), np.append(filled, np.zeros(len(digits), np.int64))
        have, room = np.append(0, np.cumsum(lengths[cut])), np.append(0, np.cumsum(spare))
        edges = np.union1d(have, room)
        begin, length = edges[:-1], np.diff(edges)
        source, target = np.searchsorted(have, begin, "right") - 1, np.searchsorted(room, begin, "right") - 1
        inside = begin < room[-1]
        shift = begin - have[source]
        pool = [(int(cut[s]), int(o), int(n)) for s, o, n in zip(source, shift, length, strict=True)]
        ids = [self.pool[i][2][4 * o:4 * (o + n)] for i, o, n in pool]
        piece = cut[source]
        used, goal = np.flatnonzero(inside), target[inside]
        self.emit(rows[piece][used], (starts[piece] + shift)[used], length[used], [zlib.crc32(ids[i]) for i in used], self.sequence + goal,
                  filled[goal] + begin[used] - room[goal])
        self.sequence += len(spare)
        self.pool = [(int(rows[piece[i]]), int(starts[piece[i]] + shift[i]), ids[i]) for i in np.flatnonzero(~inside)]
        self.pooled = sum(len(p[2]) // 4 for p in self.pool)

    def take(self) -> list[np.ndarray]:
        out, self.out, self.pieces = self.out, [], 0
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END, wave: int = WAVE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece of a document in a sequence.

    A document is its ids by the tokenizer file, without added special tokens, and then ``end_id``; ``start`` counts its ids
    before the piece. Each id lies in exactly one piece, pieces of a sequence follow each other without gaps, and sequences
    hold ``capacity`` ids, but for up to log2(capacity) shorter ones per task, whose lengths are powers of two and need no
    padding. ids_crc32 is that of the ids as little-endian 32-bit numbers. Null texts count as empty and give one id.
    Repeated rows and null doc_ids are documents of their own; an empty table gives no rows; other columns are not read.
    A long text is cut like any other; a task holds about ``wave`` ids, at least those of one text. Sequence ids are unique,
    not dense. The rows of one task make up its sequences, so the input should be a stored table, whose tasks can be repeated.
    """
    shared = documents.sparkSession.sparkContext.broadcast(file_bytes(tokenizer_path))
    name = f"packing-{zlib.crc32(shared.value)}"
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), *T._parse_datatype_string(PIECE).fields])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of = once(name, lambda: Ids(shared.value)).of
        packer = Packer(capacity, TaskContext.get().partitionId() << PARTITION_SHIFT, wave)
        doc_ids, sizes, kind = {}, {}, None

        def passed_on() -> pa.RecordBatch:
            row, *rest = packer.take()
            rows = row.tolist()
            columns = [pa.array([doc_ids[i] for i in rows], kind), *(pa.array(c) for c in rest)]
            columns.insert(4, pa.array([sizes[i] for i in rows], pa.int64()))
            waiting = {p[0] for p in packer.pool}
            for i in [i for i in doc_ids if i not in waiting]:
                del doc_ids[i], sizes[i]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        row = 0
        for batch in batches:
            kind = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = (ids_of(text) if text else b"") + end
                doc_ids[row], sizes[row] = doc_id, len(ids) // 4
                packer.add(row, ids)
                row += 1
                if packer.pieces >= HELD:
                    yield passed_on()
        if row:
            packer.pack(last=True)
            yield passed_on()

    return documents.select("doc_id", "text").mapInArrow(run, schema)
