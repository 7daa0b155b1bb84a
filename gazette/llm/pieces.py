"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces and a one-pass Viterbi.

The automaton reads a word once. At each position its output links give every piece that ends there, longest first, and each
relaxes the best segmentation of the prefix. For a unigram model the sum of piece scores is relaxed. For a BPE model a
piece may follow only where the pair stands as it is after the model's merges; exactly one segmentation of a prefix
satisfies this, and it is that of the merges, so the result is the library's.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.common import file_bytes, list_array, worker_state

SPACE = "▁"
#: Distinct words whose pieces, and pairs of pieces whose standing, a Python worker remembers.
CACHE = 200_000


def packed(ids: list[int]) -> bytes:
    """Ids as 32-bit numbers; of the few ids of a word an array is made faster than one of numpy."""
    return array("i", ids).tobytes()


def model_type(proto: bytes) -> str:
    """``unigram`` or ``bpe``: field 3 of the trainer settings, which are field 2 of the model (1 and 2)."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            else:
                size = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
                yield tag >> 3, data[at:at + size]
                at += size

    trainer = next((v for k, v in fields(proto) if k == 2), b"")
    return {1: "unigram", 2: "bpe"}[next((v for k, v in fields(trainer) if k == 3), 1)]


class Model:
    """Pieces, scores and the automaton of a model file.

    Handles models that leave the text as it is but for the blank mark, add a blank in front, and keep repeated blanks, as
    the given file does; the constructor checks this by encoding a probe with the library.
    """

    def __init__(self, proto: bytes) -> None:
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.kind = model_type(proto)
        n = lib.vocab_size()
        self.unknown = lib.unk_id()
        special = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(n)]
        names = [lib.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        self.score = [lib.get_score(i) for i in range(n)]
        self.penalty = min(self.score) - 10
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_fallback = lib.is_byte(self.bytes[0])
        self.decoded = [b"" if lib.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        for b, i in enumerate(self.bytes if self.byte_fallback else []):
            self.decoded[i] = bytes([b])
        if self.unknown >= 0:
            self.decoded[self.unknown] = " ⁇ ".encode()
        self.names = names
        self.alphabet = {p for p in self.ids if len(p) == 1}
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # the order in which merges make pieces; single characters come before all, equal scores share a place
        self.place = dict.fromkeys(self.ids.values(), -1)
        ranked = sorted((i for p, i in self.ids.items() if len(p) > 1), key=lambda i: -self.score[i])
        for k, i in enumerate(ranked):
            tied = k and self.score[i] == self.score[ranked[k - 1]]
            self.place[i] = self.place[ranked[k - 1]] if tied else k
        shared = [x for x, n in Counter(self.place.values()).items() if n > 1 and x >= 0]
        self.plain = {i for i, k in self.place.items() if k in shared}  # compared by the merges themselves
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.kind == "unigram" or self.merged(p) == [i]:
                self.automaton.add_word(p, (i, len(p)))
                if self.kind == "bpe" and len(p) > 1:
                    self.halves[i] = a, b = self.merged(p, 2)
                    if max(self.place[a], self.place[b]) >= self.place[i]:
                        self.plain.add(i)
        self.automaton.make_automaton()
        self.stands: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.newline: bytes | None = None
        probe = " Ab  c\n"
        if np.frombuffer(self.encode(probe), np.int32).tolist() != lib.encode(probe):
            raise ValueError("the model changes texts in a way that is not handled here")

    def merged(self, text: str, stop: int = 1) -> list[int]:
        """The merges of a BPE model, done plainly until ``stop`` parts: the best pair first, the leftmost of equals."""
        parts, get, score = list(text), self.ids.get, self.score
        pairs = [get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while len(parts) > stop:
            best, at = -np.inf, -1
            for k, i in enumerate(pairs):
                if i is not None and score[i] > best:
                    best, at = score[i], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at])
        return [get(p, -1) for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the merges leave this pair as it is."""
        key = left << 32 | right
        known = self.stands.get(key)
        if known is None:
            if len(self.stands) > CACHE:
                self.stands.clear()
            if left in self.plain or right in self.plain:
                known = self.merged(self.names[left] + self.names[right]) == [left, right]
            else:
                known = self._unmerged(left, right)
            self.stands[key] = known
        return known

    def _unmerged(self, left: int, right: int) -> bool:
        """Goes back in time at the seam: undoes the later of both pieces and asks whether the parts that then met would
        have merged before that piece took one of them. Of equal places the left one merges first.
        """
        place, names, get = self.place, self.names, self.ids.get
        until = np.inf  # parts at the seam met until this place
        while True:
            both = get(names[left] + names[right])
            if both is not None and place[both] < until:
                return False
            if left not in self.halves and right not in self.halves:
                return True
            if place[left] > place[right]:
                until, left = place[left], self.halves[left][1]
            else:
                until, right = place[right] + 0.5, self.halves[right][0]

    def _bpe(self, text: str) -> list[int]:
        """The pieces of a word whose characters all are in pieces: of those that end at a position, the one that may
        follow what stands before it."""
        n = len(text)
        last, start = [-1] * (n + 1), [-1] * (n + 1)
        known, follow = self.stands.get, self.may_follow
        for end, (piece, length) in self.automaton.iter(text):
            j = end + 1
            if start[j] < 0:
                i = j - length
                left = last[i]
                if left < 0:
                    last[j], start[j] = piece, i
                else:
                    stands = known(left << 32 | piece)
                    if stands or stands is None and follow(left, piece):
                        last[j], start[j] = piece, i
        out, j = [], n
        while j:
            out.append(last[j])
            j = start[j]
        return out[::-1]

    def segment(self, text: str) -> list[int]:
        """The pieces of one word by a single pass; characters in no piece become byte pieces, or the unknown piece."""
        if self.kind == "bpe" and self.alphabet.issuperset(text):
            return self._bpe(text)
        n = len(text)
        last: list[tuple[int, int] | None] = [None] * (n + 1)  # per end: the piece, where it starts
        best = [0.0] * (n + 1)
        bpe, follow, score, unknown = self.kind == "bpe", self.may_follow, self.score, self.penalty
        matches = self.automaton.iter(text)
        end, (piece, length) = next(matches, (n, (0, 0)))
        for j in range(n):
            while end == j:
                i = j + 1 - length
                before = last[i]
                if i == 0 or before is not None:
                    if bpe:
                        if i == 0 or before[0] < 0 or follow(before[0], piece):
                            last[j + 1] = (piece, i)
                    elif last[j + 1] is None or best[i] + score[piece] > best[j + 1]:
                        last[j + 1], best[j + 1] = (piece, i), best[i] + score[piece]
                end, (piece, length) = next(matches, (n, (0, 0)))
            if last[j + 1] is None and (not bpe or text[j] not in self.ids):
                last[j + 1], best[j + 1] = (-1, j), best[j] + unknown
        out, j = [], n
        while j:
            piece, i = last[j]
            if piece >= 0:
                out.append(piece)
            elif self.byte_fallback:
                out += [self.bytes[b] for b in reversed(text[i:j].encode("utf-8", "surrogatepass"))]
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)
            j = i
        return out[::-1]

    def word(self, text: str) -> bytes:
        """The ids of a word (blank marks in front only) as 32-bit numbers, remembered."""
        found = self.words.get(text)
        if found is None:
            parts = text.split("\n") if "\n" in text and "\n" not in self.ids else [text]
            if len(parts) > 1:  # a character in no piece separates what is left and right of it
                if self.newline is None:
                    self.newline = packed(self.segment("\n"))
                found = self.newline.join(self.word(p) if p else b"" for p in parts)
            else:
                found = packed(self.segment(text))
            if len(text) <= 64:
                if len(self.words) >= CACHE:
                    self.words.clear()
                self.words[text] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as 32-bit numbers."""
        if not text:
            return b""
        if not self.splits:
            return np.array(self.segment(SPACE + text.replace(" ", SPACE)), np.int32).tobytes()
        parts = text.split(" ")
        if "" in parts or SPACE in text:  # marks in a row may be one piece
            marked, words, start = SPACE + text.replace(" ", SPACE), [], 0
            for at in range(1, len(marked)):
                if marked[at] == SPACE != marked[at - 1]:
                    words.append(marked[start:at])
                    start = at
            parts = [*words, marked[start:]]
        else:
            parts = [SPACE + p for p in parts]
        get, slow = self.words.get, self.word
        return b"".join([get(p) or slow(p) for p in parts])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join([self.decoded[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def model_of(proto: bytes) -> Model:
    state = worker_state()
    name = f"pieces-{hashlib.sha256(proto).hexdigest()}"
    if name not in state:
        state[name] = Model(proto)
    return state[name]


def encode(documents: DataFrame, model_path: str) -> DataFrame:
    """``documents`` with n_pieces (long), piece_ids (array of int) and round_trip (boolean).

    piece_ids are those of the model for the whole text, without begin or end; empty and null texts have none.
    round_trip tells whether decoding gives the text again (true for null). Columns of these three names are replaced; all
    other columns stay. Repeated rows keep one row each; an empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(file_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        for batch in batches:
            texts = batch.column("_row").field("text").to_pylist()
            # some texts at a time, so that ids of very long ones do not add up
            start, size = 0, 0
            for end, text in enumerate(texts, start=1):
                size += len(text or "")
                if size >= 8 << 20 or end == len(texts):
                    found = [model.encode(t or "") for t in texts[start:end]]
                    ids = np.frombuffer(b"".join(found), np.int32)
                    offsets = np.concatenate(([0], np.cumsum([len(f) // 4 for f in found])))
                    same = [model.decode(ids[a:b].tolist()) == (t or "") for a, b, t in zip(offsets, offsets[1:], texts[start:end], strict=False)]
                    kept = batch.slice(start, end - start)
                    yield pa.RecordBatch.from_arrays(
                        [kept.column("_row"), pa.array(np.diff(offsets), pa.int64()), list_array(ids, offsets), pa.array(same)],
                        ["_row", "n_pieces", "piece_ids", "round_trip"],
                    )
                    start, size = end, 0

    own = {"n_pieces", "piece_ids", "round_trip"}
    kept = [c for c in documents.columns if c not in own]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"))
    schema = T.StructType([
        rows.schema["_row"], T.StructField("n_pieces", T.LongType()), T.StructField("piece_ids", T.ArrayType(T.IntegerType())),
        T.StructField("round_trip", T.BooleanType()),
    ])
    return rows.mapInArrow(run, schema).select("_row.*", "n_pieces", "piece_ids", "round_trip")


def decode(encoded: DataFrame, model_path: str, ids: str = "piece_ids") -> DataFrame:
    """``encoded`` with a column decoded: the text of the ids; null for null ids, empty for none."""
    shared = encoded.sparkSession.sparkContext.broadcast(file_bytes(model_path))

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_of(shared.value)
        for lists in batches:
            yield pd.Series([None if x is None else model.decode(list(x)) for x in lists], dtype=object)

    return encoded.withColumn("decoded", text_of(F.col(ids)))
