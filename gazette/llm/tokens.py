"""Token counts of a byte-level BPE tokenizer by a two-tier lookup on the map side.

A text is the sum of its pre-tokens. The lengths of frequent pre-tokens come to every worker as one compact broadcast table;
misses are encoded with the tokenizer library, in batches, and remembered in the worker. No pre-token of the corpus is
shuffled: only the counts of a bounded sample are, to choose the table. The table decides speed, never a result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import file_bytes, worker_state

#: Rows whose pre-tokens are counted to choose the table, on average, and the table's entries at most.
SAMPLE, TABLE = 5_000, 50_000
#: Pre-tokens that a worker remembers besides the table; longer ones than so many characters are not kept.
CACHE, KEPT_CHARS = 1_000_000, 64
#: Up to here `re` and the library agree on what is a letter or a number, whatever version of Unicode each knows.
SAFE = 0x530


def _class(kind: str) -> str:
    """The characters below ``SAFE`` of a general category, as ranges of a character class."""
    codes = [c for c in range(SAFE) if unicodedata.category(chr(c))[0] == kind]
    starts = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


def pattern() -> re.Pattern:
    """The published byte-level pre-token rule over characters below ``SAFE``."""
    letters, numbers, blanks = _class("L"), _class("N"), "\\t-\\r\\x20\\x85\\xa0"
    return re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
    )


class Lengths(dict):
    """Pre-token -> number of tokens: the table, and what this worker has encoded since."""

    def __init__(self, tokenizer, table: dict[str, int]) -> None:
        super().__init__(table)
        self.tokenizer, self.table = tokenizer, table

    def __missing__(self, word: str) -> int:
        n = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= KEPT_CHARS:
            if len(self) >= len(self.table) + CACHE:
                self.clear()
                self.update(self.table)
            self[word] = n
        return n


class Counting:
    """Counts the tokens of texts as the tokenizer in ``data`` does without added special tokens."""

    def __init__(self, data: bytes, table: dict[str, int]) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        own = json.loads(data)
        cut = own["pre_tokenizer"] or {}
        self.by_words = (
            own["normalizer"] is None and not own["model"].get("dropout") and cut.get("type") == "ByteLevel"
            and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        )
        self.words = pattern().findall
        self.unsafe = re.compile(f"[^\x00-{chr(SAFE - 1)}]").search
        self.lengths = Lengths(self.tokenizer, table)

    def plain(self, text: str) -> bool:
        """Whether the text can be counted by pre-tokens: no special string, only characters on which both agree."""
        return self.by_words and not self.unsafe(text) and not any(s in text for s in self.special)

    def count(self, text: str) -> int:
        if self.plain(text):
            return sum(map(self.lengths.__getitem__, self.words(text)))
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


def frequent(documents: DataFrame, data: bytes, sample: int = SAMPLE, size: int = TABLE) -> dict[str, int]:
    """The lengths of the ``size`` most frequent pre-tokens of about ``sample`` rows, drawn by a hash of the text."""
    n = documents.count()
    share = min(1.0, sample / max(n, 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting, seen = Counting(data, {}), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text and counting.plain(text):
                    seen.update(counting.words(text))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    drawn = documents.filter(F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    top = (
        drawn.mapInArrow(count, "word string, n long").filter(F.length("word") <= KEPT_CHARS).groupBy("word")
        .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).toPandas()
    )
    lengths = Lengths(Counting(data, {}).tokenizer, {})
    return {w: lengths[w] for w in top["word"]}


def count_tokens(documents: DataFrame, tokenizer_path: str, limit: int = 512, sample: int = SAMPLE, size: int = TABLE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``documents``: UTF-8 bytes and tokens of the whole text.

    Tokens are those of the tokenizer file without begin, end or padding and without truncation; special strings inside a
    text count as its default takes them. Null texts count as empty: 0 and 0. Repeated rows and null doc_ids keep one row
    each; an empty table gives no rows; other columns are not read.
    """
    data = file_bytes(tokenizer_path)
    table = frequent(documents, data, sample, size)
    packed = (data, "\0".join(table).encode(), np.array(list(table.values()), np.int32).tobytes())
    name = "tokens-" + hashlib.sha256(b"".join(packed)).hexdigest()
    shared = documents.sparkSession.sparkContext.broadcast(packed)  # the file and at most ``size`` short words

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        state = worker_state()
        if name not in state:
            data, words, lengths = shared.value
            table = dict(zip(words.decode().split("\0"), np.frombuffer(lengths, np.int32).tolist(), strict=False))
            state[name] = Counting(data, table)
        for texts in batches:
            yield pd.Series([state[name].count(t) if t else 0 for t in texts], dtype="int64")

    rows = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), count("text").alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
