"""Packing, source divergence and collocations against plain versions, and on odd rows."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gazette.llm import collocations, divergence, packing, words
from gazette.llm.common import load

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string"
ODD = ["", None, "  two  blanks ", "a'll I'LL 'tis", "<|endoftext|> in <|endoftext|>", "é́ ß ﬁ   x", "中文 текст ไทย", "a\x1cb\x85c\xa0 d", "½ ² 12ab",
       "\n\n\n x\t\ty ", "plain text, then “quoted” text — and more; 🙂 end", "a   b  c   ", "x" * 5000, "中" * 3000, "“" + "word " * 4000 + "”"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def mixed_texts(seed, n, parts, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(n)]


# --- packing --------------------------------------------------------------------------------------------------


def test_ids_are_the_librarys():
    own, theirs = packing.Ids(open(BPE, "rb").read()), library()
    mixes = mixed_texts(3, 3000, ["the", " ", "  ", "\n", "'s", "é", "9", "!", "\t", "Ω", "word", "“", "—", "🙂", "中", " ", "؁", "  a"])
    for text in [*filter(None, ODD), *mixes]:
        assert np.frombuffer(own.of(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


def check_packing(pieces, texts, capacity, end_id=0):
    """Every id once, sequences without gaps, no sequence too long; returns the padding and the lengths of the sequences."""
    theirs = library()
    ids = {i: [*(theirs.encode(t, add_special_tokens=False).ids if t else []), end_id] for i, t in enumerate(texts)}
    covered, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        cut = ids[p["doc_id"]][p["start"]:p["start"] + p["length"]]
        assert len(cut) == p["length"] > 0 and p["doc_tokens"] == len(ids[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(np.array(cut, "<u4").tobytes())
        covered[p["doc_id"]].append((p["start"], p["length"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(covered) == set(ids)
    for doc, cuts in covered.items():
        assert [s for s, _ in sorted(cuts)] == [0, *itertools.accumulate(n for _, n in sorted(cuts))][:-1]
        assert sum(n for _, n in cuts) == len(ids[doc])
    sizes = []
    for cuts in sequences.values():
        assert [s for s, _ in sorted(cuts)] == [0, *itertools.accumulate(n for _, n in sorted(cuts))][:-1]
        sizes.append(sum(n for _, n in cuts))
    assert max(sizes) <= capacity
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in sizes), sizes


@pytest.mark.parametrize("capacity,wave", [(1024, packing.WAVE), (64, 500), (1024, 3000)])
def test_packing_places_every_id_once(spark, capacity, wave):
    texts = [r["text"] for r in load(spark, SF, "documents").collect()] + ODD
    rows = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).repartition(3)
    got = packing.pack_documents(rows, BPE, capacity=capacity, wave=wave).collect()
    padding, sizes = check_packing(got, texts, capacity)
    assert padding == 0
    assert sum(n < capacity for n in sizes) <= 3 * 10


def test_bins_of_a_class_take_a_fixed_number_of_documents():
    packer = packing.Packer(1024, 0)
    rng = random.Random(5)
    for row in range(500):
        packer.add(row, bytes(4 * rng.randint(1, 1023)))
    lengths = np.array([len(p[2]) // 4 for p in packer.pool])
    order, at = packer.bins(lengths)
    for b in range(at.max() + 1):
        inside = lengths[order[at == b]]
        assert len(set(1024 // inside)) == 1 and len(inside) == 1024 // inside[0] and inside.sum() <= 1024
    packer.pack()
    row, start, length, _, sequence, _ = packer.take()
    whole = (start == 0) & (length == lengths[row])
    assert whole.sum() > 250 and packer.pooled < 1024  # most documents stay whole, less than a sequence waits
    assert set(np.bincount(sequence, length)) == {1024.0}


# --- source divergence ----------------------------------------------------------------------------------------


def plain_divergence(rows, least=10, top=10):
    upper = {c: c + 32 for c in range(65, 91)}
    docs = [(lang or "", source or "", Counter("".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in (text or "")).translate(upper).split(" ")))
            for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen, total, by_source = Counter(), Counter(), defaultdict(Counter)
        for _, source, terms in (d for d in docs if d[0] == lang):
            terms.pop("", None)
            seen.update(terms.keys())
            total.update(terms)
            by_source[source].update(terms)
        kept = sorted(t for t in seen if seen[t] >= least)
        p = lambda counts: {t: 1 + 10**9 * (counts[t] + 2) // (sum(counts[k] for k in kept) + 2 * len(kept)) for t in kept}
        q, f = p(total), lambda a, b: (a - b) ** 2 // (a + b)
        shares = {s: p(by_source[s]) for s in by_source}
        for s in by_source:
            pair = [(sum(f(shares[s][t], shares[o][t]) for t in kept), o) for o in by_source if o != s]
            term = [(f(shares[s][t], q[t]), t) for t in kept if by_source[s][t] and shares[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:most], start=1)]
    return sorted(out)


def divergence_rows(n=400, seed=1):
    rng = random.Random(seed)
    terms = ["The", "cat", "é", "ÉÉ", "中文", "🙂x", "a1b", "don't", "Zz", "Ω", "x" * 70, "\x00k", *(f"t{chr(97 + i)}" for i in range(20))]
    rows = [(i, None if i % 50 == 9 else " ".join(rng.choice(terms[:rng.randint(3, len(terms))]) for _ in range(rng.randint(0, 30))),
             rng.choice(["en", "en", "fr", None, "rare"] if i % 7 else ["", "en"]), rng.choice(["a", "b", "", None, "c", "é"])) for i in range(n)]
    return rows + [(n, "only here", "solo", "a"), (n + 1, None, "none", None), (n + 1, None, "none", "b"), (n + 1, None, "none", "b")]


@pytest.mark.parametrize("least", [10, 2, 10**6])
def test_divergence_against_the_plain_version(spark, least):
    rows = divergence_rows()
    got = divergence.source_divergence(frame(spark, rows), least_docs=least).collect()
    assert sorted(tuple(r) for r in got) == plain_divergence(rows, least)


def test_divergence_of_slices_and_flushed_buffers(spark, monkeypatch):
    rows = divergence_rows(60, 4) + [(i, " ".join(f"w{chr(97 + j % 26)} the" for j in range(i, 3000 + i)), "en", "long") for i in range(12)]
    want = plain_divergence(rows, 3)
    sizes = [np.sort(c).tolist() for _, c in (divergence.document_terms(rows[-1][1].encode(), words.Numbered()),)]
    monkeypatch.setattr(words.slices, "__defaults__", (100,))
    assert [np.sort(c).tolist() for _, c in (divergence.document_terms(rows[-1][1].encode(), words.Numbered()),)] == sizes
    assert sorted(tuple(r) for r in divergence.source_divergence(frame(spark, rows), least_docs=3).collect()) == want


def test_shares_and_differences_of_large_counts(spark):
    counts = [(0, 1, 1), (10**13, 10**15, 10**9), (9 * 10**18 // 1000, 9 * 10**18, 10**12), (5, 5, 1)]
    frame_ = spark.createDataFrame(counts, "c long, n long, v long")
    got = frame_.select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in counts]
    shares = [(10**9 + 1, 1), (1, 10**9 + 1), (7, 7), (333_333_334, 123_456_789)]
    got = spark.createDataFrame(shares, "p long, q long").select(divergence.difference(F.col("p"), F.col("q")).alias("f")).collect()
    assert [r["f"] for r in got] == [(p - q) ** 2 // (p + q) for p, q in shares]


# --- collocations ---------------------------------------------------------------------------------------------


def plain_collocations(rows, least=10, top=2000, cover=50):
    upper = {c: c + 32 for c in range(65, 91)}
    f = defaultdict(Counter)
    for _, text, lang, _ in rows:
        pieces = "".join("\n" if c in ".,;:!?\n\x0b\x0c\r" else c for c in (text or "").translate(upper)).split("\n")
        for piece in pieces:
            found = [w for w in piece.replace("\t", " ").split(" ") if w]
            for m in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(found[i:i + m]) for i in range(len(found) - m + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        phrases = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        best = []
        for p, a in phrases.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * c >= cover * a for q, c in phrases.items()):
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], start=1)]
    return sorted(out)


def phrase_rows(n=300, seed=2):
    rng = random.Random(seed)
    terms = ["the", "The", "of", "é", "a\x01", "a", "中文", "New", "york", "city", "\x00", "x" * 80, "b\x1f", "\xa0"]
    joints = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "!?", " ; "]
    return [(i, None if i % 40 == 3 else "".join(rng.choice(terms) + rng.choice(joints) for _ in range(rng.randint(0, 40))), rng.choice(["en", "fr", None, ""]), "s")
            for i in range(n)]


@pytest.mark.parametrize("budget,top", [(1_000_000, 2000), (50, 2000), (7, 5)])
def test_collocations_against_the_plain_version(spark, budget, top):
    rows = phrase_rows()
    got = collocations.collocations(frame(spark, rows), top=top, budget=budget).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(rows, top=top)


def suffix_counts(rows, parted=(), groups=5, frequent=b"\xff"):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "und" for r in rows], "text": [r[1] or "" for r in rows]})
    out = Counter()
    for b in collocations.counted_suffixes([batch], frequent, dict(parted), groups):
        for lang, group, *w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            assert 0 <= group < groups
            out[(lang, *w)] += n
    return out


def test_buffers_that_end_anywhere_count_the_same(monkeypatch):
    rows = phrase_rows(80) + [(500, "one two three four five " * 400, "en", "s"), (501, "a b. c " * 300, None, "s")]
    want = suffix_counts(rows)
    assert sum(want.values()) == sum(c for (_, w, *rest), c in want.items())
    monkeypatch.setattr(words.slices, "__defaults__", (40,))
    for positions in (1, 7, 100, 1000):
        monkeypatch.setattr(collocations, "POSITIONS", positions)
        assert suffix_counts(rows, {("en", "one"): 9, ("en", "the"): 9}) == want


def test_the_set_of_frequent_words_holds_them_all(spark):
    rows = [("en", f"w{i}é", i % 13) for i in range(500)] + [("", "w1é", 20), ("fr", "w2é", 20)]
    words_ = spark.createDataFrame(rows, "lang string, word string, n long")
    for bits in (1 << 26, 1 << 16, 4096, 64):
        held = np.frombuffer(collocations.frequent_words(words_, 10, bits), np.uint8)
        assert len(held) * 8 == bits
        bit = lambda lang, word: held[(at := zlib.crc32(f"{lang}\0{word}".encode()) % bits) >> 3] >> (at & 7) & 1
        assert all(bit(lang, w) for lang, w, n in rows if n >= 10)
        if bits == 1 << 26:
            assert not any(bit(lang, w) for lang, w, n in rows if n < 10)


def test_groups_are_merged_beyond_the_budget(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({
        "lang": ["en"] * 600, "group": [1] * 400 + [2] * 200, "w1": ["a"] * 400 + ["b"] * 200, "w2": ["x", "y"] * 300,
        "w3": pa.array(["z", None] * 300, pa.string()), "n": [1] * 600})
    monkeypatch.setattr(collocations, "BUDGET", 20)
    found = [tuple(c) for b in collocations.subtrees([batch.slice(i, 50) for i in range(0, 600, 50)], {}, 10) for c in zip(*(x.to_pylist() for x in b.columns), strict=True)]
    assert sorted(found, key=str) == sorted([("en", "a", "x", None, 200, 400, None), ("en", "a", "y", None, 200, 400, None), ("en", "a", "x", "z", 200, 400, 200),
                                             ("en", "b", "x", None, 100, 200, None), ("en", "b", "y", None, 100, 200, None), ("en", "b", "x", "z", 100, 200, 100)], key=str)


# --- odd tables -----------------------------------------------------------------------------------------------

OPERATORS = {
    "packing": lambda d: packing.pack_documents(d, BPE),
    "divergence": lambda d: divergence.source_divergence(d, least_docs=1),
    "collocations": lambda d: collocations.collocations(d, least=1),
}
CLASH = ["start", "length", "rank", "score", "n", "term", "item", "value", "part", "group", "w1", "c", "d", "m", "a", "l", "r", "phrase", "total", "row"]


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_empty_tables_and_clashing_columns(spark, name):
    rows = [(1, "A b a b. " * 30, "en", "a"), (1, "A b a b. " * 30, "en", "a"), (None, None, None, None), (2, "", "en", "b"), (3, " \n\t", "fr", "a"),
            (4, "word " * 60_000, "en", "c"), (None, "x" * 300_000, None, "c")]
    plain = OPERATORS[name](frame(spark, rows))
    extra = frame(spark, rows)
    for c in CLASH:
        extra = extra.withColumn(c, F.lit("x"))
    as_set = lambda df: sorted(map(str, df.collect()))
    if name == "packing":
        drop = lambda df: sorted(map(str, df.drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect()))
        assert drop(plain) == drop(OPERATORS[name](extra))
        tokens = {(r["doc_id"], r["doc_tokens"]) for r in plain.collect()}
        assert {d for d, _ in tokens} == {1, 2, 3, 4, None} and (None, 1) in tokens and (2, 1) in tokens
    else:
        assert as_set(plain) == as_set(OPERATORS[name](extra))
        assert plain.count() > 0
    empty = OPERATORS[name](frame(spark, []))
    assert empty.count() == 0 and empty.columns == plain.columns
