"""Personal data: fixed forms, and identifiers that bootstrapped contexts discover.

Emails, addresses, card and phone numbers are matched by their forms. They are the seeds: the words around them are lexical
patterns. Patterns and instances make a bipartite graph that Spark scores in rounds; patterns of high confidence add the
unseen identifiers that stand in the same context.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import KEY, join_on_key, row_key, stored

KINDS = ("email", "ip", "card", "phone")
#: The kind of a discovered span.
FOUND = "id"
#: A pattern is trusted from so many distinct known instances, and this share of known ones among its instances. Rounds end
#: when none is added; that many of them are an error.
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.8, 1_000

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: A token that may be an identifier: no white space, at least six characters, at least one digit.
TOKEN = re.compile(r"[^\s,;:\"'()\[\]{}<>|]*[0-9][^\s,;:\"'()\[\]{}<>|]*")
WORD = re.compile(r"\w+[:#=]?")
#: Code points on each side in which context words are looked for, and the marks of a line's ends, which are no words.
WINDOW, START, END = 64, "^", "$"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping emails in linear time: from each @ back over its local part, then on over the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", done)


def is_ip(match: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in match.split("."))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the four fixed forms, by start, then in the order of ``KINDS``."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if is_ip(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def context(text: str, start: int, end: int) -> tuple[str, str]:
    """The two words on each side of a span, lower-cased; where its line starts or ends, a mark stands for a word."""
    window = text[max(0, start - WINDOW):start]
    line = window.rpartition("\n")[2]
    whole = len(line) < len(window) or start <= WINDOW
    before = [START] * whole + [m[0] for m in WORD.finditer(line) if whole or m.start()]
    window = text[end:end + WINDOW]
    line = window.partition("\n")[0]
    whole = len(line) < len(window) or end + WINDOW >= len(text)
    after = [m[0] for m in WORD.finditer(line) if whole or m.end() < len(line)] + [END] * whole
    return " ".join(before[-2:]).lower(), " ".join(after[:2]).lower()


def candidates(text: str, spans: list[tuple[int, str, int]]) -> list[dict]:
    """Seeds and identifier-like tokens with their contexts; tokens that overlap a span of the fixed forms are left out."""
    out, i = [], 0
    for a, kind, b in spans:
        around = context(text, a, b)
        out.append({"kind": kind, "start": a, "end": b, "instance": text[a:b], "left": around[0], "right": around[1]})
    reach = 0
    for m in TOKEN.finditer(text) if DIGIT.search(text) else ():
        a, b = m.start(), m.end()
        b -= len(m[0]) - len(m[0].rstrip(".!?*#%&$"))
        while i < len(spans) and spans[i][0] < b:
            reach = max(reach, spans[i][2])
            i += 1
        if b - a >= 6 and reach <= a:
            around = context(text, a, b)
            out.append({"kind": None, "start": a, "end": b, "instance": text[a:b], "left": around[0], "right": around[1]})
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


EXTRACTED = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "seen array<struct<kind: string, start: int, end: int, instance: string, left: string, right: string>>"
)


def extracted(documents: DataFrame) -> DataFrame:
    """doc_id, the row key and what one pass over the whole texts gives: base spans, and candidates in their contexts."""

    @F.pandas_udf(EXTRACTED)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                spans = base_spans(text or "")
                base = joined(spans)
                counts = [sum(kind == k for _, kind, _ in spans) for k in KINDS]
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), base, candidates(text or "", spans)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "seen"])

    return documents.select("doc_id", *row_key(F.col("text")), scan("text").alias("found")).select(*KEY, "found.*")


def patterns_of(left: Column, right: Column) -> Column:
    """The patterns a context belongs to: the words on the left, those on the right, and both sides. Marks alone are none."""
    def named(side: str, words: Column, holds: Column) -> Column:
        return F.when(holds, F.concat(F.lit(side), words))

    first = F.substring_index(right, " ", 1)
    word = lambda c: c.rlike(r"\w")
    return F.array_compact(F.array(
        named("<", left, word(left) & left.contains(" ")),
        named(">", right, word(right) & right.contains(" ")),
        named("|", F.concat_ws("|", left, first), word(left) | word(first)),
    ))


def trusted_patterns(edges: DataFrame, support: int, confidence: float, rounds: int) -> DataFrame:
    """(pattern) of the patterns that are trusted once no round adds one; raises if that takes more than ``rounds`` rounds.

    ``edges``: distinct (pattern, instance, known), an edge of the graph each. A round trusts patterns by how many and
    which share of their instances are known, then makes known what trusted patterns hold. What is known only grows, so
    a trusted pattern stays trusted and leaves the graph; one of too few instances never enters it. Instances of many
    patterns and patterns of many instances are summed before they are shuffled; nothing is paired.
    """
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    edges = stored(edges.join(sizes, "pattern"), "edges")
    found: DataFrame | None = None
    for _ in range(rounds):
        scored = edges.groupBy("pattern", "n").agg(F.sum(F.col("known").cast("long")).alias("n_known"))
        new = stored(scored.filter((F.col("n_known") >= support) & (F.col("n_known") >= confidence * F.col("n"))).select("pattern"), "patterns")
        if new.isEmpty():
            return new if found is None else found
        found = new if found is None else stored(found.union(new), "patterns")
        reached = edges.filter(~F.col("known")).join(new, "pattern", "left_semi").select("instance").distinct()
        reached = reached.withColumn("reached", F.lit(True))
        edges = stored(
            edges.join(new, "pattern", "left_anti").join(reached, "instance", "left")
            .select("pattern", "n", "instance", (F.col("known") | F.coalesce("reached", F.lit(False))).alias("known")), "edges",
        )
    raise RuntimeError(f"patterns have not settled after {rounds} rounds")


def discovered(scanned: DataFrame, support: int, confidence: float, rounds: int) -> DataFrame:
    """The row key and the (start, end) of identifiers found by trusted patterns, one row per document that has any."""
    seen = scanned.select(*KEY, F.inline("seen"))
    edges = seen.select("instance", "kind", F.explode(patterns_of(F.col("left"), F.col("right"))).alias("pattern"))
    edges = edges.groupBy("pattern", "instance").agg(F.max(F.col("kind").isNotNull()).alias("known"))
    trusted = trusted_patterns(stored(edges, "edges"), support, confidence, rounds)
    hits = seen.filter("kind is null").select(*KEY, "start", "end", F.explode(patterns_of(F.col("left"), F.col("right"))).alias("pattern"))
    hits = hits.join(trusted, "pattern", "left_semi").select(*KEY, "start", "end").distinct()
    return stored(hits.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("more")), "discovered")


def personal_data(documents: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_id, base_sha256, spans per row of ``documents``.

    Spans are kind:start:end in code points, end exclusive, comma-joined by start and kind; base_sha256 covers the four
    fixed forms, spans also the discovered identifiers (kind ``id``), which never overlap the others. Null texts count as
    empty and have no span. Repeated rows and null doc_ids keep one row each; other columns are not read.
    """
    scanned = stored(extracted(documents), "scanned")
    more = discovered(scanned, support, confidence, rounds)
    rows = join_on_key(scanned.drop("seen"), more)
    base = F.when(F.col("base") != "", F.split("base", ",")).otherwise(F.array().cast("array<string>"))
    found = F.transform(F.coalesce("more", F.array().cast("array<struct<start: int, end: int>>")), lambda s: F.concat_ws(":", F.lit(FOUND), s["start"].cast("string"), s["end"].cast("string")))
    order = F.transform(F.concat(base, found), lambda s: F.struct(
        F.split(s, ":")[1].cast("int").alias("start"), F.array_position(F.lit([*KINDS, FOUND]), F.split(s, ":")[0]).alias("kind"), s.alias("span")))
    return rows.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_id"), "base_sha256",
        F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_join(F.array_sort(order)["span"], ",")).alias("spans"),
    )


def replaced(text: str, more: list | None) -> str:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the union takes the first kind."""
    spans = base_spans(text)
    spans = sorted(spans + [(s["start"], FOUND, s["end"]) for s in more]) if more is not None and len(more) else spans
    if not spans:
        return text
    out, done = [], 0
    for a, kind, b in spans:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask_personal_data(documents: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """``documents`` with all spans of ``personal_data`` in text replaced by ``<EMAIL>``, ``<IP>``, ``<CARD>``, ``<PHONE>``, ``<ID>``.

    All rows and columns stay. Null texts stay null. Only documents with discovered identifiers are joined with spans;
    the fixed forms are matched in place.
    """
    more = discovered(stored(extracted(documents).select(*KEY, "seen"), "scanned"), support, confidence, rounds)

    @F.pandas_udf("string")
    def mask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series([None if t is None else replaced(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    columns = [F.col(f"`{c}`") for c in documents.columns]
    rows = documents.select(F.struct(*columns).alias("_row"), "doc_id", *row_key(F.col("text")))
    rows = join_on_key(rows, more).withColumn("_text", mask("_row.text", "more"))
    return rows.select(*[F.col("_text").alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in documents.columns])
