"""Secret scans with DataFrame operations only: fixed forms, and weak candidates that complement each other.

Assignments, access identifiers and long hex strings are reported wherever they are. A weak candidate (an identifier, a
secret-like string, an endpoint) says little alone; it is one part of a credential. An interval join links candidates whose
spans lie in one scope, and a part is reported only if its complement is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import KEY, join_on_key, row_key, stored

# --- fixed forms: (kind, pattern that must occur, pattern of a match, least length, group the length is of) ----
# Runs of one character class may be asked for at their least length at once: the same matches stay.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 1, 8), ("access", "AKIA[A-Z0-9]{12,}", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32)]

# --- weak parts -----------------------------------------------------------------------------------------------
IDENTIFIER, STRING, ENDPOINT = "identifier", "string", "endpoint"
PARTS = [
    # who: an account named in front, or an access key too short for the fixed form
    (IDENTIFIER, r"(?i:\b(?:user(?:name)?|login|account|client_?id|access_?(?:key_?)?id)\b)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@_.+-]{3,}"),
    # what: forty characters as of a signing key, or sixteen to thirty-one hex digits
    (STRING, r"(?<![A-Za-z0-9+/=_.-])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"),
    (STRING, r"(?<![A-Za-z0-9])(?=[0-9a-f]{0,30}[0-9])(?=[0-9a-f]{0,30}[a-f])[0-9a-f]{16,31}(?![A-Za-z0-9])"),
    # where: a host with a scheme, or one named in front
    (ENDPOINT, r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9.-]+(?::[0-9]{1,5})?|(?i:\b(?:host|endpoint|server)\b)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
]
ORDER = ["assign", "access", "hex", IDENTIFIER, STRING, ENDPOINT]
#: Spans whose gap is at most so many code points are in one scope.
SCOPE = 200
#: What completes a part: a weak identifier or endpoint needs a secret, a weak string needs an identifier.
COMPLEMENT = [
    (IDENTIFIER, "assign"), (IDENTIFIER, "hex"), (IDENTIFIER, STRING), (STRING, "access"), (STRING, IDENTIFIER),
    (ENDPOINT, "assign"), (ENDPOINT, "hex"), (ENDPOINT, "access"),
]

SPANS = "array<struct<start: int, kind: string, end: int>>"


def running(items: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """``items`` (an array of structs) with their field ``run`` merged over all items up to each one.

    Distances double from step to step, so n items take n log n merges; appending to an array item by item would copy it n times.
    """
    def step(acc: Column, distance: Column) -> Column:
        merged = F.transform(acc, lambda x, i: x.withField("run", F.when(i >= distance, merge(x["run"], F.get(acc, i - distance)["run"])).otherwise(x["run"])))
        return F.when(distance < F.size(acc), merged).otherwise(acc)

    return F.aggregate(F.lit([1 << k for k in range(31)]), items, step)


def spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """The leftmost non-overlapping matches of ``pattern`` as an array of (start, kind, end) in code points.

    The text between the matches and the matches alternate, so positions are running sums of their lengths. Matches whose
    ``group`` has fewer than ``least`` characters take their place in that sum but are dropped.
    """
    whole = F.lit(f"({pattern})")
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, whole, F.lit(1)), F.length)
    held = F.transform(F.regexp_extract_all(text, whole, F.lit(group + 1)), F.length)
    parts = F.filter(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), held.alias("held")), lambda x: x["size"].isNotNull())
    parts = F.transform(parts, lambda x: F.struct(x["size"].alias("size"), x["held"].alias("held"), (x["gap"] + x["size"]).alias("run")))
    kept = F.filter(running(parts, lambda a, b: a + b), lambda x: x["held"] >= least)
    found = F.transform(kept, lambda x: F.struct((x["run"] - x["size"]).alias("start"), F.lit(kind).alias("kind"), x["run"].alias("end")))
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as {SPANS})"))


def clear_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others, in one walk over both by position.

    A span is overlapped if, of the others that start before its end, the furthest end lies behind its start.
    """
    place = lambda s, at, run: F.struct(at.cast("long").alias("at"), run.alias("run"), s.alias("span"))
    both = F.concat(
        F.transform(others, lambda s: place(F.lit(None).cast(SPANS[6:-1]), 2 * s["start"] + 1, s["end"])),
        F.transform(spans, lambda s: place(s, 2 * s["end"], F.lit(0))),
    )
    walked = F.filter(running(F.array_sort(both), F.greatest), lambda x: x["span"].isNotNull() & (x["run"] <= x["span"]["start"]))
    return F.transform(walked, lambda x: x["span"])


def in_order(found: Column) -> Column:
    """kind:start:end of the spans by start, then as the kinds are listed, then by end; comma-joined."""
    keyed = F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.lit(ORDER), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked_parts(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The row key and the weak spans that have a complement in scope, one row per document that has any.

    The interval join meets on the document and on blocks of code points that a span or its scope touches. Weak parts do
    not overlap within their kind and have at least three characters, so a block holds a bounded number of them.
    """
    parts = scanned.filter(F.size("weak") > 0).select(*KEY, F.explode(F.concat("base", "weak")).alias("s"))
    parts = parts.select(*KEY, "s.*")
    width = 2 * scope
    ask = parts.select(*KEY, "start", "kind", "end").join(
        F.broadcast(scanned.sparkSession.createDataFrame(COMPLEMENT, "kind string, need string")), "kind")  # eight rows
    block = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    ask = ask.withColumn("block", block(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope))
    have = parts.select(
        *[F.col(k).alias(f"h{k}") for k in KEY], F.col("kind").alias("hkind"), F.col("start").alias("hstart"), F.col("end").alias("hend"),
        block(F.col("start"), F.col("end")).alias("hblock"),
    )
    on = [ask[k].eqNullSafe(have[f"h{k}"]) for k in KEY] + [
        ask["block"] == have["hblock"], ask["need"] == have["hkind"],
        (have["hstart"] <= ask["end"] + scope) & (have["hend"] + scope >= ask["start"]),
        (have["hend"] <= ask["start"]) | (have["hstart"] >= ask["end"]),
    ]
    linked = ask.join(have, on, "left_semi").select(*KEY, F.struct("start", "kind", "end").alias("s")).distinct()
    return linked.groupBy(*KEY).agg(F.collect_list("s").alias("linked"))


def scan_secrets(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans per row of ``documents``.

    Spans are kind:start:end in code points, end exclusive. The three fixed forms are always reported; identifiers, strings
    and endpoints only with a complement that does not overlap them in scope. A weak string inside a fixed span is not one.
    Null texts count as empty and have no span. Repeated rows and null doc_ids keep one row each; an empty table gives no
    rows; other columns are not read. Texts are read once and never shuffled. The work of a text
    with n matches grows as n log n.
    """
    text = F.coalesce("text", F.lit(""))
    base = F.concat(*[spans(text, kind, pattern, group, least) for kind, pattern, group, least in BASE])
    weak = F.concat(*[spans(text, kind, pattern) for kind, pattern in PARTS])
    scanned = documents.select("doc_id", *row_key(F.col("text")), base.alias("base"), weak.alias("weak"))
    # a weak span that overlaps a fixed one is a piece of it
    scanned = scanned.withColumn("weak", F.when(
        (F.size("weak") == 0) | (F.size("base") == 0), F.col("weak")).otherwise(clear_of(F.col("weak"), F.col("base"))))
    scanned = stored(scanned, "scanned")
    rows = join_on_key(scanned, stored(linked_parts(scanned, scope), "linked"))
    none = F.expr(f"cast(array() as {SPANS})")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind, *_ in BASE],
        F.size(F.coalesce("linked", none)).cast("long").alias("n_linked"), F.sha2(in_order(F.col("base")), 256).alias("base_sha256"),
        in_order(F.concat("base", F.coalesce("linked", none))).alias("spans"),
    )
