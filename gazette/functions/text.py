"""Text expressions. All are built-in Spark functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a title is split on: every Unicode space, and the four separator control characters.
SPACES = r"(?U)[\s\x1c-\x1f]+"
OUTER_SPACES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends. ``trim`` would only remove blanks."""
    return F.regexp_replace(text, OUTER_SPACES, "")


def normalize_title(title: Column) -> Column:
    """Lower case, single blanks, no outer blanks; null becomes the empty string."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), SPACES, " "))


def text_length(text: Column) -> Column:
    return F.length(text)


def blank_to_null(text: Column) -> Column:
    """Null when nothing but white space is there; otherwise the text unchanged."""
    return F.when(strip(text) != "", text)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def author_line(authors: Column) -> Column:
    """A list of authors as one string, null when it is empty."""
    return F.nullif(F.array_join(authors, ", "), F.lit(""))


def contains_pattern(query: str) -> str:
    """The LIKE pattern of a substring search.

    ``%`` and ``_`` in the query stay wildcards. A backslash that escapes nothing is doubled,
    because Spark rejects an escape before an ordinary character.
    """
    out, i = [], 0
    while i < len(query):
        if query[i] == "\\" and query[i + 1: i + 2] in ("%", "_", "\\"):
            out.append(query[i: i + 2])
            i += 2
            continue
        out.append("\\\\" if query[i] == "\\" else query[i])
        i += 1
    return "%" + "".join(out) + "%"
