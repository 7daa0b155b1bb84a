"""Publish dates in the forms feeds use, as time-zone free UTC timestamps.

Parsing is a set of regular expressions over the parts of a date and does not depend on the session time zone.
Numeric offsets are applied; zone names, known or not, count as UTC. Of numbers alone the month comes first, where it can.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.text import strip

# Month names by their first three letters.
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"

_OFFSET = r"[+-](?:\d{1,2}:\d{2}|\d{4}|\d{1,2})"
_ZONE = r"\s*(z|[a-z]{1,5}(?:" + _OFFSET + r")?|" + _OFFSET + r")?(?:\s*\([^)]*\))?"
_SECONDS = r"(?::(\d{2})(?:[.,](\d{1,9}))?)?"
# an hour alone needs a T before it or its half of the day behind it
_TIME = (
    r"(?:(?:\s*t\s*|\s*,?\s+(?:-\s+|at\s+)?(?=\d{1,2}(?::|\s*[ap]m)))(\d{1,2})(?::(\d{2})" + _SECONDS + r")?\s*([ap]m)?"
    + _ZONE + r")?$"
)
_YEAR_FIRST = r"(?i)^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME
_COMPACT = (
    r"(?i)^(\d{4})(\d{2})(\d{2})(?:(?:\s*t\s*|\s+|(?=\d{4}(?:\d{2})?$))(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?)?()"
    + _ZONE + r")?$"
)
_DAY_FIRST = r"(?i)^(\d{1,2})(?:st|nd|rd|th)?(?:\s+|-)(" + _MONTH + r"),?(?:\s+|-)(\d{4}|\d{2})" + _TIME
_MONTH_FIRST = r"(?i)^(" + _MONTH + r")\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + _TIME
_YEAR_LAST = (
    r"(?i)^(" + _MONTH + r")\s+(\d{1,2})\s+(\d{1,2}):(\d{2})" + _SECONDS + r"\s*([ap]m)?" + _ZONE + r"\s+(\d{4})$"
)
_NUMBERS = r"(?i)^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})" + _TIME


def _number(text: Column, default: int | None = None) -> Column:
    value = F.nullif(text, F.lit("")).cast("int")
    return value if default is None else F.coalesce(value, F.lit(default))


def _month_number(name: Column) -> Column:
    return ((F.instr(F.lit(_MONTHS), F.lower(F.substring(name, 1, 3))) + 2) / 3).cast("int")


def _full_year(text: Column) -> Column:
    short = text.cast("int")
    return F.when(F.length(text) == 4, short).otherwise(F.when(short < 70, short + 2000).otherwise(short + 1900))


def _offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC. Behind a zone name the sign turns round: GMT+3 is a place where 3 hours are missing to GMT."""
    hours, minutes = (F.regexp_extract(zone, r"[+-](\d{1,2})(?::?(\d{2}))?$", part) for part in (1, 2))
    size = _number(hours, 0) * 60 + _number(minutes, 0)
    return F.when(zone.contains("-") != zone.rlike("^[A-Za-z]"), -size).otherwise(size)


# Each form is rewritten to: form, year, month, day, hour, minute, second, fraction, half of the day, zone.
_FORMS = [
    (_YEAR_FIRST, "plain|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (_COMPACT, "plain|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (_DAY_FIRST, "named|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (_MONTH_FIRST, "named|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (_YEAR_LAST, "named|$9|$1|$2|$3|$4|$5|$6|$7|$8"),
    (_NUMBERS, "numbers|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
]


def _timestamp(part: Column) -> Column:
    """The UTC timestamp of the rewritten parts."""
    form, first, second = part[0], part[2], part[3]
    day_first = (form == "numbers") & (_number(first) > 12)
    month = (
        F.when(form == "named", _month_number(first)).when(day_first, _number(second)).otherwise(_number(first))
    )
    day = F.when(day_first, _number(first)).otherwise(_number(second))
    hour, half = _number(part[4], 0), F.lower(part[8])
    hour = (
        F.when((half == "pm") & (hour < 12), hour + 12)
        .when((half == "am") & (hour == 12), 0)
        .otherwise(hour)
    )
    seconds = F.concat(F.coalesce(F.nullif(part[6], F.lit("")), F.lit("0")), F.lit("."), F.rpad(part[7], 6, "0"))
    local = F.try_make_timestamp_ntz(
        _full_year(part[1]), month, day, hour, _number(part[5], 0), seconds.cast("decimal(16,6)")
    )
    return local - F.make_dt_interval(F.lit(0), F.lit(0), _offset_minutes(part[9]))


def parse_date(raw: Column) -> Column:
    """One date text as a UTC timestamp, null when it is in none of the known forms."""
    text = F.regexp_replace(strip(raw), r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+", "")
    # The one-element arrays bind a value to a name, so that it is computed once.
    def rewritten(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, order in reversed(_FORMS):
            out = F.when(F.regexp_like(t, F.lit(pattern)), F.regexp_replace(t, pattern, order)).otherwise(out)
        return F.split(out, r"\|")

    parts = F.transform(F.array(text), rewritten)
    return F.get(F.transform(parts, lambda p: F.when(p.isNotNull(), _timestamp(p))), F.lit(0))


def parse_publish_date(*raw: Column, as_of: Column) -> Column:
    """The first of the given date texts that can be read, else the ingest time."""
    return F.coalesce(*[parse_date(r) for r in raw], as_of)


def iso_text(ts: Column) -> Column:
    """ISO text of a UTC timestamp: offset ``+00:00``, and no fraction when the microseconds are zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))
