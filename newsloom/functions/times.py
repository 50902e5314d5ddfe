"""Parsing and printing of points in time (always UTC)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom.functions.text import bind

_RFC2822 = (
    r"^\s*(?:[A-Za-z]+\s*,?\s+)?(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*[\s-]+(\d{4}|\d{2})\s+"
    r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{4}|[A-Za-z]*)\s*(?:\(.*\))?\s*$"
)
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"

# Offsets of the zone names that mail dates may use; every other name counts as UTC.
ZONE_OFFSETS = {
    "AST": "-0400", "ADT": "-0300", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def parse_rfc2822(text: Column) -> Column:
    """Mail-style date to timestamp; anything else is NULL. A date without a zone is read as UTC."""

    offsets = F.create_map(*[F.lit(part) for pair in ZONE_OFFSETS.items() for part in pair])

    def normalised(part: Column) -> Column:
        day, month, year, hour, minute, second, zone = (part[place] for place in range(1, 8))
        century = F.when(F.length(year) == 4, "").when(year > "68", "19").otherwise("20")
        offset = F.when(zone.rlike("^[+-]"), zone).otherwise(
            F.coalesce(F.try_element_at(offsets, F.upper(zone)), F.lit("+0000"))
        )
        date = F.concat_ws(" ", day, month, F.concat(century, year))
        time = F.concat_ws(":", hour, minute, F.when(second == "", "00").otherwise(second))
        return F.when(F.size(part) == 8, F.concat_ws(" ", date, time, offset))

    # one match: the parts behind a separator no date contains, or the text itself when it is no date
    parts = F.split(F.regexp_replace(text, _RFC2822, "|$1|$2|$3|$4|$5|$6|$7"), "[|]")
    return F.try_to_timestamp(bind(parts, normalised), F.lit("d MMM yyyy H:mm:ss Z"))


def parse_iso(text: Column) -> Column:
    """ISO 8601 date or date-time to timestamp; anything else is NULL."""
    return F.when(text.rlike(_ISO), F.try_to_timestamp(text))


def parse_any(text: Column) -> Column:
    """Mail-style date first, ISO 8601 second."""
    return F.coalesce(parse_rfc2822(text), parse_iso(text))


def rfc3339(moment: Column) -> Column:
    """``2026-07-01T17:00:00Z``; microseconds are printed only when there are any."""
    seconds = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(moment, "SSSSSS")
    return F.concat(seconds, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))
