"""Dates that arrive as ISO 8601 text, whole or partial, or as SAS day counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MS_PER_DAY = 86_400_000
# Milliseconds from the Julian epoch to 1970-01-01T00:00.
UNIX_EPOCH_JULIAN_MS = 210_866_760_000_000

WHOLE_DATE = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]([01]\d|2[0-4]):[0-5]\d(:[0-5]\d(\.\d+)?)?"
    r"( *([Zz]|[+-](0\d|1[0-4]):[0-5]\d) *)?)?$"
)
DIGITS_TO_ZERO = ("123456789", "000000000")
ZONE = r" *([Zz]|[+-]\d\d:\d\d) *$"


def julian_day(text: Column) -> Column:
    """Julian day number of a whole date or date-time text, else NULL.

    Works on the calendar fields alone, so the session time zone plays no
    part. A time with ``Z`` or an offset is taken to UTC. Partial and impossible
    dates give NULL. A date without a time, as most are, meets no regular expression.
    """
    days = F.unix_date(F.substring(text, 1, 10).try_cast("date")).cast("bigint")

    def number(digits: Column) -> Column:
        return F.coalesce(digits.try_cast("double"), F.lit(0.0))

    local = F.regexp_replace(F.substring(text, 12, 1_000), ZONE, "")
    zone = F.regexp_extract(F.substring(text, 12, 1_000), ZONE, 1)

    def part(start: int, length: int) -> Column:
        return number(F.substring(local, start, length))

    minutes = number(F.substring(zone, 2, 2)) * 60.0 + number(F.substring(zone, 5, 2))
    ahead = F.when(zone.startswith("-"), -minutes).otherwise(minutes) * 60_000.0
    clock = part(1, 2) * 3_600_000.0 + part(4, 2) * 60_000.0 + part(7, 16) * 1000.0
    midnight = days * F.lit(MS_PER_DAY) + F.lit(UNIX_EPOCH_JULIAN_MS)
    timed = midnight + clock.cast("bigint") - ahead.cast("bigint")
    is_date = F.translate(text, *DIGITS_TO_ZERO) == "0000-00-00"
    return (
        F.when(is_date, midnight.cast("double"))
        .when((F.length(text) > 10) & text.rlike(WHOLE_DATE), timed.cast("double"))
        / F.lit(float(MS_PER_DAY))
    )


def study_day(text: Column, reference: Column) -> Column:
    """Day count from ``reference``, which itself is day 1; keeps fractions."""
    return julian_day(text) - julian_day(reference) + F.lit(1.0)


def sas_day_to_iso(days: Column) -> Column:
    """Days since 1960-01-01 as ``YYYY-MM-DD`` text; missing stays NULL."""
    number = days.cast("double")
    whole = F.when(~F.isnan(number), F.floor(number).cast("int"))
    return F.date_add(F.lit("1960-01-01").cast("date"), whole).cast("string")
