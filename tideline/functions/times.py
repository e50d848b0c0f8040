"""Time stamps, spans and rounding of seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_CUE = 0.5


def positive(seconds: Column) -> Column:
    """Zero for what is no positive number."""
    return F.when(F.isnan(seconds) | seconds.isNull() | (seconds < 0) | (seconds == float("inf")), F.lit(0.0)).otherwise(seconds)


def stamp(seconds: Column, separator: str) -> Column:
    """``hh:mm:ss`` and milliseconds; hours may exceed 99."""
    ms = F.round(positive(seconds) * 1000).cast("bigint")
    hours = F.floor(ms / 3_600_000).cast("string")
    return F.concat(
        F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours),
        F.lit(":"),
        F.lpad((F.floor(ms / 60_000) % 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((F.floor(ms / 1000) % 60).cast("string"), 2, "0"),
        F.lit(separator),
        F.lpad((ms % 1000).cast("string"), 3, "0"),
    )


def cue_end(start: Column, end: Column) -> Column:
    """A cue lasts half a second at least."""
    return F.greatest(positive(end), positive(start) + MIN_CUE)


def midpoint(start: Column, end: Column) -> Column:
    return start + F.greatest(end - start, F.lit(0.0)) / 2


def clock(seconds: Column) -> Column:
    """``h:mm:ss``, or ``m:ss`` below an hour; fractions are cut off."""
    s = F.floor(seconds).cast("bigint")
    hours, minutes = F.floor(s / 3600).cast("bigint"), F.floor(s / 60).cast("bigint") % 60
    short = F.concat(minutes.cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    long = F.concat(hours.cast("string"), F.lit(":"), F.lpad(minutes.cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    return F.when(hours > 0, long).otherwise(short)


def round_ms(seconds: Column) -> Column:
    """To milliseconds, halves away from zero; what is no number is zero."""
    return F.when(F.isnan(seconds) | seconds.isNull() | (F.abs(seconds) == float("inf")), F.lit(0.0)).otherwise(F.round(seconds, 3))


def human_bytes(count: Column) -> Column:
    """Megabytes without a fraction, from 1,024 of them on gigabytes with two digits."""
    mb = count / float(1 << 20)
    return F.when(mb >= 1024, F.format_string("%.2f GB", mb / 1024)).otherwise(F.format_string("%.0f MB", mb))
