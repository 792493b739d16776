"""Number parsing, rounding and time text with the semantics of Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalmill.fixed_values import FLOAT_PATTERN, INTEGER_PATTERN
from evalmill.functions.text import strip_text

# Splits a double into two halves of at most 27 bits, whose products with a power of ten
# below 2^26 are exact.
_SPLIT = float(2**27 + 1)


def round_exact(value: Column, digits: int) -> Column:
    """Round the exact binary value, half to even, as Python's ``round(x, digits)``.

    ``round`` and ``bround`` work on the shortest decimal text of a double, which differs for
    ties such as 0.12345. Here a tie is settled by the exact sign of ``value * scale - tie``.
    Valid while ``|value| * 10**(digits + 1)`` stays below 2**53 and ``digits`` is at most 6.
    """
    scale = float(10 ** (digits + 1))
    size = F.abs(value)
    near = F.rint(size * scale)
    high = size * _SPLIT - (size * _SPLIT - size)
    low = size - high
    beyond = (high * scale - near) + low * scale
    # near / 10 is a tie just where its last digit is 5, and rint takes a tie to even.
    tie = (near % 10 == 5) & (beyond != 0)
    units = F.when(tie, F.floor(near / 10) + F.when(beyond > 0, 1).otherwise(0)).otherwise(
        F.rint(near / 10)
    )
    return F.signum(value) * units / float(10**digits)


def gibibytes(size: Column) -> Column:
    return round_exact(size.cast("double") / float(1024**3), 3)


def minutes(seconds: Column) -> Column:
    return round_exact(seconds.cast("double") / 60.0, 2)


def parse_integer(text: Column) -> Column:
    """Whole-number text as a long, else NULL; single ``_`` between digits is allowed."""
    body = strip_text(text)
    return F.when(
        body.rlike(INTEGER_PATTERN), F.translate(body, "_", "").try_cast("bigint")
    )


def parse_float(text: Column) -> Column:
    """Number text as a double, else NULL."""
    body = strip_text(text)
    return F.when(body.rlike(FLOAT_PATTERN), F.translate(body, "_", "").try_cast("double"))


def utc_iso(ts: Column, zoned: bool = True) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of an instant; ``zoned=False`` for timestamps without a zone."""
    # An instant is told by its microseconds, so no wall clock of the session's zone is asked.
    wall = ts.cast("timestamp_ntz")
    if zoned:
        since = F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(0), (F.unix_micros(ts) / F.lit(1_000_000).cast("decimal(18,0)")).cast("decimal(18,6)")
        )
        wall = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since
    text = F.translate(F.substring(wall.cast("string"), 1, 19), " ", "T")
    return F.concat(text, F.lit("Z"))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one timestamp to a later one of the same type, whatever the session's zone."""
    span = end - start
    whole = sum(
        (F.date_part(F.lit(unit), span).cast("bigint") * size
         for unit, size in (("DAY", 86_400), ("HOUR", 3_600), ("MINUTE", 60))),
        start=F.lit(0).cast("bigint"),
    )
    micros = (F.date_part(F.lit("SECOND"), span) * 1_000_000).cast("bigint")
    return (whole * 1_000_000 + micros) / 1e6
