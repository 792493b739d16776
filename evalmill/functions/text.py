"""Text expressions with the semantics of Python's str methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalmill.fixed_values import LEVELS, WHITESPACE


def strip_text(text: Column) -> Column:
    """Remove all leading and trailing whitespace, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def first_chars(text: Column, n: int, mark: str = "") -> Column:
    """The first ``n`` characters, with ``mark`` appended only when something was cut."""
    head = F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(head, F.lit(mark))).otherwise(text) if mark else head


def last_chars(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def normalise_level(level: Column) -> Column:
    """Lower-cased reasoning level; test with :func:`is_level`."""
    return F.lower(level)


def is_level(level: Column) -> Column:
    return F.coalesce(F.lower(level).isin(LEVELS), F.lit(False))
