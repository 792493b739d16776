"""Tagged model output, answer letters and gold letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalmill.fixed_values import (
    ANSWER_PATTERN,
    CHOICES,
    END_PATTERN,
    HEADER_PATTERN,
    NO_CHOICE,
)
from evalmill.functions.text import strip_text


def channel_spans(raw: Column) -> Column:
    """Texts that end with an end tag, in order.

    A complete channel runs from the first header of such a text to its end, so each text holds
    at most one: an earlier channel without an end tag swallows the headers that follow it. What
    comes after the last end tag is left out, as it is not complete.
    """
    pieces = F.split(raw, END_PATTERN)
    return F.slice(pieces, 1, F.size(pieces) - 1)


def channel_names(spans: Column) -> Column:
    """Lower-cased channel name of each text, empty where there is no header."""
    return F.transform(spans, lambda span: F.lower(F.regexp_extract(span, HEADER_PATTERN, 1)))


def last_channel(spans: Column, names: Column, name: str) -> Column:
    """Stripped content of the last channel called ``name``, NULL if there is none."""
    from_end = F.array_position(F.reverse(names), name)
    span = F.try_element_at(spans, F.when(from_end > 0, -from_end).cast("int"))
    return strip_text(F.regexp_extract(span, HEADER_PATTERN + "(.*)", 2))


def parse_channels(raw: Column) -> Column:
    """``struct(response, analysis, commentary)``; without a final channel the whole text
    is the response."""
    spans = channel_spans(raw)
    return select_channels(raw, spans, channel_names(spans))


def select_channels(raw: Column, spans: Column, names: Column) -> Column:
    return F.struct(
        F.coalesce(last_channel(spans, names, "final"), strip_text(raw)).alias("response"),
        last_channel(spans, names, "analysis").alias("analysis"),
        last_channel(spans, names, "commentary").alias("commentary"),
    )


def choice_letter(response: Column) -> Column:
    """A, B, C or D from ``answer: X``, else from the first character, else ``?``."""
    stated = F.regexp_extract(response, ANSWER_PATTERN, 1)
    first = F.substring(response, 1, 1)
    return F.when(stated != "", stated).when(first.isin(CHOICES), first).otherwise(NO_CHOICE)


def gold_letter(index: Column | None = None, text: Column | None = None) -> Column:
    """Gold letter from a 0-based index or from text; an index out of range gives NULL."""
    letters = []
    if index is not None:
        choices = F.array(*[F.lit(c) for c in CHOICES])
        letters.append(F.when(index.between(0, len(CHOICES) - 1), F.get(choices, index.cast("int"))))
    if text is not None:
        stated = F.upper(strip_text(text))
        letters.append(F.when(index.isNull(), stated) if index is not None else stated)
    if not letters:
        raise ValueError("an answer index or an answer text is needed")
    return F.coalesce(*letters)


def gold_error(index: Column) -> Column:
    """Reason why an answer index has no letter, NULL when it has one."""
    bad = index.isNotNull() & ~index.between(0, len(CHOICES) - 1)
    return F.when(bad, F.concat(F.lit("answer index out of range: "), index.cast("string")))
