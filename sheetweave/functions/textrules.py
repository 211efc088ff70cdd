"""Rules about recognised text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of tags and of label words, and of discarded categories.
TAG = r"^(?:[A-Z]{1,3}-?\d{2,5}[A-Z]?|SG\d+|PC|FO|N\d+|E\d+|ATM)$"
WORDY = r"^[A-Z][A-Z\s\-]{2,}$"
DISCARD_PATTERNS = [
    "text", "txt", "label", "annotation",
    "line", "lines", "pipe", "pipes", "piping",
    "connector", "connection",
    "border", "frame",
    "title", "heading",
    "noise", "background", "other", "unknown",
]
DIRECTIONS = ["none", "forward", "backward", "bidirectional", "coming_in", "going_out"]

# Java matches ASCII classes unless told otherwise.
UNICODE = "(?U)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, UNICODE + r"^\s+|\s+$", "")


def normalise(text: Column) -> Column:
    """Trimmed, runs of white space as one space."""
    return F.regexp_replace(strip(text), UNICODE + r"\s+", " ")


def is_tag(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("")).rlike(UNICODE + TAG)


def is_wordy(text: Column) -> Column:
    return F.upper(text).rlike(UNICODE + WORDY)


def is_valid_text(text: Column, area: Column) -> Column:
    s = strip(text)
    return F.coalesce(
        (F.length(s) >= 2) & (area >= 120)
        & ~s.rlike(UNICODE + r"^[^\w]+$")
        & (s.rlike(UNICODE + r"\d") | s.rlike(r"[A-Z]{2,}")),
        F.lit(False))


def is_discarded(label: Column, exempt: list[str] | None = None) -> Column:
    """Category to be left out: it holds a pattern or is held by one; '' is kept."""
    low = strip(F.lower(label))
    patterns = F.array(*(F.lit(p) for p in DISCARD_PATTERNS))
    hit = F.exists(patterns, lambda p: F.contains(low, p) | F.contains(p, low))
    if exempt:
        hit = hit & ~low.isin(exempt)
    return F.coalesce(hit & (label != ""), F.lit(False))


def next_direction(direction: Column) -> Column:
    """The next of the six directions; an unknown one becomes forward."""
    cycle = F.array(*(F.lit(d) for d in DIRECTIONS))
    place = F.array_position(cycle, direction)
    return F.when(place == 0, F.lit("forward")).otherwise(
        F.element_at(cycle, (place % len(DIRECTIONS) + 1).cast("int")))
