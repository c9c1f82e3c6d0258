"""Strict typing of text cells as column expressions.

Each function takes a trimmed, nonempty text column and returns the typed value, NULL if
the text is malformed.  Nothing here throws: every cast is a ``try_`` cast behind a pattern,
since plain casts accept more than the contract does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?$"


def stripped(raw: Column) -> Column:
    """Without white space of any script at either end; NULL if nothing is left."""
    s = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    return F.when(s != "", s)


def to_double(s: Column) -> Column:
    """A real number: no thousands separators, currency signs, infinities or NaN."""
    d = F.when(s.rlike(_NUMBER), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(F.abs(d) != float("inf"), d)


def to_long(s: Column) -> Column:
    """A whole number; ``720.0`` is one, ``720.5`` isn't."""
    d = to_double(s)
    return F.when((d == F.floor(d)) & (F.abs(d) < 9.2e18), d.try_cast("long"))


def to_iso_date(s: Column) -> Column:
    """An ISO date, as the same text."""
    d = F.when(s.rlike(_DATE), F.try_to_date(s, "yyyy-MM-dd"))
    return d.cast("string")


def to_time(s: Column) -> Column:
    """An ISO date-time, or an ISO date at midnight, in UTC."""
    return F.when(s.rlike(_TIME) | s.rlike(_DATE), F.try_to_timestamp(F.regexp_replace(s, ",", ".")))


def to_status(s: Column, known: dict[str, str]) -> Column:
    """A known token by its lower-case name, else the lower-cased text; never malformed."""
    low = F.lower(s)
    listed = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.coalesce(F.try_element_at(listed, low), low)
