"""Dates as they are written on cards and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Russian month names in the genitive.
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]


def dotted_date(c: Column) -> Column:
    """dd.MM.yyyy, null if it is none."""
    s = F.trim(c)
    return F.when(s.rlike("^[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}$"), F.try_to_date(s, "dd.MM.yyyy"))


def first_date(c: Column) -> Column:
    """The first dd.MM.yyyy in a text."""
    return F.try_to_date(F.nullif(F.regexp_extract(c, "[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}", 0), F.lit("")), "dd.MM.yyyy")


def date_after(c: Column, marker: str) -> Column:
    """The first dd.MM.yyyy after a marker, whatever its case."""
    at = F.instr(F.lower(c), F.lit(marker.lower()))
    return F.when(at > 0, first_date(F.substring(c, at, F.length(c))))


def written_date(c: Column) -> Column:
    """A date such as '5 марта 2019 г.', null if it is none."""
    day, name, year = (F.regexp_extract(F.lower(c), "^ *([0-9]{1,2}) +([а-я]+) +([0-9]{4})", i) for i in (1, 2, 3))
    month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name), F.lit(0))
    text = F.concat_ws("-", F.nullif(year, F.lit("")), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when(month.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def publication_date(c: Column) -> Column:
    """A full date, or the first of January of a bare year."""
    bare = F.trim(c)
    return F.coalesce(dotted_date(bare), F.when(bare.rlike("^(?:19|20)[0-9]{2}$"), F.try_to_date(F.concat(bare, F.lit("-01-01")), "yyyy-MM-dd")))


def is_newer(source: Column, local: Column) -> Column:
    """Whether the source has a date after the local one; no local date is older than any."""
    return source.isNotNull() & (local.isNull() | F.coalesce(source > local, F.lit(False)))


def retry_at(now: Column, delay_seconds: int = 60) -> Column:
    """When a job is tried again: whole seconds from now."""
    return F.timestamp_add("SECOND", F.lit(delay_seconds), F.date_trunc("second", now))
