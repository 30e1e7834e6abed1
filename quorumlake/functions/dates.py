"""Dates in German public records as ISO strings; an unknown date is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze, text

#: Month names.
MONTHS = ("jänner", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember")


def iso(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD if the parts make a calendar date, else empty."""
    joined = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.coalesce(F.date_format(F.try_to_date(joined, "yyyy-MM-dd"), "yyyy-MM-dd"), F.lit(""))


def from_german(value: Column) -> Column:
    """The first d.m.yyyy in a text."""
    pattern = r"([0-9]{1,2}) *\. *([0-9]{1,2}) *\. *([0-9]{4})"
    return iso(*(F.regexp_extract(text(value), pattern, k) for k in (3, 2, 1)))


def from_long(value: Column) -> Column:
    """The first d. month yyyy in a text."""
    pattern = r"([0-9]{1,2})\. *(\p{L}+) +([0-9]{4})"
    plain = F.lower(text(value))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.replace(F.regexp_extract(plain, pattern, 2), F.lit("januar"), F.lit("jänner"))).cast("string")
    return F.when(month != "0", iso(F.regexp_extract(plain, pattern, 3), month, F.regexp_extract(plain, pattern, 1))).otherwise("")


def from_file_name(name: Column) -> Column:
    """An ISO date in a file name, else six digits yymmdd."""
    full = F.regexp_extract(text(name), r"(^|[^0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})($|[^0-9])", 2)
    short = r"(^|[^0-9])([0-9]{2})([0-9]{2})([0-9]{2})($|[^0-9])"
    compact = compact_date(*(F.regexp_extract(text(name), short, k) for k in (2, 3, 4)))
    return F.when(full != "", full).otherwise(compact)


def compact_date(year: Column, month: Column, day: Column) -> Column:
    """Two-digit years are of this century."""
    return F.when(year == "", "").otherwise(iso(F.concat(F.lit("20"), year), month, day))


def meeting_date(name: Column, title: Column) -> Column:
    """By file name, else by 'Sitzung ... am d.m.yyyy' in the text."""
    said = F.regexp_extract(text(title), r"(?i)(sitzung|gemeinderate?s?)[^\n]{0,80}? am +([0-9]{1,2} *\. *[0-9]{1,2} *\. *[0-9]{4})", 2)
    by_name = from_file_name(name)
    return F.when(by_name != "", by_name).otherwise(from_german(said))


def period(value: Column) -> Column:
    """struct(start, end): first and last date of a text; a missing year comes from the other end."""
    found = F.regexp_extract_all(squeeze(value), F.lit(r"[0-9]{1,2}\.[0-9]{1,2}\.(?:[0-9]{4})?"), F.lit(0))
    low, high = F.try_element_at(found, F.lit(1)), F.try_element_at(found, F.lit(-1))
    year = F.coalesce(F.nullif(F.regexp_extract(low, "([0-9]{4})$", 1), F.lit("")), F.nullif(F.regexp_extract(high, "([0-9]{4})$", 1), F.lit("")))

    def whole(x: Column) -> Column:
        return F.when(F.regexp_extract(x, "([0-9]{4})$", 1) == "", F.concat(x, year)).otherwise(x)

    open_ended = F.contains(F.lower(text(value)), F.lit("derzeit"))
    start = F.when(open_ended & (F.size(found) == 1), "").otherwise(F.coalesce(from_german(whole(low)), F.lit("")))
    return F.struct(start.alias("start"), F.coalesce(from_german(whole(high)), F.lit("")).alias("end"))


def period_status(value: Column, start: Column, end: Column, today: Column) -> Column:
    """aktuell, kuenftig, abgeschlossen or unklar."""
    running = F.contains(F.lower(text(value)), F.lit("derzeit")) & (end != "")
    return (
        F.when(running, F.when(today <= end, "aktuell").otherwise("abgeschlossen"))
        .when((start == "") | (end == "") | (start > end), "unklar")
        .when((start <= today) & (today <= end), "aktuell")
        .when(start > today, "kuenftig")
        .otherwise("abgeschlossen")
    )


def council_year(date: Column) -> Column:
    """First year of the council year, which runs from February to January."""
    return F.when(F.month(date) >= 2, F.year(date)).otherwise(F.year(date) - 1)
