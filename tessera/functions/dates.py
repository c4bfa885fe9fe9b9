"""Date functions (D1-D6). Dates stay text: days are checked by range, not by calendar."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 2000
#: Labels in the order in which they are tried, and month names.
LABELS = ("published on", "published:", "published", "date published", "publication date", "date:")
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}


def valid_date(year: Column, month: Column, day: Column) -> Column:
    """The date as text where its parts lie in range, else null."""
    return F.when(year.between(1900, 2100) & month.between(1, 12) & day.between(1, 31), F.format_string("%04d-%02d-%02d", year, month, day))


def _int(text: Column) -> Column:
    return text.try_cast("int")


def numeric_date(text: Column) -> Column:
    """A leading date of three numbers with the year first."""
    form = r"^[-/]*([0-9]{4})[-/]+([0-9]+)[-/]+([0-9]+)[-/]*(?![-/0-9])"
    return valid_date(*[_int(F.regexp_extract(text, form, i)) for i in (1, 2, 3)])


def month_date(text: Column) -> Column:
    """D3: a leading ``Month DD, YYYY`` or ``DD Month YYYY``."""
    first = F.slice(F.filter(F.split(text, r"[\s,]+"), lambda w: w != ""), 1, 3)
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in MONTHS.items()))

    def month(i: int) -> Column:
        return F.try_element_at(names, F.lower(F.regexp_replace(F.get(first, F.lit(i)), r"^[^A-Za-z]+|[^A-Za-z]+$", "")))

    def day(i: int) -> Column:
        return _int(F.regexp_replace(F.get(first, F.lit(i)), "[sthndr]+$", ""))

    year = _int(F.get(first, F.lit(2)))
    return F.when(F.size(first) == 3, F.coalesce(valid_date(year, month(0), day(1)), valid_date(year, month(1), day(0))))


def authored_date(text: Column) -> Column:
    """The date behind the first label that has one, in the first characters of a text."""
    window = F.left(text, F.lit(WINDOW))

    def behind(label: str) -> Column:
        rests = F.regexp_extract_all(window, F.lit(f"(?i){label}(?=[: \\t]*\\s*([\\s\\S]{{0,200}}))"), F.lit(1))
        return F.try_element_at(F.filter(F.transform(rests, lambda r: F.coalesce(numeric_date(r), month_date(r))), lambda d: d.isNotNull()), F.lit(1))

    return F.coalesce(*[behind(label) for label in LABELS])


def pdf_date(raw: Column) -> Column:
    """Date of ``D:YYYYMMDD...``."""
    form = r"^(?:D:)*([0-9]{4})([0-9]{2})([0-9]{2})"
    return valid_date(*[_int(F.regexp_extract(F.trim(raw), form, i)) for i in (1, 2, 3)])


def iso_time(seconds: Column) -> Column:
    """Unix seconds as UTC text (in a session of time zone UTC); years of at least four places and without a plus sign."""
    at = F.timestamp_seconds(seconds)
    return F.concat(F.format_string("%04d", F.year(at)), F.date_format(at, "-MM-dd'T'HH:mm:ss'Z'"))
