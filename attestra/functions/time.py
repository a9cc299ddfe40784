"""Valid time and calendar arithmetic. Dates stay strings with a precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations in calendar order.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def parse_valid_time(raw: Column) -> Column:
    """Struct of value, precision and raw text; precision is never raised."""
    s = F.trim(raw)
    words = F.split(s, "\\s+")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(F.try_element_at(words, F.lit(2)), 1, 3)))
    spelled = s.rlike("^\\d{1,2}\\s+[A-Za-z]+\\s+\\d{4}$") & (month > 0)
    iso = F.concat_ws(
        "-",
        F.try_element_at(words, F.lit(3)),
        F.lpad(month.cast("string"), 2, "0"),
        F.lpad(F.try_element_at(words, F.lit(1)), 2, "0"),
    )
    lead_year = s.rlike("^\\d{4}\\b")

    def pick(exact, mon, year, spelled_v, lead, other):
        return (
            F.when(s.rlike("^\\d{4}-\\d{2}-\\d{2}$"), exact)
            .when(s.rlike("^\\d{4}-\\d{2}$"), mon)
            .when(s.rlike("^\\d{4}$"), year)
            .when(spelled, spelled_v)
            .when(lead_year, lead)
            .otherwise(other)
        )

    value = pick(s, s, s, iso, F.substring(s, 1, 4), F.lit(None).cast("string"))
    precision = pick(
        F.lit("EXACT_DATE"), F.lit("MONTH"), F.lit("YEAR"), F.lit("EXACT_DATE"), F.lit("YEAR"), F.lit("UNKNOWN")
    )
    return F.struct(value.alias("value"), precision.alias("precision"), s.alias("raw"))


def add_days(day: Column, days) -> Column:
    """ISO date text plus whole days, as ISO date text."""
    return F.date_format(F.date_add(F.to_date(day), days), "yyyy-MM-dd")


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(F.to_date(end), F.to_date(start))


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days that passed between two timestamps."""
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 86400)


def year_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "(\\d{4})", 1), F.lit("")).cast("int")


def date_issue(value: Column, today: Column) -> Column:
    """``invalid``, ``future`` or null for a date text."""
    day = F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd")
    return F.when(value.isNotNull() & day.isNull(), "invalid").when(day > F.to_date(today), "future")
