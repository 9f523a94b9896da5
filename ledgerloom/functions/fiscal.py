"""Fiscal dates and periods as Column expressions (group K). Bad or missing text gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weeks of a duration code.
WEEKS = {"3M": 13, "6M": 26, "9M": 39, "FY": 52}
WORDS = {"three": "3", "six": "6", "nine": "9", "twelve": "12"}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def duration_code(text: Column) -> Column:
    """K1: "Three months" as 3M, "Year" as FY, '' otherwise."""
    months = F.lower(F.regexp_extract(text, r"(?i)\b(\d+|three|six|nine|twelve)\s*[- ]?\s*months?\b", 1))
    n = F.coalesce(F.try_element_at(_map(WORDS), months), F.nullif(months, F.lit("")))
    return F.when(n.isNotNull(), F.concat(n.cast("int").cast("string"), F.lit("M"))).when(text.rlike(r"(?i)\byears?\b"), "FY").otherwise("")


def period_span(duration: Column, end: Column) -> Column:
    """K2: struct(start, days): weeks back from the end, both ends counted; a point in time has 0 days."""
    days = F.coalesce(F.try_element_at(_map(WEEKS), duration), F.lit(0)) * 7
    return F.when(end.isNotNull(), F.struct(F.when(days > 0, F.date_sub(end, days - 1)).otherwise(end).alias("start"), days.alias("days")))


def fiscal_year(day: Column, close_month: Column, close_day: Column) -> Column:
    """K3: the year in which the fiscal year of a day closes; the calendar year without a close."""
    after = F.month(day) * 100 + F.day(day) > close_month * 100 + close_day
    return F.year(day) + F.when(after, 1).otherwise(0)


def fiscal_year_start(day: Column, close_month: Column, close_day: Column) -> Column:
    """K4: the day after the close before; null if that close is no date."""
    text = F.format_string("%04d-%02d-%02d", fiscal_year(day, close_month, close_day) - 1, close_month, close_day)
    return F.date_add(F.try_to_date(text, "yyyy-MM-dd"), 1)


def cumulative(duration: Column, start: Column, year_start: Column) -> Column:
    """K5: year-to-date periods: 6M, 9M and FY, and a 3M that begins within six days of the fiscal year."""
    return duration.isin("6M", "9M", "FY") | F.coalesce((duration == "3M") & (F.abs(F.datediff(start, year_start)) <= 6), F.lit(False))


def period_key(text: Column) -> Column:
    """K7: an ISO date, a written date as ISO, or FY and a year; the cleaned text otherwise."""
    iso = F.regexp_extract(text, r"(?:19|20)\d{2}-\d{2}-\d{2}", 0)
    long = r"(?i)(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{1,2})\s*,?\s*((?:19|20)\d{2})"
    month = (F.floor((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.substring(F.lower(F.regexp_extract(text, long, 1)), 1, 3)) - 1) / 3) + 1).cast("int")
    written = F.format_string("%s-%02d-%02d", F.regexp_extract(text, long, 3), month, F.regexp_extract(text, long, 2).try_cast("int"))
    year = F.regexp_extract(text, r"(?:19|20)\d{2}", 0)
    return F.when(iso != "", iso).when(F.regexp_extract(text, long, 3) != "", written).when(year != "", F.concat(F.lit("FY"), year)).otherwise(F.trim(text))


def calendar_year_overlap(start: Column, end: Column) -> Column:
    """K9: the calendar year that holds more of a period; the end's on ties, for periods under 28 days, and without a start."""
    first = F.make_date(F.year(end), F.lit(1), F.lit(1))
    inside = F.datediff(end, F.greatest(start, first)) + 1
    before = F.when(start < first, F.datediff(first, start)).otherwise(0)
    short = F.datediff(end, start) + 1 < 28
    return F.when(start.isNull() | short | (inside >= before), F.year(end)).otherwise(F.year(end) - 1)


def reporting_lag(end: Column, filed: Column) -> Column:
    """Days from the period's end to the filing; null if either is missing or a sentinel."""
    floor = F.lit("0001-01-01").cast("date")
    return F.when((end != floor) & (filed != floor), F.datediff(filed, end))


def iso_date(text: Column) -> Column:
    """Dates written in words, month or day first, or as ISO or month/day/year numbers."""
    t = F.trim(text)
    return F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), F.try_to_date(t, "MM/dd/yyyy"), F.try_to_date(t, "MMMM d, yyyy"), F.try_to_date(t, "d MMMM yyyy"))


def quarter_label(day: Column, close_month: Column) -> Column:
    """FY2025-Q1 of a fiscal calendar that closes with a month."""
    since = F.pmod(F.month(day) - close_month - 1, F.lit(12))
    return F.concat(F.lit("FY"), (F.year(day) + F.when(F.month(day) > close_month, 1).otherwise(0)).cast("string"), F.lit("-Q"), (F.floor(since / 3) + 1).cast("string"))


def concept_period(name: Column) -> Column:
    """struct(concept, duration, period_end) of "Net Sales (3M-2026-03-28)"; parts that are missing are ''."""
    pattern = r"^(.*?)\s*\((?:(3M|6M|9M|FY)-)?(\d{4}-\d{2}-\d{2}|FY\d{4})\)\s*$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    return F.struct(F.when(part(3) != "", part(1)).otherwise(name).alias("concept"), part(2).alias("duration"), part(3).alias("period_end"))


def coerced(column: Column, kind: str) -> Column:
    """Coercion on load: doubles to null, dates to 0001-01-01, integers to -1, text to '' where the value is missing or bad."""
    text = F.nullif(F.trim(column.cast("string")), F.lit(""))
    return {
        "double": text.try_cast("double"),
        "date": F.coalesce(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), F.lit("0001-01-01").cast("date")),
        "bigint": F.coalesce(text.try_cast("bigint"), F.lit(-1)),
        "string": F.coalesce(column.cast("string"), F.lit("")),
    }[kind]


def stable_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of the parts; a null part is written None."""
    return F.substring(F.sha1(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)).cast("binary")), 1, 16)
