"""Period labels as Column expressions: everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANNUAL, QUARTER, MONTH, DAY = r"^\d{4}$", r"^\d{4}-?[Qq][1-4]$", r"^\d{4}-\d{2}$", r"^\d{4}-\d{2}-\d{2}$"

# Spellings of frequencies, SDMX codes, periods in a year.
SPELLINGS = {
    "annual": ("a", "annual", "yearly", "year", "y", "annuel"),
    "quarterly": ("q", "quarterly", "quarter", "trimestriel"),
    "monthly": ("m", "monthly", "month", "mensuel"),
    "weekly": ("w", "weekly", "week"),
    "daily": ("d", "daily", "day"),
}
SDMX_LABELS = {"A": "annual", "Q": "quarterly", "M": "monthly", "D": "daily", "W": "weekly"}
PER_YEAR = {"annual": 1, "quarterly": 4, "monthly": 12, "weekly": 52, "daily": 365}


def _choose(key: Column, table: dict[str, str | int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def coerce_frequency(raw: Column) -> Column:
    """Any spelling of a frequency to its name; ``unknown`` otherwise."""
    table = {s: name for name, spelled in SPELLINGS.items() for s in spelled}
    return F.coalesce(_choose(F.lower(F.trim(raw.cast("string"))), table), F.lit("unknown"))


def frequency_label(code: Column) -> Column:
    """An SDMX code's label; an unknown code is itself, an empty one annual."""
    clean = F.trim(F.coalesce(code.cast("string"), F.lit("")))
    return F.coalesce(_choose(F.upper(clean), SDMX_LABELS), F.nullif(clean, F.lit("")), F.lit("annual"))


def frequency_from_period(period: Column) -> Column:
    """A, Q or M from a label's shape (A where none fits)."""
    p = F.trim(F.coalesce(period, F.lit("")))
    return F.when(p.rlike(r"^\d{4}-?Q[1-4]$"), "Q").when(p.rlike(r"^\d{4}-M\d{1,2}$|^\d{4}-\d{2}$"), "M").otherwise("A")


def infer_frequency(period: Column) -> Column:
    """The frequency of a canonical label (``2020-13`` passes as monthly)."""
    return F.when(period.rlike(ANNUAL), "annual").when(period.rlike(QUARTER), "quarterly").when(period.rlike(MONTH), "monthly").when(period.rlike(DAY), "daily").otherwise("unknown")


def periods_per_year(frequency: Column) -> Column:
    return _choose(frequency, PER_YEAR)


def canonical_period(raw: Column, frequency: Column) -> Column:
    """A provider's date as the label of its declared frequency."""
    p = F.trim(F.coalesce(raw, F.lit("")))
    year = F.substring(p, 1, 4)
    quarter = F.concat(year, F.lit("Q"), F.ceil(F.substring(p, 6, 2).try_cast("int") / 3).cast("string"))
    finer = F.when(frequency == "annual", year).when(frequency == "quarterly", quarter)
    return (
        F.when(p.rlike(r"^\d{4}-\d{2}-\d{2}"), finer.when(frequency == "monthly", F.substring(p, 1, 7)).otherwise(p))
        .when(p.rlike(MONTH), finer.otherwise(p))
        .when(p.rlike(QUARTER), F.when(frequency == "annual", year).otherwise(F.concat(year, F.lit("Q"), F.right(p, F.lit(1)))))
        .otherwise(p)
    )


def period_to_iso_date(period: Column) -> Column:
    """The first day of an SDMX period; other labels stay as they are."""
    p = F.trim(F.coalesce(period.cast("string"), F.lit("")))
    month = F.lpad((F.right(p, F.lit(1)).try_cast("int") * 3 - 2).cast("string"), 2, "0")
    return (
        F.when(p.rlike(ANNUAL), F.concat(p, F.lit("-01-01")))
        .when(p.rlike(r"^\d{4}-?Q[1-4]$"), F.concat(F.substring(p, 1, 4), F.lit("-"), month, F.lit("-01")))
        .when(p.rlike(r"^\d{4}-M\d{1,2}$"), F.concat(F.substring(p, 1, 5), F.lpad(F.regexp_extract(p, r"M(\d{1,2})$", 1), 2, "0"), F.lit("-01")))
        .when(p.rlike(MONTH), F.concat(p, F.lit("-01")))
        .otherwise(p)
    )


def period_year(period: Column) -> Column:
    known = period.rlike(f"{ANNUAL}|{QUARTER}|{MONTH}|{DAY}")
    return F.when(known, F.substring(period, 1, 4).try_cast("int")).otherwise(F.lit(0))


def period_sub(period: Column) -> Column:
    """Quarter, month, or month and day as one number; 0 for years and unknown labels."""
    return (
        F.when(period.rlike(QUARTER), F.right(period, F.lit(1)).try_cast("int"))
        .when(period.rlike(MONTH), F.substring(period, 6, 2).try_cast("int"))
        .when(period.rlike(DAY), F.substring(period, 6, 2).try_cast("int") * 100 + F.substring(period, 9, 2).try_cast("int"))
        .otherwise(F.lit(0))
    )


def period_key(period: Column) -> Column:
    """What periods are ordered by; (0, 0) for unknown labels."""
    return F.struct(period_year(period).alias("year"), period_sub(period).alias("sub"))


def period_slot(period: Column) -> Column:
    """A number that grows by one from a period to the next of the same frequency; null for days."""
    year = period_year(period)
    return F.when(period.rlike(ANNUAL), year).when(period.rlike(QUARTER), year * 4 + period_sub(period) - 1).when(period.rlike(MONTH), year * 12 + period_sub(period) - 1)


def comtrade_periods(start_year: Column, end_year: Column, monthly: bool = False) -> Column:
    """All years, or all months as yyyymm, of a span: ``array<string>``."""
    years = F.sequence(start_year, end_year)
    if not monthly:
        return F.transform(years, lambda y: y.cast("string"))
    return F.flatten(F.transform(years, lambda y: F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: (y * 100 + m).cast("string"))))


def extract_years(text: Column) -> tuple[Column, Column]:
    """(first, last) year named in a text; a single year has no last."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), 1), lambda y: y.cast("int"))
    return F.array_min(years), F.when(F.size(F.array_distinct(years)) > 1, F.array_max(years))


def within_dates(date: Column, start: tuple[int, int | None, int | None], end: tuple[int, int | None, int | None]) -> Column:
    """Whether a date lies in a span whose missing months and days are the first and the last."""
    parts = F.struct(F.year(date).alias("y"), F.month(date).alias("m"), F.day(date).alias("d"))
    low = F.struct(*(F.lit(x).alias(n) for n, x in zip("ymd", (start[0], start[1] or 1, start[2] or 1), strict=True)))
    high = F.struct(*(F.lit(x).alias(n) for n, x in zip("ymd", (end[0], end[1] or 12, end[2] or 31), strict=True)))
    return (parts >= low) & (parts <= high)
