"""Values: sanitising, safe arithmetic, rounding, scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for no value.
NO_VALUE = ("nan", "null", "none", ".", "", "n/a", "na", "-")


def sanitise(raw: Column) -> Column:
    """A provider's text as a finite double, else null."""
    text = F.trim(raw.cast("string"))
    number = text.try_cast("double")
    return F.when(~F.lower(text).isin(*NO_VALUE), finite(number))


def finite(c: Column) -> Column:
    """The value where it is a number; NaN and infinities are missing."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def safe_div(a: Column, b: Column) -> Column:
    """The quotient, or null for a zero or null divisor."""
    return F.try_divide(a, b)


def numeric_parse(raw: Column) -> Column:
    """A number written with thousands' commas."""
    return F.replace(F.trim(raw), F.lit(","), F.lit("")).try_cast("double")


def rescale(value: Column, from_power: Column | int, to_power: Column | int) -> Column:
    """From units of 10^from_power to units of 10^to_power."""
    as_column = lambda p: F.lit(p) if isinstance(p, int) else p
    step = as_column(from_power) - as_column(to_power)
    return F.when(step < 0, value / F.pow(F.lit(10.0), -step)).otherwise(value * F.pow(F.lit(10.0), step))  # exact powers either way


def to_billions(value: Column, unit: Column, from_power: Column) -> Column:
    """Currency levels in billions; rates, indexes and counts stay as they are."""
    money = F.lower(unit).rlike("dollar|usd|cad|eur|currency") & ~F.lower(unit).rlike("percent|index|per ")
    return F.when(money, rescale(value, from_power, 9)).otherwise(value)


def short_number(value: Column) -> Column:
    """1.2K, 3.4M, 5.6B, 7.8T."""
    size = F.abs(value)
    cut = lambda scale, mark: F.concat(F.format_string("%.1f", value / scale), F.lit(mark))
    return F.when(size >= 1e12, cut(1e12, "T")).when(size >= 1e9, cut(1e9, "B")).when(size >= 1e6, cut(1e6, "M")).when(size >= 1e3, cut(1e3, "K")).otherwise(F.format_string("%.1f", value))


def magnitude(value: Column) -> Column:
    """The order of magnitude; null for zero and null."""
    return F.when(value != 0, F.floor(F.log10(F.abs(value))))


def axis_buckets(orders: Column) -> Column:
    """Which axis each series belongs on, from the orders of magnitude of all: neighbours within two orders share one.

    ``array<int>`` of orders to ``array<int>`` of axes, from 0 for the smallest; null orders have none.
    """
    sorted_ = F.array_sort(F.array_distinct(F.filter(orders, lambda x: x.isNotNull())))
    start = F.struct(F.array().cast("array<int>").alias("firsts"))
    firsts = F.aggregate(sorted_, start, lambda s, x: F.struct(F.when((F.size(s["firsts"]) == 0) | (x - F.element_at(s["firsts"], -1) > 2), F.array_append(s["firsts"], x)).otherwise(s["firsts"]).alias("firsts")))["firsts"]
    # The inner variable holds the bounds, so that they are found once an array and not once an element.
    each = F.transform(F.array(firsts), lambda fs: F.transform(orders, lambda x: F.when(x.isNotNull(), F.size(F.filter(fs, lambda f: f <= x)) - 1)))
    return F.element_at(each, 1)


def json_field(text: Column, path: str, kind: str = "string") -> Column:
    """One field of a JSON text, null where there is none or it is of another kind."""
    return F.get_json_object(text, path).try_cast(kind)


def round_even(value: Column, digits: int) -> Column:
    """Half-even rounding of the decimal form (the nearest of Spark's to binary half-even)."""
    return F.bround(value, digits)


def round_binary(value: Column, digits: int) -> Column:
    """The double nearest to the value's exact binary number rounded half-even at ``digits`` places (0 to 22).

    The product with the power of ten is held as a rounded part and its exact error (both factors split in
    halves), so a product that only looks like a tie goes the way of its error. Sizes without places stay.
    """
    power, split = 10.0**digits, 134217729.0
    high = (b := split * power) - (b - power)
    low = power - high
    x = value.cast("double")
    p = x * power
    c = x * split
    xh = c - (c - x)
    xl = x - xh
    error = ((xh * high - p) + xh * low + xl * high) + xl * low
    tie = p - F.floor(p) == 0.5
    whole = F.when(tie & (error > 0), F.floor(p) + 1).when(tie & (error < 0), F.floor(p)).otherwise(F.rint(p))
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**53 / power), x).otherwise(whole / power)


def guard_formula(text: Column) -> Column:
    """A leading quote before texts that a spreadsheet would run."""
    return F.when(F.ltrim(text).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def epoch_ms_to_iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


# Unit families in order of precedence.
UNIT_FAMILIES = (
    ("percent", ("%", "percent", "pct", "annual %")),
    ("index", ("index", "idx", "2010 = 100", "2015 = 100")),
    ("current_usd", ("current us$", "current usd")),
    ("constant_usd", ("constant us$", "constant usd", "constant 2015 us$")),
    ("ppp", ("ppp",)),
    ("lcu", ("lcu", "local currency")),
    ("people", ("people", "persons", "number")),
)


def unit_family(unit: Column) -> Column:
    """The first family that a unit names; null for none."""
    low, out = F.lower(unit), None
    for family, needles in UNIT_FAMILIES:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | low.contains(needle)
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out
