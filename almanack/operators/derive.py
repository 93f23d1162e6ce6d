"""Derived series: changes, balances, sums, merges, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.functions.values import round_even, safe_div
from almanack.operators.order import upper_median

#: Positions back to the same period of the year before.
LAGS = {"monthly": 12, "quarterly": 4, "annual": 1}


def year_over_year(rows: DataFrame, group: list[str], frequency: str, order: str = "period", value: str = "value") -> DataFrame:
    """Percentage change against the value ``LAGS`` places back among the values present.

    Positional: a missing period shifts the base. Null or zero bases give no row.
    """
    k = LAGS[frequency]
    base = F.lag(value, k).over(Window.partitionBy(*group).orderBy(order))
    out = rows.filter(F.col(value).isNotNull()).withColumn("base", base).filter("base is not null and base <> 0")
    return out.select(*group, order, round_even((F.col(value) - F.col("base")) / F.col("base") * 100, 2).alias("yoy"))


def year_over_year_calendar(rows: DataFrame, group: list[str], slot: Column, per_year: int, value: str = "value") -> DataFrame:
    """The same against the period one calendar year before; no row where that is missing."""
    now = rows.withColumn("slot", slot)
    before = now.select(*group, (F.col("slot") + per_year).alias("slot"), F.col(value).alias("base"))
    return now.join(before, [*group, "slot"]).filter("base <> 0").withColumn("yoy", round_even((F.col(value) - F.col("base")) / F.col("base") * 100, 2))


def member_sum(rows: DataFrame, by: list[str], value: str = "value", strict: bool = False) -> DataFrame:
    """Sum over members for each date. A null counts as 0 and makes the date; ``strict`` keeps a date
    with a null member null."""
    total = F.sum(F.coalesce(F.col(value), F.lit(0)))
    if strict:
        total = F.when(F.count(value) == F.count(F.lit(1)), total)
    return rows.groupBy(*by).agg(total.alias("total"), F.count(F.lit(1)).alias("members"))


def trade_balance(flows: DataFrame, by: list[str], flow: str = "flow", value: str = "value") -> DataFrame:
    """Exports less imports over the union of keys, a missing side being 0: one pass, one shuffle."""
    side = lambda name: F.sum(F.when(F.col(flow) == name, F.coalesce(F.col(value), F.lit(0))).otherwise(F.lit(0)))
    return flows.groupBy(*by).agg(side("export").alias("exports"), side("import").alias("imports")).withColumn("balance", F.col("exports") - F.col("imports"))


def merge_segments(rows: DataFrame, by: list[str], date: str = "date", value: str = "value") -> DataFrame:
    """One value for each series and date: a value beats null, the larger beats the smaller."""
    return rows.groupBy(*by, date).agg(F.max(value).alias(value), F.count(F.lit(1)).alias("segments"))


def strongest_record(rows: DataFrame, by: list[str], value: str, keep: list[str]) -> DataFrame:
    """One record for each key, that of the largest value (null as 0); ties to the smallest record."""
    order = F.struct(F.coalesce(F.col(value), F.lit(0.0)), *(F.col(k) for k in keep))
    best = rows.groupBy(*by).agg(F.max(F.coalesce(F.col(value), F.lit(0.0))).alias("_v"), F.max_by(F.struct(value, *keep), order).alias("_r"))
    return best.select(*by, f"_r.{value}", *(f"_r.{k}" for k in keep))


def first_of(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def last_by_date(rows: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """The last value to arrive for each key."""
    return rows.groupBy(*by).agg(F.max_by(value, seq).alias(value))


def latest(rows: DataFrame, by: list[str], date: str = "period", value: str = "value") -> DataFrame:
    """Each series' last date that has a value, with the value."""
    pick = F.max_by(F.struct(F.col(date).alias("date"), F.col(value).alias("value")), F.col(date))
    return rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(pick.alias("l")).select(*by, F.col("l.date").alias("latest_date"), F.col("l.value").alias("latest_value"))


def top_n(rows: DataFrame, by: list[str], n: int, year: int | None = None, ascending: bool = False, date: str = "period", value: str = "value") -> DataFrame:
    """Series ranked by their value at the latest date of ``year``, else at the latest of all.

    Ties: descending order has the first key first, ascending order the last. ``n`` is what the caller asks
    for; ``requests.top_count`` keeps what a sentence asks for within 1 to 100.
    """
    full = rows.filter(F.col(value).isNotNull())
    inside = F.col(date).startswith(str(year)) if year else F.lit(False)
    pick = F.max_by(F.struct(F.col(date).alias("date"), F.col(value).alias("value"), inside.alias("inside")), F.struct(inside, F.col(date)))
    found = full.groupBy(*by).agg(pick.alias("l"))
    order = [F.asc("l.value"), *map(F.desc, by)] if ascending else [F.desc("l.value"), *map(F.asc, by)]
    best = found.orderBy(*order).limit(max(n, 1))
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), *by, F.col("l.date").alias("date"), F.col("l.value").alias("value"))


def collapse_dates(rows: DataFrame, by: list[str], value: str = "value", growth: bool = False) -> DataFrame:
    """Several values of one date become one: the upper median; for growth rates, that of the values
    within 50 of zero, else the smallest in size. It chooses among values, so it is off unless called."""
    if not growth:
        return upper_median(rows, by, F.col(value)).select(*by, F.col("median").alias(value))
    small = rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.min(F.struct(F.abs(value).alias("size"), F.col(value).alias("x"))).alias("_s"))
    near = upper_median(rows, by, F.when(F.abs(value) <= 50, F.col(value))).withColumnsRenamed({k: f"_of_{k}" for k in by})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by))
    return small.join(near, same, "left").select(*by, F.coalesce("median", "_s.x").alias(value))


def best_slice(rows: DataFrame, series: list[str], preferred: list[Column], value: str = "value") -> DataFrame:
    """The series of the highest score: its points, and 1000 for each preferred member of its key.

    Series without points are left out; the first key wins ties. ``preferred`` are conditions on the key.
    """
    points = F.count(value)
    each = rows.groupBy(*series).agg(points.alias("points")).filter("points > 0")
    score = F.col("points") + sum((1000 * F.coalesce(c, F.lit(False)).cast("int") for c in preferred), F.lit(0))
    return each.withColumn("score", score.cast("long")).orderBy(F.desc("score"), *series).limit(1)


def default_slice(rows: DataFrame, series: str, match: Column, value: str = "value") -> DataFrame:
    """The rows of the series that fits a provider's defaults best: (matches, points, key), if any matches; else all rows."""
    each = rows.groupBy(series).agg(F.max(F.coalesce(match, F.lit(0))).alias("m"), F.count(value).alias("n"))
    best = each.orderBy(F.desc("m"), F.desc("n"), F.desc(series)).limit(1).filter("m > 0").collect()  # one row
    return rows.filter(F.col(series) == best[0][series]) if best else rows


def in_years(rows: DataFrame, date: str, start: int | None, end: int | None) -> DataFrame:
    """Rows of a span of years, both ends included; dates without a readable year stay."""
    year = F.left(F.col(date).cast("string"), F.lit(4)).try_cast("int")
    inside = (year >= start if start else F.lit(True)) & (year <= end if end else F.lit(True))
    return rows.filter(year.isNull() | inside)


def latest_date(rows: DataFrame, date: str, start: int | None, end: int | None) -> DataFrame:
    """One row: the last date there is, as text, and how many rows a span of years keeps; for spans that keep none."""
    kept = in_years(rows.select(F.col(date).cast("string").alias("d")).withColumn("in", F.lit(1)), "d", start, end)
    return rows.agg(F.max(F.col(date).cast("string")).alias("latest")).unionByName(kept.agg(F.count("in").alias("in_window")), allowMissingColumns=True).agg(F.max("latest").alias("latest"), F.max("in_window").alias("in_window"))


def with_values(rows: DataFrame, series: list[str], value: str = "value") -> DataFrame:
    """Rows of the series that have a value at all."""
    some = rows.filter(F.col(value).isNotNull()).select(*series).distinct()
    return rows.join(some, series, "left_semi")


def partial_sums(rows: DataFrame, by: list[str], member: str, expected: int, value: str = "value") -> DataFrame:
    """Sums over members with a note where fewer came back than were expected."""
    out = rows.groupBy(*by).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("total"), F.countDistinct(F.when(F.col(value).isNotNull(), F.col(member))).alias("members"))
    note = F.when(F.col("members") < expected, F.concat(F.lit("partial: "), F.col("members").cast("string"), F.lit(f" of {expected} members")))
    return out.withColumn("note", note)


def daily(events: DataFrame, ts: str, failed: Column, user: str, amount: Column) -> DataFrame:
    """Events, failures, users and amounts of each day; amounts are summed as decimals."""
    return events.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("events"), F.count_if(failed).alias("errors"), F.countDistinct(user).alias("users"), F.sum(amount.cast("decimal(18,4)")).cast("double").alias("purchases"))


def activity(users: DataFrame, actions: DataFrame, user: str, action_user: str, action: str, at: str) -> DataFrame:
    """Every user with the number and the day of their last actions; 0 and null for those without any."""
    each = actions.groupBy(F.col(action_user).alias(user)).agg(F.count(action).alias("actions"), F.to_date(F.max(at)).alias("last_action"))
    return users.select(user).join(each, user, "left").withColumn("actions", F.coalesce("actions", F.lit(0).cast("long")))


def backfill(base: DataFrame, more: DataFrame, key: list[str], requested: int, country: str) -> tuple[DataFrame, Column]:
    """Rows of both, the first of equal keys kept, and the aggregate by which a caller accepts it:
    (share of requested countries, rows) must improve."""
    both = base.withColumn("_p", F.lit(0)).unionByName(more.withColumn("_p", F.lit(1)))
    return first_of(both, key, [F.col("_p")]).drop("_p"), F.struct(safe_div(F.countDistinct(country), F.lit(requested)).alias("ratio"), F.count(F.lit(1)).alias("rows"))


def backfilled(base: DataFrame, more: DataFrame, key: list[str], requested: int, country: str) -> DataFrame:
    """The merged rows where they cover more of the request than the base alone (share, then rows), else the base."""
    merged, measure = backfill(base, more, key, requested, country)
    before, after = (tuple(x.agg(measure.alias("m")).first()["m"]) for x in (base, merged))
    return merged if after > before else base


def spacing_frequency(rows: DataFrame, by: list[str], ts: str) -> DataFrame:
    """Frequency by the upper median of positive spacings: minutely up to 30 minutes, hourly up to 6 hours, else daily."""
    step = F.unix_micros(F.lead(ts).over(Window.partitionBy(*by).orderBy(ts))) - F.unix_micros(ts)
    got = upper_median(rows.withColumn("step", step).filter("step > 0"), by, F.col("step"))
    mid = F.col("median").cast("long")  # microseconds of a spacing are whole numbers below 2^53
    return got.select(*by, mid.alias("median_us"), F.when(mid <= 30 * 60_000_000, "minutely").when(mid <= 6 * 3600_000_000, "hourly").otherwise("daily").alias("frequency"))


def freshest(rows: DataFrame, by: list[str], end: Column, tie: list[str]) -> DataFrame:
    """The series of each group that ends last."""
    return first_of(rows, by, [end.desc_nulls_last(), *map(F.asc, tie)])


def tail(rows: DataFrame, by: list[str], n: int, order: str = "period") -> DataFrame:
    """The last n rows of each series."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).filter(F.col("_n") <= n).drop("_n")


def rolling_count(rows: DataFrame, by: list[str], seconds: Column, width: int) -> DataFrame:
    """How many rows of the group fall into the last ``width`` seconds, this one included."""
    w = Window.partitionBy(*by).orderBy(seconds).rangeBetween(-width, 0)
    return rows.withColumn("in_window", F.count(F.lit(1)).over(w))


def total_filter(rows: DataFrame, by: list[str], code: str) -> DataFrame:
    """Rows of the total commodity where a group has one, else all its rows."""
    total = F.upper(F.coalesce(F.col(code), F.lit(""))).isin("TOTAL", "AG2", "")
    return rows.withColumn("_has", F.max(total).over(Window.partitionBy(*by))).filter(total | ~F.col("_has")).drop("_has")
