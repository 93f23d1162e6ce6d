"""Missing values. A NaN is present here, as a value that was delivered; null is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.functions.periods import period_key
from almanack.functions.values import round_even, safe_div


def cells(wide: DataFrame, aliases: list[str]) -> DataFrame:
    """(geo_key, period, alias, value) of every cell of a wide table."""
    cell = F.array(*(F.struct(F.lit(a).alias("alias"), F.col(f"`{a}`").cast("double").alias("value")) for a in aliases))
    return wide.select("geo_key", "period", F.explode(cell).alias("c")).select("geo_key", "period", "c.alias", "c.value")


def _share(part: Column, whole: Column, digits: int) -> Column:
    return round_even(safe_div(100 * part, whole), digits)


def by(cell: DataFrame, *group: str) -> DataFrame:
    """Cells, missing ones and their percentage (and what is left of 100) of each group."""
    gone = F.count_if(F.col("value").isNull())
    out = cell.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), gone.alias("missing"))
    return out.withColumn("missing_pct", _share(F.col("missing"), F.col("total"), 2)).withColumn("coverage_pct", round_even(100 - F.col("missing_pct"), 2))


def coverage_matrix(cell: DataFrame) -> DataFrame:
    """Percentage present of each variable and period."""
    return cell.groupBy("alias", "period").agg(_share(F.count("value"), F.count(F.lit(1)), 1).alias("coverage_pct"))


def absent_matrix(cell: DataFrame) -> DataFrame:
    """Whether a variable is missing altogether in a geography."""
    return cell.groupBy("alias", "geo_key").agg(F.bool_and(F.col("value").isNull()).alias("all_missing"))


def detail(cell: DataFrame) -> DataFrame:
    """For each variable, besides ``by``: first and last period with a value, and the periods without any, in order.

    The periods of a dataset are few; each is listed once a variable.
    """
    have = F.when(F.col("value").isNotNull(), F.struct(period_key(F.col("period")).alias("k"), F.col("period").alias("p")))
    each = cell.groupBy("alias", "period").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("v"), F.max(have).alias("h"))
    out = each.groupBy("alias").agg(F.sum("n").alias("total"), (F.sum("n") - F.sum("v")).alias("missing"), F.min("h.p").alias("first_valid"), F.max("h.p").alias("last_valid"), F.array_sort(F.collect_list(F.when(F.col("v") == 0, F.struct(period_key(F.col("period")).alias("k"), F.col("period").alias("p"))))).alias("gone"))
    return out.withColumn("missing_pct", _share(F.col("missing"), F.col("total"), 2)).select("alias", "total", "missing", "missing_pct", "first_valid", "last_valid", F.col("gone.p").alias("missing_periods"))


def longest_gap(cell: DataFrame) -> DataFrame:
    """(alias, longest_gap, geo_key, gap_start, gap_end): the longest run of missing periods inside a series' own coverage.

    Only periods of the dataset count, and the gap's ends are the first and last of them. Of equally
    long runs the first wins, geographies in order.
    """
    place = cell.select("period").distinct().withColumn("at", F.row_number().over(Window.orderBy(period_key(F.col("period")), "period")))
    rows = cell.join(place, "period")
    own = Window.partitionBy("alias", "geo_key").orderBy("at")
    have = rows.filter(F.col("value").isNotNull()).withColumn("gap", F.lead("at").over(own) - F.col("at") - 1).filter("gap > 0")
    # Every geography has a row in the dataset's calendar only where some variable delivered one, so gaps are counted by place.
    best = have.groupBy("alias").agg(F.min(F.struct((-F.col("gap")).alias("gap"), "geo_key", "at")).alias("b"))
    out = best.select("alias", (-F.col("b.gap")).cast("long").alias("longest_gap"), F.col("b.geo_key").alias("geo_key"), (F.col("b.at") + 1).alias("a"), (F.col("b.at") - F.col("b.gap")).alias("z"))
    out = out.join(place.select(F.col("at").alias("a"), F.col("period").alias("gap_start")), "a").join(place.select(F.col("at").alias("z"), F.col("period").alias("gap_end")), "z")
    return out.select("alias", "longest_gap", "geo_key", "gap_start", "gap_end")


def fill_marked(rows: DataFrame, group: list[str], order: list[Column], value: str = "value", direction: str = "forward") -> DataFrame:
    """Adds ``filled`` and ``was_filled``; the original stays as it is."""
    w = Window.partitionBy(*group).orderBy(*order)
    near = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if direction == "forward" else F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("filled", near).withColumn("was_filled", F.col(value).isNull() & F.col("filled").isNotNull())


def runs(rows: DataFrame, group: list[str], place: str, value: str = "value") -> DataFrame:
    """(group, run, start, end, points): unbroken runs of places that have a value."""
    w = Window.partitionBy(*group).orderBy(place)
    marked = rows.filter(F.col(value).isNotNull()).withColumn("run", F.col(place) - F.row_number().over(w))
    return marked.groupBy(*group, "run").agg(F.min(place).alias("start"), F.max(place).alias("end"), F.count(F.lit(1)).alias("points"))
