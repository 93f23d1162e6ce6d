"""n-dimensional cubes given as flat, row-major values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat_index(sizes: Column, coordinates: Column) -> Column:
    """The row-major offset of a cell."""
    return F.aggregate(F.arrays_zip(sizes.alias("s"), coordinates.alias("c")), F.lit(0).cast("long"), lambda a, x: a * x["s"] + x["c"])


def coordinates(index: Column, sizes: Column) -> Column:
    """The cell's coordinates of a row-major offset: ``array<long>``."""
    later = lambda k: F.aggregate(F.slice(sizes, k + 2, F.greatest(F.size(sizes) - k - 1, F.lit(0))), F.lit(1).cast("long"), lambda a, s: a * s)
    return F.transform(F.sequence(F.lit(0), F.size(sizes) - 1), lambda k: F.floor(index / later(k)) % F.element_at(sizes, k + 1))


def decode(cubes: DataFrame) -> DataFrame:
    """(..., index, value, coords) of each value of ``values map<string, double>`` with ``sizes``; nulls are dropped."""
    rows = cubes.select("*", F.explode("values").alias("index", "value")).filter("value is not null").withColumn("index", F.col("index").cast("long"))
    return rows.withColumn("coords", coordinates(F.col("index"), F.col("sizes").cast("array<long>"))).drop("values")


def default_member(labels: DataFrame, dimension: str = "dimension", code: str = "code", place: str = "place") -> DataFrame:
    """Each dimension's default member: a total if there is one, then the first."""
    total = F.when(F.upper(code).isin("TOTAL", "T", "_TOTAL"), 5).otherwise(0)
    return labels.groupBy(dimension).agg(F.max_by(code, F.struct(total, -F.col(place))).alias("default_code"))


def best_covered_slice(rows: DataFrame, slice_by: list[str], preference: Column, first: str) -> DataFrame:
    """The slice with most points, then preference, then the first."""
    return rows.groupBy(*slice_by).agg(F.count("value").alias("points"), F.max(preference).alias("preference"), F.min(first).alias("first")).orderBy(F.desc("points"), F.desc("preference"), "first").limit(1)


def aggregate_score(codes: Column) -> Column:
    """How many of a key's members stand for a whole dimension."""
    return F.size(F.filter(codes, lambda c: F.upper(c).isin("TOTAL", "T", "_T", "_Z", "A", "ALL")))


def covers_region(countries: Column, members: Column) -> Column:
    """Whether a country list may be replaced by its region: five countries and 85 % of it."""
    return (F.size(countries) >= 5) & (F.size(F.array_intersect(countries, members)) / F.greatest(F.size(members), F.lit(1)) >= 0.85)


def strict_filter(rows: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Rows of the members asked for; asking for one that is not there is an error."""
    have = {r[0] for r in rows.filter(F.col(column).isin(wanted)).select(column).distinct().collect()}  # at most len(wanted)
    if gone := [w for w in wanted if w not in have]:
        raise ValueError(f"no such member of {column}: {gone}")
    return rows.filter(F.col(column).isin(wanted))
