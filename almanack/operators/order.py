"""Exact order statistics of groups of any size: places, quantiles, mean ranks. No group is held in one buffer.

Places (the r-th smallest of a group) are found by counted ranges. Each place starts with the whole
group as its range. While a range holds more than ``limit`` values, a sketch proposes a narrower one, the values
below and inside it are counted exactly, and the part that holds the place stays, so the sketch decides how
fast, and never what, is found. What is left of a group, as distinct values with their counts, is then summed in order.

Mean ranks come from distinct values and their counts, sorted by ranges over all partitions; what the
partitions before hold is added to the sums inside each.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.functions.values import finite
from almanack.sources.landing import keep

#: A place, from 0, as a column made of the column with the group's size.
Place = Callable[[Column], Column]


def with_group(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``a`` with the row of ``b`` of their group; null keys are a group too."""
    other = b.withColumnsRenamed({k: f"_of_{k}" for k in by})
    return a.join(other, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by), F.lit(True))).drop(*(f"_of_{k}" for k in by))


def _within(i: int) -> Column:
    return (F.col("_x") >= F.col(f"lo{i}")) & (F.col("_x") <= F.col(f"hi{i}"))


def _narrow(values: DataFrame, state: DataFrame, by: list[str], count: int, limit: int, grid: int) -> DataFrame:
    """The state with smaller ranges for the groups that have a large one; two passes over those groups' values."""
    large = reduce(lambda a, b: a | b, ((F.col(f"in{i}") > limit) & (F.col(f"lo{i}") < F.col(f"hi{i}")) for i in range(count)))
    todo, each = state.filter(large), range(count)
    marks = F.array(*(F.lit(j / grid) for j in range(grid + 1)))
    seen = with_group(values, todo, by).groupBy(*by).agg(*(F.percentile_approx(F.when(_within(i), F.col("_x")), marks, F.lit(10 * grid)).alias(f"g{i}") for i in each))
    at = lambda i, step: F.get(f"g{i}", F.greatest(F.lit(0), F.least(F.lit(grid), F.floor(grid * (F.col(f"r{i}") - F.col(f"below{i}")) / F.col(f"in{i}")).cast("int") + step)))
    tried = with_group(todo, seen, by).select(*todo.columns, *(c for i in each for c in (at(i, -1).alias(f"a{i}"), at(i, 2).alias(f"b{i}"))))
    tried = keep(tried, "ranges")
    x = F.col("_x")
    of = lambda i: {"lta": F.count_if(x < F.col(f"a{i}")), "lea": F.count_if(x <= F.col(f"a{i}")), "ltb": F.count_if(x < F.col(f"b{i}")), "leb": F.count_if(x <= F.col(f"b{i}")), "before": F.max(F.when(x < F.col(f"a{i}"), x)), "next": F.min(F.when(x > F.col(f"a{i}"), x)), "last": F.max(F.when(x < F.col(f"b{i}"), x)), "after": F.min(F.when(x > F.col(f"b{i}"), x))}
    counted = with_group(values, tried, by).groupBy(*by).agg(*(v.alias(f"{k}{i}") for i in each for k, v in of(i).items()))
    both, out = with_group(tried, counted, by), []
    for i in each:
        c = lambda n, i=i: F.col(f"{n}{i}")
        # Below a, at a, between, at b, above b: (least, greatest, values below, values inside). Every case leaves out a or b, so ranges shrink.
        cases = [
            (c("r") < c("lta"), c("lo"), c("before"), c("below"), c("lta") - c("below")),
            (c("r") < c("lea"), c("a"), c("a"), c("lta"), c("lea") - c("lta")),
            (c("r") < c("ltb"), c("next"), c("last"), c("lea"), c("ltb") - c("lea")),
            (c("r") < c("leb"), c("b"), c("b"), c("ltb"), c("leb") - c("ltb")),
            (F.lit(True), c("after"), c("hi"), c("leb"), c("below") + c("in") - c("leb")),
        ]
        pick = lambda k, cases=cases: reduce(lambda w, x: w.when(x[0], x[k]), cases[1:], F.when(cases[0][0], cases[0][k]))
        done = (c("r") < 0) | (c("r") >= F.col("n")) | (c("lo") == c("hi"))  # a place outside the group, or found before
        keepers = {"lo": (1, c("lo")), "hi": (2, F.when(c("lo") == c("hi"), c("hi")).otherwise(c("lo"))), "below": (3, c("below")), "in": (4, c("in"))}
        out += [c("r"), *(F.when(done, old).otherwise(pick(k)).alias(f"{n}{i}") for n, (k, old) in keepers.items())]
    return keep(both.select(*by, "n", *out).unionByName(state.filter(~large)), "ranges")


def places(rows: DataFrame, by: list[str], value: Column, wanted: list[Place], limit: int = 100_000, grid: int = 256) -> DataFrame:
    """(by..., n, values): of each group with numbers, how many it has and those at the wanted places of their order.

    A place outside the group gives null. NaN, infinities and nulls are no numbers.
    """
    each = range(len(wanted))
    values = rows.select(*by, finite(value.cast("double")).alias("_x")).filter("_x is not null")
    sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    x, order = F.col("_x"), Window.partitionBy(*by).orderBy("_x")
    if largest <= limit:
        summed = values.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("c")).withColumn("sum", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
        found = [F.min(F.when((w(F.col("n")) >= 0) & (F.col("sum") > w(F.col("n"))), x)) for w in wanted]
        return summed.groupBy(*by).agg(F.max("n").alias("n"), F.array(*found).alias("values"))
    state = sizes.select(*by, "n", *(c for i, w in enumerate(wanted) for c in (w(F.col("n")).cast("long").alias(f"r{i}"), F.col("lo").alias(f"lo{i}"), F.col("hi").alias(f"hi{i}"), F.lit(0).cast("long").alias(f"below{i}"), F.col("n").alias(f"in{i}"))))
    state = keep(state, "ranges")
    size = F.greatest(F.lit(0).cast("long"), *(F.when(F.col(f"lo{i}") < F.col(f"hi{i}"), F.col(f"in{i}")).otherwise(0) for i in each))
    while (state.agg(F.max(size)).first()[0] or 0) > limit:
        state = _narrow(values, state, by, len(wanted), limit, grid)
    near = with_group(values, state, by).filter(reduce(lambda a, b: a | b, map(_within, each)))
    summed = with_group(near.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("c")), state, by).withColumn("sum", F.sum("c").over(order))
    every = Window.partitionBy(*by)
    for i in each:
        summed = summed.withColumn(f"base{i}", F.coalesce(F.sum(F.when(x < F.col(f"lo{i}"), F.col("c"))).over(every), F.lit(0)))
    found = [F.min(F.when((F.col(f"r{i}") >= 0) & _within(i) & (F.col("sum") - F.col(f"base{i}") > F.col(f"r{i}") - F.col(f"below{i}")), x)) for i in each]
    return summed.groupBy(*by).agg(F.max("n").alias("n"), F.array(*found).alias("values"))


def quantiles(rows: DataFrame, by: list[str], value: Column, shares: tuple[float, ...], limit: int = 100_000) -> DataFrame:
    """(by..., n, q): exact quantiles of each group with numbers, linear between neighbouring places."""
    at = lambda p, n: p * (n - 1)
    wanted = [f for p in shares for f in (lambda n, p=p: F.floor(at(p, n)), lambda n, p=p: F.ceil(at(p, n)))]
    found = places(rows, by, value, wanted, limit)
    out = []
    for i, p in enumerate(shares):
        spot, low, high = at(p, F.col("n")), F.get("values", F.lit(2 * i)), F.get("values", F.lit(2 * i + 1))
        out.append(F.when(low == high, low).otherwise((F.ceil(spot) - spot) * low + (spot - F.floor(spot)) * high))
    return found.select(*by, "n", F.array(*out).alias("q"))


def upper_median(rows: DataFrame, by: list[str], value: Column, limit: int = 100_000) -> DataFrame:
    """(by..., n, median): element n // 2 of each group's sorted numbers."""
    found = places(rows, by, value, [lambda n: F.floor(n / 2)], limit)
    return found.select(*by, "n", F.get("values", F.lit(0)).alias("median"))


def mean_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value, rank) of each group's distinct values; equal values share the mean of their places."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    stored = keep(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "ranks")
    sums = stored.groupBy(*by, "_part").agg(F.sum("c").alias("s"))  # a row for each group and partition
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy(*by).orderBy("_part")) - F.col("s")).drop("s")
    inside = stored.withColumn("sum", F.sum("c").over(Window.partitionBy(*by, "_part").orderBy(value)))
    return with_group(inside, before, [*by, "_part"]).select(*by, value, (F.col("before") + F.col("sum") - F.col("c") + (F.col("c") + 1) / 2).alias("rank"))
