"""Datasets: long observations, variables, and what was done to them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.functions.periods import period_key
from almanack.sources.landing import keep

LONG = ("geography", "iso3", "period", "indicator", "value", "unit", "frequency", "provider", "series_id", "status")


def geo_key() -> Column:
    """The country code, or the name where there is none or an empty one."""
    return F.coalesce(F.nullif(F.col("iso3"), F.lit("")), F.col("geography"))


def first_variable(variables: DataFrame) -> DataFrame:
    """One variable for each series: the one of lowest ordinal."""
    order = Window.partitionBy("provider", "series_id").orderBy("ordinal", "alias")
    return variables.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n").select("provider", "series_id", "alias")


#: Variables up to this many are broadcast; more are joined by shuffle.
BROADCAST_VARIABLES = 10_000


def named(observations: DataFrame, variables: DataFrame, how: str = "left") -> DataFrame:
    """Observations with their variable's alias. The variables' number is checked before they are broadcast."""
    names = first_variable(variables)
    few = variables.limit(BROADCAST_VARIABLES + 1).count() <= BROADCAST_VARIABLES
    return observations.join(F.broadcast(names) if few else names, ["provider", "series_id"], how)


def to_long(observations: DataFrame, variables: DataFrame) -> DataFrame:
    """Ten columns; a series without variable is ``provider:series_id``."""
    out = named(observations, variables).withColumn("indicator", F.coalesce("alias", F.concat_ws(":", "provider", "series_id")))
    return out.select(*LONG)


def to_wide(observations: DataFrame, variables: DataFrame, aliases: list[str]) -> DataFrame:
    """One row for each geography and period, one column for each alias.

    The first value to arrive counts, even if it is null, and so does the first name. The aliases
    are given, so the pivot needs no extra job. Values are combined by hash on the map side, with
    the name among the keys; what is left, about one row a cell row, is merged over the names.
    """
    rows = named(observations, variables, "inner").withColumn("geo_key", geo_key())
    seq = lambda a: F.when(F.col("alias") == a, F.col("obs_seq"))
    cells = [c for i, a in enumerate(aliases) for c in (F.min_by("value", seq(a)).alias(f"_v{i}"), F.min(seq(a)).alias(f"_s{i}"))]
    each = rows.groupBy("geo_key", "period", "geography").agg(F.min("obs_seq").alias("_s"), *cells)
    merged = [F.min_by(f"_v{i}", f"_s{i}").alias(a) for i, a in enumerate(aliases)]
    return each.groupBy("geo_key", "period").agg(F.min_by("geography", "_s").alias("geography"), *merged)


def union_dates(*parts: DataFrame) -> DataFrame:
    """The distinct values of one-column tables."""
    out = None
    for part in parts:
        out = part if out is None else out.union(part)
    return out.distinct()


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Observations one after another: each part's arrivals come after those before it."""
    out = None
    for n, part in enumerate(parts):
        part = part.withColumn("obs_seq", F.lit(n).cast("long") * (1 << 48) + F.col("obs_seq"))
        out = part if out is None else out.unionByName(part)
    return out


def alias_numbers(variables: DataFrame) -> DataFrame:
    """Aliases made unique in order: the n-th of equal ones gets ``_n``."""
    n = F.row_number().over(Window.partitionBy("alias").orderBy("ordinal"))
    return variables.withColumn("_n", n).withColumn("alias", F.when(F.col("_n") > 1, F.concat_ws("_", "alias", "_n")).otherwise(F.col("alias"))).drop("_n")


@dataclass(frozen=True)
class Dataset:
    """Immutable: every transformation returns a new one, with a record of it."""

    observations: DataFrame
    variables: DataFrame
    aliases: tuple[str, ...]
    shape: str = "wide"
    transformations: tuple[dict, ...] = field(default=())

    def _log(self, operation: str, **parameters: object) -> tuple[dict, ...]:
        return (*self.transformations, {"operation": operation, "parameters": parameters})

    def stored(self) -> Dataset:
        """The same with its observations written to the shared folder: validation and statistics each read them again."""
        return replace(self, observations=keep(self.observations, "observations"))

    def long(self) -> DataFrame:
        return to_long(self.observations, self.variables)

    def wide(self) -> DataFrame:
        return to_wide(self.observations, self.variables, list(self.aliases))

    def rows(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        """A page of the sorted rows, in the dataset's shape."""
        out = self.wide().orderBy("geo_key", period_key(F.col("period")), "period") if self.shape == "wide" else self.long().orderBy(geo_key(), "period", "indicator")
        out = out.offset(offset) if offset else out
        return out if limit is None else out.limit(limit)

    def preview(self, cap: int = 300) -> tuple[list, bool]:
        """The first rows, and whether there are more."""
        got = self.rows(limit=cap + 1).collect()
        return got[:cap], len(got) > cap

    def filter_geographies(self, codes: list[str]) -> Dataset:
        if not codes:
            raise ValueError("no geography given")
        keep = self.observations.filter(F.upper(geo_key()).isin([c.upper() for c in codes]))
        return replace(self, observations=keep, transformations=self._log("filter_geographies", geographies=codes))

    def filter_periods(self, start: str | None = None, end: str | None = None) -> Dataset:
        """By the labels as strings, both ends included: 2020Q1 is after 2020."""
        keep = self.observations
        keep = keep if start is None else keep.filter(F.col("period") >= start)
        keep = keep if end is None else keep.filter(F.col("period") <= end)
        return replace(self, observations=keep, transformations=self._log("filter_periods", start=start, end=end))

    def select_variables(self, names: list[str]) -> Dataset:
        """Drops variables; their observations stay, under ``provider:series_id`` in the long form."""
        if unknown := set(names) - set(self.aliases):
            raise ValueError(f"unknown variables: {sorted(unknown)}")
        kept = tuple(a for a in self.aliases if a in names)
        return replace(self, variables=self.variables.filter(F.col("alias").isin(list(kept))), aliases=kept, transformations=self._log("select_variables", variables=names))

    def rename_variable(self, old: str, new: str) -> Dataset:
        if old not in self.aliases or new in self.aliases:
            raise ValueError(f"cannot rename {old} to {new}")
        names = self.variables.withColumn("alias", F.when(F.col("alias") == old, new).otherwise(F.col("alias")))
        return replace(self, variables=names, aliases=tuple(new if a == old else a for a in self.aliases), transformations=self._log("rename_variable", old=old, new=new))

    def set_shape(self, shape: str) -> Dataset:
        if shape not in ("wide", "long"):
            raise ValueError(f"unknown shape: {shape}")
        return replace(self, shape=shape, transformations=self._log("set_shape", shape=shape))

    def transform(self, operation: str, **parameters: object) -> Dataset:
        """Any of the five operations by name."""
        allowed = ("filter_geographies", "filter_periods", "select_variables", "rename_variable", "set_shape")
        if operation not in allowed:
            raise ValueError(f"unknown operation: {operation}")
        return getattr(self, operation)(**parameters)

    def validate(self, frequency: str | None = None, end: int | None = None) -> DataFrame:
        from almanack.operators.validate import validate

        return validate(self.observations, self.variables, frequency, end)

    def describe(self) -> DataFrame:
        from almanack.operators.describe import describe_wide

        return describe_wide(self.wide(), list(self.aliases))

    def missingness(self) -> dict[str, DataFrame]:
        """By variable and by geography, coverage by period, and what is absent altogether."""
        from almanack.operators import missing

        cell = missing.cells(self.wide(), list(self.aliases))
        return {"variables": missing.detail(cell), "geographies": missing.by(cell, "geo_key"), "coverage": missing.coverage_matrix(cell), "absent": missing.absent_matrix(cell)}

    def outliers(self, method: str = "zscore", threshold: float = 3.0) -> DataFrame:
        from almanack.operators import missing, outliers

        cell = missing.cells(self.wide(), list(self.aliases))
        if method == "zscore":
            return outliers.z_scores(cell, ["alias"], threshold=threshold)
        if method == "iqr":
            return outliers.iqr_fences(cell, ["alias"], multiplier=threshold)
        raise ValueError(f"unknown method: {method}")

    def profile(self) -> tuple[DataFrame, bool]:
        """The profile of every column, and whether it is that of a sample (over 250,000 cells and 10,000 rows)."""
        from almanack.operators.describe import profile, profiling_sample

        wide = self.wide()
        table, sampled = profiling_sample(wide, wide.count(), len(wide.columns))
        return profile(table, table.columns), sampled

    def lineage(self) -> DataFrame:
        """One row for each column: where it comes from and what was done."""
        steps = F.array(*(F.lit(t["operation"]) for t in self.transformations)).cast("array<string>")
        return self.variables.select("alias", "provider", "series_id", "title", "unit", "frequency", steps.alias("transformations"))
