"""A dataset's exports by name."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.functions.text import citation
from almanack.operators import describe, missing
from almanack.operators.dataset import Dataset
from almanack.operators.validate import validate, verdict
from almanack.plans.recipes import Recipe
from almanack.sources import landing, sinks

FORMATS = ("csv", "json", "parquet", "feather", "dta", "xlsx", "html", "bundle", "recipe_yaml", "recipe_json")


def _few(df: DataFrame) -> list[dict]:
    """Rows of a small side table: variables, steps, issues."""
    return sinks._whole(df, 100_000).to_pylist()


def _data(d: Dataset) -> DataFrame:
    return d.rows()


def sources(d: Dataset) -> DataFrame:
    """How each series of a dataset is quoted."""
    none = F.lit(None).cast("string")
    return d.variables.select("alias", "provider", "series_id", citation(F.col("provider"), F.col("title"), F.col("series_id"), F.col("unit"), none, none).alias("citation"))


def sheets(d: Dataset) -> dict[str, DataFrame]:
    """The eight sheets of a workbook."""
    wide = landing.keep(d.wide(), "wide")  # three sheets are made of it, two of the issues
    cells = missing.cells(wide, list(d.aliases))
    spark = d.variables.sparkSession
    steps = spark.createDataFrame([(t["operation"], json.dumps(t["parameters"], default=str)) for t in d.transformations], "operation string, parameters string")
    issues = landing.keep(validate(d.observations, d.variables), "issues")
    flat = issues.select("code", "severity", "variable", F.to_json("details").alias("details"))
    return {
        "Data": _data(d),
        "Variables": d.variables.orderBy("ordinal"),
        "Sources": sources(d),
        "Transformations": steps,
        "Validation": flat,
        "Missingness": missing.by(cells, "alias"),
        "Statistics": describe.describe_wide(wide, list(d.aliases)),
        "Verdict": verdict(issues),
    }


def report(d: Dataset, path: str) -> None:
    """Charts by geography and variable, broken at gaps, and coverage."""
    cells = missing.cells(landing.keep(d.wide(), "wide"), list(d.aliases))
    sinks.html_report(", ".join(d.aliases), cells, missing.coverage_matrix(cells), list(d.aliases), path)


def export(d: Dataset, fmt: str, path: str, name: str = "dataset") -> None:
    """One of ``FORMATS``. CSV and Parquet are folders written by executors; the others are single files."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    recipe = lambda: Recipe.of(d, name)
    if fmt == "csv":
        sinks.to_csv(_data(d), path)
    elif fmt == "parquet":
        sinks.to_parquet(_data(d), path)
    elif fmt == "json":
        sinks.to_json(_data(d), path, _few(d.variables), list(d.transformations))
    elif fmt == "feather":
        sinks.to_feather(_data(d), path)
    elif fmt == "dta":
        sinks.to_stata(_data(d), path, {r["alias"]: r["title"] or "" for r in _few(d.variables)})
    elif fmt == "xlsx":
        sinks.to_excel(sheets(d), path)
    elif fmt == "html":
        report(d, path)
    elif fmt == "bundle":
        sinks.bundle(path, _data(d), recipe().text(), _few(sources(d)), list(d.transformations), f"# {name}\n\nSeries: {', '.join(d.aliases)}\n")
    else:
        Path(path).write_text(recipe().text(), encoding="utf-8")
