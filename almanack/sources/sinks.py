"""Exports. Tables, and the parts of large documents, are written by executors; Stata files by the driver, within a stated bound."""

from __future__ import annotations

import csv
import io
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.functions.periods import period_key
from almanack.functions.values import finite, guard_formula
from almanack.sources import documents, workbook

#: Rows that a document made by the driver may hold; a larger table is an error there, and goes to another format.
DOCUMENT_ROWS = 5_000_000


def to_csv(df: DataFrame, path: str) -> None:
    """UTF-8 with a header; nulls are empty."""
    df.write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def to_safe_csv(df: DataFrame, path: str) -> None:
    """The same, with texts guarded that a spreadsheet would run as formulas."""
    to_csv(df.select(*(guard_formula(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes)), path)


def to_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    (df.write.partitionBy(*by) if by else df.write).parquet(path)


def _whole(df: DataFrame, limit: int | None = None) -> pa.Table:
    """All rows on the driver, behind a check of their number: more than the bound is an error, never a cut."""
    limit = DOCUMENT_ROWS if limit is None else limit
    table = df.limit(limit + 1).toArrow()
    if table.num_rows > limit:
        raise ValueError(f"over {limit} rows are too many for this format; write another one instead")
    return table


def to_json(df: DataFrame, path: str, variables: list[dict], transformations: list[dict]) -> None:
    """Rows and provenance in one document of any size."""
    head = json.dumps({"variables": variables, "transformations": transformations}, default=str, ensure_ascii=False)
    rows = documents.json_parts(df)
    with documents.Document(df.sparkSession, path) as out:
        out.text(head[:-1] + ', "data": [')
        out.parts(rows, skip=1)  # the comma before the first row
        out.text("]}")


def to_json_lines(df: DataFrame, path: str) -> None:
    """Any number of rows, written by executors."""
    df.write.option("ignoreNullFields", False).json(path)


def to_feather(df: DataFrame, path: str) -> None:
    """An Arrow file of any number of rows on the driver's disk, which holds one part's batches at a time."""
    documents.write_arrow(df, path)


def stata_names(columns: list[str]) -> dict[str, str]:
    """Names of at most 32 letters, digits and underscores, none starting with a digit, none twice."""
    out: dict[str, str] = {}
    used: set[str] = set()
    for c in columns:
        name = "".join(x if x.isalnum() and x.isascii() or x == "_" else "_" for x in c)
        name = (f"v_{name}" if name[:1].isdigit() else name or "v")[:32]
        base, n = name, 1
        while name in used:
            n += 1
            name = f"{base[: 31 - len(str(n))]}_{n}"
        used.add(name)
        out[c] = name
    return out


def to_stata(df: DataFrame, path: str, labels: dict[str, str] | None = None) -> None:
    names = stata_names(df.columns)
    labels = {names[c]: label[:80] for c, label in (labels or {}).items() if c in names}
    _whole(df).to_pandas().rename(columns=names).to_stata(path, write_index=False, variable_labels=labels, version=118)


def to_excel(sheets: dict[str, DataFrame], path: str) -> None:
    """One sheet for each table, and further ones for what a sheet does not hold; executors write the rows."""
    pages = []
    for name, df in sheets.items():
        folder, n = documents.numbered_parts(df, workbook.row, workbook.SHEET_ROWS, "sheet")
        pages += [(name, workbook.header(df.columns), f"{folder}/page={i}") for i in range(max(n, 1))]
    spark = next(iter(sheets.values())).sparkSession
    with documents.Document(spark, path, zipped=True) as out:
        for name, text in workbook.package([name for name, _, _ in pages]).items():
            out.entry(name, lambda text=text: out.text(text))
        for i, (_, first, folder) in enumerate(pages, 1):

            def sheet(first: str = first, folder: str = folder) -> None:
                out.text(workbook.OPEN + first)
                out.parts(folder)
                out.text(workbook.CLOSE)

            out.entry(f"xl/worksheets/sheet{i}.xml", sheet)


def _escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def charts(cells: DataFrame, order: list[str]) -> DataFrame:
    """(place, geo_key, html): a line chart for each series with numbers; a gap begins a new line.

    ``cells(alias, geo_key, period, value)``; NaN and infinities are gaps too. One task orders a series' periods.
    """
    one = Window.partitionBy("alias", "geo_key")
    time = one.orderBy(period_key(F.col("period")), "period")
    rows = cells.withColumn("value", finite(F.col("value")))
    placed = rows.select("alias", "geo_key", "value", (F.row_number().over(time) - 1).alias("i"), F.count(F.lit(1)).over(one).alias("n"), F.min("value").over(one).alias("low"), F.max("value").over(one).alias("high"), F.count_if(F.col("value").isNull()).over(time).alias("gaps"))
    span = F.coalesce(F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(1.0))
    point = F.format_string("%.1f,%.1f", 10 + 580 * F.col("i") / F.greatest(F.lit(1), F.col("n") - 1), 110 - 100 * (F.col("value") - F.col("low")) / span)
    joined = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c.alias("t")))), lambda x: x["t"])
    lines = placed.filter("value is not null").groupBy("alias", "geo_key", "gaps").agg(F.min("i").alias("i"), F.array_join(joined(point), " ").alias("points"))
    drawn = F.concat(F.lit('<polyline fill="none" stroke="currentColor" points="'), F.col("points"), F.lit('"/>'))
    series = lines.groupBy("alias", "geo_key").agg(F.array_join(joined(drawn), "").alias("lines"))
    html = F.concat(F.lit("<h2>"), _escaped(F.concat_ws(", ", "alias", "geo_key")), F.lit('</h2><svg viewBox="0 0 600 120">'), F.col("lines"), F.lit("</svg>"))
    return series.select(F.array_position(F.array(*map(F.lit, order)), F.col("alias")).alias("place"), "geo_key", html.alias("html"))


def html_report(title: str, cells: DataFrame, coverage: DataFrame, order: list[str], path: str) -> None:
    """A page of any size without outside parts: charts by geography and variable, and ``coverage(alias, period, coverage_pct)`` as a table."""
    share = F.coalesce("coverage_pct", F.lit(0.0))
    row = F.concat(F.lit("<tr><td>"), _escaped(F.coalesce("alias", F.lit(""))), F.lit("<td>"), _escaped(F.coalesce("period", F.lit(""))), F.format_string("<td style='background:rgba(0,128,0,%.2f)'>%.1f", share / 100, share))
    drawn = documents.text_parts(charts(cells, order).orderBy("geo_key", "place").select("html"))
    table = documents.text_parts(coverage.orderBy("alias", period_key(F.col("period")), "period").select(row))
    name = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    with documents.Document(cells.sparkSession, path) as out:
        out.text(f"<!doctype html><meta charset=utf-8><title>{name}</title><h1>{name}</h1>")
        out.parts(drawn)
        out.text("<h2>Coverage</h2><table>")
        out.parts(table)
        out.text("</table>")


def bundle(path: str, data: DataFrame, recipe_text: str, sources: list[dict], transformations: list[dict], readme: str) -> None:
    """A research bundle of any size: data, metadata, sources, transformations, recipe, read-me, and their digests."""
    parts = {"metadata.json": json.dumps(data.dtypes), "sources.json": json.dumps(sources, default=str), "transformations.json": json.dumps(transformations, default=str), "recipe.yaml": recipe_text, "README.md": readme}
    rows, names = documents.csv_parts(data), io.StringIO()
    csv.writer(names, lineterminator="\n").writerow(data.columns)
    with documents.Document(data.sparkSession, path, zipped=True) as out:

        def table() -> None:
            out.text(names.getvalue())
            out.parts(rows)

        sums = {"data.csv": out.entry("data.csv", table)} | {n: out.entry(n, lambda body=body: out.text(body)) for n, body in parts.items()}
        out.entry("SHA256SUMS", lambda: out.text("".join(f"{digest}  {n}\n" for n, digest in sums.items())))


def align_series(series: DataFrame, names: list[str], date: str = "date", name: str = "series", value: str = "value", seq: str = "seq") -> DataFrame:
    """One row for each date, one column for each series; of equal dates the last value wins."""
    cell = lambda n: F.max_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, F.col(seq))).alias(n)
    return series.groupBy(F.substring(F.col(date), 1, 10).alias(date)).agg(*(cell(n) for n in names))

