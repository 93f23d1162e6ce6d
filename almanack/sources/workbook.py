"""Workbooks: the parts of an .xlsx file. Rows are made by column expressions, so executors write them."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.functions.values import finite

#: Rows of a sheet; what is beyond goes on in further sheets, as the format holds little more.
SHEET_ROWS = 1_000_000
#: Number formats by the largest magnitude of a column, and their places in the style table.
FORMATS = ((1_000_000, "#,##0"), (1_000, "#,##0.0"), (1, "#,##0.00"), (0, "0.0000"))
BLANK = len(FORMATS) + 1

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def sheet_name(name: str, used: set[str]) -> str:
    """At most 31 characters without ``[]:*?/\\``, none twice."""
    clean = "".join("_" if c in "[]:*?/\\" else c for c in name)[:31] or "Sheet"
    out, n = clean, 1
    while out.lower() in used:
        n += 1
        out = f"{clean[: 30 - len(str(n))]}_{n}"
    used.add(out.lower())
    return out


def _inline(text: Column) -> Column:
    """A cell of text, without the characters that XML forbids."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\uFFFE\uFFFF]", "")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        clean = F.replace(clean, F.lit(char), F.lit(entity))
    return F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), clean, F.lit("</t></is></c>"))


def _is_number(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")


def header(columns: list[str]) -> str:
    cells = (f'<c t="inlineStr"><is><t xml:space="preserve">{escape("".join(x for x in c if x >= " "))}</t></is></c>' for c in columns)
    return f"<row>{''.join(cells)}</row>"


def row(df: DataFrame) -> Column:
    """The XML of each row of a stored table: a column's numbers formatted by the largest of them, gaps highlighted, infinities and NaN as texts."""
    col = lambda c: F.col(f"`{c}`")
    numbers = [c for c, kind in df.dtypes if _is_number(kind)]
    most = df.agg(*(F.max(F.abs(finite(col(c).cast("double")))).alias(f"m{i}") for i, c in enumerate(numbers))).first() if numbers else ()  # a number a column
    style = {c: next((i for i, (least, _) in enumerate(FORMATS, 1) if m >= least), 0) if m is not None else 0 for c, m in zip(numbers, most, strict=True)}
    cells = []
    for c, kind in df.dtypes:
        if c in style:
            value = F.when(finite(col(c).cast("double")).isNull(), _inline(col(c).cast("string"))).otherwise(F.concat(F.lit(f'<c s="{style[c]}"><v>'), col(c).cast("string"), F.lit("</v></c>")))
        elif kind == "boolean":
            value = F.concat(F.lit('<c t="b"><v>'), col(c).cast("int").cast("string"), F.lit("</v></c>"))
        else:
            value = _inline(F.to_json(col(c)) if kind.startswith(("array", "map", "struct")) else col(c).cast("string"))
        cells.append(F.when(col(c).isNull(), f'<c s="{BLANK}"/>').otherwise(value))
    return F.concat(F.lit("<row>"), *cells, F.lit("</row>"))


OPEN, CLOSE = f"<worksheet {_NS}><sheetData>", "</sheetData></worksheet>"


def package(sheets: list[str]) -> dict[str, str]:
    """All files of a workbook but the sheets: ``{path: text}``; sheets are ``xl/worksheets/sheet1.xml`` and so on."""
    used: set[str] = set()
    names = [sheet_name(n, used) for n in sheets]
    formats = "".join(f'<numFmt numFmtId="{163 + i}" formatCode="{f}"/>' for i, (_, f) in enumerate(FORMATS, 1))
    xfs = '<xf numFmtId="0" fillId="0"/>' + "".join(f'<xf numFmtId="{163 + i}" fillId="0" applyNumberFormat="1"/>' for i in range(1, BLANK)) + '<xf numFmtId="0" fillId="2" applyFill="1"/>'
    fills = '<fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFE699"/></patternFill></fill>'
    styles = f'<styleSheet {_NS}><numFmts count="{len(FORMATS)}">{formats}</numFmts><fonts count="1"><font/></fonts><fills count="3">{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{BLANK + 1}">{xfs}</cellXfs></styleSheet>'
    kinds = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    links = "".join(f'<Relationship Id="rId{i}" Type="{kinds}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
    return {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{parts}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{parts}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{parts}.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{kinds}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {_NS} xmlns:r="{kinds}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}<Relationship Id="rId0" Type="{kinds}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": styles,
    }
