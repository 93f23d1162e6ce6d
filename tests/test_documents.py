"""Documents of any size: whole, in order, and never in the driver's Python."""

import csv
import hashlib
import io
import json
import re
import zipfile

import pytest
from pyarrow import feather
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.sources import documents, sinks, workbook
from almanack.streaming import streams

ROWS = 25_000


@pytest.fixture
def table(spark):
    """Sorted rows over many partitions, some of them empty, with texts that every format has to escape."""
    text = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 7 == 1, F.lit(' a,"b"\n<c>&\\ ')).when(F.col("id") % 7 == 2, "").otherwise(F.concat(F.lit("é"), F.col("id").cast("string")))
    return spark.range(0, ROWS, 1, 9).select("id", text.alias("t"), (F.col("id") / 4).alias("v")).filter("id < 20000 or id > 23000")


@pytest.fixture
def no_collect(monkeypatch):
    """Whole tables must not come to the driver: a row a partition or column is all it may ask for."""
    for name in ("toPandas", "toArrow"):
        real = getattr(DataFrame, name)
        monkeypatch.setattr(DataFrame, name, lambda self, real=real: real(self) if self.isEmpty() else pytest.fail("a table came to the driver"))
    real = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: rows if len(rows := real(self)) < 100 else pytest.fail("a table came to the driver"))


def expected(table):
    ids = [i for i in range(ROWS) if i < 20_000 or i > 23_000]
    text = lambda i: None if i % 7 == 0 else ' a,"b"\n<c>&\\ ' if i % 7 == 1 else "" if i % 7 == 2 else f"é{i}"
    return [(i, text(i), i / 4) for i in ids]


def test_json(table, no_collect, tmp_path):
    sinks.to_json(table, str(tmp_path / "x.json"), [{"alias": "v"}], [{"operation": "o"}])
    got = json.loads((tmp_path / "x.json").read_text(encoding="utf-8"))
    assert [tuple(r.values()) for r in got["data"]] == expected(table)
    assert got["variables"] == [{"alias": "v"}] and got["transformations"] == [{"operation": "o"}]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x.json"]  # no checksum files
    sinks.to_json(table.filter("id < 0"), str(tmp_path / "x.json"), [], [])  # written over
    assert json.loads((tmp_path / "x.json").read_text())["data"] == []


def test_arrow(table, no_collect, tmp_path):
    sinks.to_feather(table, str(tmp_path / "x.feather"))
    got = feather.read_table(tmp_path / "x.feather")
    assert list(zip(*(got[c].to_pylist() for c in got.column_names), strict=True)) == expected(table)
    sinks.to_feather(table.filter("id < 0"), str(tmp_path / "none.feather"))
    assert feather.read_table(tmp_path / "none.feather").column_names == ["id", "t", "v"]


def test_bundle(table, no_collect, tmp_path):
    sinks.bundle(str(tmp_path / "b.zip"), table, "recipe", [{"s": "é"}], [], "read me")
    with zipfile.ZipFile(tmp_path / "b.zip") as z:
        assert z.testzip() is None
        rows = list(csv.reader(io.StringIO(z.read("data.csv").decode(), newline="")))
        sums = dict(reversed(line.split("  ")) for line in z.read("SHA256SUMS").decode().splitlines())
        assert {n: hashlib.sha256(z.read(n)).hexdigest() for n in z.namelist() if n != "SHA256SUMS"} == sums
    assert rows[0] == ["id", "t", "v"]
    assert [(int(i), t, float(v)) for i, t, v in rows[1:]] == [(i, t or "", v) for i, t, v in expected(table)]


def test_workbook_pages(table, no_collect, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "SHEET_ROWS", 9_000)
    sinks.to_excel({"Data": table, "Empty": table.filter("id < 0")}, str(tmp_path / "x.xlsx"))
    found = []
    with zipfile.ZipFile(tmp_path / "x.xlsx") as z:
        sheets = [z.read(f"xl/worksheets/sheet{i}.xml").decode() for i in range(1, 5)]
        assert len([n for n in z.namelist() if "worksheets" in n]) == 4 and 'name="Data_3"' in z.read("xl/workbook.xml").decode()
    for s in sheets:
        rows = re.findall("<row>(.*?)</row>", s, re.S)
        assert s.startswith("<worksheet") and s.endswith("</worksheet>") and len(rows) <= 9_001
        found += rows[1:]
    assert [int(re.search("<v>(.*?)</v>", r)[1]) for r in found] == [i for i, _, _ in expected(table)]
    assert sheets[3].count("<row>") == 1 and 'preserve"> a,"b"\n&lt;c&gt;&amp;\\ </t>' in found[1]
    assert found[0].count(f'<c s="{workbook.BLANK}"/>') == 1 and '<c s="2"><v>' in found[0]  # numbers to thousands


def test_numbered_parts_keep_the_order(spark):
    table = spark.range(0, 1_000, 1, 7).select(F.col("id").alias("x.y"), F.lit(None).alias("nothing")).filter("`x.y` % 3 = 0")
    line = lambda df: F.concat(F.col("`x.y`").cast("string"), F.coalesce("nothing", F.lit("")))
    path, pages = documents.numbered_parts(table, line, 100)
    got = [[int(r) for p in documents.part_files(spark, f"{path}/page={i}") for r in open(p.removeprefix("file:"))] for i in range(pages)]  # noqa: SIM115
    assert [len(g) for g in got] == [100, 100, 100, 34] and sum(got, []) == list(range(0, 1_000, 3))
    assert documents.numbered_parts(table.limit(0), line, 100)[1] == 0


def test_circuits_go_on_over_batches(spark):
    """One provider with most of the calls, in batches of a few rows, against all in one."""
    calls = spark.range(3_000).select(F.when(F.col("id") % 5 == 0, F.lit(None).cast("string")).when(F.col("id") % 5 == 1, "b").otherwise("a").alias("provider"), (F.col("id") * 7).alias("seconds"), (F.col("id") * 37 % 11 > 4).alias("ok"))
    whole = sorted(streams.breaker_states(calls).collect(), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        few = sorted(streams.breaker_states(calls).collect(), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    alone = [(p, r.seconds, r.ok, s) for p in (None, "a", "b") for r, s in one_by_one([r for r in whole if r.provider == p])]
    assert few == whole and sorted(map(tuple, whole), key=str) == sorted(alone, key=str) and len({r.state for r in whole}) == 3


def one_by_one(rows):
    memory = ("closed", 0, 0, [])
    for r in sorted(rows, key=lambda r: (r.seconds, r.ok)):
        memory = streams._advance(memory, r.seconds, r.ok, streams.Breaker())
        yield r, memory[0]
