"""Permuted titles and binary rounding against Python, and sheets that go on."""

import random
import zipfile
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from almanack.functions.values import round_binary
from almanack.operators import search
from almanack.sources import readers, sinks, workbook


def test_permuted_titles_agree_with_all_pairs(spark):
    rng = random.Random(1)
    titles = [["everywhere", *rng.choices("abcdefgh", k=rng.randint(3, 14))] for _ in range(150)]
    titles += [t[::-1] for t in titles[:20]] + [[*t[1:], "new"] for t in titles[:20]] + [[*t, "more"] for t in titles[20:40]] + [[], ["a"] * 5, ["a"] * 6, ["a"] * 13, ["a"] * 12]
    rng.shuffle(titles)
    left, right = titles[:90], titles[60:]
    shape = "id int, tokens array<string>"
    got = search.permuted_titles(spark.createDataFrame(enumerate(left), shape), spark.createDataFrame(enumerate(right), shape))

    def near(a, b):
        common, small, large = sum((Counter(a) & Counter(b)).values()), min(len(a), len(b)), max(len(a), len(b))
        return small >= 5 and large - small <= 1 and large - common <= 1 and common / small >= 0.92

    expected = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if near(a, b)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == expected and len(rows) == len(expected) and len(expected) > 40


def test_a_common_word_pairs_nothing(spark):
    df = spark.range(2000).select("id", F.split(F.concat_ws(" ", F.lit("the one word of all"), F.col("id"), F.col("id") * 7 + 1), " ").alias("tokens"))
    assert search.permuted_titles(df, df).filter("left <> right").count() == 0
    plan = search.permuted_titles(df, df)
    plan.collect()
    assert "CartesianProduct" not in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("digits", [0, 1, 2, 6])
def test_rounding_of_a_million_doubles(spark, digits):
    rng = np.random.default_rng(digits)
    x = np.concatenate([rng.normal(0, 100, 400_000), np.round(rng.normal(0, 100, 300_000), 3) + 0.0005 * rng.integers(-3, 4, 300_000), rng.integers(-4000, 4000, 200_000) / 64, 10 ** rng.uniform(-30, 300, 99_996) * rng.choice([-1, 1], 99_996), [0.0, np.inf, -np.inf, np.nan]])
    got = spark.createDataFrame(pd.DataFrame({"x": x})).select("x", round_binary(F.col("x"), digits).alias("r")).toPandas()
    finite = np.isfinite(got.x)
    assert [round(v, digits) for v in got.x[finite].tolist()] == got.r[finite].tolist()
    assert got.r[~finite].astype(str).tolist() == got.x[~finite].astype(str).tolist()


def test_long_tables_go_on_in_further_sheets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "SHEET_ROWS", 3)
    sinks.to_excel({"Data": spark.range(8).select(F.col("id").alias("a")), "None": spark.range(0).select(F.col("id").alias("b"))}, str(tmp_path / "a.xlsx"))
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        sheets = [z.read(f"xl/worksheets/sheet{i}.xml").decode() for i in range(1, 5)]
        assert 'name="Data_3"' in z.read("xl/workbook.xml").decode()
    assert [s.count("<row>") for s in sheets] == [4, 4, 3, 1] and "<v>7</v>" in sheets[2]


def test_damage_far_into_a_source_is_its_own(spark):
    bad = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).alias("v"))
    good = spark.range(3).select(F.lit("y").alias("v"))
    parts, log = readers.fetch_all([("bad", lambda: bad), ("good", lambda: good)], apart=True)
    assert parts[0] is None and parts[1].count() == 3 and [x["ok"] for x in log] == [False, True] and "broken" in log[0]["error"]


def test_classes_hold_every_link(spark):
    rng = random.Random(2)
    titles = [rng.choices("abcdefgh", k=rng.choice([4, 5, 6, 13, 14])) for _ in range(120)]
    titles += [t[::-1] for t in titles[:30]] + [[*t[1:], "new"] for t in titles[:40]] + [[*t, "more"] for t in titles[40:80]]
    df = spark.createDataFrame(enumerate(titles), "id int, tokens array<string>")
    rows = search.permuted_classes(df).collect()
    of = {r.right: r.left for r in rows if r.kind == "member"}
    near = [(r.left, r.right) for r in rows if r.kind == "near"]
    assert len(near) == len(set(near)) and all(a < b and of[a] == a and of[b] == b for a, b in near)
    linked = {(a, b) for a in of for b in of if a < b and (of[a] == of[b] or (min(of[a], of[b]), max(of[a], of[b])) in set(near))}
    assert linked == {(r.left, r.right) for r in search.permuted_titles(df, df).collect() if r.left < r.right}


def test_many_copies_of_many_near_titles_stay_classes(spark):
    """Copies and shared words neither pair with each other nor meet in a join: 150,000 titles of 25,000 classes."""
    word = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(30)).cast("string")
    few = spark.range(25_000).select("id", F.concat(F.array(*map(F.lit, "series of in size".split())), F.array(*(F.concat(F.lit(f"w{n}-"), word(n)) for n in range(1, 5)))).alias("t"))
    df = few.crossJoin(spark.range(6).withColumnRenamed("id", "copy")).select((F.col("id") + 25_000 * F.col("copy")).alias("id"), F.when(F.col("copy") % 2 == 1, F.reverse("t")).otherwise(F.col("t")).alias("tokens"))
    rows = search.permuted_classes(df).groupBy("kind").count().collect()
    assert [tuple(r) for r in rows] == [("member", 150_000)]
