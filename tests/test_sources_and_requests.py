import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from almanack import schema
from almanack.functions import text
from almanack.operators import cube, geography, search
from almanack.plans import recipes, requests, vocabulary
from almanack.sources import readers, sinks


def put(path, body):
    path.write_text(body if isinstance(body, str) else json.dumps(body), encoding="utf-8")
    return str(path)


def brief(df):
    return sorted((r.series_id, r.iso3, r.period, r.value) for r in df.collect())


def test_json_payloads(spark, tmp_path):
    wb = put(tmp_path / "wb.json", [{"page": 1}, [{"indicator": {"id": "GDP", "value": "x"}, "country": {"id": "DZ", "value": "Algeria"}, "countryiso3code": "DZA", "date": "2001", "value": 1.5}, {"indicator": {"id": "GDP"}, "country": {"value": "Algeria"}, "countryiso3code": "DZA", "date": "2002", "value": None}]])
    assert brief(readers.world_bank(spark, wb)) == [("GDP", "DZA", "2001", 1.5)]
    fred = put(tmp_path / "fred.json", {"observations": [{"date": "2000-01-01", "value": "3.5"}, {"date": "2000-02-01", "value": "."}]})
    assert brief(readers.fred(spark, fred, "UNRATE")) == [("UNRATE", "USA", "2000-01", 3.5), ("UNRATE", "USA", "2000-02", None)]
    imf = put(tmp_path / "imf.json", {"values": {"PCPI": {"DZA": {"2000": 1.0, "2001": None}}}})
    assert brief(readers.imf_datamapper(spark, imf)) == [("PCPI", "DZA", "2000", 1.0)]
    gecko = put(tmp_path / "gecko.json", {"prices": [[946684800000, 2.0]]})
    assert brief(readers.coingecko(spark, gecko, "btc")) == [("btc:prices", None, "2000-01-01", 2.0)]
    rates = put(tmp_path / "rates.json", {"base_code": "USD", "conversion_rates": {"EUR": 0.9}})
    assert brief(readers.exchange_rates(spark, rates)) == [("USD", None, "EUR", 0.9)]
    wds = put(tmp_path / "wds.json", [{"object": {"vectorId": 7, "frequencyCode": 6, "vectorDataPoint": [{"refPer": "2000-03-01", "value": 2, "scalarFactorCode": 3}]}}])
    assert brief(readers.statcan_vectors(spark, wds)) == [("v7", "CAN", "2000-03", 2000.0)]
    trade = put(tmp_path / "trade.json", {"data": [{"period": "2000", "flowDesc": "Export", "cmdCode": "TOTAL", "primaryValue": 5.0, "reporterDesc": "X", "partnerDesc": "World"}]})
    assert readers.comtrade(spark, trade).first().flow == "export"
    catalogue = put(tmp_path / "cat.json", {"indicators": [{"code": "A", "name": "One", "frequency": "Q"}, {"id": "B", "name": " "}, {"id": "C", "name": "Three", "aliases": ["x"] * 20}]})
    assert [(r.code, r.frequency, len(r.aliases or [])) for r in readers.catalogue_json(spark, catalogue, "p").orderBy("code").collect()] == [("A", "quarterly", 0), ("C", "unknown", 12)]


def test_cubes(spark, tmp_path):
    stat = put(tmp_path / "stat.json", {"id": ["unit", "geo", "time"], "size": [1, 2, 3], "value": {"0": 1.0, "4": 5.0, "5": None}, "dimension": {"unit": {"category": {"index": {"PC": 0}}}, "geo": {"category": {"index": {"DE": 0, "FR": 1}, "label": {"DE": "Germany", "FR": "France"}}}, "time": {"category": {"index": {"2000": 0, "2001": 1, "2002": 2}}}}})
    assert brief(readers.json_stat(spark, stat)) == [("PC", "DE", "2000", 1.0), ("PC", "FR", "2001", 5.0)]
    sdmx = put(tmp_path / "sdmx.json", {"dataSets": [{"series": {"0:1": {"observations": {"0": [1.5], "1": [None]}}}}], "structure": {"dimensions": {"series": [{"id": "FREQ", "values": [{"id": "Q", "name": "Quarterly"}]}, {"id": "REF_AREA", "values": [{"id": "US", "name": "United States"}, {"id": "FR", "name": "France"}]}], "observation": [{"id": "TIME_PERIOD", "values": [{"id": "2000-Q1"}, {"id": "2000-Q2"}]}]}}})
    assert brief(readers.sdmx_json(spark, sdmx, "oecd")) == [("Q.FR", "FR", "2000Q1", 1.5)]
    one = spark.range(24).withColumn("sizes", F.expr("array(2L, 3L, 4L)"))
    back = one.withColumn("c", cube.coordinates(F.col("id"), F.col("sizes"))).withColumn("i", cube.flat_index(F.col("sizes"), F.col("c")))
    assert back.filter("i <> id").count() == 0 and back.filter("id = 23").first().c == [1, 2, 3]
    labels = spark.createDataFrame([("sex", "M", 0), ("sex", "T", 1), ("age", "Y1", 0), ("age", "Y2", 1)], "dimension string, code string, place int")
    assert {r[0]: r[1] for r in cube.default_member(labels).collect()} == {"sex": "T", "age": "Y1"}
    with pytest.raises(ValueError):
        cube.strict_filter(labels, "code", ["M", "Q"])


def test_tables_and_xml(spark, tmp_path):
    csv = put(tmp_path / "a.csv", "FREQ,COUNTRY,INDICATOR,TIME_PERIOD,OBS_VALUE,UNIT_MULT\nA,DZA,X,2000,1.5,3\nA,DZA,X,2001,,3\nQ,MAR,X,2000-Q2,2,\n")
    assert brief(readers.sdmx_csv(spark, csv, "imf", dimensions=["INDICATOR"])) == [("X", "DZA", "2000", 1500.0), ("X", "MAR", "2000Q2", 2.0)]
    table = put(tmp_path / "t.csv", 'REF_DATE,GEO,COORDINATE,VALUE,UOM\n2000,Canada,1.1,,$\n2000,Canada,1.2,"1,000",$\n2001,Canada,1.3,7,$\n2001,Canada,1.2,8,$\n')
    assert brief(readers.statcan_table(spark, table, "annual")) == [("1.2", None, "2000", 1000.0), ("1.2", None, "2001", 8.0)]
    china = put(tmp_path / "c.csv", "d,v\n2000-01,1\n2000-01,2\n")
    assert brief(readers.china_macro(spark, china, "m2", "d", "v", "monthly", ["d", "v"])) == [("m2", "CHN", "2000-01", 2.0)]
    with pytest.raises(ValueError):
        readers.china_macro(spark, china, "m2", "d", "v", "monthly", ["d", "w"])
    xml = put(tmp_path / "s.xml", '<D><Series FREQ="A" COUNTRY="DZA" INDICATOR="X" UNIT="u"><Obs TIME_PERIOD="2000" OBS_VALUE="1"/><Obs TIME_PERIOD="2001" OBS_VALUE="2" OBS_STATUS="E"/></Series><Series FREQ="Q" COUNTRY="MAR" INDICATOR="X"><Obs TIME_PERIOD="2000-Q4" OBS_VALUE="3"/></Series></D>')
    assert brief(readers.sdmx_xml(spark, xml, "imf")) == [("X", "DZA", "2000", 1.0), ("X", "DZA", "2001", 2.0), ("X", "MAR", "2000Q4", 3.0)]


def test_one_failure_does_not_stop_the_others(spark, tmp_path):
    good = put(tmp_path / "r.json", {"base_code": "USD", "conversion_rates": {"EUR": 0.9}})
    rows, log = readers.fetch_all([("bad", lambda: spark.read.parquet(str(tmp_path / "none"))), ("good", lambda: readers.exchange_rates(spark, good))])
    assert rows.count() == 1 and [x["ok"] for x in log] == [False, True]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), (None, None), ("=1", 2.0)], "s string, v double").coalesce(1)
    sinks.to_safe_csv(df, str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).collect()[3][0] == "'=1,2.0"
    sinks.to_json(df, str(tmp_path / "x.json"), [], [])
    assert len(json.loads((tmp_path / "x.json").read_text())["data"]) == 3
    sinks.to_feather(df, str(tmp_path / "x.feather"))
    names = sinks.stata_names(["2000 value", "x" * 40, "x" * 41, "ok"])
    assert names["2000 value"] == "v_2000_value" and len(set(names.values())) == 4 and max(map(len, names.values())) <= 32
    sinks.to_stata(df.na.fill("").na.fill(0.0), str(tmp_path / "x.dta"), {"v": "l" * 100})
    cells = spark.createDataFrame([("v", "A<", "2000", 1.0), ("v", "A<", "2001", None), ("v", "A<", "2002", 2.0), ("v", "A<", "2003", 3.0), ("v", "B", "2000", None), ("u", "A<", "2000", float("nan")), ("u", "A<", "2001", 5.0)], "alias string, geo_key string, period string, value double")
    sinks.html_report("T<", cells, spark.createDataFrame([("v", "2000", 100.0), ("v", None, None)], "alias string, period string, coverage_pct double"), ["v", "u"], str(tmp_path / "x.html"))
    page = (tmp_path / "x.html").read_text()
    assert 'points="10.0,110.0"/><polyline' in page and 'points="396.7,60.0 590.0,10.0"' in page and 'points="590.0,110.0"' in page
    assert page.index("v, A&lt;") < page.index("u, A&lt;") and "v, B" not in page and ">100.0" in page and page.endswith("</table>")
    assert page.count("<polyline") == 3 and "T&lt;" in page
    sinks.bundle(str(tmp_path / "b.zip"), df, "recipe", [], [], "readme")
    assert "SHA256SUMS" in zipfile.ZipFile(tmp_path / "b.zip").namelist()


WORDS = vocabulary.Vocabulary(
    {"cpi": [["consumer prices", "CPI"], ["prix"], ["أسعار"]], "jobs": [["jobless share"], ["sans travail"], ["عطالة"]], "trade": [["goods sold abroad"], [], []], "trade_share": [["goods sold abroad per head"], [], []]},
    {"PER": ["Peru", "Pérou", "بيرو"], "FIN": ["Finland", "Finlande"], "BOL": ["Bolivia", "Bolivie"]},
    {"andes": (["Andes"], ["BOL", "PER"])},
    {"quarterly": ["quarterly"], "annual": ["annual"], "half": ["half of quarterly"]},
    {"statfin": ["statistics finland"]},
    {"csv": ["csv"]},
    ["long"],
    ["cpi"],
)


@pytest.mark.parametrize(
    ("sentence", "language", "concepts", "places", "span"),
    [
        ("Consumer prices of Peru, 1999-2004", "en", ("cpi",), ("PER",), (1999, 2004)),
        ("les prix au Pérou depuis 2011", "fr", ("cpi",), ("PER",), (2011, None)),
        ("أسعار في بيرو 2001 2003", "ar", ("cpi",), ("PER",), (2001, 2003)),
        ("goods sold abroad per head, goods sold abroad in the Andes and Bolivia", "en", ("trade_share", "trade"), ("BOL", "PER"), (None, None)),
        ("jobless share of Finland in the past 7 years", "en", ("jobs",), ("FIN",), (2019, 2025)),
        ("", "en", (), (), (None, None)),
    ],
)
def test_parse(spark, sentence, language, concepts, places, span):
    spec = requests.parse(sentence, WORDS, current_year=2025)
    assert (spec.language, spec.concepts, spec.geographies, (spec.start, spec.end)) == (language, concepts, places, span)
    assert spec.ambiguous == tuple(c for c in concepts if c == "cpi")


def test_parse_details(spark):
    spec = requests.parse("CPI quarterly and half of quarterly from Statistics Finland as long csv", WORDS)
    assert spec.frequency == "half" and spec.providers == ("statfin",) and spec.shape == "long" and spec.formats == ("csv",) and spec.geographies == ("FIN",)
    rows = requests.parse_requests(spark.createDataFrame([(1, None), (2, "CPI Peru")], "concepts_of int, said string"), WORDS, "said")
    assert [(r.concepts_of, r.concepts, r.geographies) for r in rows.orderBy("concepts_of").collect()] == [(1, [], []), (2, ["cpi"], ["PER"])]
    assert (requests.top_count("top 500"), requests.top_count("the highest"), requests.top_count("rank them")) == (100, 1, 10)
    asked = spark.createDataFrame([(["DZA"], "a"), ([], "z"), (["DZA", "FRA"], None), (None, "a")], "c array<string>, p string")
    offers = [{"provider": "a", "confidence": 0.8, "scope": "global"}, {"provider": "b", "confidence": 0.75, "scope": "list", "countries": ["DZA"]}, {"provider": "t", "confidence": 0.8, "scope": "global"}]
    after = requests.fallback_order(F.col("p"), {"a": ["b", "a", "c", "b"]}, F.array(F.lit("b"), F.lit("a")))
    got = asked.select(requests.choose_provider(offers, F.col("c")), requests.choose_provider(offers[1:2], F.col("c")), requests.choose_provider([], F.col("c")), after).collect()
    assert [tuple(r) for r in got] == [("b", "b", None, ["b"]), ("a", "b", None, []), ("a", None, None, []), ("a", "b", None, ["b"])]


def test_parse_a_table_of_requests(spark, tmp_path):
    """Requests in three languages, one of them null, read from files and dealt over tasks."""
    said = ["Consumer prices of Peru, 1999-2004", "les prix au Pérou depuis 2011", "أسعار في بيرو 2001 2003", "jobless share of Finland in the past 7 years", None]
    spark.createDataFrame([(i, said[i % 5]) for i in range(50)], "i int, said string").repartition(3).write.parquet(str(tmp_path / "said"))
    rows = requests.parse_requests(spark.read.parquet(str(tmp_path / "said")), WORDS, "said", current_year=2025).collect()
    expected = [("en", ["cpi"], ["PER"], 1999, 2004), ("fr", ["cpi"], ["PER"], 2011, None), ("ar", ["cpi"], ["PER"], 2001, 2003), ("en", ["jobs"], ["FIN"], 2019, 2025), ("en", [], [], None, None)]
    assert len(rows) == 50 and all((r.language, r.concepts, r.geographies, r.start, r.end) == expected[r.i % 5] for r in rows)


def test_instant(spark):
    def fetch(series, spec):
        if series["series_id"] == "bad":
            raise OSError("down")
        return spark.createDataFrame([("p", series["series_id"], "Algeria", "DZA", str(y), float(y), "%", "annual", None, y) for y in (2000, 2001)], schema.OBSERVATIONS)

    resolve = lambda concept, spec: [{"provider": "p", "series_id": s, "title": concept, "unit": "%"} for s in ("bad", f"good-{concept}")]
    out = requests.instant("CPI and jobless share in Peru 2000 to 2001", resolve, fetch, WORDS)
    assert out["dataset"].wide().count() == 2 and len(out["failures"]) == 2 and out["verdict"].first().status == "clean"
    assert requests.instant("CPI", resolve, fetch, WORDS)["warning"] == "no geography"


def test_recipes(spark, tmp_path):
    one = recipes.Recipe("n", geographies=["MAR", "DZA"], series=[{"provider": "p", "series_id": "s", "alias": "a", "title": "x"}], start_year=2000, end_year=2001, transformations=[{"operation": "build_dataset"}])
    two = recipes.Recipe("other", {"request": "text"}, geographies=["DZA", "MAR"], series=[["p", "s", "a"]], start_year=2000, end_year=2001)
    assert one.hash() == two.hash() and len(one.hash()) == 16
    one.save(str(tmp_path / "r.json"))
    back = recipes.Recipe.load(str(tmp_path / "r.json"))
    assert back.hash() == one.hash() and back.notes == {"name": "n"}
    assert recipes.Recipe("e").problems() == ["no series", "no geographies"]
    (tmp_path / "bad.json").write_text(one.text().replace("2001", "2002"))
    with pytest.raises(ValueError):
        recipes.Recipe.load(str(tmp_path / "bad.json"))
    with pytest.raises(ValueError):
        recipes.Recipe("n", place="x")


def test_no_export_cuts_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "DOCUMENT_ROWS", 5)
    df = spark.range(6).withColumn("x", F.lit("a"))
    with pytest.raises(ValueError):
        sinks.to_stata(df, str(tmp_path / "a.dta"))
    sinks.to_json(df.limit(5), str(tmp_path / "b.json"), [{"alias": "x"}], [])
    assert len(json.loads((tmp_path / "b.json").read_text())["data"]) == 5
    sinks.to_json(df.limit(0), str(tmp_path / "c.json"), [], [])
    assert json.loads((tmp_path / "c.json").read_text())["data"] == []


def test_a_million_rows_and_one(spark, tmp_path):
    from pyarrow import feather

    sinks.to_feather(spark.range(1_000_001), str(tmp_path / "m.feather"))
    assert feather.read_table(str(tmp_path / "m.feather")).num_rows == 1_000_001


def test_workbooks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks.workbook, "SHEET_ROWS", 3)
    df = spark.createDataFrame([("a<b", 1_500_000.0, None), (None, float("nan"), True), ("c", 2.0, False), ("d", 3.0, None)], "s string, v double, b boolean").coalesce(1)
    sinks.to_excel({"x/y": df, "X_y": df.limit(0)}, str(tmp_path / "w.xlsx"))
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        sheet, more, book = (z.read(f"xl/{n}.xml").decode() for n in ("worksheets/sheet1", "worksheets/sheet2", "workbook"))
    assert "a&lt;b" in sheet and sheet.count("<row>") == 4 and more.count("<row>") == 2 and ">d<" in more
    assert 'name="x_y"' in book and 'name="x_y_2"' in book and 'name="X_y_3"' in book


def test_a_broken_source_is_its_own_failure(spark, tmp_path):
    good = spark.createDataFrame([("p", "s", "A", "AAA", "2000", 1.0, None, "annual", None, 1)], schema.OBSERVATIONS)
    late = good.withColumn("value", F.raise_error(F.lit("cut off")).cast("double"))
    rows, log = readers.fetch_all([("late", lambda: late), ("good", lambda: good)], apart=True, land=str(tmp_path / "land"))
    assert rows[0] is None and rows[1].count() == 1 and [x["ok"] for x in log] == [False, True]


def test_stored_index_prunes(spark, tmp_path):
    catalog = spark.createDataFrame([(i, f"C{i}", f"gross product {i}" if i % 3 else f"trade of region {i}", "long words " * 5, "p", "t") for i in range(60)], "id long, code string, title string, description string, provider string, topic string")
    search.build_index(catalog, str(tmp_path / "index"))
    index = search.open_index(spark, str(tmp_path / "index"))
    for query in ("gross product", "trade", "nothing here", "", "C7"):
        assert search.search(index, query, 7).collect() == search.search(catalog, query, 7).collect()
    plan = search._hits(index, ["trade"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,trade)]" in plan


def test_stored_index_reads_whole_texts(spark, tmp_path):
    """Words far inside a description and items far down a list are found, as in a search of the whole catalogue."""
    many = [f"w{i}" for i in range(40)]
    rows = [(1, "C1", "gross last", " ".join(many * 5 + ["last", "far", "far"]), "p", "last", many), (2, "C2", "other", "far " * 130 + "end", "p", "t", many[:13] + ["end"]), (3, "C3", None, None, None, None, None)]
    catalog = spark.createDataFrame(rows, "id long, code string, title string, description string, provider string, topic string, aliases array<string>")
    search.build_index(catalog, str(tmp_path / "index"))
    index = search.open_index(spark, str(tmp_path / "index"))
    found = {q: [r.id for r in search.search(index, q, 5).collect()] for q in ("far", "last", "end", "w39", "w12")}
    assert {q: sorted(ids) for q, ids in found.items()} == {"far": [1, 2], "last": [1], "end": [2], "w39": [1], "w12": [1, 2]}
    for query in (*found, "far end last", "gross w39", "nothing"):
        assert search.search(index, query, 5).collect() == search.search(catalog, query, 5, limits=search.WHOLE).collect()
    assert {(r.key, r.weight) for r in search._hits(index, ["last"]).collect()} == {(1, 8.0 + 2.0 + 1.0)}


def test_search_tie_and_fusion(spark):
    a = spark.createDataFrame([(i, float(-i)) for i in range(30)], "id long, score double")
    b = spark.createDataFrame([(29, 1.0), (0, 0.5)], "id long, score double")
    got = {r.id: r.rrf for r in search.reciprocal_rank_fusion([a, b], "id").collect()}
    assert len(got) == 21 and got[0] == pytest.approx(1 / 61 + 1 / 62) and got[29] == pytest.approx(1 / 61)
    t = spark.createDataFrame([(["a", "b", "c"], ["x", "a", "b", "c"]), (["a", "b"], ["a", "b"]), (["a", "b"], ["c"])], "a array<string>, b array<string>")
    assert [r[0] for r in t.select(search.title_match(F.col("a"), F.col("b"))).collect()] == ["close", "exact", "none"]
    w = spark.createDataFrame([(1, list("abcde")), (2, list("edcba")), (3, list("abcxy"))], "id long, tokens array<string>")
    assert {(r.left, r.right) for r in search.permuted_titles(w, w).filter("left < right").collect()} == {(1, 2)}
    r = spark.createDataFrame([(1,), (2,), (None,)], "rank int")
    assert tuple(search.ranking_quality(r, 1).first())[:2] == (pytest.approx(1 / 3), pytest.approx(0.5))
    c = geography.coverage(w, w.filter("id = 1"), "id").first()
    assert (c.requested, c.covered, c.missing) == (3, 1, "2,3")


def test_languages(spark):
    cases = ["le taux de chômage", "unemployment rate", "GDP والتضخم", "", "Évolution"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(text.detect_language(F.col("t"))).collect()] == ["fr", "en", "ar", "en", "fr"]
    folded = [r[0] for r in df.select(text.fold(F.col("t"), text.detect_language(F.col("t")))).collect()]
    assert folded == ["taux chomage", "unemployment rate", "GDP تضخم gdp", "", "evolution"]
    one = lambda t, g: spark.range(1).select(text.fold(F.lit(t), F.lit(g))).first()[0]
    assert one("الأسعار ٢٠٢٠", "ar") == one("اسعار 2020", "ar") and one("the of", "en") == "the of" and one("l'indice des prix", "fr") == "indice prix"
    assert one("GDP", "ar") == "gdp" and one(None, "en") is None


def test_folded_texts_go_to_python(spark):
    """A Python function of a folded text is computed, in every language, with marks and without."""
    shout = F.pandas_udf(lambda t: t.str.upper(), "string")
    rows = [("the prices of Peru", "en"), ("les prix d'été", "fr"), ("the of", "en"), ("la de", "fr"), ("", "en"), (None, "fr"), ("الأسعار GDP", "ar")]
    df = spark.createDataFrame(rows, "t string, g string").withColumn("p", text.fold(F.col("t"), F.col("g")))
    got = [r[0] for r in df.select(shout("p")).collect()]
    assert got == ["PRICE PERU", "PRIX ETE", "THE OF", "LA DE", "", None, "اسعار GDP GDP"]


def test_mentions_of_a_large_vocabulary(spark):
    """Longest names win, and the time of a text does not follow the number of names."""
    small = {"a b": "AB", "b": "B", "b c d": "BCD", "d": "D", "e": "E"}
    large = small | {f"name {i} of many": str(i) for i in range(100_000)}
    texts = ["a b c d e", "b c d a b", "e name 77 of many e", "", "x"] * 400
    df = spark.createDataFrame(enumerate(texts), "i int, t string")
    got = [r.m for r in df.select("i", requests.mentions(F.col("t"), large).alias("m")).orderBy("i").collect()]
    assert got == [requests.consume(t, small | {"name 77 of many": "77"}) for t in texts]

    def seconds(names):
        every = requests.Names(names)
        every.consume("x")  # the automaton
        start = time.perf_counter()
        for t in texts:
            every.consume(t)
        return time.perf_counter() - start

    assert seconds(large) < 20 * seconds(small) + 0.05
