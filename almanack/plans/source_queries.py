"""Registered queries over landed payloads: each lands files made from the driver's tables and reads them back.

The oracle works on the tables themselves, so it says whether a payload comes through whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanack.plans.registry import query
from almanack.sources import driver_tables as tables
from almanack.sources import connector, readers, sinks
from almanack.sources.landing import folder, land

ANNUAL = """WITH a AS (SELECT n_name AS nation, 'N' || n_nationkey AS code, n_regionkey AS region, strftime(o_orderdate, '%Y') AS year, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
MONTHLY = """WITH m AS (SELECT c_mktsegment AS segment, strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def annual(spark: SparkSession, sf: str) -> DataFrame:
    """Order totals by nation and year: at most some hundred rows, whatever the tables' size."""
    o, c, n = (tables.read(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value")
    return rows.groupBy(F.col("n_name").alias("nation"), F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_regionkey").alias("region"), F.date_format("o_orderdate", "yyyy").alias("year")).agg(total)


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    o, c = tables.read(spark, sf, "orders"), tables.read(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("segment"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))


def _all(*fields: Column | str) -> Column:
    return F.sort_array(F.collect_list(F.struct(*fields)))


def _brief(df: DataFrame, *more: str) -> DataFrame:
    return df.select("series_id", "geography", "iso3", "period", "value", *more)


_SERIES = "SELECT 'TOT' AS series_id, nation AS geography, code AS iso3, year AS period, value"


@query(ANNUAL + f" {_SERIES}, 'annual' AS frequency FROM a")
def source_world_bank(spark, sf):
    """Pages of the batch answer, a page a region, with null points that are dropped."""
    point = [F.struct(F.lit("TOT").alias("id"), F.lit("t").alias("value")).alias("indicator"), F.struct("code", F.col("nation").alias("value")).alias("country"), F.col("code").alias("countryiso3code"), F.col("year").alias("date"), "value"]
    rows = annual(spark, sf)
    empty = rows.withColumn("value", F.lit(None).cast("double")).withColumn("year", F.lit("2050"))
    pages = rows.unionByName(empty.distinct()).groupBy("region").agg(_all(*point).alias("p"))
    return _brief(readers.world_bank(spark, land(pages, F.concat(F.lit('[{"page":1,"pages":5},'), F.to_json("p"), F.lit("]")).alias("value"), "wb")), "frequency")


def _pages(spark: SparkSession, sf: str) -> str:
    """Landed pages of a batch answer, a page a region, and a payload that no connector can read."""
    point = [F.struct(F.lit("TOT").alias("id")).alias("indicator"), F.struct(F.col("nation").alias("value")).alias("country"), F.col("code").alias("countryiso3code"), F.col("year").alias("date"), "value"]
    pages = annual(spark, sf).groupBy("region").agg(_all(*point).alias("p")).select(F.concat(F.lit('[{"page":1},'), F.to_json("p"), F.lit("]")).alias("value"))
    return land(pages.unionByName(spark.createDataFrame([("<html>busy</html>",)], "value string")), "value", "pages")


@query(ANNUAL + f" {_SERIES} FROM a")
def connector_table(spark, sf):
    """The pages through the data source: a partition for each payload, the damaged one in the log."""
    connector.register(spark)
    return _brief(spark.read.format("almanack").options(path=_pages(spark, sf), connector="world_bank", log=folder(spark, "failures")).load())


@query(ANNUAL + f" {_SERIES} FROM a")
def connector_stream(spark, sf):
    """The same pages as a stream, up to what there is now."""
    connector.register(spark)
    at = folder(spark, "stream")
    rows = spark.readStream.format("almanack").options(path=_pages(spark, sf), connector="world_bank", log=f"{at}/failures").load()
    rows.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return _brief(spark.read.parquet(f"{at}/rows"))


@query(ANNUAL + " SELECT 'A.TOT' AS series_id, code AS geography, code AS iso3, year AS period, value FROM a")
def connector_csv(spark, sf):
    """Tables of comma-separated values, one a region."""
    connector.register(spark)
    line = F.concat_ws(",", F.lit("A"), F.lit("TOT"), "code", "year", F.col("value").cast("string"), F.lit("usd"))
    text = F.concat(F.lit("FREQ,INDICATOR,REF_AREA,TIME_PERIOD,OBS_VALUE,UNIT_MEASURE\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"))
    at = land(annual(spark, sf).groupBy("region").agg(text.alias("value")).select("value"), "value", "csv")
    return _brief(spark.read.format("almanack").options(path=at, connector="sdmx_csv").load())


@query(ANNUAL + f" {_SERIES} FROM a")
def source_world_bank_ladder(spark, sf):
    """A batch answer without some regions, completed country by country, and never twice."""
    point = [F.struct(F.lit("TOT").alias("id")).alias("indicator"), F.struct(F.col("nation").alias("value")).alias("country"), F.col("code").alias("countryiso3code"), F.col("year").alias("date"), "value"]
    page = F.concat(F.lit('[{"page":1},'), F.to_json("p"), F.lit("]")).alias("value")
    rows = annual(spark, sf)
    batch = land(rows.filter("region < 3").groupBy("region").agg(_all(*point).alias("p")), page, "wb")
    single = land(rows.filter("region >= 2").groupBy("code").agg(_all(*point).alias("p")), page, "wb-country")
    return _brief(readers.ladder(readers.world_bank(spark, batch), readers.world_bank(spark, single)))


@query(ANNUAL + f" {_SERIES} FROM a")
def source_world_bank_sources(spark, sf):
    part = lambda concept, i, v: F.struct(F.lit(concept).alias("concept"), i.alias("id"), v.alias("value"))
    item = [F.array(part("Country", F.col("code"), F.col("nation")), part("Series", F.lit("TOT"), F.lit("t")), part("Time", F.concat(F.lit("YR"), "year"), F.col("year"))).alias("variable"), F.col("value").cast("string").alias("value")]
    doc = annual(spark, sf).groupBy("region").agg(F.to_json(F.struct(F.struct(_all(*item).alias("data")).alias("source"))).alias("value"))
    return _brief(readers.world_bank_sources(spark, land(doc, "value", "wbs")))


@query(MONTHLY + " SELECT 'BLD' AS series_id, 'United States' AS geography, 'USA' AS iso3, month AS period, CASE WHEN month LIKE '%-02' THEN NULL ELSE value END AS value FROM m WHERE segment = 'BUILDING'")
def source_fred(spark, sf):
    """Dots stay as null observations."""
    value = F.when(F.col("month").endswith("-02"), ".").otherwise(F.col("value").cast("string"))
    doc = monthly(spark, sf).filter("segment = 'BUILDING'").groupBy("segment").agg(F.to_json(F.struct(_all(F.concat("month", F.lit("-01")).alias("date"), value.alias("value")).alias("observations"))).alias("value"))
    return _brief(readers.fred(spark, land(doc, "value", "fred"), "BLD"))


@query(MONTHLY + """, l AS (SELECT *, lag(value, 1) OVER w AS b, lag(value, 12) OVER w AS y FROM m WINDOW w AS (PARTITION BY segment ORDER BY month))
 SELECT segment, month AS period, round(value - b, 2) AS chg, round((value - b) / b * 100, 6) AS pch, round((value - y) / y * 100, 6) AS pc1, round(CASE WHEN value > 0 THEN ln(value) END, 9) AS log, value AS lin FROM l""")
def source_fred_units(spark, sf):
    rows = monthly(spark, sf).withColumnRenamed("month", "period")
    out = None
    for unit, digits in (("lin", None), ("chg", 2), ("pch", 6), ("pc1", 6), ("log", 9)):
        one = readers.fred_units(rows, unit, 12, ["segment"]).select("segment", "period", (F.round("value", digits) if digits else F.col("value")).alias(unit))
        out = one if out is None else out.join(one, ["segment", "period"])
    return out


@query(ANNUAL + " SELECT 'TOT' AS series_id, code AS geography, code AS iso3, year AS period, value FROM a")
def source_imf_datamapper(spark, sf):
    years = annual(spark, sf).groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("year", "value"))).alias("y"))
    doc = years.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("code", "y"))).alias("c")).select(F.to_json(F.struct(F.create_map(F.lit("TOT"), "c").alias("values"))).alias("value"))
    return _brief(readers.imf_datamapper(spark, land(doc, "value", "imf")))


@query(ANNUAL + " SELECT 'TOT' AS series_id, code AS geography, code AS iso3, year AS period, value, CASE WHEN year = '1995' THEN 'E' END AS status FROM a")
def source_sdmx_xml(spark, sf):
    obs = F.concat(F.lit('<Obs TIME_PERIOD="'), "year", F.lit('" OBS_VALUE="'), F.col("value").cast("string"), F.when(F.col("year") == "1995", F.lit('" OBS_STATUS="E')).otherwise(F.lit("")), F.lit('"/>'))
    series = annual(spark, sf).groupBy("region", "code").agg(F.array_join(F.sort_array(F.collect_list(obs)), "").alias("o")).withColumn("s", F.concat(F.lit('<Series FREQ="A" COUNTRY="'), "code", F.lit('" INDICATOR="TOT">'), "o", F.lit("</Series>")))
    doc = series.groupBy("region").agg(F.concat(F.lit("<DataSet>"), F.array_join(F.sort_array(F.collect_list("s")), ""), F.lit("</DataSet>")).alias("value"))
    return _brief(readers.sdmx_xml(spark, land(doc, "value", "sdmx"), "imf"), "status")


@query(ANNUAL + " SELECT 'TOT' AS series_id, code AS geography, code AS iso3, year AS period, round(value * 1000, 2) AS value FROM a")
def source_sdmx_csv(spark, sf):
    """A file a partition, values in thousands, and observations without a value."""
    rows = annual(spark, sf).select(F.lit("A").alias("FREQ"), F.col("code").alias("COUNTRY"), F.lit("TOT").alias("INDICATOR"), F.col("year").alias("TIME_PERIOD"), F.col("value").cast("string").alias("OBS_VALUE"), F.lit("3").alias("UNIT_MULT"))
    path = folder(spark, "csv")
    sinks.to_csv(rows.unionByName(rows.withColumn("OBS_VALUE", F.lit(None).cast("string")).withColumn("TIME_PERIOD", F.lit("2050"))), path)
    return _brief(readers.sdmx_csv(spark, path, "imf", dimensions=["INDICATOR"])).withColumn("value", F.round("value", 2))


def _indexed(codes: DataFrame, name: str) -> DataFrame:
    """A JSON-stat dimension: place of each code in order, labels."""
    return codes.groupBy().agg(F.sort_array(F.collect_list(F.struct("code", "label"))).alias("c")).select(F.struct(F.struct(F.map_from_entries(F.transform("c", lambda x, i: F.struct(x["code"], i))).alias("index"), F.map_from_entries(F.transform("c", lambda x: F.struct(x["code"], x["label"]))).alias("label")).alias("category")).alias(name), F.size("c").alias(f"{name}_n"))


@query(ANNUAL + " SELECT 'PC' AS series_id, nation AS geography, code AS iso3, year AS period, value FROM a")
def source_json_stat(spark, sf):
    """A cube of unit, geography and time, as flat offsets."""
    rows = annual(spark, sf)
    geo, time = rows.select("code", F.col("nation").alias("label")).distinct(), rows.select(F.col("year").alias("code"), F.col("year").alias("label")).distinct()
    g, t = _indexed(geo, "geo").first(), _indexed(time, "time").first()
    place = lambda d, c: F.create_map(*(F.lit(x) for kv in d["category"]["index"].items() for x in kv))[c]
    cells = rows.groupBy().agg(F.map_from_entries(F.collect_list(F.struct((place(g["geo"], F.col("code")) * t["time_n"] + place(t["time"], F.col("year"))).cast("string"), "value"))).alias("value"))
    unit = F.struct(F.struct(F.create_map(F.lit("PC"), F.lit(0)).alias("index"), F.create_map(F.lit("PC"), F.lit("pieces")).alias("label")).alias("category"))
    as_dim = lambda d: F.struct(F.struct(F.create_map(*(F.lit(x) for kv in d["category"]["index"].items() for x in kv)).alias("index"), F.create_map(*(F.lit(x) for kv in d["category"]["label"].items() for x in kv)).alias("label")).alias("category"))
    doc = cells.select(F.to_json(F.struct(F.array(F.lit("unit"), F.lit("geo"), F.lit("time")).alias("id"), F.array(F.lit(1), F.lit(g["geo_n"]), F.lit(t["time_n"])).alias("size"), "value", F.struct(unit.alias("unit"), as_dim(g["geo"]).alias("geo"), as_dim(t["time"]).alias("time")).alias("dimension"))).alias("value"))
    return _brief(readers.json_stat(spark, land(doc, "value", "jsonstat")))


def _sdmx_json(spark: SparkSession, sf: str) -> str:
    """Series by frequency and area with positions into dimension lists."""
    rows = annual(spark, sf)
    areas = [r for r in rows.select("code", "nation").distinct().orderBy("code").collect()]
    years = [r.year for r in rows.select("year").distinct().orderBy("year").collect()]
    at = lambda names, c: F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, str(i))))[c]
    obs = rows.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct(at(years, F.col("year")), F.array("value")))).alias("observations"))
    series = obs.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("0:"), at([a.code for a in areas], F.col("code"))), F.struct("observations")))).alias("series"))
    member = lambda i, n: F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"))
    dim = lambda i, values: F.struct(F.lit(i).alias("id"), F.array(*values).alias("values"))
    shape = F.struct(F.array(dim("FREQ", [member("A", "Annual")]), dim("REF_AREA", [member(a.code, a.nation) for a in areas])).alias("series"), F.array(dim("TIME_PERIOD", [member(y, y) for y in years])).alias("observation"))
    return land(series.select(F.to_json(F.struct(F.array(F.struct("series")).alias("dataSets"), F.struct(shape.alias("dimensions")).alias("structure"))).alias("value")), "value", "sdmxjson")


@query(ANNUAL + " SELECT 'A.' || code AS series_id, nation AS geography, code AS iso3, year AS period, value FROM a")
def source_sdmx_json(spark, sf):
    return _brief(readers.sdmx_json(spark, _sdmx_json(spark, sf), "oecd"))


@query(ANNUAL + " SELECT 'A.' || code AS series_id, nation AS geography, code AS iso3, year AS period, value FROM a WHERE code = 'N7'")
def source_preferred_series(spark, sf):
    """Of many series of one answer, the one whose members are preferred."""
    return _brief(readers.preferred_series(readers.sdmx_json(spark, _sdmx_json(spark, sf), "bis"), ["FREQ", "BORROWERS_CTY"], {"BORROWERS_CTY": "N7", "UNIT": "USD"}))


@query(MONTHLY + ", v AS (SELECT *, dense_rank() OVER (ORDER BY segment) AS k FROM m) SELECT 'v' || k AS series_id, 'Canada' AS geography, 'CAN' AS iso3, month AS period, value * 1000.0 AS value FROM v")
def source_statcan_vectors(spark, sf):
    rows = monthly(spark, sf).withColumn("k", F.dense_rank().over(Window.orderBy("segment")))
    point = F.struct(F.concat("month", F.lit("-01")).alias("refPer"), F.col("value").alias("value"), F.lit(3).alias("scalarFactorCode"))
    one = rows.groupBy(F.col("k").alias("vectorId"), F.lit(6).alias("frequencyCode")).agg(F.sort_array(F.collect_list(point)).alias("vectorDataPoint"))
    doc = one.groupBy().agg(F.to_json(F.collect_list(F.struct(F.struct("vectorId", "frequencyCode", "vectorDataPoint").alias("object")))).alias("value"))
    return _brief(readers.statcan_vectors(spark, land(doc, "value", "wds")))


@query(MONTHLY + ", v AS (SELECT *, dense_rank() OVER (ORDER BY segment) AS k FROM m) SELECT '36:' || k || '.1' AS series_id, CASE k WHEN 1 THEN 'Ontario' WHEN 2 THEN 'Quebec' ELSE 'Canada' END AS geography, 'CAN' AS iso3, month AS period, value FROM v")
def source_statcan_coordinates(spark, sf):
    rows = monthly(spark, sf).withColumn("k", F.dense_rank().over(Window.orderBy("segment")))
    point = F.struct(F.concat("month", F.lit("-01")).alias("refPer"), F.col("value").alias("value"), F.lit(0).alias("scalarFactorCode"))
    one = rows.groupBy(F.lit(36).alias("productId"), F.concat(F.col("k").cast("string"), F.lit(".1")).alias("coordinate"), F.lit(6).alias("frequencyCode")).agg(F.sort_array(F.collect_list(point)).alias("vectorDataPoint"))
    doc = one.select(F.to_json(F.array(F.struct(F.struct(*one.columns).alias("object")))).alias("value"))
    return _brief(readers.statcan_coordinates(spark, land(doc, "value", "wdsc"), {"1": "Ontario", "2": "Quebec"}))


@query(ANNUAL + " SELECT '1.2' AS series_id, nation AS geography, NULL::VARCHAR AS iso3, year AS period, round(value, 0) AS value FROM a")
def source_statcan_table(spark, sf):
    """Coordinates without data come first; numbers have thousands' commas."""
    rows = annual(spark, sf).coalesce(1).select(F.col("year").alias("REF_DATE"), F.col("nation").alias("GEO"), F.explode(F.array(F.lit("1.1"), F.lit("1.2"))).alias("COORDINATE"), F.format_number(F.round("value", 0), 0).alias("VALUE"), F.lit("$").alias("UOM"))
    path = folder(spark, "table")
    sinks.to_csv(rows.withColumn("VALUE", F.when(F.col("COORDINATE") != "1.1", F.col("VALUE"))), path)
    return _brief(readers.statcan_table(spark, path, "annual"))


@query(ANNUAL + " SELECT year AS period, 'export' AS flow, 'TOTAL' AS commodity, nation AS reporter, code AS iso3, 'World' AS partner, value FROM a")
def source_comtrade(spark, sf):
    """One answer for each chunk of at most two periods."""
    rows = annual(spark, sf)
    years = [r.year for r in rows.select("year").distinct().orderBy("year").collect()]
    chunk = F.coalesce(*(F.when(F.col("year").isin(c), i) for i, c in enumerate(readers.period_chunks(years, 2))))
    item = [F.col("year").alias("period"), F.lit("Export").alias("flowDesc"), F.lit("TOTAL").alias("cmdCode"), F.lit("All").alias("cmdDesc"), F.col("value").alias("primaryValue"), F.col("nation").alias("reporterDesc"), F.col("code").alias("reporterISO"), F.lit("World").alias("partnerDesc")]
    doc = rows.groupBy(chunk.alias("k")).agg(F.to_json(F.struct(_all(*item).alias("data"))).alias("value"))
    return readers.comtrade(spark, land(doc, "value", "comtrade"))


@query("WITH d AS (SELECT o_orderdate::DATE AS day, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders GROUP BY 1) SELECT 'btc:prices' AS series_id, 'World' AS geography, NULL::VARCHAR AS iso3, strftime(day, '%Y-%m-%d') AS period, value, 'usd' AS unit FROM d")
def source_coingecko(spark, sf):
    days = tables.read(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    pair = F.array(F.unix_date("day").cast("double") * 86_400_000.0, F.col("value"))
    doc = days.groupBy(F.year("day").alias("y")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(pair)).alias("prices"))).alias("value"))
    return _brief(readers.coingecko(spark, land(doc, "value", "gecko"), "btc"), "unit")


@query("SELECT 'USD' AS series_id, 'USD' AS geography, NULL::VARCHAR AS iso3, 'C' || n_nationkey AS period, 1.0::DOUBLE + n_nationkey AS value, 'categorical' AS kind FROM nation")
def source_exchange_rates(spark, sf):
    n = tables.read(spark, sf, "nation")
    rates = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("C"), "n_nationkey"), F.lit(1.0) + F.col("n_nationkey"))))
    doc = n.groupBy().agg(F.to_json(F.struct(F.lit("USD").alias("base_code"), rates.alias("conversion_rates"))).alias("value"))
    return _brief(readers.exchange_rates(spark, land(doc, "value", "rates"))).withColumn("kind", F.lit("categorical"))


@query(MONTHLY + " SELECT 'm2' AS series_id, 'China' AS geography, 'CHN' AS iso3, month AS period, value FROM m WHERE segment = 'BUILDING'")
def source_china_csv(spark, sf):
    """Of equal dates the last row counts."""
    rows = monthly(spark, sf).filter("segment = 'BUILDING'").select(F.explode(F.array(F.struct("month", F.lit(0.0).alias("value")), F.struct("month", "value"))).alias("r")).select("r.*").coalesce(1)
    path = folder(spark, "china")
    sinks.to_csv(rows.select(F.col("month").alias("d"), F.col("value").alias("v")), path)
    return _brief(readers.china_macro(spark, path, "m2", "d", "v", "monthly", ["d", "v"]))


@query(MONTHLY + " SELECT 'm2' AS series_id, 'China' AS geography, 'CHN' AS iso3, month AS period, value FROM m WHERE segment = 'BUILDING'")
def source_registered_json(spark, sf):
    doc = monthly(spark, sf).filter("segment = 'BUILDING'").groupBy().agg(F.to_json(_all(F.col("month").alias("d"), F.col("value").alias("v"))).alias("value"))
    return _brief(readers.registered_json(spark, land(doc, "value", "reg"), "chinamacro", "m2", {"date": "d", "value": "v"}, "monthly", "China", "CHN"))


def _catalogue_files(spark: SparkSession, sf: str) -> dict[str, str]:
    p = tables.read(spark, sf, "part").filter("p_size <= 3")
    row = F.struct(F.when(F.col("p_partkey") % 20 != 0, F.concat(F.lit("P"), "p_partkey")).alias("code"), F.col("p_name").alias("name"), F.lit("annual").alias("frequency"), F.col("p_type").alias("category"), F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: F.concat(F.lit("a"), i.cast("string"))).alias("aliases"))
    files = p.groupBy("p_size").agg(F.to_json(F.struct(F.sort_array(F.collect_list(row)).alias("indicators"))).alias("value"))
    return {f"size{k}": land(files.filter(F.col("p_size") == k), "value", "catalogue") for k in (1, 2, 3)}


_PARTS = "SELECT 'size' || p_size AS provider, 'P' || p_partkey AS code, p_name AS title, 'annual' AS frequency, p_type AS topic, 12 AS aliases FROM part WHERE p_size <= 3 AND p_partkey % 20 <> 0"


@query(_PARTS + " AND p_size = 2")
def source_catalogue_json(spark, sf):
    out = readers.catalogue_json(spark, _catalogue_files(spark, sf)["size2"], "size2")
    return out.select("provider", "code", "title", "frequency", "topic", F.size("aliases").alias("aliases"))


@query(_PARTS)
def source_bulk_catalogue(spark, sf):
    """Three providers' files, and one that is not there."""
    rows, log = readers.bulk_catalogue(spark, _catalogue_files(spark, sf) | {"gone": "file:///nowhere/at/all.json"})
    if [x["source"] for x in log if not x["ok"]] != ["gone"]:
        raise AssertionError(f"unexpected log: {log}")
    return rows.select("provider", "code", "title", "frequency", "topic", F.size("aliases").alias("aliases"))


@query(_PARTS.replace("12 AS aliases", "count(*) OVER ()::BIGINT AS series"))
def catalogue_persisted(spark, sf):
    """A catalogue that is stored as a table and read back."""
    rows, _ = readers.bulk_catalogue(spark, _catalogue_files(spark, sf))
    path = folder(spark, "stored")
    sinks.to_parquet(rows, path, ["provider"])
    back = spark.read.parquet(path)
    return back.select("provider", "code", "title", "frequency", "topic", F.lit(back.count()).cast("long").alias("series"))


@query("SELECT 'ecb' AS provider, 'F' || n_nationkey AS code, n_name AS title FROM nation")
def source_dataflows(spark, sf):
    flow = F.concat(F.lit('<structure:Dataflow id="F'), F.col("n_nationkey").cast("string"), F.lit('"><common:Name xml:lang="en">'), "n_name", F.lit('</common:Name><common:Name xml:lang="fr">x</common:Name></structure:Dataflow>'))
    doc = tables.read(spark, sf, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<r>"), F.array_join(F.collect_list(flow), ""), F.lit("</r>")).alias("value"))
    return readers.dataflows(spark, land(doc, "value", "flows"), "ecb")


@query("SELECT 'unsd' AS provider, 'S' || n_nationkey AS code, n_name AS title FROM nation WHERE n_nationkey <> 3")
def source_sdg_series(spark, sf):
    item = F.struct(F.concat(F.lit(" S"), "n_nationkey").alias("code"), F.when(F.col("n_nationkey") == 3, "").otherwise(F.col("n_name")).alias("description"))
    doc = tables.read(spark, sf, "nation").groupBy().agg(F.to_json(F.collect_list(item)).alias("value"))
    return readers.sdg_series(spark, land(doc, "value", "sdg"))


@query("SELECT c_mktsegment AS design_stratum, c_custkey::DOUBLE AS weight, c_acctbal > 0 AS success FROM customer")
def source_sessions(spark, sf):
    path = folder(spark, "sessions")
    tables.read(spark, sf, "customer").select(F.col("c_mktsegment").alias("design_stratum"), F.col("c_custkey").cast("double").alias("weight"), (F.col("c_acctbal") > 0).alias("success")).write.json(path)
    return readers.sessions(spark, path)


@query(ANNUAL + " SELECT 'N' || region AS series_id, nation AS geography, code AS iso3, year AS period, CASE WHEN year < '1994' THEN NULL ELSE value END AS value, 'annual' AS frequency, NULL::VARCHAR AS unit FROM a")
def source_direct(spark, sf):
    """A table that a caller posts: texts become numbers, what is no number is missing, absent columns are null."""
    from almanack.schema import OBSERVATIONS

    said = F.when(F.col("year") < "1994", F.lit("n/a")).otherwise(F.col("value").cast("string"))
    posted = annual(spark, sf).select(F.lit("p").alias("provider"), F.concat(F.lit("N"), "region").alias("series_id"), F.col("nation").alias("geography"), F.col("code").alias("iso3"), F.col("year").alias("period"), said.alias("value"), F.lit("annual").alias("frequency"), F.lit(1).alias("more"))
    return readers.direct(spark, posted, OBSERVATIONS).select("series_id", "geography", "iso3", "period", "value", "frequency", "unit")


@query(ANNUAL + " SELECT 'TOT' AS series_id, nation AS geography, NULL::VARCHAR AS iso3, year AS period, value FROM a")
def source_points(spark, sf):
    """Blocks of metadata and points, as providers hand them on."""
    block = annual(spark, sf).groupBy("nation").agg(_all(F.col("year").alias("date"), F.col("value").cast("string").alias("value")).alias("data"))
    meta = F.struct(F.lit("TOT").alias("seriesId"), F.lit("i").alias("indicator"), F.col("nation").alias("country"), F.lit("$").alias("unit"), F.lit("annual").alias("frequency"))
    return _brief(readers.points(block.select(meta.alias("metadata"), "data"), "p"))


@query(ANNUAL + " SELECT 'TOT' AS series_id, code AS geography, code AS iso3, year AS period, value FROM a UNION ALL SELECT 'USD', 'USD', NULL, 'EUR', 0.9::DOUBLE")
def source_fetch_all(spark, sf):
    """Three sources in order: one is missing, one fails while it runs, and neither stops the others."""
    path = land(spark.createDataFrame([('{"base_code":"USD","conversion_rates":{"EUR":0.9}}',)], "value string"), "value", "rates")
    years = annual(spark, sf)
    good = readers.canonical(years, "p", series_id=F.lit("TOT"), geography="code", iso3="code", period="year", value="value", frequency=F.lit("annual"))
    broken = lambda: good.withColumn("value", F.raise_error(F.lit("cut off")).cast("double"))
    rows, log = readers.fetch_all([("a", lambda: good), ("gone", lambda: spark.read.parquet("file:///nowhere/at/all")), ("broken", broken), ("rates", lambda: readers.exchange_rates(spark, path))], land=folder(spark, "landed"))
    if [x["ok"] for x in log] != [True, False, False, True]:
        raise AssertionError(f"unexpected log: {log}")
    return _brief(rows)


def _round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return annual(spark, sf).select("nation", "code", "year", "value")


@query(ANNUAL + " SELECT nation, code, year, value FROM a")
def sink_csv(spark, sf):
    path = folder(spark, "csv")
    sinks.to_csv(_round_trip(spark, sf), path)
    return spark.read.option("header", True).schema("nation string, code string, year string, value double").csv(path)


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN '''=' || n_name ELSE n_name END AS name FROM nation")
def sink_safe_csv(spark, sf):
    path = folder(spark, "safe")
    sinks.to_safe_csv(tables.read(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("="), "n_name")).otherwise(F.col("n_name")).alias("name")), path)
    return spark.read.option("header", True).csv(path)


@query(ANNUAL + " SELECT nation, code, year, value FROM a")
def sink_parquet(spark, sf):
    path = folder(spark, "parquet")
    sinks.to_parquet(_round_trip(spark, sf), path, ["code"])
    return spark.read.parquet(path).select("nation", "code", "year", "value")


@query(ANNUAL + " SELECT nation, code, year, value FROM a")
def sink_json_lines(spark, sf):
    path = folder(spark, "lines")
    sinks.to_json_lines(_round_trip(spark, sf), path)
    return spark.read.schema("nation string, code string, year string, value double").json(path)
