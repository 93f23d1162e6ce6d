"""Provider payloads to canonical observations.

Payloads are files that a fetcher has landed (JSON, CSV, XML); every reader is a plan over
``spark.read``, so large landings are split and pruned as any other. ``canonical`` is the one way
into the observation schema.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanack.functions import periods
from almanack.functions.values import numeric_parse, sanitise
from almanack.operators import cube
from almanack.operators.dataset import union_all
from almanack.operators.derive import best_slice
from almanack.sources import landing

_NAMES = ("provider", "series_id", "geography", "iso3", "period", "value", "unit", "frequency", "status")


def canonical(rows: DataFrame, provider: str, **columns: Column | str | None) -> DataFrame:
    """Columns of the canonical schema; periods take the label of their frequency, values are sanitised.

    ``obs_seq`` is the order in which files and rows come, unless the rows have one.
    """
    given = {k: (F.col(v) if isinstance(v, str) else v) for k, v in columns.items() if v is not None}
    frequency = periods.coerce_frequency(given.get("frequency", F.lit(None)))
    seq = given.pop("obs_seq", F.monotonically_increasing_id())
    out = {"provider": F.lit(provider)} | {k: given.get(k, F.lit(None)).cast("string") for k in _NAMES if k not in ("provider", "value", "frequency", "period")}
    out |= {"frequency": frequency, "period": periods.canonical_period(given["period"].cast("string"), frequency), "value": sanitise(given["value"])}
    return rows.select(*(out[n].alias(n) for n in _NAMES), seq.cast("long").alias("obs_seq"))


def direct(spark: SparkSession, rows: list[dict] | DataFrame, schema: T.StructType) -> DataFrame:
    """Observations that a caller posts, as a list or a table; columns of a table that are missing are null, values that do not fit their type too."""
    if not isinstance(rows, DataFrame):
        return spark.createDataFrame(rows, schema)
    have = set(rows.columns)
    return rows.select(*((F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def world_bank(spark: SparkSession, path: str) -> DataFrame:
    """Pages ``[header, [points]]`` as the service returns them; null points are dropped."""
    point = "struct<indicator:struct<id:string,value:string>,country:struct<id:string,value:string>,countryiso3code:string,date:string,value:string,unit:string>"
    raw = spark.read.option("wholetext", True).text(path)
    points = F.from_json(F.get_json_object("value", "$[1]"), f"array<{point}>")
    rows = raw.select(F.explode(points).alias("p")).select("p.*").filter("value is not null")
    frequency = F.when(F.col("date").contains("Q"), "quarterly").when(F.col("date").contains("M"), "monthly").otherwise("annual")
    label = F.replace(F.col("date"), F.lit("M"), F.lit("-"))
    return canonical(rows, "worldbank", series_id="indicator.id", geography="country.value", iso3="countryiso3code", period=label, value="value", unit="unit", frequency=frequency)


def fred(spark: SparkSession, path: str, series_id: str, unit: str | None = None, frequency: str = "monthly") -> DataFrame:
    """``{observations: [{date, value}]}``; a dot or nothing stays as a null observation."""
    raw = spark.read.schema("observations array<struct<date:string,value:string>>").option("multiLine", True).json(path)
    rows = raw.select(F.explode("observations").alias("o")).select("o.*")
    return canonical(rows, "fred", series_id=F.lit(series_id), geography=F.lit("United States"), iso3=F.lit("USA"), period="date", value="value", unit=F.lit(unit), frequency=F.lit(frequency))


def fred_units(rows: DataFrame, units: str, per_year: int, group: list[str]) -> DataFrame:
    """The service's own transformations: lin, chg, pch, pc1, log."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy("period")
    v, before, year = F.col("value"), F.lag("value", 1).over(w), F.lag("value", per_year).over(w)
    how = {"lin": v, "chg": v - before, "pch": F.try_divide(v - before, before) * 100, "pc1": F.try_divide(v - year, year) * 100, "log": F.when(v > 0, F.log(v))}
    return rows.withColumn("value", how[units])


def imf_datamapper(spark: SparkSession, path: str) -> DataFrame:
    """``{values: {indicator: {country: {year: value}}}}``."""
    raw = spark.read.schema("values map<string,map<string,map<string,double>>>").option("multiLine", True).json(path)
    rows = raw.select(F.explode("values").alias("series_id", "c")).select("series_id", F.explode("c").alias("iso3", "y")).select("series_id", "iso3", F.explode("y").alias("period", "value")).filter("value is not null")
    return canonical(rows, "imf", series_id="series_id", geography="iso3", iso3="iso3", period="period", value="value", frequency=F.lit("annual"))


def sdmx_xml(spark: SparkSession, path: str, provider: str, country: str = "COUNTRY", series: str = "INDICATOR") -> DataFrame:
    """Structure-specific SDMX: attributes of Series and Obs."""
    obs = T.ArrayType(T.StructType([T.StructField("_TIME_PERIOD", T.StringType()), T.StructField("_OBS_VALUE", T.StringType()), T.StructField("_OBS_STATUS", T.StringType())]))
    schema = T.StructType([*(T.StructField(f"_{c}", T.StringType()) for c in (country, series, "FREQ", "UNIT")), T.StructField("Obs", obs)])
    rows = spark.read.format("xml").option("rowTag", "Series").schema(schema).load(path).select("*", F.explode("Obs").alias("o")).filter("o._OBS_VALUE is not null")
    label = F.left(periods.period_to_iso_date(F.col("o._TIME_PERIOD")), F.lit(10))
    return canonical(rows, provider, series_id=f"_{series}", geography=f"_{country}", iso3=f"_{country}", period=label, value="o._OBS_VALUE", unit="_UNIT", frequency=periods.frequency_label(F.col("_FREQ")), status="o._OBS_STATUS")


#: SDMX columns that are no dimensions.
NO_DIMENSION = ("TIME_PERIOD", "OBS_VALUE", "OBS_STATUS", "UNIT_MULT", "DECIMALS", "DATAFLOW", "STRUCTURE", "STRUCTURE_ID", "ACTION", "LAST_UPDATE")


def sdmx_csv(spark: SparkSession, path: str, provider: str, country: str = "COUNTRY", dimensions: list[str] | None = None) -> DataFrame:
    """One series for each key of dimensions; values are scaled by UNIT_MULT where it is given."""
    raw = spark.read.option("header", True).csv(path)
    dims = dimensions or [c for c in raw.columns if c not in NO_DIMENSION]
    power = F.coalesce(F.col("UNIT_MULT").try_cast("int"), F.lit(0)) if "UNIT_MULT" in raw.columns else F.lit(0)
    value = F.col("OBS_VALUE").try_cast("double") * F.pow(F.lit(10.0), power)
    freq = periods.frequency_label(F.col("FREQ")) if "FREQ" in raw.columns else periods.frequency_label(periods.frequency_from_period(F.col("TIME_PERIOD")))
    place = F.col(country) if country in raw.columns else F.lit(None)
    rows = raw.filter(F.col("OBS_VALUE").try_cast("double").isNotNull())
    return canonical(rows, provider, series_id=F.concat_ws(".", *(F.col(d) for d in dims)), geography=place, iso3=place, period=periods.period_to_iso_date(F.col("TIME_PERIOD")), value=value, frequency=freq, status=F.col("OBS_STATUS") if "OBS_STATUS" in raw.columns else None)


def json_stat(spark: SparkSession, path: str, provider: str = "eurostat", geo: str = "geo", time: str = "time") -> DataFrame:
    """A JSON-stat cube: flat offsets to coordinates to codes, all by arithmetic; nulls are dropped."""
    dimension = "map<string,struct<category:struct<`index`:map<string,int>,label:map<string,string>>>>"
    raw = spark.read.schema(f"id array<string>, size array<int>, value map<string,double>, dimension {dimension}").option("multiLine", True).json(path)
    cells = cube.decode(raw.select("id", F.col("size").alias("sizes"), F.col("value").alias("values"), "dimension"))
    inverse = lambda name: F.map_from_entries(F.transform(F.map_entries(F.col("dimension")[name]["category"]["index"]), lambda e: F.struct(e["value"], e["key"])))
    code = lambda name: inverse(name)[F.get(F.col("coords"), F.array_position("id", name).cast("int") - 1).cast("int")]
    place = code(F.lit(geo))
    others = F.filter("id", lambda d: ~d.isin(geo, time))
    key = F.array_join(F.transform(others, lambda d: F.coalesce(inverse(d)[F.get(F.col("coords"), F.array_position(F.col("id"), d).cast("int") - 1).cast("int")], F.lit(""))), ".")
    label = F.coalesce(F.col("dimension")[geo]["category"]["label"][place], place)
    period = code(F.lit(time))
    return canonical(cells, provider, series_id=key, geography=label, iso3=place, period=periods.period_to_iso_date(period), value="value", frequency=periods.frequency_label(periods.frequency_from_period(period)))


def sdmx_json(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """``dataSets[].series{key -> observations{index -> [value, ...]}}`` with dimension lists by place."""
    dims = "array<struct<id:string,values:array<struct<id:string,name:string>>>>"
    schema = f"dataSets array<struct<series:map<string,struct<observations:map<string,array<double>>>>>>, structure struct<dimensions:struct<series:{dims},observation:{dims}>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = raw.select("structure", F.explode("dataSets").alias("d")).select("structure", F.explode("d.series").alias("key", "s")).select("structure", "key", F.explode("s.observations").alias("at", "o"))
    places = F.transform(F.split("key", ":"), lambda x: x.cast("int"))
    codes = F.transform(F.arrays_zip(F.col("structure.dimensions.series").alias("d"), places.alias("p")), lambda z: F.struct(z["d"]["id"].alias("id"), F.get(z["d"]["values"], z["p"]).alias("v")))
    area = F.get(F.filter(codes, lambda c: c["id"].isin("REF_AREA", "BORROWERS_CTY", "COUNTRY", "LOCATION")), F.lit(0))["v"]
    freq = F.get(F.filter(codes, lambda c: c["id"].isin("FREQ", "FREQUENCY")), F.lit(0))["v"]["id"]
    period = F.get(F.get(F.col("structure.dimensions.observation"), F.lit(0))["values"], F.col("at").cast("int"))["id"]
    rows = rows.select(F.array_join(F.transform(codes, lambda c: c["v"]["id"]), ".").alias("series_id"), area["name"].alias("geography"), area["id"].alias("iso3"), period.alias("period"), F.get("o", F.lit(0)).alias("value"), F.coalesce(freq, periods.frequency_from_period(period)).alias("freq")).filter("value is not null")
    return canonical(rows, provider, series_id="series_id", geography="geography", iso3="iso3", period=periods.period_to_iso_date(F.col("period")), value="value", frequency=periods.frequency_label(F.col("freq")))


def statcan_vectors(spark: SparkSession, path: str) -> DataFrame:
    """WDS answers: ``[{object: {vectorId, frequencyCode, vectorDataPoint: [{refPer, value, scalarFactorCode}]}}]``."""
    point = "struct<refPer:string,value:string,scalarFactorCode:int>"
    raw = spark.read.schema(f"object struct<vectorId:long,frequencyCode:int,vectorDataPoint:array<{point}>>").option("multiLine", True).json(path)
    rows = raw.select("object.vectorId", "object.frequencyCode", F.explode("object.vectorDataPoint").alias("p"))
    frequency = F.when(F.col("frequencyCode") == 6, "monthly").when(F.col("frequencyCode") == 9, "quarterly").when(F.col("frequencyCode") == 12, "annual").when(F.col("frequencyCode") == 1, "daily").otherwise("unknown")
    value = F.col("p.value").try_cast("double") * F.pow(F.lit(10.0), F.coalesce("p.scalarFactorCode", F.lit(0)))
    return canonical(rows, "statscan", series_id=F.concat(F.lit("v"), "vectorId"), geography=F.lit("Canada"), iso3=F.lit("CAN"), period="p.refPer", value=value, frequency=frequency)


def statcan_table(spark: SparkSession, path: str, frequency: str) -> DataFrame:
    """A whole table as CSV; of several coordinates the first one with data wins, in the file's order."""
    raw = spark.read.option("header", True).csv(path).withColumn("seq", F.monotonically_increasing_id()).withColumn("v", numeric_parse(F.col("VALUE")))
    first = raw.filter("v is not null").groupBy("GEO").agg(F.min_by("COORDINATE", "seq").alias("COORDINATE"))
    rows = raw.join(first, ["GEO", "COORDINATE"], "left_semi")
    return canonical(rows, "statscan", series_id="COORDINATE", geography="GEO", period="REF_DATE", value="v", unit="UOM", frequency=F.lit(frequency), obs_seq="seq")


def comtrade(spark: SparkSession, path: str) -> DataFrame:
    """Trade records: (period, flow, commodity, reporter, partner, value)."""
    schema = "data array<struct<period:string,flowDesc:string,cmdCode:string,cmdDesc:string,primaryValue:double,reporterDesc:string,reporterISO:string,partnerDesc:string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = raw.select(F.explode("data").alias("d")).select("d.*")
    return rows.select("period", F.lower("flowDesc").alias("flow"), F.col("cmdCode").alias("commodity"), F.col("reporterDesc").alias("reporter"), F.col("reporterISO").alias("iso3"), F.col("partnerDesc").alias("partner"), F.col("primaryValue").alias("value"))


def coingecko(spark: SparkSession, path: str, coin: str, metric: str = "prices", currency: str = "usd") -> DataFrame:
    """``{prices|market_caps|total_volumes: [[epoch ms, value]]}``."""
    raw = spark.read.schema(f"{metric} array<array<double>>").option("multiLine", True).json(path)
    rows = raw.select(F.explode(metric).alias("p")).select(F.get("p", F.lit(0)).cast("long").alias("ms"), F.get("p", F.lit(1)).alias("value"))
    day = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd")
    return canonical(rows, "coingecko", series_id=F.lit(f"{coin}:{metric}"), geography=F.lit("World"), period=day, value="value", unit=F.lit(currency), frequency=F.lit("daily"), obs_seq="ms")


def exchange_rates(spark: SparkSession, path: str) -> DataFrame:
    """``{base_code, conversion_rates: {code: rate}}``: the currency is the period of a categorical series."""
    raw = spark.read.schema("base_code string, conversion_rates map<string,double>").option("multiLine", True).json(path)
    rows = raw.select("base_code", F.explode("conversion_rates").alias("currency", "value"))
    return canonical(rows, "exchangerate", series_id="base_code", geography="base_code", period="currency", value="value", unit="currency", frequency=F.lit("categorical"))


def china_macro(spark: SparkSession, path: str, series_id: str, date: str, value: str, frequency: str, columns: list[str]) -> DataFrame:
    """A CSV snapshot whose columns must be as registered; of equal dates the last row wins."""
    raw = spark.read.option("header", True).csv(path)
    if gone := [c for c in columns if c not in raw.columns]:
        raise ValueError(f"the source's columns have changed; missing: {gone}")
    rows = raw.withColumn("seq", F.monotonically_increasing_id()).groupBy(date).agg(F.max_by(value, "seq").alias(value), F.max("seq").alias("seq"))
    return canonical(rows, "chinamacro", series_id=F.lit(series_id), geography=F.lit("China"), iso3=F.lit("CHN"), period=date, value=value, frequency=F.lit(frequency), obs_seq="seq")


def catalogue_json(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """``{indicators: [{code|id, name, ...}]}``; rows without code or name are left out."""
    row = "struct<code:string,id:string,name:string,description:string,unit:string,frequency:string,category:string,source:string,last_updated:string,aliases:array<string>>"
    raw = spark.read.schema(f"indicators array<{row}>").option("multiLine", True).json(path)
    rows = raw.select(F.explode("indicators").alias("i")).select("i.*")
    code, name = F.nullif(F.trim(F.coalesce("code", "id")), F.lit("")), F.nullif(F.trim("name"), F.lit(""))
    out = rows.select(F.lit(provider).alias("provider"), code.alias("code"), name.alias("title"), "description", "unit", periods.coerce_frequency(F.col("frequency")).alias("frequency"), F.col("category").alias("topic"), "source", "last_updated", F.slice("aliases", 1, 12).alias("aliases"))
    return out.filter("code is not null and title is not null")


def dataflows(spark: SparkSession, path: str, provider: str, tag: str = "structure:Dataflow", name_tag: str = "common:Name") -> DataFrame:
    """SDMX dataflow lists in XML: (provider, code, title)."""
    schema = T.StructType([T.StructField("_id", T.StringType()), T.StructField(name_tag, T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_xml:lang", T.StringType())])))])
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return rows.select(F.lit(provider).alias("provider"), F.col("_id").alias("code"), F.get(F.col(f"`{name_tag}`"), F.lit(0))["_VALUE"].alias("title")).filter("code is not null")


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """Certification sessions, one JSON object a line."""
    return spark.read.schema("design_stratum string, weight double, success boolean").json(path)


def points(rows: DataFrame, provider: str) -> DataFrame:
    """Provider blocks ``struct<metadata, data array<struct<date, value>>>``, flattened; an empty block gives no row."""
    flat = rows.select("metadata.*", F.explode("data").alias("d"))
    return canonical(flat, provider, series_id=F.coalesce("seriesId", "indicator"), geography="country", period="d.date", value="d.value", unit="unit", frequency="frequency")


def ladder(first: DataFrame, more: DataFrame, key: str = "iso3") -> DataFrame:
    """A batch answer, completed by a finer one for the keys that the batch lacks altogether."""
    return first.unionByName(more.join(first.select(key).distinct(), key, "left_anti").select(first.columns))


def world_bank_sources(spark: SparkSession, path: str) -> DataFrame:
    """The source endpoint: ``{source: {data: [{variable: [{concept, id, value}], value}]}}``; times are ``YR2000``."""
    item = "struct<variable:array<struct<concept:string,id:string,value:string>>,value:string>"
    raw = spark.read.schema(f"source struct<data:array<{item}>>").option("multiLine", True).json(path)
    rows = raw.select(F.explode("source.data").alias("d")).select("d.*").filter("value is not null")
    part = lambda name, field: F.get(F.filter("variable", lambda v: F.lower(v["concept"]) == name), F.lit(0))[field]
    return canonical(rows, "worldbank", series_id=part("series", "id"), geography=part("country", "value"), iso3=part("country", "id"), period=F.regexp_replace(part("time", "id"), "^YR", ""), value="value", frequency=F.lit("annual"))


def statcan_coordinates(spark: SparkSession, path: str, members: dict[str, str] | None = None) -> DataFrame:
    """WDS answers by coordinate; ``members`` names the geography of a coordinate's first member (provinces)."""
    point = "struct<refPer:string,value:string,scalarFactorCode:int>"
    raw = spark.read.schema(f"object struct<productId:long,coordinate:string,frequencyCode:int,vectorDataPoint:array<{point}>>").option("multiLine", True).json(path)
    rows = raw.select("object.*").select("productId", "coordinate", "frequencyCode", F.explode("vectorDataPoint").alias("p")).filter("p.value is not null")
    frequency = F.when(F.col("frequencyCode") == 6, "monthly").when(F.col("frequencyCode") == 9, "quarterly").when(F.col("frequencyCode") == 12, "annual").when(F.col("frequencyCode") == 1, "daily").otherwise("unknown")
    value = F.col("p.value").try_cast("double") * F.pow(F.lit(10.0), F.coalesce("p.scalarFactorCode", F.lit(0)))
    first = F.substring_index("coordinate", ".", 1)
    place = F.coalesce(F.create_map(*(F.lit(x) for kv in members.items() for x in kv))[first], F.lit("Canada")) if members else F.lit("Canada")
    return canonical(rows, "statscan", series_id=F.concat_ws(":", "productId", "coordinate"), geography=place, iso3=F.lit("CAN"), period="p.refPer", value=value, frequency=frequency)


def period_chunks(periods_: list[str], most: int = 12) -> list[list[str]]:
    """The requests that a list of periods takes, each of at most ``most``."""
    return [periods_[a : a + most] for a in range(0, len(periods_), most)]


def preferred_series(rows: DataFrame, dimensions: list[str], preferences: dict[str, str]) -> DataFrame:
    """The rows of the series whose key (members joined by dots) fits the preferences best: 1000 for each, and its points."""
    member = lambda d: F.element_at(F.split("series_id", r"\."), dimensions.index(d) + 1)
    best = best_slice(rows, ["series_id"], [member(d) == v for d, v in preferences.items() if d in dimensions]).first()
    return rows.filter(F.col("series_id") == best.series_id) if best else rows.filter("false")


def registered_json(spark: SparkSession, path: str, provider: str, series_id: str, fields: dict[str, str], frequency: str, geography: str, iso3: str) -> DataFrame:
    """Records ``[{...}]`` whose fields for date and value are registered; a missing field is an error, as the source has changed."""
    raw = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    if gone := [f for f in fields.values() if f not in raw.columns]:
        raise ValueError(f"the source's fields have changed; missing: {gone}")
    rows = raw.withColumn("seq", F.monotonically_increasing_id()).groupBy(F.col(f"`{fields['date']}`").alias("d")).agg(F.max_by(F.col(f"`{fields['value']}`"), "seq").alias("v"), F.max("seq").alias("seq"))
    return canonical(rows, provider, series_id=F.lit(series_id), geography=F.lit(geography), iso3=F.lit(iso3), period="d", value="v", frequency=F.lit(frequency), obs_seq="seq")


def sdg_series(spark: SparkSession, path: str) -> DataFrame:
    """The list of a JSON catalogue of series, ``[{code, description}]``: (provider, code, title)."""
    raw = spark.read.schema("code string, description string").option("multiLine", True).json(path)
    return raw.select(F.lit("unsd").alias("provider"), F.trim("code").alias("code"), F.trim("description").alias("title")).filter("code <> '' and title <> ''")


def bulk_catalogue(spark: SparkSession, files: dict[str, str]) -> tuple[DataFrame | None, list[dict]]:
    """Catalogue files of many providers in one table, last of equal codes winning; a provider that fails is logged."""
    from almanack.operators.search import build_catalogue

    rows, log = fetch_all([(name, lambda n=name, p=path: catalogue_json(spark, p, n).withColumn("seq", F.monotonically_increasing_id())) for name, path in files.items()], apart=True)
    good = [r for r in rows if r is not None]
    return (build_catalogue(reduce(DataFrame.unionByName, good), "seq", upsert=True).drop("seq") if good else None), log


def fetch_all(jobs: list[tuple[str, Callable[[], DataFrame]]], apart: bool = False, land: str | None = None) -> tuple[DataFrame | list[DataFrame | None] | None, list[dict]]:
    """(name, function returning a DataFrame) in order: the union of those that work (or each ``apart``), and a log of all.

    Plans are lazy, so each source is run by an action of its own: it is written whole to ``land``, or else to a new
    folder that the cluster shares, and read back, so whatever fails in it is its own failure.
    """
    log, parts = [], []
    for n, (name, job) in enumerate(jobs):
        try:
            part = job()
            path = f"{land}/{n:05d}" if land else landing.folder(part.sparkSession, "fetched")
            part.write.mode("overwrite").parquet(path)
            parts.append(part.sparkSession.read.schema(part.schema).parquet(path))
            log.append({"source": name, "ok": True, "error": None})
        except Exception as e:  # noqa: BLE001  one source must not stop the others
            parts.append(None)
            log.append({"source": name, "ok": False, "error": str(e)[:500]})
    if apart:
        return parts, log
    good = [p for p in parts if p is not None]
    return (union_all(good) if good else None), log
