"""The data source: partitions, failures, and a stream that goes on where it stopped."""

import json

import pytest

from almanack.sources import connector


def page(*rows):
    return json.dumps([{"page": 1}, [{"indicator": {"id": "GDP"}, "country": {"value": "Peru"}, "countryiso3code": "PER", "date": y, "value": v} for y, v in rows]])


@pytest.fixture
def landing(spark, tmp_path):
    connector.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(page(("2001", 1.5), ("2002", None)))
    (tmp_path / "in/b.json").write_text("<html>busy</html>")
    (tmp_path / "in/c.json").write_text(page(("2003", 2.5)))
    (tmp_path / "in/_SUCCESS").write_text("")
    return tmp_path


def test_a_table_has_a_partition_a_payload_and_logs_failures(spark, landing):
    options = {"path": f"file://{landing}/in", "connector": "world_bank", "log": f"file://{landing}/log"}
    df = spark.read.format("almanack").options(**options).load()
    assert df.rdd.getNumPartitions() == 3
    assert sorted((r.series_id, r.iso3, r.period, r.value, r.payload) for r in df.collect()) == [("GDP", "PER", "2001", 1.5, "a.json"), ("GDP", "PER", "2002", None, "a.json"), ("GDP", "PER", "2003", 2.5, "c.json")]
    bad = connector.failures(spark, options["log"]).collect()
    assert [(r.payload, r.connector) for r in bad] == [("b.json", "world_bank")] and "JSONDecodeError" in bad[0].error
    options.pop("log")
    with pytest.raises(Exception, match="JSONDecodeError"):
        spark.read.format("almanack").options(**options).load().collect()


def test_connectors_by_name(spark, landing):
    read = lambda **o: spark.read.format("almanack").options(**o).load()
    (landing / "fred").mkdir()
    (landing / "fred/x.json").write_text(json.dumps({"observations": [{"date": "2001-01-01", "value": "3.5"}, {"date": "2001-02-01", "value": "."}]}))
    assert [(r.series_id, r.value) for r in read(path=f"{landing}/fred", connector="fred", series_id="CPI").orderBy("period").collect()] == [("CPI", 3.5), ("CPI", None)]
    (landing / "csv").mkdir()
    (landing / "csv/x.csv").write_text("FREQ,REF_AREA,ITEM,TIME_PERIOD,OBS_VALUE\nM,PER,CPI,2001-01,7\n")
    assert tuple(read(path=f"{landing}/csv", connector="sdmx_csv").select("series_id", "iso3", "value", "frequency").first()) == ("M.CPI", "PER", 7.0, "M")
    (landing / "none").mkdir()
    assert read(path=f"{landing}/none", connector="fred").count() == 0
    with pytest.raises(Exception, match="unknown connector"):
        read(path=f"{landing}/in", connector="nowhere").count()


def test_a_stream_takes_each_payload_once(spark, landing):
    def run():
        rows = spark.readStream.format("almanack").options(path=f"{landing}/in", connector="world_bank", log=f"{landing}/log").load()
        rows.writeStream.format("parquet").option("checkpointLocation", f"{landing}/checkpoint").trigger(availableNow=True).start(f"{landing}/out").awaitTermination()
        return sorted((r.payload, r.period) for r in spark.read.parquet(f"{landing}/out").collect())

    first = [("a.json", "2001"), ("a.json", "2002"), ("c.json", "2003")]
    assert run() == first
    (landing / "in/d.json").write_text(page(("2004", 4.0)))
    assert run() == [*first, ("d.json", "2004")]
    assert run() == [*first, ("d.json", "2004")]
