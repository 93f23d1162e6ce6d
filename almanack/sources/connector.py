"""Connectors as Spark data sources: ``spark.read.format("almanack")`` and ``spark.readStream.format("almanack")``.

A connector turns one landed payload into canonical observations. Each file of the landing folder is a
partition, read in a task of its own; a payload that cannot be read gives no rows and one line in the log, and
nothing else stops. As a stream, files are taken in the order of their names, a batch's offsets being the last
name taken, so a restart goes on where the checkpoint says.

Options: ``path`` (a folder that driver and executors mount), ``connector`` (a name of ``CONNECTORS``), ``log`` (a
folder for failures; without it a failure is an error), ``series_id`` for connectors whose payload does not say.
"""

from __future__ import annotations

import csv
import io
import json
import os
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SHAPE = "provider string, series_id string, geography string, iso3 string, period string, value double, unit string, frequency string, payload string"

#: What a connector gives for each observation: (series_id, geography, iso3, period, value, unit, frequency).
Row = tuple[str | None, str | None, str | None, str | None, float | None, str | None, str | None]
Connector = Callable[[str, dict], Iterator[Row]]


def _number(raw: object) -> float | None:
    text = str(raw).strip() if raw is not None else ""
    return None if text.lower() in ("", ".", "nan", "null", "none", "n/a", "na", "-") else float(text)


def world_bank(text: str, options: dict) -> Iterator[Row]:
    """``[page, [{indicator, country, countryiso3code, date, value}]]``."""
    for r in json.loads(text)[1] or []:
        yield r["indicator"]["id"], r["country"]["value"], r.get("countryiso3code"), r["date"], _number(r.get("value")), r.get("unit") or None, "annual"


def fred(text: str, options: dict) -> Iterator[Row]:
    """``{observations: [{date, value}]}`` of the series in the options."""
    for r in json.loads(text)["observations"]:
        yield options.get("series_id"), "United States", "USA", r["date"], _number(r["value"]), None, None


def sdmx_csv(text: str, options: dict) -> Iterator[Row]:
    """A table with TIME_PERIOD and OBS_VALUE; the series' code joins all other dimensions but REF_AREA."""
    for r in csv.DictReader(io.StringIO(text)):
        key = [v for k, v in r.items() if k not in ("REF_AREA", "TIME_PERIOD", "OBS_VALUE", "UNIT_MEASURE")]
        yield ".".join(key), r.get("REF_AREA"), r.get("REF_AREA"), r["TIME_PERIOD"], _number(r["OBS_VALUE"]), r.get("UNIT_MEASURE"), r.get("FREQ")


#: The connectors there are, by name; a caller may add its own before reading.
CONNECTORS: dict[str, Connector] = {"world_bank": world_bank, "fred": fred, "sdmx_csv": sdmx_csv}


class Payload(InputPartition):
    def __init__(self, name: str) -> None:
        super().__init__(name)
        self.name = name


class _Landed:
    """What the reader of a table and that of a stream share."""

    def __init__(self, options: dict, connector: Connector, name: str) -> None:
        self.options, self.connector, self.name = dict(options), connector, name
        self.folder = self.options["path"].removeprefix("file://")

    def names(self) -> list[str]:
        return sorted(n for n in os.listdir(self.folder) if not n.startswith((".", "_")))

    def rows(self, partition: Payload) -> Iterator[tuple]:
        try:
            with open(os.path.join(self.folder, partition.name), encoding="utf-8") as f:
                found = [(self.name, *row, partition.name) for row in self.connector(f.read(), self.options)]  # one payload, whole or not at all
        except Exception as e:  # noqa: BLE001  one payload must not stop the others
            if "log" not in self.options:
                raise
            log = self.options["log"].removeprefix("file://")
            os.makedirs(log, exist_ok=True)
            with open(os.path.join(log, f"{uuid.uuid4().hex}.json"), "w", encoding="utf-8") as f:
                f.write(json.dumps({"payload": partition.name, "connector": self.name, "error": f"{type(e).__name__}: {e}"[:500]}) + "\n")
            return
        yield from found


class TableReader(DataSourceReader):
    def __init__(self, landed: _Landed) -> None:
        self.landed = landed

    def partitions(self) -> list[Payload]:
        return [Payload(n) for n in self.landed.names()]

    def read(self, partition: Payload) -> Iterator[tuple]:
        if isinstance(partition, Payload):  # an empty folder has no partition
            yield from self.landed.rows(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, landed: _Landed) -> None:
        self.landed = landed

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(self.landed.names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Payload]:
        return [Payload(n) for n in self.landed.names() if start["after"] < n <= end["after"]]

    def read(self, partition: Payload) -> Iterator[tuple]:
        yield from self.landed.rows(partition)

    def commit(self, end: dict) -> None:
        """Payloads stay; the offsets alone say what was taken."""


class Landed(DataSource):
    """The data source ``almanack``."""

    @classmethod
    def name(cls) -> str:
        return "almanack"

    def schema(self) -> str:
        return SHAPE

    def _landed(self) -> _Landed:
        name = self.options.get("connector", "")
        if name not in CONNECTORS:
            raise ValueError(f"unknown connector: {name!r}; there are {sorted(CONNECTORS)}")
        return _Landed(self.options, CONNECTORS[name], name)

    def reader(self, schema) -> TableReader:  # noqa: ANN001
        return TableReader(self._landed())

    def streamReader(self, schema) -> StreamReader:  # noqa: ANN001
        return StreamReader(self._landed())


def register(spark: SparkSession) -> None:
    """Make ``format("almanack")`` known to the session."""
    spark.dataSource.register(Landed)


def failures(spark: SparkSession, log: str) -> DataFrame:
    """(payload, connector, error) of a log; a payload that was read again after a failure of its task may stand twice."""
    return spark.read.schema("payload string, connector string, error string").json(log).distinct()
