"""Single documents of any size: executors write the parts, which are then joined in order, byte by byte, inside the JVM.

A part is what one partition holds, so the order of a sorted table is kept. Neither Python nor the
driver's memory holds more than a buffer of a part. A path without a scheme is in the session's default
store, as it is for Spark's own writers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from pathlib import Path

import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.sources.landing import folder, keep

BUFFER = 1 << 20


def _store(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The Hadoop file system of a path, and the path; local files get no checksum files beside them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return (store.getRawFileSystem() if store.getScheme() == "file" else store), place


def part_files(spark: SparkSession, path: str) -> list[str]:
    """The files that Spark wrote into a folder, in the order of their partitions; none if there is no such folder."""
    store, place = _store(spark, path)
    found = [str(s.getPath()) for s in store.listStatus(place)] if store.exists(place) else []
    number = lambda p: (int(p.split("-")[1]), p)
    return [p for _, p in sorted((number(p.rsplit("/", 1)[1]), p) for p in found if p.rsplit("/", 1)[1].startswith("part-"))]


class Document:
    """A file, or a zip archive of entries, to which texts and folders of parts are added one after another."""

    def __init__(self, spark: SparkSession, path: str, zipped: bool = False) -> None:
        self.spark, self.jvm = spark, spark._jvm
        store, place = _store(spark, path)
        raw = store.create(place, True)
        self.out = self.jvm.java.util.zip.ZipOutputStream(raw) if zipped else raw
        self.digest = None

    def __enter__(self) -> Document:
        return self

    def __exit__(self, *failure: object) -> None:
        self.out.close()

    def entry(self, name: str, write: Callable[[], None]) -> str:
        """A zip entry that ``write`` fills; its SHA-256."""
        self.digest = self.jvm.java.security.MessageDigest.getInstance("SHA-256")
        self.out.putNextEntry(self.jvm.java.util.zip.ZipEntry(name))
        write()
        self.out.closeEntry()
        return bytes(self.digest.digest()).hex()

    def text(self, text: str) -> None:
        self._copy(self.jvm.java.io.ByteArrayInputStream(text.encode()))

    def parts(self, path: str, skip: int = 0) -> None:
        """All bytes of a folder's parts but the first ``skip``, which have to be in one part."""
        for part in part_files(self.spark, path):
            store, place = _store(self.spark, part)
            if store.getFileStatus(place).getLen():
                source = store.open(place)
                source.seek(skip)
                skip = 0
                self._copy(source)

    def _copy(self, source: JavaObject) -> None:
        if self.digest is not None:
            source = self.jvm.java.security.DigestInputStream(source, self.digest)
        try:
            self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, self.out, BUFFER, False)
        finally:
            source.close()


def text_parts(lines: DataFrame) -> str:
    """A folder with a table's one column of texts, a line each."""
    path = folder(lines.sparkSession, "text")
    lines.write.text(path)
    return path


def json_parts(df: DataFrame) -> str:
    """A folder with one JSON object a row, each after a comma. Dates are ISO texts; NaN and infinities are texts."""
    return text_parts(df.select(F.concat(F.lit(","), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}))))


def csv_parts(df: DataFrame) -> str:
    """A folder of CSV without headers: quotes doubled, blanks kept, nulls empty."""
    path = folder(df.sparkSession, "csv")
    df.write.options(header=False, escape='"', nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def numbered_parts(df: DataFrame, line: Callable[[DataFrame], Column], size: int, name: str = "lines") -> tuple[str, int]:
    """A table as texts in parts for pages of ``size`` rows, in its order: the folder of ``page=0``, ``page=1``..., and how many.

    The table is computed and stored once; ``line`` makes the column of texts for the stored one. Rows are counted
    by partition; what the partitions before hold is added to the place inside each.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    plain = [F.col(f"`{c}`").cast("string").alias(c) if kind == "void" else F.col(f"`{c}`") for c, kind in df.dtypes]
    stored = keep(df.select(*plain, F.spark_partition_id().alias("_part"), inside.alias("_at")), name)
    sizes = {r["_part"]: r["n"] for r in stored.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number a partition
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    path = folder(df.sparkSession, name)
    if total:
        starts = df.sparkSession.createDataFrame(before, "_part int, _before long")
        at = F.col("_before") + F.col("_at")
        lines = stored.select("_part", "_at", line(stored.drop("_part", "_at")).alias("value"))
        paged = lines.join(starts, "_part").select(F.floor(at / size).cast("int").alias("page"), at.alias("_at"), "value")
        paged.orderBy("page", "_at").select("page", "value").write.partitionBy("page").text(path)
    return path, -(-total // size)


def write_arrow(df: DataFrame, path: str) -> None:
    """An Arrow file, batch after batch: executors make the batches, the driver holds those of one part at a time."""
    spark, schema = df.sparkSession, df.limit(0).toArrow().schema

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "batch": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    stored = folder(spark, "arrow")
    df.mapInArrow(pack, "n long, batch binary").write.parquet(stored)
    with pa.OSFile(str(Path(path)), "wb") as file, pa.ipc.new_file(file, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        for part in part_files(spark, stored):
            for row in spark.read.schema("n long, batch binary").parquet(part).orderBy("n").toLocalIterator():
                out.write_table(pa.ipc.open_stream(row.batch).read_all().cast(schema))
