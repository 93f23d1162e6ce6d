"""Shared working storage for intermediate tables.

Intermediates go to the folder that the session names in ``spark.checkpoint.dir``: every
executor and the driver see it, so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def workdir(spark: SparkSession) -> str:
    """A folder of this driver's own below ``spark.checkpoint.dir``, removed at exit.

    Only a ``local[...]`` master without that setting (tests) gets a temporary folder; on a
    cluster a missing setting is an error, because executors do not share local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = _OWN.get("local") or _OWN.setdefault("local", "file://" + tempfile.mkdtemp(prefix="almanack-"))
    key = f"{spark.sparkContext.applicationId} {base}"
    if key not in _OWN:
        _OWN[key] = f"{base.rstrip('/')}/almanack-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _OWN[key])
    return _OWN[key]


def small_batches(spark: SparkSession, limit: str = "8m") -> None:
    """Lower the bytes of the batches that go to Python workers, for jobs over long texts.

    This sets the session, for good: plans are lazy, and a value put back would not hold when they run.
    Only the registered queries and the pipeline call it; the operators leave the session as it is.

    A batch is held several times (rows, vectors that grow by doubling, the worker's copy), so the
    default of 64 MB costs an executor some hundred MB for each core.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the working folder that nobody else uses."""
    return f"{workdir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by ``materialise`` that no later plan reads."""
    path = _PATHS.pop(df, None)
    if path:
        _remove(spark, path)


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to shared storage and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out
