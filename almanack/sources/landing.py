"""Folders for landed payloads and stored tables: below the folder that the session's cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a ``local[...]`` session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="almanack-landing-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def land(payloads: DataFrame, payload: str | Column, name: str) -> str:
    """Each row's text as a file of its own, as a fetcher would leave it; the folder's path."""
    path = folder(payloads.sparkSession, name)
    payloads.select(payload).write.option("maxRecordsPerFile", 1).text(path)
    return path


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """A table written to a folder that the cluster shares and read back: its plan starts anew, and lost executors cost a re-read."""
    path = folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
