"""Intermediate tables in the folder that driver and executors share: a long plan is cut there, and lost executors cost no recomputation before it."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet below spark.checkpoint.dir and reads it back. A machine-local folder serves only a local master that has none set."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "quillspan-shared")
    path = f"{base}/quillspan/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def joined_by_measured_size(spark: SparkSession) -> Iterator[None]:
    """While it is open, what is planned and run broadcasts a side of a join only by the bytes its exchange has measured, or where asked to.

    The bytes of a file tell little of its rows: a scratch table of millions of short, repeated values passes for a few MB and would be gathered on the driver. What is
    built here must be written here too, since a plan is made when it runs.
    """
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (static, adaptive)}
    try:
        spark.conf.set(adaptive, before[adaptive] or before[static] or "10MB")
        spark.conf.set(static, "-1")
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
