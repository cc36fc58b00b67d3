"""Shared plumbing: table access, shared scratch tables, document order without a global sort task."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONG_MIN = -(2**63)
#: `[\x20\x09-\x0D]`, the ASCII white space that separates words.
WS_CLASS = "[\\x20\\x09-\\x0D]"
NOT_WS_CLASS = "[^\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a local one is set only where that is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "quillspan-shared")
    return f"{base}/quillspan"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, after which the worker, which may stay idle or serve another query, gives its free memory back to the system."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def own_columns(df: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """Every row of df as one struct, _row, beside the given columns: helper columns can't clash with df's own, and select("_row.*") gives df's columns back."""
    return df.select(F.struct(*own_columns(df)).alias("_row"), *[c.alias(n) for n, c in columns.items()])


def plain_text(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def normalised_text(col: str | Column = "text") -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(plain_text(col), f"{WS_CLASS}+", " ")


def word_count(col: str | Column = "text") -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; null has none. Counts the starts of words, without building an array of them."""
    return F.length(F.regexp_replace(F.regexp_replace(plain_text(col), f"{NOT_WS_CLASS}+", "x"), f"{WS_CLASS}+", "")).cast("long")


def order_key(col: str = "doc_id") -> Column:
    """Ascending document order; null ids come first."""
    return F.coalesce(F.col(col).cast("long"), F.lit(LONG_MIN))


def bucket_count(df: DataFrame) -> int:
    """As many range buckets as Spark is told to shuffle into, and no fewer than the input has partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions(), 1)
