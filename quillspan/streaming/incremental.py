"""Ordered page state and resumable scoring with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def carry_headers(pages: DataFrame) -> DataFrame:
    """doc_id, page, width, header -> doc_id, page, carried: the last header of the pages up to this one, in page order, forgotten where the width changes by more than 1.

    In a stream, pages of a document are expected in ascending order over batches; within a batch they are sorted.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        width, header = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values("page", kind="stable")
        out = []
        for r in rows.itertuples():
            if width is not None and abs(r.width - width) > 1:
                header = None
            width = float(r.width)
            header = r.header if isinstance(r.header, str) else header
            out.append((key[0], int(r.page), header))
        state.update((width, header))
        yield pd.DataFrame(out, columns=["doc_id", "page", "carried"])

    return pages.groupBy("doc_id").applyInPandasWithState(step, "doc_id long, page long, carried string", "width double, header string", "append", GroupStateTimeout.NoTimeout)


def score_new(spark: SparkSession, source: str, schema: str, score, out: str, checkpoint: str):
    """Scores files as they come and appends to `out`; after a stop the checkpoint tells what is done, so nothing is scored twice. Returns the query."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, batch: score(df).withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
