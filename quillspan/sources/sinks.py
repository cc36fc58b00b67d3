"""Writers of the JSON contracts and of text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fields_json(fields: DataFrame) -> DataFrame:
    """doc_id, json: rows (doc_id, page, id, type, x0, y0, x1, y1, label, rule, confidence, origin) as one document each, fields in order of page and id."""
    f = F.struct("page", "id", "type", F.array("x0", "y0", "x1", "y1").alias("rect"), "label", "rule", "confidence", "origin")
    return fields.groupBy("doc_id").agg(F.sort_array(F.collect_list(f)).alias("fields")).select("doc_id", F.to_json(F.struct(F.lit(1).alias("version"), "fields")).alias("json"))


def scores_json(scores: DataFrame) -> DataFrame:
    """key, json: label accuracy that could not be measured is written as the word UNAVAILABLE."""
    cols = sorted(c for c in scores.columns if c != "key")
    held = [F.coalesce(F.col(c).cast("string"), F.lit("UNAVAILABLE")).alias(c) if c == "label_accuracy" else F.col(c) for c in cols]
    return scores.select("key", F.to_json(F.struct(*held)).alias("json"))


def text_table(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """n, line: a report table with every column padded to its widest value, two spaces between."""
    s = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns], F.col(order).alias("_o"))
    widths = s.agg(*[F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(c) for c in columns]).first()
    line = F.rtrim(F.concat_ws("  ", *[F.rpad(F.col(c), int(widths[c] or len(c)), " ") for c in columns]))
    return s.select(F.col("_o").alias("n"), line.alias("line")).orderBy("n")
