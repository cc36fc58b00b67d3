"""A corpus pipeline: toxicity, exact dedup, near-dedup, mixing, packing. Each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import op2_simhash, op4_toxicity, op5_mixing, op6_packing, op8_exact_dedup
from quillspan.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op4_toxicity.train_on(docs, table(spark, sf_dir, "labels"))
    return op4_toxicity.score_documents(docs, model).where("predicted = 0").select("_row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: a row that shares id and text with another is gone before."""
    return op2_simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it whole; what it takes in part is the text up to that many words."""
    return op5_mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("simhash near-dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: Toxicity scores, SimHash and token ids can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
