"""Exact dedup with a log-structured merge index, in DataFrame functions only.

A task's rows are a memtable, which it flushes as a run of (digest, identifier) sorted by digest. Compaction merges all runs by digest into one of the next level and
keeps the smallest identifier and the count. A bitmap filter over the digests of more than one row picks the hits among the documents: only the hits' texts are
shuffled, and their very bytes are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import materialise, normalised_text, packed, scratch_path

#: Bits of a filter: eight for each digest in it, as a power of two between these (128 KB and 128 MB). A fuller filter passes more rows, which costs a shuffle of texts and no result.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
_WORD = 32768


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def identifier() -> Column:
    """Orders rows by doc_id, null ids last, then by their place in the run, so that one row of equal ids is the smallest."""
    return F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid"))


class DigestIndex:
    """Runs of digests in a shared folder: flush adds a level-0 run, compact merges all runs into one of the next level, both readable at any time."""

    def __init__(self, spark, path: str | None = None) -> None:
        self.spark, self.path, self.runs, self.n = spark, path or scratch_path(spark, "lsm"), [], 0

    def _write(self, run: DataFrame, level: int) -> DataFrame:
        to = f"{self.path}/level{level}-run{self.n}"
        self.n += 1
        run.sortWithinPartitions("digest").write.option("compression", "zstd").parquet(to)
        return self.spark.read.schema(run.schema).parquet(to)

    def flush(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, digest, ...) -> the run as written, with rid, each row's fixed place in it. No shuffle: each task sorts what it holds."""
        base = self.n << 52
        run = self._write(rows.withColumn("rid", F.monotonically_increasing_id() + F.lit(base)), 0)
        self.runs.append(run.select("digest", identifier().alias("least"), F.lit(1).cast("long").alias("rows")))
        return run

    def compact(self) -> DataFrame:
        """-> digest, least, rows: the smallest identifier of each digest and its count over all runs. Equal digests meet per task before the shuffle."""
        merged = self.runs[0]
        for r in self.runs[1:]:
            merged = merged.unionByName(r)
        table = self._write(merged.groupBy("digest").agg(F.min("least").alias("least"), F.sum("rows").alias("rows")), 1)
        self.runs = [table]
        return table


class Filter:
    """A bitmap over digests: at most MOST_BITS / 32768 rows of 4 KB, whatever the input, so it may be broadcast."""

    def __init__(self, digests: DataFrame) -> None:
        """digests: digest, each once."""
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * digests.count()).bit_length()))
        at = digests.select(self._bit().alias("b"))
        self.words = materialise(at.groupBy(F.floor(F.col("b") / _WORD).alias("word")).agg(F.bitmap_construct_agg(F.col("b") % _WORD).alias("held")), "dedup-filter")

    def _bit(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.bits))

    def flag(self, rows: DataFrame) -> DataFrame:
        """Adds maybe to rows (digest, ...): false only where the digest isn't among the filter's."""
        at = rows.withColumn("b", self._bit()).withColumn("word", F.floor(F.col("b") / _WORD))
        byte = F.conv(F.hex(F.expr("substring(held, cast((b % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        maybe = F.coalesce(F.getbit(byte, F.expr("cast(b % 8 as int)")) == 1, F.lit(False))
        return at.join(F.broadcast(self.words), "word", "left").withColumn("maybe", maybe).drop("b", "word", "held")


def exact_duplicates(docs: DataFrame, digest=sha256_digest) -> DataFrame:
    """-> doc_id, keep_id, group_size, kept, text_sha256; one row per input row, also of those dropped.

    Null texts count as empty, and all blank texts that normalise alike are equal. Of rows with the smallest doc_id, repeated rows among them, one is kept; a
    null doc_id is kept only where a group has no other. Texts of any length are hashed whole. An empty table gives no rows; other columns are ignored. `digest`
    may be any function of the normalised text: rows of one digest whose bytes differ are told apart by their bytes.
    """
    index = DigestIndex(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised_text(F.col("text").cast("string")).alias("norm"))
    base = base.select("doc_id", "norm", digest(F.col("norm")).alias("digest"))
    sha = F.sha2(F.col("norm").cast("binary"), 256)
    run = index.flush(base.select("doc_id", "digest", sha.alias("text_sha256")))
    table = index.compact()
    hits = Filter(table.where("rows > 1").select("digest")).flag(base).where("maybe")
    mixed = materialise(hits.groupBy("digest", "norm").agg(F.lit(1).alias("n")).groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "dedup-mixed")
    out = run.join(table.select("digest", "least", "rows"), "digest")
    if mixed.limit(1).count():
        # digests that stand for several texts
        odd = materialise(base.join(mixed, "digest", "left_semi").select("doc_id", "digest", "norm", sha.alias("text_sha256"), F.monotonically_increasing_id().alias("rid")), "dedup-odd")
        exact = odd.groupBy("digest", "norm").agg(F.min(identifier()).alias("least"), F.count("*").alias("rows"))
        out = out.join(mixed, "digest", "left_anti").unionByName(odd.join(exact, ["digest", "norm"]).select(*out.columns))
    keep = F.col("least.doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.col("rows").alias("group_size"), (F.col("rid") == F.col("least.rid")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one for each text, all columns kept, whatever their names.

    Rows whose bit in the filter is clear are alone and pass at once; only possible hits, with their texts, are joined with what stays. Of rows equal in doc_id and
    text one stays.
    """
    found = materialise(exact_duplicates(docs), "dedup")
    name = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit("none"))
    many = found.where("group_size > 1").select(F.unhex("text_sha256").alias("digest")).distinct()
    rows = packed(docs, digest=sha256_digest(normalised_text(F.col("text").cast("string"))), name=name("doc_id"))
    rows = Filter(many).flag(rows)
    stay = found.where("kept").select(name("doc_id").alias("name"), F.unhex("text_sha256").alias("digest"))
    first = F.row_number().over(Window.partitionBy("name", "digest").orderBy("digest"))
    some = rows.where("maybe").join(stay, ["name", "digest"], "left_semi").withColumn("n", first).where("n = 1")
    return rows.where("not maybe").select("_row.*").unionByName(some.select("_row.*"))
