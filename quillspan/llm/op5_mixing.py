"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

A source's target is met by whole copies of all its documents, as often as they fit, and by the documents under a threshold of a hash for
the rest. The threshold is found without sorting: words are summed by source and hash bucket, the bucket in which the budget ends is refined into
finer, nested buckets, and only what then is left (one bucket of 2^28) is taken in order, its last document in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import NOT_WS_CLASS, WS_CLASS, materialise, packed, plain_text, word_count

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Bits of the hash, and of those used by the first and the second histogram.
BITS, FIRST, SECOND = 60, 12, 16
#: Repeated rows are numbered in so many cells.
CELLS = 256


def hash_key() -> Column:
    """60 bits of the md5 of doc_id and the text's md5: the same in any engine, for any order of rows."""
    seed = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(plain_text().cast("binary")))
    return F.conv(F.substring(F.md5(seed.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sizes (source, source_size) -> with target: shares by weight of the sum of all sizes, none over `repeats` times its source's size.

    Sources are ranked by code point, null last. Resharing the excess by weight until none is above ends where the sources of least size per weight are
    capped and the others share the rest; that point is found on running sums in order of size per weight. One row a source, however many documents.
    """
    everything = Window.partitionBy(F.lit(1))
    by_name = everything.orderBy(F.col("source").isNull(), "source")
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int"))
    ratio = everything.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    w = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.lit(repeats).cast("long") * F.col("source_size")).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    w = w.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    w = w.withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(ratio), F.lit(0))).withColumn("rest_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(ratio), F.lit(0)))
    # A source is capped if its cap is under its share of what those before it leave; the first that is not fixes the level for all after it.
    w = w.withColumn("open", F.col("cap") * F.col("rest_weight") >= F.col("rest") * F.col("weight"))
    level = F.struct(F.col("ratio"), F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"), F.col("rest"), F.col("rest_weight"))
    w = w.withColumn("level", F.min(F.when(F.col("open"), level)).over(everything))
    share = F.col("level.rest").cast("double") * F.col("weight") / F.col("level.rest_weight")
    return w.select("source", "source_size", F.when(F.col("open"), share).otherwise(F.col("cap").cast("double")).alias("target"))


def _boundary(histogram: DataFrame, budget: str) -> DataFrame:
    """histogram (source, bucket, words, budget): the bucket of each source in which the budget ends, and what is left of it there."""
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(w), F.lit(0))
    return histogram.withColumn("before", before).where((F.col("before") <= F.col(budget)) & (F.col("before") + F.col("words") > F.col(budget)))



def _bucket1() -> Column:
    return F.shiftright("_key", BITS - FIRST)


def _bucket2() -> Column:
    return F.shiftright("_key", BITS - FIRST - SECOND)


def _bounds(rows: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """rows (source, _size, _key) -> a row a source: source_size, target, whole copies, budget for the rest, the last bucket and the words left in it."""
    first = materialise(rows.groupBy("source", _bucket1().alias("bucket")).agg(F.sum("_size").alias("words")), "mix-histogram")
    plan = targets(first.groupBy("source").agg(F.sum("words").alias("source_size")), weights, repeats)
    whole = F.round("target").cast("long")
    plan = plan.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long"))
    plan = materialise(plan.withColumn("budget", whole - F.col("copies") * F.col("source_size")), "mix-plan")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    at1 = _boundary(first.alias("h").join(plan.alias("p"), same("h", "p")).select("h.source", "bucket", "words", "budget"), "budget")
    at1 = at1.select("source", F.col("bucket").alias("bucket1"), (F.col("budget") - F.col("before")).alias("left1"))
    inside = rows.withColumn("bucket1", _bucket1()).alias("r").join(at1.alias("a"), same("r", "a") & (F.col("r.bucket1") == F.col("a.bucket1"))).select("r.source", "r._key", "r._size", "a.left1")
    second = inside.groupBy("source", "left1", _bucket2().alias("bucket")).agg(F.sum("_size").alias("words"))
    at2 = _boundary(second, "left1").select("source", F.col("bucket").alias("bucket2"), (F.col("left1") - F.col("before")).alias("left2"))
    return materialise(plan.alias("p").join(at2.alias("b"), same("p", "b"), "left").select("p.*", "b.bucket2", "b.left2"), "mix-bounds")


def _taken(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds source_size, target and taken to rows (source, doc_id, _size, _key, ...): a comparison for all but the rows of a source's last bucket, which are summed in order.

    Rows of one hash there are repeated rows. They are counted in cells, so that the order is one of a few cells, and any number of repeated rows is numbered cell by cell.
    """
    held = rows.alias("r").join(bounds.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source"))).select("r.*", "b.source_size", "b.target", "b.copies", "b.budget", "b.bucket2", "b.left2")
    last = _bucket2() == F.col("bucket2")
    clear = held.where(~F.coalesce(last, F.lit(False))).withColumn("_part", F.when((F.col("budget") > 0) & F.coalesce(_bucket2() < F.col("bucket2"), F.lit(True)), F.col("_size")).otherwise(0))
    edge = materialise(held.where(last).withColumn("_cell", F.pmod(F.monotonically_increasing_id(), F.lit(CELLS))), "mix-edge")
    alike = ["source", "bucket2", "_key", "doc_id", "_size", "_cell"]
    order = Window.partitionBy("source", "bucket2").orderBy("_key", "doc_id", "_size", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = edge.groupBy(*alike).agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum(F.col("n") * F.col("_size")).over(order), F.lit(0)))
    edge = edge.withColumn("_nth", F.row_number().over(Window.partitionBy(*alike).orderBy("_key"))).alias("e")
    edge = edge.join(cells.drop("n").alias("c"), [F.col(f"e.{c}").eqNullSafe(F.col(f"c.{c}")) for c in alike]).select("e.*", "c._before")
    spent = F.col("_before") + (F.col("_nth") - 1) * F.col("_size")
    edge = edge.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("left2") - spent))).drop("_cell", "_nth", "_before")
    out = clear.unionByName(edge).withColumn("taken", (F.col("copies") * F.col("_size") + F.col("_part")).cast("long"))
    return out.drop("copies", "budget", "bucket2", "left2", "_part")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """-> doc_id, source, size, source_size, target, taken; one row per input row.

    Null texts have size 0; documents without words are never taken. Null is a source of its own, ranked last. Repeated rows have one hash; those in the
    last bucket are taken one by one. Words of very long texts are counted without building an array of them. The last document of a source may be taken in part, so sums of taken equal the rounded target. An empty
    table gives no rows; other columns are ignored. A hot source is summed per task before any shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("_size"), hash_key().alias("_key"))
    rows = materialise(rows, "mix-rows")
    return _taken(rows, _bounds(rows, weights, repeats)).select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The rows of docs as often as the mix takes them whole, and once more cut after the words it takes in part; all columns kept, whatever their names; n_chars, if
    there, recounted.

    A row's own hash and its source's bounds decide, so texts are not shuffled. Documents without words leave.
    """
    rows = packed(docs, doc_id=F.col("doc_id").cast("long"), source=F.col("source").cast("string"), _size=word_count(), _key=hash_key())
    narrow = materialise(rows.select("source", "_size", "_key"), "mix-rows")
    held = _taken(rows, _bounds(narrow, weights, repeats)).where("taken > 0")
    text = plain_text(F.col("_row.text"))
    pieces = F.split(text, f"(?<={WS_CLASS})(?={NOT_WS_CLASS})")
    lead = F.regexp_like(text, F.lit(f"^{WS_CLASS}")).cast("int")
    rest = (F.col("taken") % F.col("_size")).cast("int")
    cut = F.when(rest > 0, F.array_join(F.slice(pieces, 1, rest + lead), ""))
    copies = F.array_repeat(text, F.floor(F.col("taken") / F.col("_size")).cast("int"))
    out = held.select("_row", F.explode(F.concat(copies, F.array_compact(F.array(cut)))).alias("text"))
    kept = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[kept.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
