"""Additive score buckets, their rollup and the ratios made of them. Sums of IoU are kept in millionths, exact in any order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from quillspan.functions.text import normalize_label
from quillspan.operators.matching import Sides, codes, keyed, verdicts

MEASURES = ["truth", "detected", "matched", "iou_micro", "near_miss", "label_pairs", "label_agree"]
#: Label pairs of check boxes, which count by rule alone: elsewhere they would only tell how many check boxes there are.
_BOXES = ["box_pairs", "box_agree"]


def _groups(columns: Sequence[pa.Array], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each group of equal values, and each row's group."""
    code = np.zeros(n, np.int64)
    for c in columns:
        k = codes(c)
        if k.min() < 0 or k.max() >> 20:
            k = np.unique(k, return_inverse=True)[1]
        code = code * (int(k.max()) + 1) + k
        if code.max() >> 40:
            code = np.unique(code, return_inverse=True)[1]
    return np.unique(code, return_index=True, return_inverse=True)[1:]


def measures(det: DataFrame | Sides, truth: DataFrame | None = None, *sets: Sequence[str]) -> DataFrame:
    """part, keys, measures: additive rows for each set of keys (part numbers them; keys of other sets are null), of split, family, doc_id and rule, all four by default.

    Truth and misses count under the truth's keys, detections and matches under their own. Rows are summed where they are matched, some thousand documents at once: there are
    many of one key, but one only of keys with doc_id. Labels that differ are compared afterwards, without their masks. Truth is left out where det has both sides.
    """
    sets = sets or (["split", "family", "doc_id", "rule"],)
    keys = list(dict.fromkeys(k for some in sets for k in some))
    sides = keyed(det, truth, *keys, "type", "label")
    counts = [*MEASURES, *_BOXES]
    odd = StructType([StructField("label", StringType()), StructField("of_label", StringType()), StructField("box", BooleanType())])
    schema = StructType([StructField("part", IntegerType()), *[StructField(k, sides.types[k]) for k in keys], *[StructField(n, LongType()) for n in counts], StructField("odd", ArrayType(odd))])

    def told(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        iou, partner, missed, _ = verdicts(b)
        box = pc.fill_null(pc.equal(b.column("type"), "checkbox"), False).to_numpy(zero_copy_only=False)
        found, hit = b.column("found").to_numpy(zero_copy_only=False), np.flatnonzero(partner >= 0)
        own, theirs = (pc.fill_null(b.column("label").take(pa.array(i)), "") for i in (hit, partner[hit]))
        shown, same = pc.not_equal(theirs, "").to_numpy(zero_copy_only=False), pc.equal(own, theirs).to_numpy(zero_copy_only=False)
        pair, agree, micro = np.zeros(b.num_rows, bool), np.zeros(b.num_rows, bool), np.zeros(b.num_rows)
        pair[hit], agree[hit], micro[hit] = shown, shown & same, np.floor(iou[hit] * 1_000_000)
        values = (~found, found, partner >= 0, micro, missed, pair & ~box, agree & ~box, pair & box, agree & box)
        apart = np.flatnonzero(shown & ~same)
        for part, some in enumerate(sets):
            first, group = _groups([b.column(k) for k in some], b.num_rows)
            n = len(first)
            at = apart[np.argsort(group[hit[apart]], kind="stable")]
            ends = np.cumsum(np.bincount(group[hit[at]], minlength=n))
            labels = pa.StructArray.from_arrays([own.take(pa.array(at)), theirs.take(pa.array(at)), pa.array(box[hit[at]])], names=odd.names)
            place = pa.array(first)
            # sums of doubles are exact up to 2 ** 53
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), *[b.column(k).take(place) if k in some else pa.nulls(n, b.column(k).type) for k in keys], *[pa.array(np.bincount(group, v, n).astype(np.int64)) for v in values], pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), labels)],
                schema.names,
            )

    agreed = lambda kept: F.size(F.filter("odd", lambda x: kept(x["box"]) & (normalize_label(x["label"]) == normalize_label(x["of_label"])))).cast("long")
    plus = {"label_agree": agreed(lambda box: ~box), "box_agree": agreed(lambda box: box)}
    return sides.run(told, schema).select("part", *keys, *[(F.col(n) + plus[n]).alias(n) if n in plus else n for n in counts])


def ratio(a: str | Column, b: str | Column) -> Column:
    """0 over an empty denominator, never over 1."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, F.least(F.lit(1.0), a.cast("double") / b)).otherwise(F.lit(0.0))


def finalise(buckets: DataFrame) -> DataFrame:
    p, r = ratio("matched", "detected"), ratio("matched", "truth")
    return buckets.withColumns(
        {
            "precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)),
            "placement": F.when(F.col("matched") > 0, F.col("iou_micro").cast("double") / F.col("matched") / 1_000_000).otherwise(F.lit(0.0)),
            "attribution_ok": (F.col("matched") <= F.col("truth")) & (F.col("matched") <= F.col("detected")),
            "label_accuracy": F.when(F.col("label_pairs") > 0, F.col("label_agree").cast("double") / F.col("label_pairs")),
        }
    )


#: The sets of keys that a rollup reads.
ROLLUP = (["split", "rule", "family"], ["doc_id"])


def rollup(m: DataFrame) -> DataFrame:
    """scope, key, measures: overall by split, by rule, by family and by document, in one pass over the measures of ROLLUP."""
    scope = lambda name, key: F.struct(F.lit(name).alias("scope"), F.col(key).cast("string").alias("key"))
    scopes = F.when(F.col("part") == 0, F.array(scope("split", "split"), scope("rule", "rule"), scope("family", "family"))).otherwise(F.array(scope("form", "doc_id")))
    e = m.select(F.inline(scopes), *MEASURES, *_BOXES)
    boxes = {"label_pairs": "box_pairs", "label_agree": "box_agree"}
    total = lambda k: F.sum(F.col(k) + F.when(F.col("scope") == "rule", F.col(boxes[k])).otherwise(0) if k in boxes else F.col(k)).alias(k)
    return e.groupBy("scope", "key").agg(*map(total, MEASURES))


def by(m: DataFrame, *keys: str) -> DataFrame:
    boxes = {"label_pairs": "box_pairs", "label_agree": "box_agree"} if "rule" in keys else {}
    return finalise(m.groupBy(*keys).agg(*[(F.sum(k) + F.sum(boxes[k]) if k in boxes else F.sum(k)).alias(k) for k in MEASURES]))


def scores(det: DataFrame | Sides, truth: DataFrame | None, *keys: str) -> DataFrame:
    """What by makes of the measures of these keys; with doc_id among them their rows are whole already."""
    m = measures(det, truth, keys)
    return by(m, *keys) if "doc_id" not in keys or "rule" in keys else finalise(m.select(*keys, *MEASURES))
