"""Greedy one-to-one matching of detections and truth by IoU, and what is left over."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, StructField, StructType

from quillspan.functions.geometry import rect
from quillspan.functions.text import type_family

KEYS = ["doc_id", "page", "family_type"]
MATCH, NEAR = 0.5, 0.15
#: Rows that are matched at once (more where one document has more), and pairs of boxes that are compared at once.
ROWS, PAIRS = 100_000, 1 << 21


def both(det: DataFrame, truth: DataFrame, *columns: str) -> DataFrame:
    """Detections (found, with di) and truth (with ti) in one table; of what else they have, the columns named."""
    keep = list(dict.fromkeys(["doc_id", "page", "type", "x0", "y0", "x1", "y1", *columns]))
    return det.select(F.lit(True).alias("found"), "di", *keep).unionByName(truth.select(F.lit(False).alias("found"), "ti", *keep), allowMissingColumns=True)


def _sides(det: DataFrame, truth: DataFrame | None, *columns: str) -> DataFrame:
    """Rows of a document stand together, in one task. Without truth, det is a table of both sides where they do already."""
    return det if truth is None else both(det, truth, *[c for c in columns if c not in ("di", "ti", "found")]).repartition("doc_id").sortWithinPartitions("doc_id")


@dataclass(frozen=True)
class Sides:
    """Detections and truth as the matching reads them: rows, of which all of a document (the first column) stand together in one task, and what makes both sides of whole documents' rows."""

    rows: DataFrame
    types: dict[str, DataType]
    make: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda b: b

    def run(self, told: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
        make = self.make

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _whole_documents(batches):
                yield from told(make(b))

        return self.rows.mapInArrow(run, schema)


def keyed(det: DataFrame | Sides, truth: DataFrame | None = None, *columns: str) -> Sides:
    """Boxes normalised, keyed by type family, then the columns named. Truth is left out where det has both sides, here and in what follows."""
    if isinstance(det, Sides):
        return det
    sides = _sides(det, truth, *columns)
    kinds = dict(sides.dtypes)
    whole = all(kinds[c] in ("tinyint", "smallint", "int", "bigint") for c in ("x0", "y0", "x1", "y1"))
    box = [c.cast("long" if whole else "double").alias(n) for c, n in zip(rect(), ("x0", "y0", "x1", "y1"))]
    own = ["doc_id", "page", "family_type", "found", "di", "ti", "x0", "y0", "x1", "y1"]
    rows = sides.select("doc_id", "page", type_family(F.col("type")).alias("family_type"), "found", "di", "ti", *box, *[c for c in dict.fromkeys(columns) if c not in own])
    return Sides(rows, {f.name: f.dataType for f in rows.schema})


def codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where the values are."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _ranks(column: pa.Array) -> np.ndarray:
    """Numbers in the order of the values, null first."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    return pc.rank(column, null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ROWS that end where a document does."""
    held, n, least = [], 0, ROWS
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        every = pa.concat_batches(held)
        doc = codes(every.column(0))
        ends = np.flatnonzero(doc[1:] != doc[:-1])
        if len(ends):
            yield every.slice(0, int(ends[-1]) + 1)
            every = every.slice(int(ends[-1]) + 1)
        # a document longer than that is joined as often as it doubles
        held, n, least = [every], every.num_rows, max(ROWS, 2 * every.num_rows)
    if n:
        yield pa.concat_batches(held)


def _met(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of NEAR at least: the detection's row, the truth's, the IoU. Only sides of one known document, page and type family meet."""
    doc, page, kind = (codes(b.column(k)).astype(np.int64) for k in KEYS)
    page = np.unique(page, return_inverse=True)[1] if len(page) and (page.min() < 0 or page.max() > 1 << 20) else page
    run = np.concatenate([np.zeros(1, np.int64), np.cumsum(doc[1:] != doc[:-1])])
    group = (run * (page.max() + 1) + page) * (kind.max() + 1) + kind
    known, box = np.ones(b.num_rows, bool), []
    for c in [*KEYS, "x0", "y0", "x1", "y1"]:
        column = b.column(c)
        if column.null_count:
            known &= pc.is_valid(column).to_numpy(zero_copy_only=False)
            column = pc.fill_null(column, 0) if c not in KEYS else column
        box += [] if c in KEYS else [column.to_numpy()]
    found = b.column("found").to_numpy(zero_copy_only=False)
    area = (box[2] - box[0]) * (box[3] - box[1])
    d, t = np.flatnonzero(known & found), np.flatnonzero(known & ~found)
    t = t[np.argsort(group[t], kind="stable")]
    first = np.searchsorted(group[t], group[d])
    n = np.searchsorted(group[t], group[d], "right") - first
    ends = np.cumsum(n)
    out, at = [], 0
    while at < len(d):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        m = n[at:to]
        i = np.repeat(d[at:to], m)
        j = t[np.arange(m.sum()) + np.repeat(first[at:to] - (ends[at:to] - m - before), m)]
        w = np.minimum(box[2][i], box[2][j]) - np.maximum(box[0][i], box[0][j])
        h = np.minimum(box[3][i], box[3][j]) - np.maximum(box[1][i], box[1][j])
        meet = np.flatnonzero((w > 0) & (h > 0))
        i, j, shared = i[meet], j[meet], (w[meet] * h[meet]).astype(np.float64)
        iou = shared / (area[i] + area[j] - shared)
        near = np.flatnonzero(iou >= NEAR)
        out.append((i[near], j[near], iou[near]))
        at = to
    return tuple(map(np.concatenate, zip(*out))) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _taken(b: pa.RecordBatch, i: np.ndarray, j: np.ndarray, iou: np.ndarray) -> np.ndarray:
    """Places of the pairs that are taken: without a rival at once, the others in descending IoU, ties by detection then truth order, unless either side is taken."""
    good = np.flatnonzero(iou >= MATCH)
    rival = (np.bincount(i[good], minlength=b.num_rows)[i[good]] > 1) | (np.bincount(j[good], minlength=b.num_rows)[j[good]] > 1)
    least, most = good[~rival], good[rival]
    di, ti = _ranks(b.column("di").take(pa.array(i[most]))), _ranks(b.column("ti").take(pa.array(j[most])))
    most = most[np.lexsort((ti, di, -iou[most]))]
    used, taken = bytearray(b.num_rows), []
    for k, x, y in zip(most.tolist(), i[most].tolist(), j[most].tolist()):
        if not used[x] and not used[y]:
            used[x] = used[y] = 1
            taken.append(k)
    return np.concatenate([least, np.array(taken, np.int64)])


def verdicts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row of whole documents: the IoU of the pair taken and its truth's row (NaN and -1 but on its detection), whether it is missed, whether a pair took it.

    In descending IoU, ties by detection then truth order, a pair of a page and type family is taken unless either side is. Missed: a truth that is near a detection, but
    not taken. di and ti each number a document's rows. Thousands of documents are matched at once, column by column.
    """
    i, j, iou = _met(b)
    k = _taken(b, i, j, iou)
    told, partner, near, taken = np.full(b.num_rows, np.nan), np.full(b.num_rows, -1), np.zeros(b.num_rows, bool), np.zeros(b.num_rows, bool)
    told[i[k]], partner[i[k]] = iou[k], j[k]
    near[j[iou < MATCH]] = True
    taken[i[k]] = taken[j[k]] = True
    return told, partner, near & ~taken, taken


def judged(det: DataFrame | Sides, truth: DataFrame | None, *columns: str) -> DataFrame:
    """A row for each detection (found) and each truth: the columns named, found, iou and of_ti (of the pair taken, on its detection), missed, taken."""
    sides = keyed(det, truth, *columns)
    made = {"found": BooleanType(), "iou": DoubleType(), "of_ti": sides.types["ti"], "missed": BooleanType(), "taken": BooleanType()}
    schema = StructType([StructField(n, t) for n, t in [*[(c, sides.types[c]) for c in columns], *made.items()]])

    def told(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        iou, partner, missed, taken = verdicts(b)
        alone = partner < 0
        own = [pa.array(iou, mask=alone), b.column("ti").take(pa.array(partner, mask=alone)), pa.array(missed), pa.array(taken)]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], b.column("found"), *own], schema.names)

    return sides.run(told, schema)


def candidate_pairs(det: DataFrame | Sides, truth: DataFrame | None = None, least: float = MATCH) -> DataFrame:
    """doc_id, page, family_type, di, ti, iou: the pairs of a page and type family that reach `least`, which is NEAR or more."""
    sides = keyed(det, truth)
    schema = StructType([*[StructField(c, sides.types[c]) for c in [*KEYS, "di", "ti"]], StructField("iou", DoubleType())])

    def told(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        i, j, iou = _met(b)
        left, right = pa.array(i), pa.array(j)
        yield pa.RecordBatch.from_arrays([*[b.column(c).take(left) for c in [*KEYS, "di"]], b.column("ti").take(right), pa.array(iou)], schema.names)

    return sides.run(told, schema).where(F.col("iou") >= least)


def match_greedy(det: DataFrame | Sides, truth: DataFrame | None = None) -> DataFrame:
    """doc_id, di, ti, iou of the pairs taken."""
    return judged(det, truth, "doc_id", "di").where("iou IS NOT NULL").select("doc_id", "di", F.col("of_ti").alias("ti"), "iou")


def near_misses(det: DataFrame | Sides, truth: DataFrame | None = None) -> DataFrame:
    """Unmatched truth met by any detection of its page and type family at 0.15 <= IoU < 0.5."""
    return judged(det, truth, "doc_id", "ti").where("missed").select("doc_id", "ti")


def unmatched(det: DataFrame | Sides, truth: DataFrame | None = None) -> DataFrame:
    """side ('truth' or 'det'), doc_id, ix: what no pair took."""
    return judged(det, truth, "doc_id", "di", "ti").where("NOT taken").select(F.when(F.col("found"), "det").otherwise("truth").alias("side"), "doc_id", F.when(F.col("found"), F.col("di")).otherwise(F.col("ti")).alias("ix"))
