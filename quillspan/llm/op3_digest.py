"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every window of four bytes gives three triplets, each with its own salt, counted into 256 buckets. A bucket's code is the number of quartiles of the
counts that lie under it (two bits), and one byte holds the logarithm of the length. Digests are compared by a bounded difference score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import bucket_count, materialise, order_key, released

BUCKETS = 256
#: Difference of two codes: apart by the whole range counts double.
_STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.int32)
#: The expected score of unrelated digests, at which likeness reaches 0.
UNRELATED = 1.625 * BUCKETS
_OFFSETS = ((1, 2), (1, 3), (2, 3))


def digest(data: bytes, chunk: int = 1 << 20) -> bytes:
    """64 bytes of bucket codes and one of length; data without a triplet has all codes 0."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), chunk):
        b = np.frombuffer(data[at : at + chunk + 3], np.uint8).astype(np.uint32)
        n = len(b)
        for salt, (p, q) in enumerate(_OFFSETS):
            m = min(n - q, chunk)
            if m <= 0:
                continue
            mixed = (b[:m] * np.uint32(0x9E3779B1) + b[p : p + m] * np.uint32(0x85EBCA77) + b[q : q + m] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F * (salt + 1) & 0xFFFFFFFF)) * np.uint32(0x165667B1)
            counts += np.bincount((mixed >> np.uint32(24)).astype(np.intp), minlength=BUCKETS)
    quartiles = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > quartiles).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = (codes << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    return packed.tobytes() + bytes([min(255, int(np.log1p(len(data)) * 12))])


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests, 0 from the score of unrelated ones on."""
    if a == b:
        return 1.0
    x, y = (np.unpackbits(np.frombuffer(d[:-1], np.uint8), bitorder="little").reshape(-1, 2) @ np.array([1, 2]) for d in (a, b))
    score = int(_STEP[x, y].sum()) + abs(a[-1] - b[-1])
    return max(0.0, 1.0 - score / UNRELATED)


def _row(doc_id: int | None, text: str, fp: bytes, follower: str, follower_fp: bytes) -> tuple:
    n = len(text)
    edited = (text[: n - n // 2] + follower[: n // 2]).encode("utf-8", "surrogatepass")
    edited_fp = digest(edited)
    return doc_id, n, hashlib.sha256(edited).digest(), fp, edited_fp, likeness(fp, edited_fp), likeness(fp, follower_fp)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


_TYPES = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited": pa.binary(), "fp": pa.binary(), "edited_fp": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
_ROW = "doc_id long, n_chars long, edited binary, fp binary, edited_fp binary, near_edited double, near_next double"


def _batch(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES.values())]


def document_digests(docs: DataFrame) -> DataFrame:
    """-> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row per input row: the digest of each text, of its edited text,
    and their likeness.

    Order is by doc_id, null ids first, ties by a hash of the text and then the text; a null text is empty, whose digest has no bucket set; the last document is
    followed by the first (a single one by itself). Very long texts are read whole, in pieces of a megabyte. An empty table gives no rows; other columns are
    ignored. The texts are shuffled once, by ranges of that order, so an id of any number of rows fills as many ranges as it needs; the last text of each range
    meets the first of the next in a small join.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["k", "h", "text"]
    dealt = rows.withColumns({"k": order_key(), "h": F.xxhash64("text")}).repartitionByRange(bucket_count(docs), "k", "h").sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pid = None, TaskContext.get().partitionId()

        def made(out: list[tuple], edge: str, texts: list[str | None]) -> pa.RecordBatch:
            n = len(out)
            return pa.RecordBatch.from_arrays([*_batch(out), pa.array([pid] * n, pa.int32()), pa.array([edge] * n, pa.string()), pa.array(texts, pa.string())], [*_TYPES, "pid", "edge", "text"])

        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fp = digest(_bytes(text))
                if held is None:
                    yield made([(None,) * 7], "first", [text])
                else:
                    out.append(_row(*held, text, fp))
                held = doc_id, text, fp
            if out:
                yield made(out, "", [None] * len(out))
        if held is not None:
            yield made([(held[0], *(None,) * 6)], "last", [held[1]])

    parts = materialise(dealt.mapInArrow(released(run), f"{_ROW}, pid int, edge string, text string"), "digest-rows")
    # one row a range
    firsts = parts.where("edge = 'first'").select("pid", F.col("text").alias("follower"))
    after = firsts.select("pid", F.coalesce(F.lead("pid").over(Window.orderBy("pid")), F.min("pid").over(Window.partitionBy())).alias("next"))
    edges = parts.where("edge = 'last'").select("doc_id", "text", "pid").join(after, "pid").join(firsts.withColumnRenamed("pid", "next"), "next").select("doc_id", "text", "follower")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_row(doc_id, text, digest(_bytes(text)), follower, digest(_bytes(follower))) for doc_id, text, follower in zip(*(c.to_pylist() for c in b.columns))]
            if out:
                yield pa.RecordBatch.from_arrays(_batch(out), list(_TYPES))

    every = parts.where("edge = ''").select(*_TYPES).unionByName(edges.mapInArrow(released(close), _ROW))
    text = lambda c: F.lower(F.hex(c))
    return every.select("doc_id", "n_chars", text("edited").alias("edited_sha256"), text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")
