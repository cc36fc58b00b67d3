"""Packing into sequences of at most 2048 tokens by best-fit decreasing.

Overlong documents are first cut into full windows. Of the rests, longest first, each goes to the tightest open window, which a segment
tree over remaining capacities finds. A task packs what it reads, in blocks of fixed size, so nothing is shuffled and a lost task repeats alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import released
from quillspan.llm.tokens import encoder, tokenizer_path

LENGTH = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Capacities:
    """Segment tree indexed by remaining capacity; a leaf counts the open windows of that capacity."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._add(capacity, 1)

    def _add(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity >= need with an open window."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not self.count[at]:
                    at += 1
        return at - self.size

    def take(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.windows[capacity].pop()


def best_fit_decreasing(lengths: list[int], most: int = LENGTH) -> list[tuple[int, int]]:
    """(window, offset) of each length, all between 1 and most; ties keep their order."""
    tree, placed, n = Capacities(most), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = tree.tightest(lengths[i])
        if room is None:
            room, window, n = most, n, n + 1
        else:
            window = tree.take(room)
        placed[i] = (window, most - room)
        if room > lengths[i]:
            tree.put(room - lengths[i], window)
    return placed


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, length: int = LENGTH, block: int = 65_536) -> DataFrame:
    """-> SCHEMA, one row per piece; a document's ids lie in its pieces in full.

    Null and empty texts hold the end id alone. Repeated rows are packed as often as they come. A block holds the rests of `block` documents at most (their
    numbers, not their ids), and only a task's last block is smaller. sequence_id is unique over all tasks: the task's number, then its windows. An empty
    table gives no rows; other columns are ignored.
    """
    path = tokenizer_path(tokenizer)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, used = encoder(path), TaskContext.get().partitionId() << 40
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        rests: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rests, used
            placed = best_fit_decreasing([r[2] for r in rests], length)
            out = [(*r, used + w, o) for r, (w, o) in zip(rests, placed)]
            used += 1 + max(w for w, _ in placed)
            rests = []
            for at in range(0, len(out), 8192):
                yield batch(out[at : at + 8192])

        for b in batches:
            full: list[tuple] = []
            for doc_id, ids in zip(b.column(0).to_pylist(), ids_of.encode(b.column(1))):
                data = ids.astype("<u4").tobytes() + end
                n = len(data) // 4
                rest = n - n % length
                for s in range(0, rest, length):
                    full.append((doc_id, s, length, zlib.crc32(data[4 * s : 4 * (s + length)]), n, used, 0))
                    used += 1
                if rest < n:
                    rests.append((doc_id, rest, n - rest, zlib.crc32(data[4 * rest :]), n))
                if len(rests) >= block:
                    yield from flush()
            if full:
                yield batch(full)
        if rests:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), SCHEMA)
