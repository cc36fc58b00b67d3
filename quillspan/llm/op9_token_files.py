"""Token ids in binary files of patched frame-of-reference blocks.

A file: the magic, then blocks, then the table of documents, the index of block starts and a footer. A block subtracts its minimum, packs every value
at the width that holds the 90th percentile, and lists the outliers' positions and high parts. All numbers are little-endian.

    block   minimum u32, count u16, width u8, spare u8, outliers u16, packed bytes, positions u16 each, high parts u32 each
    tables  doc_id i64 each, null flag u8 each, tokens u32 each; block starts u64 each
    footer  place of the tables u64, documents u64, blocks u64, ids u64, magic
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import bucket_count, materialise, order_key, plain_text, released, scratch_path
from quillspan.llm.tokens import encoder, tokenizer_path

MAGIC = b"QSPFOR01"
BLOCK = 1024
PERCENTILE = 90
#: A file is closed at the first document after so many ids.
FILE_IDS = 1 << 25
#: Bytes of text that are encoded at once.
BATCH = 12 << 20
_FOOTER = "<QQQQ8s"
_HEAD = "<IHBBH"


@cache
def _places(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of a block begins: the byte, and the bit in it."""
    at = np.arange(BLOCK) * width
    return at >> 3, (at & 7).astype("<u4")


def _unpack_bits(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    """Up to 25 bits, each value lies within the four bytes from its first one on. A block is followed by more than four bytes of tables."""
    if width == 0:
        return np.zeros(n, "<u4")
    if width > 25:
        wide = (width + 7) // 8
        bits, low = np.zeros((n, 8 * wide), np.uint8), np.zeros((n, 4), np.uint8)
        bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, (n * width + 7) // 8, at), count=n * width, bitorder="little").reshape(n, width)
        low[:, :wide] = np.packbits(bits, axis=1, bitorder="little")
        return low.view("<u4").ravel()
    size = (n * width + 7) // 8
    if at + size + 4 > len(data):
        data, at = bytes(data[at : at + size]) + bytes(4), 0
    byte, bit = _places(width)
    words = np.ndarray(size, "<u4", data, at, (1,))
    return words[byte[:n]] >> bit[:n] & np.uint32((1 << width) - 1)


def pack_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    v = (ids - np.uint32(low)).astype("<u4")
    at = (len(v) - 1) * PERCENTILE // 100
    width = int(np.partition(v, at)[at]).bit_length()
    over = np.flatnonzero(v >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    bits = np.unpackbits(v.view(np.uint8).reshape(-1, 4)[:, : (width + 7) // 8], axis=1, bitorder="little")[:, :width]
    high = (v[over] >> np.uint32(width)).astype("<u4") if width < 32 else np.empty(0, "<u4")
    return struct.pack(_HEAD, low, len(v), width, 0, len(over)) + np.packbits(bits, bitorder="little").tobytes() + over.astype("<u2").tobytes() + high.tobytes()


def unpack_block(data: bytes, at: int) -> np.ndarray:
    low, n, width, _, outliers = struct.unpack_from(_HEAD, data, at)
    at += struct.calcsize(_HEAD)
    v = _unpack_bits(data, at, n, width)
    at += (n * width + 7) // 8
    where = np.frombuffer(data, "<u2", outliers, at)
    v[where] |= np.frombuffer(data, "<u4", outliers, at + 2 * outliers) << np.uint32(width)
    return v + np.uint32(low)


class FileWriter:
    """Blocks are written as ids come; in memory stay an open block and the tables."""

    def __init__(self, sink) -> None:
        self.sink, self.at, self.n_ids = sink, len(MAGIC), 0
        self.open: list[np.ndarray] = []
        self.held = 0
        self.docs: list[tuple[int | None, int]] = []
        self.starts: list[int] = []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.n_ids += len(ids)
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            every = np.concatenate(self.open)
            whole = len(every) - len(every) % BLOCK
            for s in range(0, whole, BLOCK):
                self._block(every[s : s + BLOCK])
            self.open, self.held = [every[whole:]], len(every) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack_block(ids)
        self.starts.append(self.at)
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.open))
        names = np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
        nulls = np.array([d is None for d, _ in self.docs], np.uint8).tobytes()
        counts = np.array([n for _, n in self.docs], "<u4").tobytes()
        self.sink.write(names + nulls + counts + np.array(self.starts, "<u8").tobytes())
        self.sink.write(struct.pack(_FOOTER, self.at, len(self.docs), len(self.starts), self.n_ids, MAGIC))


def read_file(data: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids of the file before it, its ids); decodes block by block, through the index."""
    at, docs, blocks, n_ids, magic = struct.unpack_from(_FOOTER, data, len(data) - struct.calcsize(_FOOTER))
    if magic != MAGIC or data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    names = np.frombuffer(data, "<i8", docs, at)
    nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(data, "<u4", docs, at + 9 * docs)
    starts = np.frombuffer(data, "<u8", blocks, at + 13 * docs)
    held, have, b, before = np.empty(0, np.uint32), 0, 0, 0
    for name, null, n in zip(names.tolist(), nulls.tolist(), counts.tolist()):
        if have < n:
            more = [held]
            while have < n:
                more.append(unpack_block(data, int(starts[b])))
                have += len(more[-1])
                b += 1
            held = np.concatenate(more)
        yield (None if null else name), before, held[:n]
        held, have, before = held[n:], have - n, before + n


def read_at(data: bytes, position: int) -> int:
    """One id of a file by its place, decoding its block alone."""
    at, docs, blocks, _, _ = struct.unpack_from(_FOOTER, data, len(data) - struct.calcsize(_FOOTER))
    start = np.frombuffer(data, "<u8", blocks, at + 13 * docs)[position // BLOCK]
    return int(unpack_block(data, int(start))[position % BLOCK])


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes files of ascending doc_id under path (a folder that all executors share) -> bucket, part, docs, ids, first (ids of all files before it); a row a file.

    Texts are dealt by ranges of doc_id and, within one, of a hash of the text, so an id of any number of rows fills as many ranges as it needs; each range is sorted.
    A file is written under the task attempt's name and then renamed, so a lost executor's work is repeated with the same result and never seen in part.
    """
    tok = tokenizer_path(tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text(F.col("text").cast("string")).alias("text"))
    dealt = rows.withColumns({"k": order_key(), "h": F.xxhash64("text")}).repartitionByRange(bucket_count(docs), "k", "h").sortWithinPartitions("k", "h", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        ids_of, store, folder = encoder(tok, BATCH), *fs.FileSystem.from_uri(path)
        attempt, bucket = TaskContext.get().taskAttemptId(), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        done: list[tuple[int, int, int, int]] = []
        writer, sink, temp = None, None, ""

        def close() -> None:
            nonlocal writer
            writer.close()
            sink.close()
            final = f"{folder}/{_name(bucket, len(done))}"
            if store.get_file_info(final).type != fs.FileType.NotFound:
                store.delete_file(final)
            store.move(temp, final)
            done.append((bucket, len(done), len(writer.docs), writer.n_ids))
            writer = None

        for b in batches:
            for name, ids in zip(b.column(0).to_pylist(), ids_of.encode(b.column(1))):
                if writer is None:
                    store.create_dir(folder, recursive=True)
                    temp = f"{folder}/_temp-{bucket:05d}-{len(done):05d}-{attempt}"
                    sink = store.open_output_stream(temp)
                    writer = FileWriter(sink)
                writer.add(name, np.concatenate([ids, end]))
                if writer.n_ids >= file_ids:
                    close()
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], ["bucket", "part", "docs", "ids"])

    files = materialise(dealt.mapInArrow(released(run), "bucket long, part long, docs long, ids long"), "token-files")
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a range: its number is that of the shuffle's partitions
    ranges = files.groupBy("bucket").agg(F.sum("ids").alias("all")).select("bucket", earlier(Window.orderBy("bucket"), "all").alias("base"))
    within = files.withColumn("before", earlier(Window.partitionBy("bucket").orderBy("part"), "ids"))
    return within.join(ranges, "bucket").select("bucket", "part", "docs", "ids", (F.col("base") + F.col("before")).alias("first"))


def _name(bucket: int, part: int) -> str:
    return f"part-{bucket:05d}-{part:05d}.qspf"


SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(files: DataFrame, path: str) -> DataFrame:
    """files (bucket, part, first) -> SCHEMA, one row per document of them. Files are dealt to tasks by name and number; each is opened where it is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
        for b in batches:
            for bucket, part, first in zip(*(c.to_pylist() for c in b.columns)):
                with store.open_input_file(f"{folder}/{_name(bucket, part)}") as source:
                    data = source.read()
                out = []
                for doc_id, start, ids in read_file(data):
                    out.append((doc_id, first + start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))))
                    if len(out) >= 8192:
                        yield batch(out)
                        out = []
                if out:
                    yield batch(out)

    return files.select("bucket", "part", "first").repartition(bucket_count(files), "bucket", "part").mapInArrow(released(run), SCHEMA)


def token_files(docs: DataFrame, path: str | None = None, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files and reads them back: -> SCHEMA, one row per input row.

    Null and empty texts hold the end id alone. Null ids come first, ties in the order of a hash of their texts and then of the texts. Very long texts take their
    memory in one task and span blocks like any other. An empty table writes no file and gives no rows; other columns are ignored.
    """
    path = path or scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, path, tokenizer, end_id, file_ids), path)
