"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two 64-bit fingerprints at 3 or fewer differing bits differ in at most 3 of their 8 bytes, so they are sure to share 5 positional bytes.
The 14 planes of the affine space of the 8 positions (the 4-sets whose numbers xor to 0) meet every such pair: any 3 positions lie in one
plane, and the pair agrees on the whole of the plane's complement, itself a plane. Posting lists are therefore keyed by the 4 positional
bytes of a plane instead of a single byte, whose lists would hold a 256th of all fingerprints each. Within a list, shared positional
bytes are tallied for each pair, and only pairs of the guaranteed 5 have their differing bits counted; the links of a spanning forest leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import bucket_count, materialise, packed, plain_text, released
from quillspan.llm.components import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Positions shared at least: 8 bytes less one for each differing bit.
GUARANTEED = 8 - MAX_BITS
#: Fingerprints in a list that one task compares whole.
HEAVY = 16_384
PLANES = sorted({tuple(sorted((a, b, c, a ^ b ^ c))) for a in range(8) for b in range(a) for c in range(b)})


def fingerprint(text: str | None, width: int = SHINGLE, chunk: int = 65536) -> int:
    """The text's 64-bit fingerprint; 0 without words. bytes.lower() and bytes.split() know ASCII letters and ASCII white space alone."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: len(words) - width])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], SEED) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), chunk):
        part = np.array(hashes[at : at + chunk], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def text_key() -> Column:
    """Tells the texts of rows that share a doc_id apart; null counts as empty."""
    return F.md5(plain_text().cast("binary"))


def fingerprints(docs: DataFrame, *keys: Column) -> DataFrame:
    """-> doc_id, fp (the fingerprint's bits as a long), then the string columns in keys as key0, key1 and so on."""
    names = [f"key{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[k.alias(n) for k, n in zip(keys, names)])
    return rows.mapInArrow(released(run), ", ".join(["doc_id long", "fp long", *[f"{n} string" for n in names]]))


def _links(run: np.ndarray, rows: int = 256, columns: int = 8192) -> list[tuple[int, int]]:
    """Spanning forest of the verified pairs in one posting list of distinct fingerprints, compared in blocks of rows x columns."""
    run = run.view(np.uint64)
    n = len(run)
    label = np.arange(n)
    out = []
    for at in range(0, n, rows):
        for to in range(at, n, columns):
            part = run[at : at + rows, None] ^ run[None, to : to + columns]
            shared = (np.ascontiguousarray(part).view(np.uint8).reshape(part.shape + (8,)) == 0).sum(axis=2, dtype=np.uint8)
            near = shared >= GUARANTEED
            near[near] = np.bitwise_count(part[near]) <= MAX_BITS
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                own = label[at + i]
                js = to + np.flatnonzero(near[i])
                found, first = np.unique(label[js], return_index=True)
                for other, k in zip(found.tolist(), first.tolist()):
                    if other != own:
                        out.append((int(run[at + i].view(np.int64)), int(run[js[k]].view(np.int64))))
                        label[label == other] = own
    return out


def links(distinct: DataFrame, heavy_list: int = HEAVY) -> DataFrame:
    """distinct (fp) -> (a, b): fingerprints at 3 or fewer bits, enough of them to connect all that are linked.

    A list holds distinct fingerprints only, however many documents share one. A list of over HEAVY of them is cut into blocks by a hash, and every two blocks are
    compared in a list of their own, so no task compares more than a few blocks at a time.
    """
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = []
    for at, plane in enumerate(PLANES):
        key = F.lit(at).cast("long") * F.lit(1 << 32)
        for i, p in enumerate(plane):
            key = key + byte(p) * F.lit(1 << (8 * i))
        keys.append(key)
    n = bucket_count(distinct)
    posting = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    heavy = materialise(posting.groupBy("key").count().where(F.col("count") > heavy_list).select("key", F.ceil(F.col("count") * 2 / heavy_list).alias("blocks")), "simhash-heavy")
    if heavy.limit(1).count():
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        cut = posting.join(heavy, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        cut = cut.select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
        posting = posting.join(heavy, "key", "left_anti").unionByName(cut, allowMissingColumns=False)
    posting = posting.select("fp", "key").repartition(n, "key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []
        empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])

        def done(parts: list[np.ndarray]) -> pa.RecordBatch:
            all_fp = np.concatenate(parts)
            if len(all_fp) < 2:
                return empty
            found = _links(all_fp)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        for b in batches:
            fp, key = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(key):
                continue
            cuts = np.flatnonzero(np.diff(key)) + 1
            bounds = np.concatenate(([0], cuts, [len(key)]))
            many = np.flatnonzero(np.diff(bounds) > 1).tolist()
            last = len(bounds) - 2
            for r in sorted({0, last, *many}):
                s, e = bounds[r], bounds[r + 1]
                if r == 0 and held and held_key == key[0]:
                    held.append(fp[s:e])
                    if last > 0:
                        yield done(held)
                        held = []
                    continue
                if r == 0 and held:
                    yield done(held)
                    held = []
                if r == last:
                    held_key, held = key[s], [fp[s:e]]
                elif e - s > 1:
                    yield done([fp[s:e]])
            held_key = key[-1]
        if held:
            yield done(held)

    return posting.mapInArrow(released(run), "a long, b long")


def homes(fps: DataFrame) -> DataFrame:
    """fps (doc_id, fp) -> fp, component_id; one row per distinct fingerprint. With key0 in fps also first: the component's least doc_id and key0, null ids last."""
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "key0")).alias("first")] if "key0" in fps.columns else []
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), *first)
    parts = connected_components(links(distinct.select("fp"))).select(F.col("node").alias("fp"), "component")
    columns = ["first"] if first else []
    named = materialise(distinct.join(parts, "fp", "left").select("fp", "least", *columns, F.coalesce("component", "fp").alias("component")), "simhash-parts")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), *[F.min(c).alias(c) for c in columns])
    return named.drop(*columns).join(least, "component").select("fp", "component_id", *columns)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """-> doc_id, fingerprint, component_id; one row per input row.

    Null and blank texts have fingerprint zero and are linked like any other; texts under three words are one shingle. Ties and repeated rows fall into the
    same component. A null doc_id never names a component unless all its ids are null. An empty table gives no rows; other columns are ignored.
    """
    fps = materialise(fingerprints(docs), "simhash")
    return fps.join(homes(fps), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs of the least doc_id in their component, and of its least text hash; all columns kept. Rows without an id come last.

    Rows that share a doc_id but not the text are judged apart, each in its own component. Rows equal in doc_id and text stay or go together.
    """
    fps = materialise(fingerprints(docs, text_key()), "simhash")
    gone = fps.join(homes(fps), "fp").where("not (doc_id <=> first.doc_id and key0 = first.key0)").select(F.col("doc_id").alias("gone"), "key0")
    gone = materialise(gone.distinct(), "simhash-gone")
    rows = packed(docs, doc_id=F.col("doc_id").cast("long"), key=text_key())
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")) & (F.col("key") == F.col("key0")), "left_anti").select("_row.*")
