"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts.

Law `bytes`: shards come near equal in bytes. Groups are dealt to bins by a hash of their digest; in each bin the two partial
partitions of largest spread are combined in opposite order until one is left. The bins' partial partitions are combined the same
way, level by level, so that no task and no driver ever holds all groups, and the last level combines at most `fan` of them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import materialise, plain_text


def difference(vectors: np.ndarray) -> np.ndarray:
    """vectors (n, k): the sums in the k slots of n partial partitions -> (n, k), the final slot of each slot.

    Repeatedly takes the two of largest spread and adds the largest sums of one to the smallest of the other. Ties fall to the lower position.
    """
    n, k = vectors.shape
    order = np.argsort(-vectors, axis=1, kind="stable")
    sums = list(np.take_along_axis(vectors, order, axis=1))
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        s = sums[a] + sums[b][::-1]
        perm = np.argsort(-s, kind="stable")
        s = s[perm]
        sums[a] = sums[b] = None
        sums.append(s)
        made.append((a, b, perm))
        heapq.heappush(heap, (-int(s[0] - s[-1]), len(sums) - 1))
    label: list[np.ndarray | None] = [None] * len(sums)
    label[-1] = np.arange(k)
    for at in range(len(made) - 1, -1, -1):
        a, b, perm = made[at]
        top = label[n + at]
        label[n + at] = None
        la, lb = np.empty(k, np.int64), np.empty(k, np.int64)
        la[perm] = top
        lb[k - 1 - perm] = top
        label[a], label[b] = la, lb
    out = np.empty((n, k), np.int64)
    np.put_along_axis(out, order, np.stack(label[:n]), axis=1)
    return out


def shard_documents(docs: DataFrame, shards: int = 16, bin_groups: int = 4096, fan: int = 512) -> DataFrame:
    """-> doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per input row.

    Null texts count as empty (size 1, crc 0). Repeated rows and equal texts stay together: a group larger than a shard's share is not cut, so the
    other shards are filled evenly around it. An empty table gives no rows; other columns are ignored. Slots count from 0 in each shard, gapless,
    in the order of a hash of doc_id. bin_groups and fan bound what one task combines.
    """
    text = plain_text().cast("binary")
    rows = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")),
        "shard-rows",
    )
    n_rows = rows.count()
    bins = max(1, -(-n_rows // bin_groups))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes")).withColumn("node", F.pmod(F.xxhash64("digest"), F.lit(bins)))

    def in_bin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("digest", kind="stable")
        vectors = np.zeros((len(pdf), shards), np.int64)
        vectors[:, 0] = pdf["bytes"].to_numpy()
        return pd.DataFrame({"digest": pdf["digest"], "node": pdf["node"], "slot": difference(vectors)[:, 0], "bytes": pdf["bytes"]})

    placed = materialise(groups.groupBy("node").applyInPandas(in_bin, "digest binary, node long, slot long, bytes long"), "shard-bins")

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(pdf["node"].to_numpy(), return_inverse=True)
        vectors = np.zeros((len(nodes), shards), np.int64)
        vectors[at, pdf["slot"].to_numpy()] = pdf["bytes"].to_numpy()
        up = difference(vectors)
        return pd.DataFrame({"node": np.repeat(nodes, shards), "slot": np.tile(np.arange(shards), len(nodes)), "parent": np.repeat(pdf["parent"].iloc[0], up.size), "up": up.ravel()})

    mapping, sums, width = None, placed.groupBy("node", "slot").agg(F.sum("bytes").alias("bytes")), bins
    while True:
        width = -(-width // fan)
        step = materialise(sums.withColumn("parent", F.floor(F.col("node") / fan)).groupBy("parent").applyInPandas(combine, "node long, slot long, parent long, up long"), "shard-level")
        sums = sums.join(step, ["node", "slot"]).groupBy(F.col("parent").alias("node"), F.col("up").alias("slot")).agg(F.sum("bytes").alias("bytes"))
        if mapping is None:
            mapping = step
        else:
            mapping = mapping.select(F.col("node").alias("low"), F.col("slot").alias("low_slot"), F.col("parent").alias("node"), F.col("up").alias("slot")).join(step, ["node", "slot"]).select(F.col("low").alias("node"), F.col("low_slot").alias("slot"), "parent", "up")
        if width <= 1:
            break
    homes = placed.join(mapping, ["node", "slot"]).select("digest", F.col("up").cast("int").alias("shard"))
    cells = max(32, n_rows // 200_000)
    dealt = materialise(rows.join(homes, "digest").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)).alias("cell")), "shard-dealt")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size"))
    return (
        dealt.withColumn("n", local)
        .join(offsets, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
