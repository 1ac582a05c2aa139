"""Byte-balanced shards by Karmarkar-Karp differencing of indivisible groups."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import positions, small, stored, text_or_empty

#: Items that one task differences; more items form more blocks, whose results are items again.
FAN_IN = 16_384


def difference(loads: np.ndarray) -> np.ndarray:
    """Target part of every part of every item: an array of the shape of ``loads`` (items, parts).

    The heap holds partial partitions, each as parts sorted from heavy to light with the lightest
    subtracted. The two of largest spread combine, the heavy parts of one on the light parts of the
    other. Parts of a merged partition are nodes of a forest; at the end each root is a target part.
    Ties go by item number.
    """
    items, parts = loads.shape
    left: list[int] = [-1] * (items * parts)
    right: list[int] = [-1] * (items * parts)
    heap = []
    for i in range(items):
        order = np.argsort(-loads[i], kind="stable")
        sums = loads[i][order].tolist()
        low = sums[-1]
        heap.append((low - sums[0], i, [s - low for s in sums], [i * parts + int(p) for p in order]))
    heapq.heapify(heap)
    count = items
    while len(heap) > 1:
        _, _, sa, na = heapq.heappop(heap)
        _, _, sb, nb = heapq.heappop(heap)
        merged = []
        for x, y, p, q in zip(sa, reversed(sb), na, reversed(nb), strict=True):
            left.append(p)
            right.append(q)
            merged.append((-(x + y), len(left) - 1))
        merged.sort()
        low = -merged[-1][0]
        heapq.heappush(heap, (low + merged[0][0], count, [-s - low for s, _ in merged], [n for _, n in merged]))
        count += 1
    target = np.full(len(left), -1, np.int64)
    if heap:
        for part, root in enumerate(heap[0][3]):
            target[root] = part
    for node in range(len(left) - 1, items * parts - 1, -1):  # children come before their parents
        target[left[node]] = target[node]
        target[right[node]] = target[node]
    return target[: items * parts].reshape(items, parts)


def _combine(key: str, parts: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", kind="stable")
        loads = np.array(rows["loads"].tolist(), np.int64).reshape(len(rows), parts)
        target = difference(loads)
        total = np.zeros(parts, np.int64)
        np.add.at(total, target.ravel(), loads.ravel())
        out = pd.DataFrame({"item": rows["item"].to_numpy(), key: rows[key].to_numpy(), "target": target.tolist()})
        out["total"] = [total.tolist() if i == 0 else None for i in range(len(out))]
        return out

    return block


def balance(groups: DataFrame, shards: int, fan_in: int = FAN_IN) -> DataFrame:
    """Shard of every group: ``groups`` (item binary, bytes long) to (item, shard).

    Blocks of about ``fan_in`` groups, chosen by hash, are differenced in parallel; the partial
    partition of each block is an item of the next level, and so on until one is left. The number of
    blocks follows the number of groups, so no task grows with the input. Every level is stored.
    """
    blocks = max(1, -(-groups.count() // fan_in))
    vector = F.array(F.col("bytes").cast("long"), *[F.lit(0).cast("long")] * (shards - 1))
    level = groups.select("item", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), vector.alias("loads"))
    schema = "item binary, block bigint, target array<bigint>, total array<bigint>"
    done = stored(level.groupBy("block").applyInPandas(_combine("block", shards), schema), "shard-level")
    route = done.select("item", "block", F.col("target")[0].cast("int").alias("part"))
    while True:
        upper = done.filter("total IS NOT NULL").select(F.col("block").alias("item"), F.col("total").alias("loads"))
        if blocks == 1:
            return route.select("item", F.col("part").alias("shard"))
        blocks = -(-blocks // fan_in)
        upper = upper.withColumn("block", F.pmod("item", F.lit(blocks)))
        schema = "item bigint, block bigint, target array<bigint>, total array<bigint>"
        done = stored(upper.groupBy("block").applyInPandas(_combine("block", shards), schema), "shard-level")
        steps = done.select(F.col("item").alias("_from"), F.col("block").alias("_to"), "target")
        route = route.join(small(steps), F.col("block") == F.col("_from")).select(
            "item", F.col("_to").alias("block"), F.element_at("target", F.col("part") + 1).cast("int").alias("part")
        )


def shard_documents(docs: DataFrame, shards: int = 16, fan_in: int = FAN_IN) -> DataFrame:
    """Law ``bytes``: documents with equal texts stay together, and shards get near equal bytes.

    Returns doc_id, size (UTF-8 bytes + 1, null text as empty), text_crc32, law, shard, slot (places
    from 0 in each shard, by doc_id, then text) and grown_shard (null under this law), one row per
    row of ``docs``. A null text and an empty one are equal. Repeated rows take slots of their own;
    null ids come first. An empty table gives no rows; other columns play no part. The spread is at
    most what the largest group forces.
    """
    text = text_or_empty().cast("binary")
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("item"),
        ),
        "shard-rows",
    )
    groups = stored(rows.groupBy("item").agg(F.sum("size").alias("bytes")), "shard-groups")
    where = stored(balance(groups, shards, fan_in), "shard-map")
    placed = positions(rows.join(where, "item"), ["shard"], ["doc_id", "item"], "slot", "shard-slots")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
