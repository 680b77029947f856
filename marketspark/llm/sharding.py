"""Byte-balanced shards by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.llm.common import cut, table

#: Partial partitions that one task combines, about. A group of over 1 / ITEMS of all bytes is broadcast, so there are
#: fewer than ITEMS of those.
ITEMS = 4096


def difference(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """slots: sums of n partial partitions (n x shards). The two with the largest spread are combined again and again, the
    heaviest slot of one with the lightest of the other, until one is left. Returns the shard of each slot (n x shards)
    and the sums of the shards. Ties go by the order of the rows."""
    n, shards = slots.shape
    heap = []
    for i, row in enumerate(slots.tolist()):
        # members are nested pairs, so that joining two slots costs the same at any size
        ordered = sorted(((x, (i * shards + k,)) for k, x in enumerate(row)), key=lambda s: s[0])
        heap.append((ordered[0][0] - ordered[-1][0], i, ordered))
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        both = sorted(((a[0] + b[0], (a[1], b[1])) for a, b in zip(one, reversed(two), strict=True)), key=lambda s: s[0])
        order += 1
        heapq.heappush(heap, (both[0][0] - both[-1][0], order, both))
    out, sums = np.zeros(n * shards, dtype=np.int64), np.zeros(shards, dtype=np.int64)
    for shard, (total, members) in enumerate(heap[0][2] if heap else []):
        sums[shard], stack = total, [members]
        while stack:
            m = stack.pop()
            if len(m) == 1:
                out[m[0]] = shard
            else:
                stack += m
    return out.reshape(n, shards), sums


def _alone(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Groups as partial partitions: the group in slot 0, nothing in the others."""
    slots = np.zeros((len(sizes), shards), dtype=np.int64)
    slots[:, 0] = sizes
    return slots


def assigned(groups: DataFrame, number: int, items: int = ITEMS) -> DataFrame:
    """groups(key, bytes) with a shard each: key, shard.

    A group that holds an even share of what is left, or more, has a shard alone (the last ones); the others are
    differenced over the remaining shards.     Differencing joins partial partitions in any number of steps: buckets of about `items` groups give one partial
    partition each, buckets of about `items` of those the next ones, until one is left. Every group is differenced, and
    no task holds more than a bucket."""
    count, left = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    alone: list[tuple[str, int]] = []
    for key, size in groups.orderBy(F.desc("bytes"), "key").limit(number).collect():
        if number - len(alone) > 1 and count > number and size * (number - len(alone)) >= left:
            left, alone = left - size, [*alone, (key, number - 1 - len(alone))]
    number -= len(alone)
    groups = groups.where(~F.col("key").isin([k for k, _ in alone]))

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "key"], ascending=[False, True], ignore_index=True)
        slot, sums = difference(_alone(rows["bytes"].to_numpy(), number))
        return pd.DataFrame({"bucket": rows["bucket"], "key": rows["key"], "slot": slot[:, 0], "sums": [sums] + [None] * (len(rows) - 1)})

    def further(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket", ignore_index=True)
        slot, sums = difference(np.stack(rows["sums"].to_list()))
        return pd.DataFrame({"above": rows["above"], "bucket": rows["bucket"], "slots": list(slot), "sums": [sums] + [None] * (len(rows) - 1)})

    buckets = max(1, -(-count // items))
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    dealt = cut(dealt.groupBy("bucket").applyInPandas(first, "bucket long, key string, slot int, sums array<long>"))
    level, placed = dealt.where("sums is not null").select("bucket", "sums"), dealt.select("bucket", "key", "slot")
    while buckets > 1:
        buckets = -(-buckets // items)
        up = cut(level.withColumn("above", F.pmod("bucket", F.lit(buckets))).groupBy("above").applyInPandas(further, "above long, bucket long, slots array<int>, sums array<long>"))
        placed = placed.join(up.select("bucket", "above", "slots"), "bucket").select(F.col("above").alias("bucket"), "key", F.element_at("slots", F.col("slot") + 1).alias("slot"))
        level = up.where("sums is not null").select(F.col("above").alias("bucket"), "sums")
    large = groups.sparkSession.createDataFrame(alone, "key string, shard int")
    return placed.select("key", F.col("slot").cast("int").alias("shard")).union(large)


def shards(docs: DataFrame, number: int = 16, items: int = ITEMS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, size (UTF-8 bytes and 1), text_crc32, law ("bytes"), shard from 0,
    slot (gapless from 0 in each shard), grown_shard (null: the law is not by key).

    Equal texts are one group, null with empty ones, and a group is never divided: one that holds more than an even shard
    has a shard alone, and the others share the rest evenly. Repeated rows stay; null ids are kept; other
    columns are ignored; an empty table gives no rows."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("key"))
    # the checkpoint's partitions do not change, so a row's partition and place can name it
    rows = cut(rows).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    found = cut(assigned(groups, number, items).join(groups, "key").select("key", "shard", (F.col("bytes") > total / ITEMS).alias("large")))
    # under ITEMS rows: each holds over 1 / ITEMS of the bytes; what is left has no hot key
    large = F.broadcast(found.where("large").select("key", F.col("shard").alias("of_large")))
    known = rows.join(large, "key", "left")
    small = known.where("of_large is null").join(found.where("not large").select("key", "shard"), "key")
    columns = ["doc_id", "size", "text_crc32", "shard", "part", "place"]
    placed = cut(known.where("of_large is not null").withColumnRenamed("of_large", "shard").select(columns).union(small.select(columns)))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("place"))
    return placed.withColumn("inside", inside).join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("inside") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))
