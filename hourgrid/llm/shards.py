"""Sharding through fixed virtual slots: records hash into thousands of slots, and a versioned map gives a slot's shard.

Only the map decides where a slot lives. Rebalancing reads the bytes of each slot, moves whole slots between shards and
stores the edited map as a new version; records never change their slot.
"""
from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import new_path, stored

SLOTS = 4096
COPIES = 10_000
MAP_SCHEMA = "version int, virtual_slot int, shard int"


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot``; size is the UTF-8 length plus 1 (a null text counts as empty).

    The slot comes from the id, the text's checksum and the number of a row among rows equal in both, never from the text
    alone, so groups of equal texts and repeated rows spread over all slots, also where one holds a third of all rows. Repeated
    rows are counted on the map side and put back in chunks of ``COPIES``, so no task makes a whole group of them.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                        F.crc32(text).alias("text_crc32"))
    counted = plain.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    chunks = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long"))))
    every = chunks.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("_copy", F.explode(
        F.sequence(F.col("_from"), F.least(F.col("_from") + COPIES, F.col("_n")) - 1)))
    mark = F.when(F.col("_copy") == 0, F.xxhash64("doc_id", "text_crc32")).otherwise(F.xxhash64("doc_id", "text_crc32", "_copy"))
    return every.select("doc_id", "size", "text_crc32", F.pmod(mark, F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_loads(records: DataFrame) -> DataFrame:
    """Bytes and rows of each slot that holds any: at most as many rows as there are slots."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def first_map(slots: int, shards: int) -> list[int]:
    """Version 1: equal runs of slots."""
    return [s * shards // slots for s in range(slots)]


def rebalanced(current: list[int], loads: dict[int, int], shards: int) -> list[int]:
    """An edited copy of ``current`` whose shards hold nearly equal bytes.

    Shards above the mean give up slots, smallest first, until one more would take them below it; the slots given up
    go, largest first, to the shard that holds least. Ties go to the smaller number, so the same loads give the same map.
    """
    mean = sum(loads.values()) / shards
    held: dict[int, list[int]] = {k: [] for k in range(shards)}
    total = [0] * shards
    for slot, shard in enumerate(current):
        held[shard].append(slot)
        total[shard] += loads.get(slot, 0)
    moving = []
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda s: (loads.get(s, 0), s)):
            if total[shard] <= mean:
                break
            if loads.get(slot, 0):
                moving.append(slot)
                total[shard] -= loads[slot]
    heap = [(total[k], k) for k in range(shards)]
    heapq.heapify(heap)
    edited = list(current)
    for slot in sorted(moving, key=lambda s: (-loads[s], s)):
        least, shard = heapq.heappop(heap)
        edited[slot] = shard
        heapq.heappush(heap, (least + loads[slot], shard))
    return edited


def store_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> DataFrame:
    """Add one version to the stored map; earlier versions stay."""
    rows = [(version, slot, shard) for slot, shard in enumerate(shard_of)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(MAP_SCHEMA).parquet(path)


def sharded(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Each record with its shard and its position in that shard.

    Columns ``doc_id, size, text_crc32, virtual_slot, shard, position, map_version``. Law: bytes, the sums of ``size``
    per shard are near equal. Positions run from 0 without gaps inside a shard, by virtual slot and then by (doc_id,
    text_crc32, size); rows equal in all of these are interchangeable. Null ids, null and empty texts are records like
    others; an empty table gives no rows. Windows hold one virtual slot, never a shard. The driver sees one number for
    each slot.
    """
    spark = docs.sparkSession
    records = stored(with_slots(docs, slots), "slotted")
    loads = {r["virtual_slot"]: (r["slot_bytes"], r["slot_rows"]) for r in slot_loads(records).collect()}
    path = map_path or new_path(spark, "slot-map")
    shard_of = first_map(slots, shards)
    store_map(spark, path, 1, shard_of)
    shard_of = rebalanced(shard_of, {s: b for s, (b, _) in loads.items()}, shards)
    versions = store_map(spark, path, 2, shard_of)
    before, start = [0] * shards, []
    for slot in range(slots):
        start.append((slot, before[shard_of[slot]]))
        before[shard_of[slot]] += loads.get(slot, (0, 0))[1]
    starts = spark.createDataFrame(start, "virtual_slot int, before long")
    places = versions.where("version = 2").join(starts, "virtual_slot")
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    # The map has one row for each slot, some thousands whatever the input.
    return (records.withColumn("_row", F.row_number().over(in_slot) - 1).join(F.broadcast(places), "virtual_slot")
            .select("doc_id", "size", "text_crc32", "virtual_slot", "shard",
                    (F.col("before") + F.col("_row")).alias("position"), F.col("version").alias("map_version")))
