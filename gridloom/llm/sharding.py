"""Sharding by fixed virtual slots.

Every record hashes into one of ``SLOTS`` virtual slots by its key and content; bytes and rows are summed per slot; a
versioned map says which shard holds which slot. The first version deals slots to shards largest first, each to the
lightest shard, so that shards' bytes come out near equal. Rebalancing edits the map: it moves slots only, never single
records, and only out of shards that are over the new mean.

Only DataFrame functions touch records. What comes to the driver is one row per slot, SLOTS rows at most.

Nulls: a null text has no bytes, a null key hashes like any other value. Repeated rows share a slot. An empty table gives
an empty result. Columns named like those added are replaced.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096
#: A shard gives slots away only while it is over the mean by this share.
SLACK = 0.005


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] is the shard of a slot; an edit makes a new version."""

    shard_of: tuple[int, ...]
    shards: int
    version: int = 1

    def loads(self, sizes: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += sizes[slot]
        return out


def deal(sizes: list[int], shards: int) -> SlotMap:
    """Version 1: slots from largest to smallest, each to the shard with the fewest bytes, ties to the smaller shard."""
    heap = [(0, shard) for shard in range(shards)]
    out = [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes[slot], shard))
    return SlotMap(tuple(out), shards)


def rebalance(current: SlotMap, sizes: list[int], shards: int) -> SlotMap:
    """The next version for a changed number of shards or changed sizes.

    Slots of shards that no longer exist move, and slots of shards over the mean by more than SLACK as long as the
    receiving shard stays at the mean or below; all others stay where they are.
    """
    out = list(current.shard_of)
    mean = sum(sizes) / shards
    loads = [0] * shards
    homeless = []
    by_shard: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        if shard < shards:
            loads[shard] += sizes[slot]
            by_shard[shard].append(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-sizes[s], s)):
        shard = min(range(shards), key=lambda k: (loads[k], k))
        out[slot], loads[shard] = shard, loads[shard] + sizes[slot]
    for shard in sorted(range(shards), key=lambda k: (-loads[k], k)):
        for slot in sorted(by_shard[shard], key=lambda s: (-sizes[s], s)):
            light = min(range(shards), key=lambda k: (loads[k], k))
            if sizes[slot] and loads[shard] > mean * (1 + SLACK) and loads[light] + sizes[slot] <= mean:
                out[slot] = light
                loads[shard] -= sizes[slot]
                loads[light] += sizes[slot]
    return SlotMap(tuple(out), shards, current.version + 1)


def store(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Add this version to the map's table: one row per slot."""
    shard = _lookup(list(slot_map.shard_of), "int", "id")
    spark.range(len(slot_map.shard_of)).select(F.col("id").alias("slot"), shard.alias("shard"), F.lit(slot_map.shards).alias("shards"), F.lit(slot_map.version).alias("version")).coalesce(1).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the stored map, the newest by default."""
    table = spark.read.parquet(path)
    wanted = table.agg(F.max("version")).first()[0] if version is None else version
    rows = table.filter(F.col("version") == wanted).orderBy("slot").collect()  # one row per slot
    return SlotMap(tuple(r.shard for r in rows), rows[0].shards, wanted)


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null, plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def slot_of(*columns: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def slot_totals(records: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """(bytes, rows) of each slot, from the columns virtual_slot and size."""
    sizes, rows = [0] * slots, [0] * slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():  # slots rows at most
        sizes[r.virtual_slot], rows[r.virtual_slot] = r["size"], r.n
    return sizes, rows


def _lookup(values: list[int], kind: str, slot: str = "virtual_slot") -> Column:
    """values[slot], from a constant array of one number per slot."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), F.col(slot).cast("int") + 1)


def assign(documents: DataFrame, slot_map: SlotMap, slots: int = SLOTS) -> DataFrame:
    """documents with virtual_slot, shard and map_version; no shuffle."""
    out = documents.withColumn("virtual_slot", slot_of(F.col("doc_id"), text_crc(F.col("text")), slots=slots))
    return out.withColumns({"shard": _lookup(list(slot_map.shard_of), "int"), "map_version": F.lit(slot_map.version)})


def sized(documents: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of each document."""
    return documents.select(F.col("doc_id"), text_size(F.col("text")).alias("size"), text_crc(F.col("text")).alias("text_crc32")).withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots=slots))


def place(documents: DataFrame, slot_map: SlotMap, rows: list[int], slots: int = SLOTS) -> DataFrame:
    """Each document's shard and its place there, gapless from 0.

    Places go by virtual slot, then doc_id, checksum and size. The rank within a slot needs one slot's keys in a task; the
    slot's first place in its shard is a running sum over the rows per slot.
    """
    first, filled = [0] * slots, [0] * slot_map.shards
    for slot, shard in enumerate(slot_map.shard_of):
        first[slot] = filled[shard]
        filled[shard] += rows[slot]
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (
        sized(documents, slots)
        .withColumn("place", rank)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            _lookup(list(slot_map.shard_of), "int").alias("shard"),
            (_lookup(first, "long") + F.col("place") - 1).alias("slot"),
            "virtual_slot",
            F.lit(slot_map.version).alias("map_version"),
        )
    )
