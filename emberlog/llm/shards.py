"""Sharding by fixed virtual slots, in DataFrame operations only.

A record belongs for ever to the virtual slot that the hash of its key names; a slot belongs to a
shard by a versioned map of a few thousand rows. Bytes are summed per slot, and the map is edited:
rebalancing moves or swaps as few slots as bring the shards' bytes together, growing hands slots to
the new shard only. Records never move between slots, so a new version of the map tells exactly
which slots travel. The map has one row per slot whatever the corpus holds, so it is edited on the
driver and broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm.common import shared_folder, text_or_empty, written

SLOTS = 8192
#: Bytes that a record takes beside its text.
RECORD_BYTES = 8


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] for every virtual slot; the version goes up with each edit."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def even(shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(0, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, slot_bytes: dict[int, int], tolerance: float = 1e-4) -> SlotMap:
        """The map after moving slots from the fullest shard to the emptiest, or swapping two, while that narrows the gap."""
        shard_of, slots_in = list(self.shard_of), [set() for _ in range(self.shards)]
        load = [0] * self.shards
        for slot, shard in enumerate(shard_of):
            load[shard] += slot_bytes.get(slot, 0)
            if slot_bytes.get(slot, 0):
                slots_in[shard].add(slot)
        stop = tolerance * sum(load) / self.shards
        for _ in range(4 * len(shard_of)):
            high, low = max(range(self.shards), key=load.__getitem__), min(range(self.shards), key=load.__getitem__)
            gap = load[high] - load[low]
            if gap <= stop:
                break
            best = self._edit(sorted(slots_in[high], key=lambda s: (slot_bytes[s], s)), sorted(slots_in[low], key=lambda s: (slot_bytes[s], s)), slot_bytes, gap)
            if best is None:
                break
            out, back = best
            for slot, start, end in ((out, high, low), (back, low, high)):
                if slot is not None:
                    slots_in[start].discard(slot)
                    slots_in[end].add(slot)
                    shard_of[slot] = end
                    load[start] -= slot_bytes[slot]
                    load[end] += slot_bytes[slot]
        return replace(self, version=self.version + 1, shard_of=tuple(shard_of))

    @staticmethod
    def _edit(high: list[int], low: list[int], size: dict[int, int], gap: int):
        """The slot to hand over and the one to take back (or None) that leave the smallest gap; None if none helps."""
        best, best_left, k = None, gap, 0
        for out in high:
            while k < len(low) and size[out] - size[low[k]] > gap / 2:
                k += 1
            for back in (None, *low[max(0, k - 1) : k + 1]):
                moved = size[out] - (size[back] if back is not None else 0)
                if 0 < moved < gap and (left := abs(gap - 2 * moved)) < best_left:
                    best, best_left = (out, back), left
        return best

    def grown(self, slot_bytes: dict[int, int]) -> SlotMap:
        """One more shard: slots move only into it, from the fullest shard each time, until it holds its share."""
        new, shard_of = self.shards, list(self.shard_of)
        load, slots_in = [0] * (new + 1), [[] for _ in range(new + 1)]
        for slot, shard in enumerate(shard_of):
            load[shard] += slot_bytes.get(slot, 0)
            slots_in[shard].append(slot)
        share = sum(load) / (new + 1)
        for slots in slots_in:
            slots.sort(key=lambda s: (slot_bytes.get(s, 0), s))
        while True:
            high = max(range(new), key=load.__getitem__)
            fits = [s for s in slots_in[high] if 0 < slot_bytes.get(s, 0) <= share - load[new] + slot_bytes.get(s, 0) / 2]
            if not fits or load[high] <= share:
                break
            slot = fits[-1]
            slots_in[high].remove(slot)
            shard_of[slot] = new
            load[high] -= slot_bytes[slot]
            load[new] += slot_bytes[slot]
        return SlotMap(self.version + 1, new + 1, tuple(shard_of))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, s, x) for s, x in enumerate(self.shard_of)], "version int, virtual_slot int, shard int")


def store(spark: SparkSession, maps: list[SlotMap], path: str | None = None) -> str:
    """Appends map versions to a table (version, virtual_slot, shard); gives its path."""
    path = path or shared_folder(spark)
    for m in maps:
        m.table(spark).coalesce(1).write.mode("append").parquet(path)
    return path


def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version of the map, the last one if none is named."""
    table = spark.read.parquet(path)
    version = version if version is not None else table.agg(F.max("version")).first()[0]
    rows = table.where(F.col("version") == version).orderBy("virtual_slot").collect()
    return SlotMap(version, 1 + max(r.shard for r in rows), tuple(r.shard for r in rows))


def slotted(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """key, size, text_crc32, virtual_slot of each record. Null text: no bytes; a null key has a slot like any other."""
    return docs.select(
        F.col(key),
        (F.octet_length(text_or_empty()).cast("long") + RECORD_BYTES).alias("size"),
        F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def place(docs: DataFrame, shards: int, slots: int = SLOTS, key: str = "doc_id", slot_map: SlotMap | None = None) -> tuple[DataFrame, SlotMap]:
    """Every record with its shard and its place there, and the map that decided.

    Without a map, one is made from the bytes per slot. Places count from 0 in each shard without
    gaps: the slots of a shard follow each other, and records within a slot go by key, then size
    and checksum (repeated rows in any order). Numbering is by slot, so no task holds a shard.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = written(slotted(docs, slots, key))
    sums = {r.virtual_slot: (r.bytes, r.rows) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    if slot_map is None:
        slot_map = SlotMap.even(shards, slots).rebalanced({s: b for s, (b, _) in sums.items()})
    filled, before = [0] * slot_map.shards, []
    for slot, shard in enumerate(slot_map.shard_of):
        before.append((slot, shard, filled[shard]))
        filled[shard] += sums.get(slot, (0, 0))[1]
    where = spark.createDataFrame(before, "virtual_slot int, shard int, before long")
    in_slot = Window.partitionBy("virtual_slot").orderBy(key, "size", "text_crc32")
    placed = rows.withColumn("nth", F.row_number().over(in_slot)).join(F.broadcast(where), "virtual_slot")
    return placed.select(key, "size", "text_crc32", "shard", (F.col("before") + F.col("nth") - 1).alias("slot"), "virtual_slot"), slot_map
