"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of virtual slots, bytes are summed per
slot, and a versioned slot-to-shard map is edited when shards are rebalanced.
Only slot totals (``n_slots`` rows, a parameter) ever reach the driver.

Defined results: a null text has size 16 and the checksum of the empty text; a
null id hashes like any other value; repeated rows share a virtual slot, which
shards can't split, and get different places; an empty table gives an empty
result; columns of the input other than the id and the text are ignored,
whatever their names are. Fewer shards than before empty the last ones; a saved
map keeps its own number of slots.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OVERHEAD_BYTES = 16
#: Parts of a virtual slot that are numbered separately, so that repeated rows don't meet in one task.
PARTS = 16


@dataclass
class SlotMap:
    """Version and shard of every slot; an edit makes the next version."""

    n_shards: int
    shards: list[int]
    version: int = 0
    edits: list[tuple[int, int, int]] = field(default_factory=list)  # slot, old shard, new shard

    @classmethod
    def initial(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls(n_shards, [s % n_shards for s in range(n_slots)])

    def loads(self, slot_bytes: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shards):
            out[shard] += slot_bytes[slot]
        return out

    def edited(self, shards: list[int], n_shards: int | None = None) -> SlotMap:
        edits = [(s, a, b) for s, (a, b) in enumerate(zip(self.shards, shards, strict=True)) if a != b]
        return SlotMap(n_shards or self.n_shards, shards, self.version + 1, edits)

    def rebalance(self, slot_bytes: list[int], n_shards: int | None = None) -> SlotMap:
        """The next version, with shards as near in bytes as whole slots allow.

        Shards that are no more give up all slots, overfull ones their largest
        as long as they stay at or above the mean; those go to the lightest
        shard; then single moves and swaps between the heaviest and the
        lightest shard close the rest.
        """
        if len(slot_bytes) != len(self.shards):
            raise ValueError(f"the map has {len(self.shards)} slots, not {len(slot_bytes)}")
        n = n_shards or self.n_shards
        shards = list(self.shards)
        held: list[set[int]] = [set() for _ in range(n)]
        load = [0] * n
        loose = []
        for slot, shard in enumerate(shards):
            if shard >= n:
                loose.append(slot)
            else:
                held[shard].add(slot)
                load[shard] += slot_bytes[slot]
        mean = sum(slot_bytes) / n
        for shard in range(n):
            for slot in sorted(held[shard], key=lambda s: (-slot_bytes[s], s)):
                if slot_bytes[slot] and load[shard] - slot_bytes[slot] >= mean:
                    held[shard].discard(slot)
                    load[shard] -= slot_bytes[slot]
                    loose.append(slot)
        for slot in sorted(loose, key=lambda s: (-slot_bytes[s], s)):
            to = min(range(n), key=lambda k: (load[k], k))
            held[to].add(slot)
            load[to] += slot_bytes[slot]
        for _ in range(20 * n):
            hi, lo = max(range(n), key=lambda k: (load[k], -k)), min(range(n), key=lambda k: (load[k], k))
            gap = load[hi] - load[lo]
            best = (gap, -1, -1)
            low = sorted((slot_bytes[s], s) for s in held[lo])
            for a in held[hi]:
                for b, other in [(0, -1), *_nearest(low, slot_bytes[a] - gap / 2)]:
                    moved = slot_bytes[a] - b
                    if 0 < moved < gap:
                        best = min(best, (abs(gap - 2 * moved), a, other))
            if best[1] < 0 or best[0] >= gap:
                break
            _, a, b = best
            for slot, src, to in ((a, hi, lo), (b, lo, hi)):
                if slot >= 0:
                    held[src].discard(slot)
                    held[to].add(slot)
                    load[src] -= slot_bytes[slot]
                    load[to] += slot_bytes[slot]
        for shard, slots in enumerate(held):
            for slot in slots:
                shards[slot] = shard
        return self.edited(shards, n)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.n_shards, s, k) for s, k in enumerate(self.shards)], "map_version int, n_shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map's table; earlier versions stay readable."""
        self.frame(spark).coalesce(1).write.mode("append").partitionBy("map_version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """One version of a saved map; without a version, the latest."""
        df = spark.read.parquet(path)
        if version is None:
            version = df.agg(F.max("map_version")).first()[0]
        rows = df.where(F.col("map_version") == version).orderBy("virtual_slot").collect()  # n_slots rows
        return cls(rows[0]["n_shards"], [r["shard"] for r in rows], version)


def _nearest(ordered: list[tuple[int, int]], value: float) -> list[tuple[int, int]]:
    from bisect import bisect_left

    at = bisect_left(ordered, (value, -1))
    return ordered[max(0, at - 1) : at + 1]


def slotted(docs: DataFrame, n_slots: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32 and virtual_slot of every record; the text goes no further."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(OVERHEAD_BYTES)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_totals(rows: DataFrame, n_slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot: ``n_slots`` numbers each, summed on the executors."""
    size, count = [0] * n_slots, [0] * n_slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r[0]], count[r[0]] = r["b"], r["n"]
    return size, count


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = 4096, slot_map: SlotMap | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, SlotMap]:
    """Put every record into a shard by the rebalanced map.

    Returns the records (doc_id, size, text_crc32, virtual_slot, shard, slot,
    map_version), ``slot`` being the record's place in its shard from 0, and
    the new version of the map. A place is the number of rows in the shard's
    earlier virtual slots and in the slot's earlier parts, plus the rank within
    the own part. Texts are read once; what follows works on a written table of
    their sizes and checksums.
    """
    from .near import Scratch

    spark = docs.sparkSession
    old = slot_map or SlotMap.initial(n_slots, n_shards)
    n_slots = len(old.shards)
    rows = Scratch(spark, "slotted").keep(slotted(docs, n_slots, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int"))
    size, count = slot_totals(rows, n_slots)
    new = old.rebalance(size, n_shards)
    start, offset = [0] * n_slots, [0] * n_shards
    for s, k in enumerate(new.shards):
        start[s] = offset[k]
        offset[k] += count[s]
    places = spark.createDataFrame([(s, k, start[s]) for s, k in enumerate(new.shards)], "virtual_slot int, shard int, start long")
    before = F.sum("n").over(Window.partitionBy("virtual_slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("n")).select("virtual_slot", "part", F.coalesce(before, F.lit(0)).alias("before"))
    parts = parts.join(F.broadcast(places), "virtual_slot")  # n_slots rows
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "row"))
    out = rows.withColumn("rank", rank).join(F.broadcast(parts), ["virtual_slot", "part"])  # n_slots * PARTS rows
    slot = (F.col("start") + F.col("before") + F.col("rank") - 1).cast("long")
    return out.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", slot.alias("slot"), F.lit(new.version).alias("map_version")), new


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` by a stored map: version 0 deals slots in turn, version 1 is its rebalanced edit."""
    from .common import table
    from .near import Scratch

    path = f"{Scratch(spark, 'slots').path}/map"
    SlotMap.initial(4096, 40).save(spark, path)
    rows, new = shard(table(spark, sf_dir, "documents"), 40, slot_map=SlotMap.load(spark, path))
    new.save(spark, path)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
