"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots. Bytes are summed per slot, and a small versioned
table maps slots to shards; balancing or adding a shard edits that table, so only the records of
moved slots move. The table has ``slots`` rows whatever the data: that is the proof for its
broadcast and for handling it on the driver.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlasmill.llm.common import shared_folder, stage

SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """Shard of every slot; ``version`` counts the edits."""
    shards: tuple[int, ...]
    n_shards: int
    version: int = 0

    def moved(self, other: "SlotMap") -> int:
        return sum(a != b for a, b in zip(self.shards, other.shards))


def first_map(n_shards: int, slots: int = SLOTS) -> SlotMap:
    return SlotMap(tuple(s % n_shards for s in range(slots)), n_shards)


def rebalance(current: SlotMap, weight: list[int]) -> SlotMap:
    """Move slots from the fullest to the emptiest shard while that narrows their distance.

    Each step moves the slot whose weight is nearest to half the distance, so the distance falls
    until no slot of the fullest shard fits; the shards then differ by less than its smallest slot.
    """
    shards = list(current.shards)
    held: list[list[tuple[int, int]]] = [[] for _ in range(current.n_shards)]
    for slot, shard in enumerate(shards):
        if weight[slot]:
            held[shard].append((weight[slot], slot))
    for own in held:
        own.sort()
    load = [sum(w for w, _ in own) for own in held]
    while True:
        low = min(range(len(load)), key=lambda k: (load[k], k))
        best = None
        for high in sorted(range(len(load)), key=lambda k: (-load[k], k)):
            gap = load[high] - load[low]
            at = bisect_left(held[high], (gap // 2 + 1, -1))
            fits = [held[high][k] for k in (at - 1, at) if 0 <= k < len(held[high]) and held[high][k][0] < gap]
            if fits:
                best = high, min(fits, key=lambda x: (abs(2 * x[0] - gap), x))
                break
        if best is None:
            break
        high, (w, slot) = best
        held[high].remove((w, slot))
        insort(held[low], (w, slot))
        load[high] -= w
        load[low] += w
        shards[slot] = low
    return SlotMap(tuple(shards), current.n_shards, current.version + 1)


def add_shard(current: SlotMap, weight: list[int]) -> SlotMap:
    """One more shard, filled by slots of the fullest ones; slots move into it only."""
    shards, new = list(current.shards), current.n_shards
    load = [0] * new
    held: list[list[tuple[int, int]]] = [[] for _ in range(new)]
    for slot, shard in enumerate(shards):
        load[shard] += weight[slot]
        insort(held[shard], (weight[slot], slot))
    share, taken = sum(load) / (new + 1), 0
    while True:
        high = max(range(new), key=lambda k: (load[k], -k))
        at = bisect_left(held[high], (int(share - taken) + 1, -1)) - 1
        if at < 0 or held[high][at][0] == 0:
            break
        w, slot = held[high].pop(at)
        load[high] -= w
        taken += w
        shards[slot] = new
    return SlotMap(tuple(shards), new + 1, current.version + 1)


def store_map(spark: SparkSession, slot_map: SlotMap, folder: str) -> None:
    """Add a version to a stored table of maps."""
    rows = [(slot_map.version, k, s) for k, s in enumerate(slot_map.shards)]
    spark.createDataFrame(rows, "version int, virtual_slot int, shard int").write.mode("append").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
    maps = spark.read.parquet(folder)
    version = maps.agg(F.max("version")).first()[0] if version is None else version
    rows = sorted(maps.filter(F.col("version") == version).select("virtual_slot", "shard").collect())
    return SlotMap(tuple(r.shard for r in rows), max(r.shard for r in rows) + 1, version)


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(doc_id, size, text_crc32, virtual_slot)``. A null text has no bytes; 8 are added to every size.

    The slot is a hash of id, size and checksum, so rows without an id still spread. Equal rows are counted
    first, and the hash of each takes in its number among them, so they spread over the slots too.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = sized.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    each = counted.select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("turn"))
    first = F.xxhash64("doc_id", "size", "text_crc32")
    hashed = F.when(F.col("turn") == 1, first).otherwise(F.xxhash64("doc_id", "size", "text_crc32", "turn"))
    return each.select("doc_id", "size", "text_crc32", F.pmod(hashed, F.lit(slots)).cast("int").alias("virtual_slot"))


def shard(docs: DataFrame, n_shards: int = 24, slots: int = SLOTS, current: SlotMap | None = None, folder: str | None = None) -> DataFrame:
    """Shard and gapless place inside the shard of every row, sizes of shards nearly equal.

    Law ``bytes``: the map (the given one, else round robin) is edited by the bytes per slot, and
    the new version is stored in ``folder`` (a new shared folder if none is given). Shards differ
    by little more than one slot, or by one record where a record outweighs a shard. Places are
    numbered per slot, a slot being a bounded part of the data, and shifted by the rows of the
    slots before it in its shard. Equal rows spread over slots. An empty table gives no row.
    """
    spark = docs.sparkSession
    rows = stage(records(docs, slots), "records")
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    weight, count = [0] * slots, [0] * slots
    for r in sums:  # one row a slot at most
        weight[r.virtual_slot], count[r.virtual_slot] = r.bytes, r.n
    new = rebalance(current or first_map(n_shards, slots), weight)
    store_map(spark, new, folder or shared_folder(spark, "slot-map"))
    before, filled = [0] * slots, [0] * new.n_shards
    for k, s in enumerate(new.shards):
        before[k] = filled[s]
        filled[s] += count[k]
    places = spark.createDataFrame([(k, s, before[k]) for k, s in enumerate(new.shards)], "virtual_slot int, shard int, before long")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    return (rows.withColumn("place", F.row_number().over(order)).join(F.broadcast(places), "virtual_slot")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                    "virtual_slot", F.lit(new.version).alias("map_version")))
