"""Sharding through fixed virtual slots.

A record's hash names one of a few thousand slots for good. What moves between shards is slots, never single
records: bytes are summed per slot, and a versioned map from slot to shard is edited until shards weigh alike.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import utf8_crc32
from folioscope.session import cut


@dataclass(frozen=True)
class SlotMap:
    """version counts the edits; shards[i] is the shard of virtual slot i; moved holds the slots of the last edit."""

    n_shards: int
    shards: tuple[int, ...]
    version: int = 0
    moved: tuple[int, ...] = field(default=(), compare=False)

    @staticmethod
    def initial(n_shards: int, n_slots: int) -> SlotMap:
        return SlotMap(n_shards, tuple(i % n_shards for i in range(n_slots)))

    def rebalanced(self, weights: dict[int, int], n_shards: int | None = None) -> SlotMap:
        """The next version: slots move one at a time from the heaviest shard to the lightest while that narrows their gap.

        More shards than before only start empty; fewer hand their slots to the lightest first."""
        n = n_shards or self.n_shards
        at, moved = list(self.shards), set()
        load = [0] * n
        held: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (weight, slot), sorted
        homeless = []
        for slot, shard in enumerate(at):
            if shard < n:
                insort(held[shard], (weights.get(slot, 0), slot))
                load[shard] += weights.get(slot, 0)
            else:
                homeless.append((weights.get(slot, 0), slot))
        for w, slot in sorted(homeless, reverse=True):
            low = min(range(n), key=lambda i: (load[i], i))
            insort(held[low], (w, slot))
            load[low] += w
            at[slot] = low
            moved.add(slot)
        while True:
            high, low = max(range(n), key=lambda i: (load[i], -i)), min(range(n), key=lambda i: (load[i], i))
            gap = load[high] - load[low]
            k = bisect_left(held[high], (gap / 2, -1))
            near = [held[high][i] for i in (k - 1, k) if 0 <= i < len(held[high]) and 0 < held[high][i][0] < gap]
            if not near:
                break
            w, slot = min(near, key=lambda x: (abs(x[0] - gap / 2), x[1]))
            held[high].remove((w, slot))
            insort(held[low], (w, slot))
            load[high] -= w
            load[low] += w
            at[slot] = low
            moved.add(slot)
        return SlotMap(n, tuple(at), self.version + 1, tuple(sorted(moved)))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(version, n_shards, virtual_slot, shard): one row per virtual slot."""
        rows = [(self.version, self.n_shards, i, s) for i, s in enumerate(self.shards)]
        return spark.createDataFrame(rows, "version int, n_shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version under path; earlier versions stay readable."""
        self.frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given or else the latest version under path."""
        all_versions = spark.read.option("basePath", path).parquet(path)
        version = all_versions.agg(F.max("version")).first()[0] if version is None else version
        rows = all_versions.where(F.col("version") == version).orderBy("virtual_slot").collect()  # as many rows as slots
        return SlotMap(rows[0]["n_shards"], tuple(r["shard"] for r in rows), version)


def records(docs: DataFrame, n_slots: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, virtual_slot. A null text weighs 1, with the checksum of no bytes.

    The slot hashes id and checksum, so rows repeated under one id still spread where their texts differ."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), utf8_crc32(text).alias("text_crc32"))
    return out.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def shard(docs: DataFrame, n_shards: int = 8, n_slots: int = 4096, id_col: str = "doc_id", text_col: str = "text", before: SlotMap | None = None, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot, map_version; one row per row of docs.

    shard comes from the map, edited from `before` (or the initial map) to balance bytes and stored under
    map_path where one is given. slot is the row's place in its shard, gapless from 0: the rows of a shard's
    virtual slots one after the other, by id within. An empty table gives an empty result."""
    spark = docs.sparkSession
    rows = cut(records(docs, n_slots, id_col, text_col))
    stats = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # at most n_slots rows
    before = before or SlotMap.initial(n_shards, n_slots)
    now = before.rebalanced({r["virtual_slot"]: r["bytes"] for r in stats}, n_shards)
    if map_path:
        now.save(spark, map_path)
    counts, base, starts = {r["virtual_slot"]: r["n"] for r in stats}, [0] * n_shards, []
    for i, s in enumerate(now.shards):
        starts.append((i, s, base[s]))
        base[s] += counts.get(i, 0)
    places = F.broadcast(spark.createDataFrame(starts, "virtual_slot int, shard int, first long"))  # n_slots rows
    order = "row_number() OVER (PARTITION BY virtual_slot ORDER BY doc_id, text_crc32, size) - 1"
    placed = rows.withColumn("__rank", F.expr(order)).join(places, "virtual_slot")
    return placed.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("__rank")).alias("slot"), F.lit(now.version).alias("map_version"))
