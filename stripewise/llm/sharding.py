"""Sharding over a fixed number of virtual slots, by a versioned map from slots to shards.

A record's slot is a hash of its key, of equal records also of their number, and never changes; only the map does. The map is made from the bytes of
each slot, and edited (not made anew) when shards are added or have drifted apart, so that few slots move.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shared_path, shuffle_partitions, stored, table

SLOTS = 8192
#: Bytes that count for a record besides its text.
OVERHEAD = 16


#: Equal rows that are told apart in one task.
COPIES = 1 << 16


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, and n, the number of rows that are equal in these, stored: texts are read once."""
    encoded = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(encoded) + OVERHEAD).cast("bigint").alias("size"), F.crc32(encoded).alias("text_crc32"))
    return stored(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "sized")


def slotted(sizes: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, copy and virtual_slot of each row. Equal rows are numbered, and the slot is a hash of id, checksum
    and number, so that no key, however many rows have it, fills a slot. Numbers of a row with very many copies are made by many tasks."""
    spark = sizes.sparkSession
    own = ["doc_id", "size", "text_crc32"]
    few = sizes.where(F.col("n") <= COPIES).select(*own, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("copy"))
    parts = sizes.where(F.col("n") > COPIES).select(*own, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(COPIES).cast("bigint"))).alias("low"))
    many = parts.repartition(shuffle_partitions(spark)).select(*own, F.explode(F.sequence("low", F.least(F.col("n"), F.col("low") + COPIES) - 1)).alias("copy"))
    return few.unionByName(many).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(slots)).cast("int"))


def first_map(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slots to shards, the largest first, each to the shard with the fewest bytes."""
    held, out = [0] * shards, {}
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        shard = min(range(shards), key=lambda k: (held[k], k))
        out[slot] = shard
        held[shard] += sizes.get(slot, 0)
    return out


def edited_map(old: dict[int, int], sizes: dict[int, int], shards: int, slack: float = 0.02) -> dict[int, int]:
    """The old map with few moves. New shards take slots from the fullest ones until they have their share, and slots move
    nowhere else for that. Then, while the fullest and the emptiest shard are apart by more than ``slack`` of
    the mean, a slot moves from the one to the other that narrows the gap. No shard may have gone."""
    out, held, own = dict(old), [0] * shards, [set() for _ in range(shards)]
    for slot, shard in old.items():
        held[shard] += sizes.get(slot, 0)
        own[shard].add(slot)
    mean = sum(held) / shards
    new = set(range(max(old.values(), default=-1) + 1, shards))

    def move(slot: int, top: int, low: int) -> None:
        own[top].remove(slot)
        own[low].add(slot)
        held[top] -= sizes[slot]
        held[low] += sizes[slot]
        out[slot] = low

    for low in sorted(new):
        while True:
            tops = sorted((k for k in range(shards) if k not in new and held[k] > 0), key=lambda k: (-held[k], k))
            fits = next((f for k in tops if (f := [s for s in own[k] if 0 < sizes.get(s, 0) <= mean - held[low]])), [])
            if not fits:
                break
            top = out[fits[0]]
            move(max(fits, key=lambda s: (sizes[s] <= held[top] - mean, sizes[s], -s)), top, low)
    while True:
        top, low = max(range(shards), key=lambda k: (held[k], -k)), min(range(shards), key=lambda k: (held[k], k))
        gap = held[top] - held[low]
        fits = [s for s in own[top] if 0 < sizes.get(s, 0) < gap] if gap > slack * mean else []
        if not fits:
            return out
        move(min(fits, key=lambda s: (abs(2 * sizes[s] - gap), s)), top, low)


def slot_totals(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot: at most as many rows come to the driver as there are slots."""
    return {r["virtual_slot"]: (r["b"], r["n"]) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}


_MAP = "version int, virtual_slot int, shard int, bytes bigint, rows bigint"


def stored_map(spark: SparkSession, mapped: dict[int, int], totals: dict[int, tuple[int, int]], version: int, path: str) -> DataFrame:
    """Append a version of the map to the table at ``path``: version, virtual_slot, shard, bytes, rows."""
    rows = json.dumps([{"virtual_slot": s, "shard": k, "bytes": totals.get(s, (0, 0))[0], "rows": totals.get(s, (0, 0))[1]} for s, k in sorted(mapped.items())])
    one = spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<virtual_slot: int, shard: int, bytes: bigint, rows: bigint>>")).alias("r"))
    one.select(F.lit(version).alias("version"), "r.*").coalesce(1).write.mode("append").parquet(path)
    return read_map(spark, path, version)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(_MAP).parquet(path).where(F.col("version") == version)


def placed(rows: DataFrame, mapped: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their shard and their place there, gapless from 0.

    A place is the number of records in the shard's earlier slots (a prefix sum over the map's few rows) and
    the rank in the own slot, so no task sorts a whole shard."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    based = mapped.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__base"))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order)))
    return ranked.join(F.broadcast(based), "virtual_slot").withColumn("slot", (F.col("__base") + F.col("__rank") - 1).cast("bigint")).drop("__base", "__rank")  # a row for each slot


def sharded(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, path: str | None = None, version: int = 1) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, copy (its number among equal rows), virtual_slot, shard, slot.

    Shards have near equal bytes: apart by no more than a small slot, or than one slot that alone is larger
    than a shard should be, as one very long text can be. A null text has size 16 and checksum 0. Null and repeated ids are allowed; rows
    equal in id and text are numbered and spread like others. Other columns are not looked at. An empty table gives an empty result, with a map all the same. With
    ``path``, a version above 1 edits the map of the version before; without, a new map is stored."""
    spark = docs.sparkSession
    rows = slotted(sized(docs, id_col, text_col), slots)
    totals = slot_totals(rows)
    bytes_ = {s: b for s, (b, _) in totals.items()}
    path = path or shared_path(spark, "slot-map")
    if version > 1:
        old = {r["virtual_slot"]: r["shard"] for r in read_map(spark, path, version - 1).collect()}  # a row for each slot
        made = edited_map(old, bytes_, shards)
    else:
        made = first_map(bytes_, shards, slots)
    mapped = stored_map(spark, made, totals, version, path)
    return placed(rows, mapped, [F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("copy")])


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharded(table(spark, sf_dir, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
