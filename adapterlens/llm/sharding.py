"""Sharding by fixed virtual slots, in DataFrame functions only.

Records hash into thousands of virtual slots that never change. Bytes are summed per slot, and a
versioned map says which shard holds each slot. Rebalancing edits the map and writes the next
version; records never hash anew. Every version names all slots, those that are still empty too, so that
records which come later have their place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adapterlens.llm.common import shared_dir, table

#: Virtual slots. The map has this many rows at most, which bounds its broadcast.
SLOTS = 4096
#: Parts of a slot that are numbered apart, so that no task sorts a whole slot.
PARTS = 16


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot, part of every row; the text is dropped before any shuffle."""
    text = F.coalesce("text", F.lit(""))
    spread = F.xxhash64("doc_id", text)
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(spread, F.lit(slots)).cast("int").alias("vslot"),
        F.pmod(F.shiftright(spread, 32), F.lit(PARTS)).cast("int").alias("part"),
    )


def slot_bytes(records: DataFrame) -> DataFrame:
    """vslot, bytes: one row per virtual slot in use; partial sums come before the shuffle."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"))


def _placed(slots: Column, loads: Column) -> Column:
    """array<struct<bytes, vslot>> -> array<struct<vslot, shard>>: in order, each to the shard that is
    lightest by then; loads: bytes that each shard has before."""
    zero = F.struct(loads.alias("loads"), F.expr("cast(array() as array<struct<vslot: int, shard: int>>)").alias("map"))

    def step(acc: Column, slot: Column) -> Column:
        shard = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return F.struct(
            F.transform(acc["loads"], lambda load, i: load + F.when(i == shard, slot["bytes"]).otherwise(0)).alias("loads"),
            F.array_append(acc["map"], F.struct(slot["vslot"].alias("vslot"), shard.alias("shard"))).alias("map"),
        )

    return F.aggregate(slots, zero, step, lambda acc: acc["map"])


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the slot map: version, vslot, shard. Every slot has a shard, whatever lies in it."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def newest(slot_map: DataFrame) -> DataFrame:
    """The rows of the last version in a table that holds all of them."""
    last = slot_map.agg(F.max("version").alias("version"))
    return slot_map.join(F.broadcast(last), "version")


def rebalanced_map(slot_map: DataFrame, stats: DataFrame, shards: int) -> DataFrame:
    """The next version, in which shards hold nearly equal bytes.

    Each shard keeps its largest slots up to the mean load, and its empty ones; the others move,
    largest first, each to the shard that is lightest by then.
    """
    held = newest(slot_map).join(F.broadcast(stats), "vslot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))
    falling = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    mean = held.agg((F.sum("bytes") / shards).alias("mean"))
    upto = F.sum("bytes").over(falling.rowsBetween(Window.unboundedPreceding, 0))
    held = held.select("vslot", "shard", "bytes", upto.alias("upto"), F.row_number().over(falling).alias("place")).join(F.broadcast(mean))
    stays = (F.col("upto") <= F.col("mean")) | (F.col("place") == 1) | (F.col("bytes") == 0)
    loads = held.groupBy("shard").agg(F.sum(F.when(stays, F.col("bytes")).otherwise(0)).alias("load"), F.collect_list(F.when(~stays, F.struct("bytes", "vslot"))).alias("moving"))
    whole = loads.agg(F.map_from_entries(F.collect_list(F.struct("shard", "load"))).alias("loads"), F.sort_array(F.flatten(F.collect_list("moving")), asc=False).alias("moving"))
    before = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.try_element_at("loads", i), F.lit(0).cast("long")))
    return edited_map(slot_map, whole.select(F.inline(_placed(F.col("moving"), before))))


def grown_map(slot_map: DataFrame, stats: DataFrame, shards: int) -> DataFrame:
    """The next version with one more shard, which takes whole slots from each of the others.

    Within a shard, slots go by falling bytes; the new shard takes every (shards + 1)-th, so it
    gets about its share and no slot moves between the old shards.
    """
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    return (
        newest(slot_map)
        .join(F.broadcast(stats), "vslot", "left")
        .withColumn("bytes", F.coalesce("bytes", F.lit(0)))
        .withColumn("place", F.row_number().over(order))
        .select(
            (F.col("version") + 1).alias("version"),
            "vslot",
            F.when(F.col("place") % (shards + 1) == shards, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
        )
    )


def edited_map(slot_map: DataFrame, moves: DataFrame) -> DataFrame:
    """The next version after `moves` (vslot, shard); all other slots stay."""
    to = F.broadcast(moves.select("vslot", F.col("shard").alias("to")))
    return newest(slot_map).join(to, "vslot", "left").select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").cast("int").alias("shard"))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; earlier versions stay readable. One that is there already is
    an error."""
    (version,) = {r.version for r in slot_map.select("version").distinct().collect()}
    slot_map.select("vslot", "shard").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    return newest(spark.read.parquet(path).select("version", "vslot", "shard"))


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Give every record its shard and its place there, counted from 0 without gaps.

    Places are numbered in each (slot, part) and lifted by the counts of what comes before in the
    shard: two short tables of at most SLOTS * PARTS rows, so no task holds a shard. A record whose
    slot is not in the map is an error.
    """
    missing = F.raise_error(F.concat(F.lit("the map lacks slot "), F.col("vslot").cast("string"))).cast("int")
    named = records.join(F.broadcast(slot_map), "vslot", "left").withColumn("shard", F.coalesce("shard", missing))
    parts = named.groupBy("shard", "vslot", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("vslot", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = named.withColumn("place", F.row_number().over(place) - 1)
    return numbered.join(F.broadcast(offsets), ["vslot", "part"]).withColumn("slot", (F.col("place") + F.col("offset")).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Put every row of docs(doc_id, text) into a shard.

    Law `bytes`: shards get nearly equal sizes. path: the folder of a stored map, whose newest
    version is followed as it is. Without one, a map is stored in the shared folder: version 1 deals
    the slots evenly, version 2 is that map edited for the bytes of these records, and is followed.
    Returns doc_id, size, text_crc32, law, shard, slot (place in the shard, gapless from 0),
    grown_shard (null under this law), virtual_slot, map_version.

    A null text counts as empty, with size 1 and checksum 0. A null doc_id hashes like any value.
    Repeated rows are kept, each with a place of its own; which of two equal rows gets which place
    does not matter, as they are equal. Further columns are ignored. An empty table gives none.
    """
    spark, records = docs.sparkSession, sized(docs, slots)
    if path is None:
        path = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
        store_map(first_map(spark, shards, slots), path)
        store_map(rebalanced_map(read_map(spark, path), slot_bytes(records), shards), path)
    return assign(records, read_map(spark, path)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
        F.col("version").alias("map_version"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 of every document. Nulls, repeats and empty tables: as `shard_documents` says."""
    return shard_documents(table(spark, sf_dir, "documents"))
