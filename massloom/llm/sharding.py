"""Shards by jump consistent hashing, in DataFrame functions only.

A row's key walks upward: from shard b it jumps to ``floor((b + 1) / u)``, u in (0, 1] drawn from a hash of the key
and b. The last jump that stays below the number of shards is its shard. No ring or table of shards exists, and with
one shard more a row stays or moves into the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.sources.stages import materialize

# parts each shard is numbered in; the table of their counts has shards x PARTS rows
PARTS = 1024


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. shards-1 of a key; null is a key of its own. Every jump goes at least one shard up."""
    if shards < 1:
        raise ValueError("at least one shard")

    def step(at: Column, _: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, at["next"]), 11) + F.lit(1)
        # draw / 2^53 is in (0, 1]; the quotient is capped to stay a long
        landing = F.least((at["next"] + 1) * F.lit(2.0**53) / draw, F.lit(2.0**40)).cast("long")
        moved = F.struct(at["next"].alias("shard"), landing.alias("next"))
        return F.when(at["next"] < shards, moved).otherwise(at)

    start = F.struct(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)["shard"].cast("int")


def shard_rows(docs: DataFrame, shards: int = 8, key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1; the checksum of a null text is that of the empty one.
    Slots count every shard from 0 without gaps; rows that repeat a key are numbered apart. Numbering goes by parts of
    a shard, so that no task holds a whole shard; rows are dealt to parts by their place in a written table, so one
    key that repeats very often is spread too. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.select(
        "*",
        jump_shard(F.col("_key"), shards).alias("shard"),
        jump_shard(F.col("_key"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("_key", F.monotonically_increasing_id()), F.lit(PARTS)).cast("int").alias("part"),
    )
    # written once: the parts are then data, the same for the counts and for the numbers
    rows = materialize(rows)
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("_key", "text_crc32", "size")
    numbered = rows.withColumn("rank", F.row_number().over(within).cast("long"))
    # at most shards x PARTS rows; joined on the keys the window has dealt by
    return numbered.join(F.broadcast(offsets), ["shard", "part"]).select(
        F.col("_key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("offset") + F.col("rank") - 1).alias("slot"),
        "grown_shard",
    )
