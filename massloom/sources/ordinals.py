"""Numbers of records in file order, without gaps, however the files are split and on however many cores.

A first pass counts the records of every block of a file; running sums over the blocks say where each begins. A second
pass adds a record's place within its block, which reading in order already gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = ["_file", "_start"]


def numbered(lines: DataFrame, valid: Column, name: str) -> DataFrame:
    """The rows of a file scan for which ``valid`` holds, with ``name``: 0, 1, ... by file name and place in the file."""
    own = lines.columns
    read = lines.select(*own, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    read = read.where(valid).withColumn("_id", F.monotonically_increasing_id())
    blocks = read.groupBy(*_BLOCK).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row per block of a file
    before = Window.orderBy(*_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    begins = blocks.select(*_BLOCK, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = read.join(F.broadcast(begins), _BLOCK)
    return joined.select((F.col("_before") + F.col("_id") - F.col("_first")).alias(name), *own)
