"""Tables that an operator needs for a step only."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from massloom.sources.stages import materialize, workspace


@contextmanager
def scratch_table(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` written to the shared folder and read back; the table goes when the block ends.

    What is built from it must have been written by then.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield materialize(df, path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
