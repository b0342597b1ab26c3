"""Stage tables: results written once and read back, so later work restarts from them."""

from __future__ import annotations

import functools
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_local_folders: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may go without: it gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="massloom-")
    return _local_folders[context.applicationId]


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table and read it back: lineage ends at files, which outlive executors."""
    spark = df.sparkSession
    path = path or f"{workspace(spark)}/stage-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input dealt out to all cores; larger inputs stay as they were split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class StaleStage(ValueError):
    """A stored stage was made from something else than what is asked for now, or not made to its end."""


def describe(value) -> str:
    """A setting or user function as text that is the same in every session: names for functions, values for the rest."""
    if isinstance(value, functools.partial):
        return f"partial({describe(value.func)}, {describe(value.args)}, {describe(value.keywords)})"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}: {describe(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(describe, value)) + "]"
    if callable(value):
        return f"{getattr(value, '__module__', '')}.{getattr(value, '__qualname__', type(value).__qualname__)}"
    return str(value) if isinstance(value, Column) else repr(value)


def input_mark(df: DataFrame) -> str:
    """Files behind ``df`` with their sizes and times, as one hash; of rows without files only the schema."""
    spark = df.sparkSession
    told = [df.schema.simpleString()]
    for name in sorted(df.inputFiles()):
        place = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
        told.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()


class StageStore:
    """Stage tables in one folder, each with a note of what it was made from.

    The note has the settings, user functions and inputs of the stage and the versions of the stages it read. A table
    is read only if its note says what is asked for now, so a stage that no longer fits is refused and not used.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _note(self, name: str, version: str, made_from: dict[str, str]) -> None:
        rows = [(k, v) for k, v in sorted(made_from.items())]
        note = self.spark.createDataFrame([(version, dict(rows))], "version string, made_from map<string,string>")
        note.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/_notes/{name}")

    def write(self, name: str, df: DataFrame, made_from: dict[str, str], write: Callable = materialize) -> tuple[DataFrame, str]:
        """The table as read back, and its version. Until it is whole its note has none."""
        self._note(name, "", made_from)
        table = write(df, f"{self.folder}/{name}")
        version = uuid.uuid4().hex
        self._note(name, version, made_from)
        return table, version

    def read(self, name: str, made_from: dict[str, str]) -> tuple[DataFrame, str]:
        """The stored table and its version; ``made_from`` may leave out what is not known now."""
        try:
            note = self.spark.read.parquet(f"{self.folder}/_notes/{name}").first()
        except AnalysisException:
            raise StaleStage(f"there is no stage {name} in {self.folder}") from None
        if not note["version"]:
            raise StaleStage(f"the stage {name} was not written to its end")
        other = sorted(k for k, v in made_from.items() if note["made_from"].get(k) != v)
        if other:
            raise StaleStage(f"the stored stage {name} was made with another {', '.join(other)}; run it again")
        return self.spark.read.parquet(f"{self.folder}/{name}"), note["version"]


SLAB = "mass_slab"
SLAB_WIDTH = 50.0
SLABS = 200  # the last one holds all that is heavier


def _slab(mass: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor(mass / F.lit(SLAB_WIDTH)), F.lit(SLABS))).cast("int")


def write_by_mass(df: DataFrame, path: str) -> DataFrame:
    """``df`` (cand_id, mass) in one folder per stretch of mass, rows in the order of their masses within a file.

    A stretch is dealt to several tasks, so that one which holds most rows is not written by one of them.
    """
    spark = df.sparkSession
    part = F.pmod(F.xxhash64("cand_id"), F.lit(8))
    laid = df.withColumn(SLAB, _slab(F.col("mass"))).repartition(F.col(SLAB), part).sortWithinPartitions(SLAB, "mass")
    laid.write.mode("overwrite").partitionBy(SLAB).parquet(path)
    return spark.read.schema(laid.schema).parquet(path)


def near_masses(cands: DataFrame, spectra: DataFrame) -> DataFrame:
    """The rows of a table written by mass that lie in a stretch some spectrum's window reaches; other folders are not read."""
    if SLAB not in cands.columns:
        return cands
    wanted = spectra.select(F.explode(F.sequence(_slab(F.col("min_mass")), _slab(F.col("max_mass")))).alias("s"))
    slabs = [r["s"] for r in wanted.distinct().collect()]  # at most SLABS + 1
    span = spectra.agg(F.min("min_mass").alias("low"), F.max("max_mass").alias("high")).first()
    kept = cands.where(F.col(SLAB).isin(slabs))
    if span["low"] is not None:
        kept = kept.where(F.col("mass").between(span["low"], span["high"]))
    return kept.drop(SLAB)
