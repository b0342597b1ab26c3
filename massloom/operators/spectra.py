"""Measured spectra: masses, filters, and per-spectrum peak operators.

Operators that can meet spectra of any size work on peak rows
``(query_id, mz, intensity)`` and aggregate map-side before they shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from massloom.functions import chem
from massloom.options import QueryOptions, SearchOptions
from massloom.sources.stages import workspace


def with_tolerance(spectra: DataFrame, opts: SearchOptions = SearchOptions()) -> DataFrame:
    """Candidate mass window of each spectrum, left and right tolerance independent."""
    mass = F.col("mass")
    left, right = opts.tolerance
    return spectra.withColumn("min_mass", mass + chem.tolerance_delta(mass, left, opts.unit)).withColumn(
        "max_mass", mass + chem.tolerance_delta(mass, right, opts.unit)
    )


def query_filter(opts: QueryOptions = QueryOptions()) -> Column:
    return F.col("mass").between(opts.min_mass, opts.max_mass) & F.col("charge").between(
        opts.min_charge, opts.max_charge
    )


def peak_count_filter(opts: QueryOptions = QueryOptions()) -> Column:
    return F.size("peaks").between(opts.min_peaks, opts.max_peaks)


def prepare_spectra(
    spectra: DataFrame, opts: QueryOptions = QueryOptions(), search: SearchOptions = SearchOptions()
) -> DataFrame:
    """Neutral mass from ``pepmass`` and ``charge``, charge and mass filters, tolerance window."""
    df = spectra.withColumn("mass", chem.precursor_mass(F.col("pepmass"), F.col("charge")))
    df = df.where(query_filter(opts))
    if opts.min_peaks > 0 or opts.max_peaks < QueryOptions.max_peaks:
        df = df.where(peak_count_filter(opts))
    return with_tolerance(df.drop("pepmass"), search)


def peak_rows(spectra: DataFrame, *keep: str) -> DataFrame:
    """Spectra to one row per peak."""
    return spectra.select("query_id", *keep, F.inline("peaks").alias("mz", "intensity"))


def spectrum_norm(peaks: DataFrame, kind: str = "max") -> DataFrame:
    agg = F.sum("intensity") if kind == "sum" else F.max("intensity")
    return peaks.groupBy("query_id").agg(agg.alias("norm"))


def bin_max(peaks: DataFrame, width: float) -> DataFrame:
    """Highest intensity of each bin of ``width``."""
    return peaks.groupBy("query_id", F.floor(F.col("mz") / F.lit(width)).cast("int").alias("bin")).agg(
        F.max("intensity").alias("intensity")
    )


def bin_spectra(peaks: DataFrame, width: float, size: int, root: bool = False) -> DataFrame:
    """Intensity per rounded bin, scaled to a maximum of 1; ``root`` takes the square root.

    The window runs over bins, of which a spectrum has at most ``size``.
    """
    place = F.rint(F.col("mz") / F.lit(width)).cast("int")
    bins = (
        peaks.withColumn("bin", place)
        .where(F.col("bin") < size)
        .groupBy("query_id", "bin")
        .agg(F.sum("intensity").alias("intensity"))
    )
    top = F.max("intensity").over(Window.partitionBy("query_id"))
    scaled = F.when(top != 0, F.col("intensity") / top).otherwise(F.col("intensity"))
    return bins.select("query_id", "bin", (F.sqrt(scaled) if root else scaled).alias("intensity"))


def top_peaks(bins: DataFrame, n: int = 500) -> DataFrame:
    """The ``n`` largest bins of each spectrum."""
    best = Window.partitionBy("query_id").orderBy(F.desc("intensity"), F.asc("bin"))
    return bins.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= n).drop("_rank")


def dense_bins(peaks: DataFrame, size: int = 20_000) -> DataFrame:
    """Intensity summed per whole m/z below ``size``."""
    return (
        peaks.where(F.col("mz") < size)
        .groupBy("query_id", F.col("mz").cast("int").alias("bin"))
        .agg(F.sum("intensity").alias("intensity"))
    )


def spectrum_arrays(bins: DataFrame, *keys: str) -> DataFrame:
    """One row per ``keys``: ``entries``, its (bin, intensity) in the order of bins; nulls are left out."""
    entry = F.struct(F.col("bin").cast("int").alias("bin"), F.col("intensity").cast("double").alias("intensity"))
    known = bins.where(F.col("bin").isNotNull() & F.col("intensity").isNotNull())
    return known.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def sparse_vectors(bins: DataFrame, size: int, spectra: DataFrame, *extra: str) -> DataFrame:
    """``(query_id, features)`` for every row of ``spectra``: its bins below ``size`` as a sparse ML vector, the
    ``extra`` columns of ``spectra`` as entries behind them.

    A vector is as long as its spectrum has filled bins, whatever ``size``. Bins are unique in a spectrum, as
    ``bin_spectra`` gives them; zeros and nulls are left out, and a spectrum without bins has the extra entries only.
    The table is written in the layout of the vector type and read back as vectors, so no row passes a function.
    """
    arrays = spectrum_arrays(bins.where(F.col("bin").between(0, size - 1)), "query_id")
    rows = spectra.select("query_id", *extra).join(arrays, "query_id", "left")
    behind = [F.struct(F.lit(size + n).alias("bin"), F.col(c).cast("double").alias("intensity")) for n, c in enumerate(extra)]
    none = F.array().cast("array<struct<bin:int,intensity:double>>")
    every = F.concat(F.coalesce("entries", none), F.array(*behind) if behind else none)
    rows = rows.select("query_id", F.filter(every, lambda x: F.coalesce(x["intensity"], F.lit(0.0)) != 0).alias("e"))
    vector = F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(size + len(extra)).alias("size"),
        F.col("e")["bin"].alias("indices"),
        F.col("e")["intensity"].alias("values"),
    )
    spark = bins.sparkSession
    path = f"{workspace(spark)}/vectors-{uuid.uuid4().hex}"
    rows.select("query_id", vector.alias("features")).write.parquet(path)
    return spark.read.schema(StructType([spectra.schema["query_id"], StructField("features", VectorUDT())])).parquet(path)
