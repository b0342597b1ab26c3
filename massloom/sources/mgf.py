"""MGF spectrum files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.sources.ordinals import numbered

PEAK_LINE = r"(?m)^([0-9]\S*[ \t]+\S[^\r\n]*)"


def _records(spark: SparkSession, path: str) -> DataFrame:
    blocks = spark.read.option("lineSep", "END IONS").text(path)
    rows = numbered(blocks, F.contains("value", F.lit("BEGIN IONS")), "query_id")
    return rows.select("query_id", F.substring_index("value", "BEGIN IONS", -1).alias("value"))


def _maybe(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.element_at(values, -1))


def _field(key: str) -> Column:
    return F.trim(_maybe(F.regexp_extract_all("value", F.lit(rf"(?m)^{key}=([^\r\n]*)"), F.lit(1))))


def read_mgf(spark: SparkSession, path: str, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """``(query_id, title, rt, charge, pepmass, peaks, meta)``, one row per spectrum.

    ``query_id`` counts the spectra in file order. The charge is the first whole number of its line; a spectrum without a
    readable charge or precursor has nulls there and falls to the charge and
    mass filters. A spectrum without a title is named after its ``query_id``. ``extra_keys`` become ``mgf:KEY`` entries of ``meta``.
    """
    lines = F.regexp_extract_all("value", F.lit(PEAK_LINE), F.lit(1))
    peaks = F.transform(
        lines,
        lambda line: F.struct(
            F.try_element_at(F.split(line, r"[ \t]+"), F.lit(1)).try_cast("double").alias("mz"),
            F.try_element_at(F.split(line, r"[ \t]+"), F.lit(2)).try_cast("double").alias("intensity"),
        ),
    )
    meta = (
        F.create_map(*[c for k in extra_keys for c in (F.lit(f"mgf:{k}"), _field(k))])
        if extra_keys
        else F.lit(None).cast("map<string,string>")
    )
    return _records(spark, path).select(
        "query_id",
        F.coalesce(F.nullif(_field("TITLE"), F.lit("")), F.concat(F.lit("spectrum_"), "query_id")).alias("title"),
        F.coalesce(_field("RTINSECONDS").try_cast("double"), F.lit(0.0)).alias("rt"),
        F.regexp_extract(F.coalesce(_field("CHARGE"), F.lit("0")), r"([0-9]+)", 1).try_cast("int").alias("charge"),
        F.split(_field("PEPMASS"), r"\s+").getItem(0).try_cast("double").alias("pepmass"),
        peaks.alias("peaks"),
        meta.alias("meta"),
    )


def read_mgf_fields(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``(title, value)`` of an extra header; an error if a spectrum lacks it."""
    return _titled(spark, path, key).select("title", "value")


def _titled(spark: SparkSession, path: str, key: str) -> DataFrame:
    value = _field(key)
    missing = F.raise_error(F.concat(F.lit(f"no key {key} in spectrum "), F.coalesce(_field("TITLE"), F.lit("?"))))
    return _records(spark, path).select(
        "query_id", _field("TITLE").alias("title"), F.coalesce(value, missing.cast("string")).alias("value")
    )


def with_mgf_field(spectra: DataFrame, path: str, key: str) -> DataFrame:
    """Spectra with an MGF header added to ``meta`` by title, of records with one title the first; an error where it is missing."""
    fields = _titled(spectra.sparkSession, path, key).groupBy("title").agg(F.min_by("value", "query_id").alias("value"))
    joined = spectra.join(fields, "title", "left")
    missing = F.raise_error(F.concat(F.lit("no record titled "), "title")).cast("string")
    entry = F.create_map(F.lit(f"mgf:{key}"), F.coalesce("value", missing))
    meta = F.when(F.col("meta").isNull(), entry).otherwise(
        F.map_concat(F.map_filter("meta", lambda k, _: k != f"mgf:{key}"), entry)
    )
    return joined.withColumn("meta", meta).drop("value")


def count_spectra(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    return lines.where(F.startswith("value", F.lit("BEGIN IONS"))).agg(F.count(F.lit(1)).alias("n"))


def write_mgf(spectra: DataFrame, path: str, extra: dict[str, Column] | None = None) -> None:
    """Spectra ``(title, rt, charge, pepmass, peaks)`` as MGF text."""
    head = [
        F.lit("BEGIN IONS"),
        F.concat(F.lit("TITLE="), "title"),
        F.concat(F.lit("RTINSECONDS="), F.col("rt").cast("string")),
        F.concat(F.lit("CHARGE="), F.col("charge").cast("string"), F.lit("+")),
        F.concat(F.lit("PEPMASS="), F.col("pepmass").cast("string")),
        *[F.concat(F.lit(f"{k}="), v) for k, v in (extra or {}).items()],
    ]
    peaks = F.transform(
        "peaks", lambda p: F.concat(p["mz"].cast("string"), F.lit(" "), p["intensity"].cast("string"))
    )
    lines = F.concat(F.array(*head), peaks, F.array(F.lit("END IONS")))
    spectra.select(F.array_join(lines, "\n").alias("value")).write.mode("overwrite").text(path)
