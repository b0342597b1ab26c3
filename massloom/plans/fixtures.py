"""Proteins, spectra and match tables derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions import chem
from massloom.operators.candidates import fixed_mods
from massloom.operators.digest import fragments
from massloom.operators.spectra import prepare_spectra
from massloom.sources.stages import spread
from massloom.options import DigestOptions, QueryOptions, SearchOptions

LETTERS = "[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's residue letters as a protein."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("protein_id"),
        F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string")).alias("desc"),
        F.upper(F.regexp_replace("text", LETTERS, "")).alias("seq"),
    )


def fragment_rows(spark: SparkSession, sf_dir: str, opts: DigestOptions = DigestOptions()) -> DataFrame:
    """``(protein_id, desc, k, seq)``: fragments of more than one residue, numbered within the protein."""
    return proteins(spark, sf_dir).select(
        "protein_id", "desc", F.posexplode_outer(fragments(F.col("seq"), opts)).alias("k", "seq")
    ).where(F.col("seq").isNotNull())


def planted(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """One spectrum per document, planted from its alphabetically first eligible fragment; or one for every such fragment.

    With ``every`` a spectrum has the number of its document times a million plus that of the fragment.

    Peaks are the charge-1 b and y ladder, each shifted by a few ppm, and as
    noise the embedding with the document's number, where there is one.
    ``truth`` is the modified sequence.
    """
    opts = DigestOptions()
    picked = fragment_rows(spark, sf_dir).where(F.length("seq").between(opts.min_length, opts.max_length))
    if not every:
        picked = picked.groupBy("protein_id").agg(F.min(F.struct("seq", "k")).alias("_f")).select("protein_id", "_f.seq", "_f.k")
    picked = picked.withColumn("mods", fixed_mods(F.col("seq"), opts))
    mass = chem.peptide_mass(F.col("seq"), F.col("mods"), opts.nterm, opts.cterm)
    doc, k, n = F.col("protein_id"), F.col("k"), F.length("seq")
    sums = chem.prefix_masses(F.col("seq"), F.col("mods"))
    b_end = F.lit(chem.nano(opts.cterm) - chem.HYDROXYL + chem.HYDROGEN)
    y_end = F.lit(chem.nano(opts.cterm) + 2 * chem.HYDROGEN)

    def peak(pos, nano):
        shift = F.lit(1.0) + (F.pmod(doc * 7 + pos * 11, F.lit(17)) - 8) * F.lit(1e-6)
        return F.struct(
            (nano / F.lit(1e9) * shift).alias("mz"),
            (F.lit(1.0) + F.pmod(doc * 5 + pos * 37, F.lit(100))).alias("intensity"),
        )

    inner = F.slice("sums", F.lit(1), n - 1)
    ladder = F.concat(
        F.transform(inner, lambda m, i: peak(i + 1, m + b_end)),
        F.transform(inner, lambda m, i: peak(i + 2, F.get("sums", n - 1) - m + y_end)),
    )
    noise = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("protein_id"),
        F.transform(
            "embedding",
            lambda e, i: F.struct(
                (F.lit(100.0) + i * 25.0 + F.abs(e.cast("double")) * 10.0).alias("mz"),
                (F.lit(1.0) + F.pmod(i * 7, F.lit(10))).cast("double").alias("intensity"),
            ),
        ).alias("noise"),
    )
    none = F.array().cast("array<struct<mz:double,intensity:double>>")
    return (
        picked.withColumn("sums", sums)
        .withColumn("_true", mass)
        .join(noise, "protein_id", "left")
        .select(
            (doc * 1_000_000 + k if every else doc).alias("query_id"),
            F.concat(F.lit("s"), doc.cast("string"), *([F.lit("_"), k.cast("string")] if every else [])).alias("title"),
            F.pmod(doc * 17 + k, F.lit(3600)).cast("double").alias("rt"),
            (F.lit(2) + F.pmod(doc, F.lit(3))).cast("int").alias("charge"),
            (
                F.col("_true") * (F.lit(1.0) + (F.pmod(doc * 13 + k * 29, F.lit(121)) - 60) * F.lit(1e-6))
            ).alias("_seen"),
            F.array_sort(F.concat(ladder, F.coalesce("noise", none))).alias("peaks"),
            chem.render_modseq(F.col("seq"), F.col("mods")).alias("truth"),
        )
        .withColumn("pepmass", F.col("_seen") / F.col("charge") + F.lit(chem.PROTON))
        .drop("_seen")
    )


def spectra(
    spark: SparkSession,
    sf_dir: str,
    query: QueryOptions = QueryOptions(),
    search: SearchOptions = SearchOptions(),
    every: bool = False,
) -> DataFrame:
    return prepare_spectra(planted(spark, sf_dir, every), query, search)


def is_foreign() -> Column:
    """Whether ``spectra_with_foreign`` moves the peaks of a spectrum: three of ten."""
    return F.pmod(F.col("query_id") * 7919, F.lit(10)) < 3


def spectra_with_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spectrum for every eligible fragment, three of ten of them foreign to the database.

    Peaks of a foreign spectrum are moved by 3.37 m/z, so that it fits no candidate better than chance and decoys win as
    often as targets.
    """
    moved = F.transform("peaks", lambda p: F.struct((p["mz"] + 3.37).alias("mz"), p["intensity"].alias("intensity")))
    return spectra(spark, sf_dir, every=True).withColumn("peaks", F.when(is_foreign(), moved).otherwise(F.col("peaks")))


def event_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak rows, one spectrum per user."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query_id"),
        (F.lit(100.0) + F.col("value") * 4).alias("mz"),
        (F.pmod("event_id", F.lit(97)) + 1).cast("double").alias("intensity"),
    )


def event_psms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match table with many tied scores: one match per event, decoys where the type is ``error``."""
    kind, value = F.col("event_type"), F.col("value")
    decoy = kind == "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("psm_id"),
        F.col("user_id").alias("query_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("title"),
        F.concat(F.when(decoy, F.lit("DECOY_")).otherwise(F.lit("")), kind).alias("desc"),
        F.concat(kind, F.floor(value / 5).cast("string")).alias("seq"),
        F.concat(kind, F.floor(value / 5).cast("string"), F.lit("["), F.pmod("event_id", F.lit(3)).cast("string"), F.lit("]")).alias("modseq"),
        F.round(value, 0).alias("score"),
        decoy.alias("decoy"),
        (F.lit(2) + F.pmod("user_id", F.lit(3))).cast("int").alias("charge"),
        (F.lit(500.0) + F.col("user_id") * 11.37).alias("query_mass"),
        (F.lit(500.0) + F.col("user_id") * 11.37 + F.pmod("event_id", F.lit(7)) * 0.001).alias("cand_mass"),
        F.pmod("event_id", F.lit(13)).alias("total_matched"),
    )
