"""Protein FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.sources.ordinals import numbered


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(protein_id, desc, seq)``, one row per record.

    Records are split at line ends followed by ``>``, so a ``>`` inside a header
    stays. ``desc`` is the whole header line; ``protein_id`` counts the records in file order.
    """
    records = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", "^>", "")
    # a file that starts with ">" loses it here; one that does not starts with stray lines
    header = F.trim(F.regexp_extract(body, "^([^\r\n]*)", 1))
    letters = F.regexp_replace(F.regexp_replace(body, "^[^\r\n]*", ""), r"\s", "")
    rows = numbered(records, F.length(header) + F.length(letters) > 0, "protein_id")
    return rows.select("protein_id", header.alias("desc"), letters.alias("seq"))


def count_proteins(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    return lines.where(F.startswith("value", F.lit(">"))).agg(F.count(F.lit(1)).alias("n"))


def write_fasta(proteins: DataFrame, path: str) -> None:
    """Proteins as FASTA text, one sequence line each."""
    proteins.select(F.concat(F.lit(">"), "desc", F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(path)
