"""Tab-separated result and feature tables, and scores of other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.operators.search import result_table, top_n

PSM_SCHEMA = (
    "title string, desc string, seq string, modseq string, score double, query_charge int, query_mass double, "
    "cand_mass double, candrow long, qrow long, file string, rrow long"
)

PIN_FIXED = ("PSMId", "Label", "ScanNr", "Peptide", "Proteins")
_TSV = {"sep": "\t", "header": "true", "quote": "", "escape": "", "emptyValue": "", "nullValue": ""}


def _no_tabs(df: DataFrame) -> DataFrame:
    texts = {f.name: F.replace(F.col(f.name), F.lit("\t"), F.lit("    ")) for f in df.schema if f.dataType == T.StringType()}
    return df.withColumns(texts)


def write_psm_tsv(psms: DataFrame, path: str, n: int = 10) -> None:
    """The ``n`` best matches of each spectrum, by spectrum and descending score."""
    _no_tabs(result_table(top_n(psms, n))).write.mode("overwrite").options(**_TSV).csv(path)


def finite(score: str = "score") -> Column:
    return F.abs(F.col(score)) < float("inf")


def read_psm_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A written result table; rows with infinite scores are dropped."""
    return spark.read.schema(PSM_SCHEMA).options(**_TSV).csv(path).where(finite())


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("n"))


def count_titles(psms: DataFrame) -> DataFrame:
    return psms.agg(F.countDistinct("title").alias("n"))


def decimal_text(value: Column) -> Column:
    """A number in positional notation with at most 12 decimals and at least one."""
    plain = F.regexp_replace(F.format_string("%.12f", value.cast("double")), "0+$", "")
    return F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)


def write_pin(features: DataFrame, path: str) -> None:
    """A feature table as text: peptides as ``-.X.-``, numbers in positional notation."""
    feats = [c for c in features.columns if c not in PIN_FIXED]
    repeated = [c for c in ("expMass", "calcMass") if {"expMass", "calcMass"} <= set(feats)]
    rows = features.select(
        F.array_join(
            F.array(
                F.col("PSMId"),
                F.col("Label").cast("string"),
                F.col("ScanNr").cast("string"),
                *[F.col(c).cast("string") for c in repeated],
                *[decimal_text(F.col(c)) for c in feats],
                F.concat(F.lit("-."), "Peptide", F.lit(".-")),
                F.replace("Proteins", F.lit("\t"), F.lit("    ")),
            ),
            "\t",
        ).alias("value")
    )
    # the header repeats two of the feature names, which a CSV writer would refuse
    head = "\t".join(["PSMId", "Label", "ScanNr", *repeated, *feats, "Peptide", "Proteins"])
    rows.withColumnRenamed("value", head).write.mode("overwrite").option("quote", "").option("sep", "\u0001").option(
        "header", "true"
    ).csv(path)


def read_pin(spark: SparkSession, path: str, feats: list[str]) -> DataFrame:
    """A written feature table, typed: ``feats`` as numbers, peptides unwrapped, infinite scores dropped."""
    lines = spark.read.option("sep", "\u0001").option("quote", "").option("header", "true").csv(path)
    names = lines.columns[0].split("\t")
    parts = F.split(lines[lines.columns[0]], "\t")

    def at(name: str) -> Column:
        return parts.getItem(len(names) - 1 - names[::-1].index(name))

    peptide = at("Peptide")
    return lines.select(
        at("PSMId").alias("PSMId"),
        at("Label").cast("int").alias("Label"),
        at("ScanNr").cast("long").alias("ScanNr"),
        *[at(f).cast("double").alias(f) for f in feats],
        F.substr(peptide, F.lit(3), F.length(peptide) - 4).alias("Peptide"),
        at("Proteins").alias("Proteins"),
    ).where(finite() if "score" in feats else F.lit(True))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score table of an external tool: ``(title, modseq, new_score)``."""
    rows = spark.read.option("sep", "\t").option("header", "true").csv(path)
    return external_scores(rows)


def external_scores(rows: DataFrame) -> DataFrame:
    pep = F.col("peptide")
    return rows.select(
        F.col("PSMId").alias("title"),
        F.substr(pep, F.lit(3), F.length(pep) - 4).alias("modseq"),
        F.col("score").cast("double").alias("new_score"),
    )


def import_external_scores(psms: DataFrame, targets: DataFrame, decoys: DataFrame) -> DataFrame:
    """Matches with the scores of an external tool; matches it did not score are dropped.

    Where a tool lists a match twice, the higher score counts.
    """
    scores = (
        external_scores(targets)
        .unionByName(external_scores(decoys))
        .groupBy("title", "modseq")
        .agg(F.max("new_score").alias("new_score"))
    )
    return psms.join(scores, ["title", "modseq"]).withColumn("score", F.col("new_score")).drop("new_score")
