"""Registered queries: the engine's operators on the driver's tables, each with its SQL.

Every query reads whole tables. Queries on spectra alone, and ``search_qvalues``,
have a spectrum for every eligible fragment; the others that score see the one
fragment that the fixtures plant from each text. Large results are reduced to counts and checksums
per group; the work behind them is not.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions import chem
from massloom.operators import candidates as cand
from massloom.operators import digest as dig
from massloom.operators import fdr as fdr_ops
from massloom.operators import hyperscore as hyper
from massloom.operators import ions as ion_ops
from massloom.operators import learned, report, rescoring
from massloom.operators import pin as pin_ops
from massloom.operators import running
from massloom.operators import search as search_ops
from massloom.operators import spectra as spec
from massloom.operators import xcorr as xc
from massloom.operators.cells import cell_scorer
from massloom.operators.cellscores import HyperscoreKernel, in_windows, ion_steps, ions_of
from massloom.operators.precursor import cell_rows, precursor_join
from massloom.options import (
    DigestOptions,
    HyperscoreOptions,
    IonOptions,
    PinOptions,
    QueryOptions,
    ReportOptions,
    SearchOptions,
    XcorrOptions,
)
from massloom.plans import fixtures as fx
from massloom.plans import oracle as o
from massloom.plans.oracle import sql
from massloom.sources import fasta, mgf, tables
from massloom.sources.stages import materialize, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PLAIN = DigestOptions(missed_cleavages=0, variable_mods=(), decoys=False)


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def check(text: Column) -> Column:
    """Sum that changes with any of the strings."""
    return F.sum(F.pmod(chem.stable_id(text), F.lit(1_000_003))).alias("checksum")


def _check(text: str) -> str:
    return f"sum({o._stable_id(text)} % 1000003)::BIGINT AS checksum"


def micro(value: Column, scale: float = 1e6) -> Column:
    return F.round(value * F.lit(scale)).cast("bigint")


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- proteins to peptides


@query(sql("SELECT protein_id, k, seq, length(seq)::INTEGER AS length FROM frags"))
def digest_tryptic(spark, sf_dir):
    return fx.fragment_rows(spark, sf_dir).select("protein_id", "k", "seq", F.length("seq").alias("length"))


def _per_protein(peptides: DataFrame) -> DataFrame:
    return peptides.groupBy("protein_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("letters"), check(F.col("seq"))
    )


_PER_PROTEIN = "SELECT protein_id, count(*) AS n, sum(length(seq))::BIGINT AS letters, " + _check("seq") + " FROM {} GROUP BY 1"


@query(sql(_PER_PROTEIN.format("peps")))
def digest_missed_cleavages(spark, sf_dir):
    return _per_protein(dig.digest(fx.proteins(spark, sf_dir)))


@query(sql(_PER_PROTEIN.format("mpeps")))
def met_truncation(spark, sf_dir):
    """Every protein behind a start methionine."""
    started = fx.proteins(spark, sf_dir).withColumn("seq", F.concat(F.lit("M"), "seq"))
    return _per_protein(dig.digest(started))


@query(
    sql(
        """SELECT count(*) AS proteins, sum(length(seq))::BIGINT AS residues, (SELECT count(*) FROM frags) AS fragments,
        (SELECT count(*) FROM every_planted) AS spectra, (SELECT count(DISTINCT seq) FROM frags) AS peptides FROM proteins"""
    )
)
def protein_counts(spark, sf_dir):
    frags = fx.fragment_rows(spark, sf_dir)
    return fx.proteins(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("proteins"), F.sum(F.length("seq")).alias("residues")
    ).select(
        "*",
        frags.agg(F.count(F.lit(1))).scalar().alias("fragments"),
        fx.planted(spark, sf_dir, every=True).agg(F.count(F.lit(1))).scalar().alias("spectra"),
        frags.agg(F.countDistinct("seq")).scalar().alias("peptides"),
    )


@query(sql("SELECT descr, length(seq)::INTEGER AS length, substr(md5(seq), 1, 12) AS digest FROM proteins"))
def fasta_roundtrip(spark, sf_dir):
    path = _fresh(spark, "fasta")
    fasta.write_fasta(fx.proteins(spark, sf_dir), path)
    return fasta.read_fasta(spark, path).select(
        F.col("desc").alias("descr"), F.length("seq").alias("length"), F.substring(F.md5("seq"), 1, 12).alias("digest")
    )


@query(
    sql(
        """SELECT p.title, p.charge, p.rt, round(p.pepmass, 6) AS pepmass, count(*) AS n_peaks,
        sum(round(k.mz * 1e4)::BIGINT)::BIGINT AS mz_sum, sum(k.intensity) AS intensity_sum
        FROM planted p JOIN peaks k USING (query_id) GROUP BY ALL"""
    )
)
def mgf_roundtrip(spark, sf_dir):
    path = _fresh(spark, "mgf")
    mgf.write_mgf(fx.planted(spark, sf_dir), path)
    back = mgf.read_mgf(spark, path)
    return (
        back.select("title", "charge", "rt", F.round("pepmass", 6).alias("pepmass"), F.inline("peaks"))
        .groupBy("title", "charge", "rt", "pepmass")
        .agg(
            F.count(F.lit(1)).alias("n_peaks"),
            F.sum(micro(F.col("mz"), 1e4)).alias("mz_sum"),
            F.sum("intensity").alias("intensity_sum"),
        )
    )


@query(
    sql(
        """SELECT (SELECT count(*) FROM proteins) AS proteins, (SELECT count(*) FROM planted) AS spectra,
        (SELECT count(DISTINCT title) FROM top10) AS titles, (SELECT count(*) FROM top10) AS lines"""
    )
)
def record_counts(spark, sf_dir):
    """The counters of every kind of file, on files written from the tables."""
    at = _fresh(spark, "counted")
    fasta.write_fasta(fx.proteins(spark, sf_dir), f"{at}-fasta")
    mgf.write_mgf(fx.planted(spark, sf_dir), f"{at}-mgf")
    tables.write_psm_tsv(fx.event_psms(spark, sf_dir).withColumn("cand_id", F.col("psm_id")), f"{at}-psms", 10)
    headers = spark.read.text(f"{at}-psms").where(F.startswith("value", F.lit("title\t")))
    return fasta.count_proteins(spark, f"{at}-fasta").select(
        F.col("n").alias("proteins"),
        mgf.count_spectra(spark, f"{at}-mgf").scalar().alias("spectra"),
        tables.count_titles(tables.read_psm_tsv(spark, f"{at}-psms")).scalar().alias("titles"),
        # every file has a header of its own
        (tables.count_lines(spark, f"{at}-psms").scalar() - headers.agg(F.count(F.lit(1))).scalar()).alias("lines"),
    )


@query(
    sql(
        """SELECT 'protein' AS kind, row_number() OVER (ORDER BY protein_id) - 1 AS number, descr AS name FROM proteins
        UNION ALL SELECT 'spectrum', row_number() OVER (ORDER BY query_id) - 1, title FROM planted"""
    )
)
def record_numbers(spark, sf_dir):
    """Proteins and spectra written in order to several files; a record's number is its place."""
    at = _fresh(spark, "numbered")
    fasta.write_fasta(fx.proteins(spark, sf_dir).orderBy("protein_id"), f"{at}-fasta")
    mgf.write_mgf(fx.planted(spark, sf_dir).orderBy("query_id"), f"{at}-mgf")
    proteins = fasta.read_fasta(spark, f"{at}-fasta").select(F.lit("protein").alias("kind"), F.col("protein_id").alias("number"), F.col("desc").alias("name"))
    spectra = mgf.read_mgf(spark, f"{at}-mgf").select(F.lit("spectrum").alias("kind"), F.col("query_id").alias("number"), F.col("title").alias("name"))
    return proteins.union(spectra)


@query(
    sql(
        """SELECT title, count(*) AS n, sum(score)::DOUBLE AS score_sum FROM (
            SELECT * FROM (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'Infinity'::DOUBLE ELSE score END AS seen
                FROM ev_psms JOIN events ON psm_id = event_id)
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY seen DESC, psm_id) <= 10)
        WHERE seen < 'Infinity'::DOUBLE GROUP BY title"""
    )
)
def infinite_scores(spark, sf_dir):
    """Infinite scores among the best of a spectrum are written, and dropped where the table is read."""
    path = _fresh(spark, "infinite")
    psms = fx.event_psms(spark, sf_dir).withColumn("cand_id", F.col("psm_id"))
    psms = psms.withColumn("score", F.when(F.col("psm_id") % 97 == 0, F.lit(float("inf"))).otherwise(F.col("score")))
    tables.write_psm_tsv(psms, path, 10)
    return tables.read_psm_tsv(spark, path).groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score_sum"))


@query(sql("SELECT title, truth FROM planted"))
def mgf_field_join(spark, sf_dir):
    path = _fresh(spark, "mgf")
    planted = fx.planted(spark, sf_dir)
    mgf.write_mgf(planted, path, {"SEQ": F.replace("truth", F.lit("C[57.0215]"), F.lit("C"))})
    spectra = mgf.with_mgf_field(mgf.read_mgf(spark, path), path, "SEQ")
    return spectra.select("title", chem.truth_modseq(F.try_element_at("meta", F.lit("mgf:SEQ"))).alias("truth"))


# ---------------------------------------------------------------- modifications and masses


def _plain_peptides(spark, sf_dir) -> DataFrame:
    return cand.merge_peptides(dig.digest(fx.proteins(spark, sf_dir), PLAIN))


def _plain_candidates(spark, sf_dir) -> DataFrame:
    return cand.modify(_plain_peptides(spark, sf_dir), PLAIN)


@query(sql("SELECT seq, replace(seq, 'C', 'C[57.0215]') AS modseq FROM plain"))
def fixed_mods(spark, sf_dir):
    peps = cand.with_fixed_mods(_plain_peptides(spark, sf_dir), PLAIN)
    return peps.select("seq", chem.render_modseq(F.col("seq"), F.col("mods")).alias("modseq"))


@query(
    sql(
        """SELECT sites, count(*) AS forms, sum(length(modseq))::BIGINT AS letters, """
        + _check("modseq")
        + """ FROM (SELECT length(seq) - length(replace(seq, 'M', '')) AS sites, modseq FROM cands WHERE NOT decoy) GROUP BY 1"""
    )
)
def variable_mods(spark, sf_dir):
    opts = DigestOptions(decoys=False)
    rows = cand.build_candidates(fx.proteins(spark, sf_dir), opts)
    sites = (F.length("seq") - F.length(F.replace("seq", F.lit("M"), F.lit("")))).cast("bigint")
    return rows.groupBy(sites.alias("sites")).agg(
        F.count(F.lit(1)).alias("forms"), F.sum(F.length("modseq")).alias("letters"), check(F.col("modseq"))
    )


@query(sql("SELECT cand_id, modseq FROM pcands"))
def modseq_render(spark, sf_dir):
    return _plain_candidates(spark, sf_dir).select("cand_id", "modseq")


@query(
    sql(
        """SELECT length(seq)::INTEGER AS length, count(*) AS n,
        sum(15995000 * (length(seq) - length(replace(seq, 'M', ''))) + 57021000 * (length(seq) - length(replace(seq, 'C', ''))))::BIGINT AS delta
        FROM (SELECT DISTINCT seq FROM frags) GROUP BY 1"""
    )
)
def modseq_parse(spark, sf_dir):
    labelled = F.concat(F.lit("_"), F.replace("seq", F.lit("M"), F.lit("M(ox)")), F.lit("_"))
    rows = fx.fragment_rows(spark, sf_dir).select("seq").distinct().select(labelled.alias("seq"))
    deltas = F.aggregate("mods", F.lit(0).cast("bigint"), lambda acc, m: acc + micro(m))
    return learned.parse_modseq(rows).groupBy(F.length("seq").alias("length")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(deltas).alias("delta")
    )


@query(sql("SELECT seq, round(mass * 1e9)::BIGINT AS mass, round((mass + 1.00727646688e0) / 2, 6) AS mz2 FROM pcands"))
def peptide_mass(spark, sf_dir):
    return _plain_candidates(spark, sf_dir).select(
        "seq", micro(F.col("mass"), 1e9).alias("mass"), F.round(chem.charged_mass(F.col("mass"), 2), 6).alias("mz2")
    )


@query(
    sql(
        """SELECT length, count(*) AS n, round(min(mass) * 1e9)::BIGINT AS min_mass, round(max(mass) * 1e9)::BIGINT AS max_mass
        FROM pcands WHERE mass BETWEEN 800 AND 2500 AND length BETWEEN 8 AND 20 GROUP BY 1"""
    )
)
def mass_length_filter(spark, sf_dir):
    opts = DigestOptions(
        missed_cleavages=0, variable_mods=(), decoys=False, min_length=8, max_length=20, min_mass=800.0, max_mass=2500.0
    )
    rows = cand.build_candidates(fx.proteins(spark, sf_dir), opts)
    return rows.groupBy("length").agg(
        F.count(F.lit(1)).alias("n"), micro(F.min("mass"), 1e9).alias("min_mass"), micro(F.max("mass"), 1e9).alias("max_mass")
    )


@query(
    """SELECT source, count(*) AS n, count(*) FILTER (regexp_full_match(word, '[ACDEFGHIKLMNPQRSTVWY_]+')) AS in_alphabet
    FROM (SELECT source, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1"""
)
def alphabet_filter(spark, sf_dir):
    words = fx.table(spark, sf_dir, "documents").select("source", F.explode_outer(F.split("text", " ")).alias("word"))
    return words.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("word").rlike(chem.ALPHABET_PATTERN), 1)).alias("in_alphabet")
    )


# ---------------------------------------------------------------- ions


def _ion_table(spark, sf_dir, opts: IonOptions) -> DataFrame:
    rows = ion_ops.ion_rows(_plain_candidates(spark, sf_dir), ["cand_id"], opts)
    return rows.groupBy("series", "z", "pos").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(micro(F.col("mz"), 1e5)).alias("mz_sum"),
        F.sum(micro(F.col("weight"))).alias("weight_sum"),
    )


_SHIFT = " ".join(f"WHEN '{s}' THEN {v!r}::DOUBLE" for s, v in {
    s: v - chem.ION_SHIFT["b" if s in "abc" else "y"] for s, v in chem.ION_SHIFT.items()
}.items())


def _ion_sql(series: str, charges: int, weight: str = "1", to_end: bool = False) -> str:
    listed = ", ".join(f"'{s}'" for s in series)
    upper = "length + 1" if to_end else "length"
    return sql(
        f"""SELECT series, z, pos, count(*) AS n, sum(mzi)::BIGINT AS mz_sum, sum(({weight}) * 1000000)::BIGINT AS weight_sum
        FROM (
            SELECT seq, series, z::INTEGER AS z, pos::INTEGER AS pos, length, round(
                (((CASE WHEN series IN ('a', 'b', 'c') THEN list_sum(res[1:pos])::BIGINT + {o._B}
                        ELSE list_sum(res[length - pos + 1:])::BIGINT + {o._Y} END)
                  + {chem.HYDROGEN} * (z - 1)) / 1e9 / z - (CASE series {_SHIFT} END)) / z * 1e5)::BIGINT AS mzi
            FROM (SELECT *, unnest(range(1, {upper})) AS pos FROM pcands),
                 (SELECT unnest([{listed}]) AS series), (SELECT unnest(range(1, {charges + 1})) AS z))
        GROUP BY 1, 2, 3"""
    )


@query(_ion_sql("b", 1))
def ion_ladder_b(spark, sf_dir):
    return _ion_table(spark, sf_dir, IonOptions(max_charge=1, series="b"))


@query(_ion_sql("y", 1, to_end=True))
def ion_ladder_y(spark, sf_dir):
    return _ion_table(spark, sf_dir, IonOptions(max_charge=1, series="y", exclude_end=False))


@query(_ion_sql("abcxyz", 3))
def ion_series_all(spark, sf_dir):
    return _ion_table(spark, sf_dir, IonOptions(max_charge=3, series="abcxyz"))


@query(
    _ion_sql(
        "by", 1,
        "CASE WHEN series = 'y' THEN CASE WHEN seq[length - pos + 1] = 'P' THEN 5 ELSE 1 END * 2 "
        "ELSE CASE WHEN seq[pos] = 'D' THEN 4 WHEN seq[pos] IN ('N', 'Q') THEN 2 ELSE 1 END END",
    )
)
def ion_weights(spark, sf_dir):
    weights = {"y": {"P": 5.0, "series": 2.0}, "b": {"D": 4.0, "N": 2.0, "Q": 2.0}}
    return _ion_table(spark, sf_dir, IonOptions(max_charge=1, weights=weights))


# ---------------------------------------------------------------- decoys and candidates


@query(sql(_PER_PROTEIN.format("dpeps")))
def decoy_protein_reverse(spark, sf_dir):
    return _per_protein(dig.digest_decoys(fx.proteins(spark, sf_dir)))


@query(
    sql(
        """SELECT protein_id, count(DISTINCT r) AS n, sum(DISTINCT """
        + o._stable_id("r")
        + """ % 1000003)::BIGINT AS checksum FROM (SELECT protein_id, reverse(seq[1:length(seq) - 1]) || seq[length(seq)] AS r
        FROM frags WHERE length(seq) BETWEEN 7 AND 40) GROUP BY 1"""
    )
)
def decoy_peptide_reverse(spark, sf_dir):
    opts = DigestOptions(missed_cleavages=0, decoy_type="peptide")
    rows = dig.digest_decoys(fx.proteins(spark, sf_dir), opts)
    return rows.groupBy("protein_id").agg(
        F.countDistinct("seq").alias("n"),
        F.sum_distinct(F.pmod(chem.stable_id(F.col("seq")), F.lit(1_000_003))).alias("checksum"),
    )


_LETTERS = "array_to_string(list_sort(string_split({}, '')), '')"


def _sorted_letters(text) -> Column:
    return F.array_join(F.array_sort(F.split(text, "")), "")


@query(
    sql(
        f"""SELECT protein_id, length(seq)::INTEGER AS length, md5({_LETTERS.format("seq")}) AS letters, length(seq) > 20 AS moved FROM proteins"""
    )
)
def decoy_shuffle(spark, sf_dir):
    """Whole proteins shuffled: every letter is there as often, and (beyond 20 letters) not where it was."""
    rows = fx.proteins(spark, sf_dir)
    rows = rows.withColumn("shuffled", dig.shuffle_letters(F.col("seq"), F.col("protein_id"), 0))
    return rows.select(
        "protein_id", F.length("shuffled").alias("length"), F.md5(_sorted_letters("shuffled")).alias("letters"),
        ((F.length("seq") > 20) & (F.col("shuffled") != F.col("seq"))).alias("moved"),
    )


@query(
    sql(
        f"""SELECT protein_id, count(DISTINCT w) AS n, sum(DISTINCT {o._stable_id("w")} % 1000003)::BIGINT AS checksum, true AS moved
        FROM (SELECT protein_id, {_LETTERS.format("seq[1:length(seq) - 1]")} || seq[length(seq)] AS w
            FROM frags WHERE length(seq) BETWEEN 7 AND 40) GROUP BY 1"""
    )
)
def decoy_peptide_shuffle(spark, sf_dir):
    """Fragments shuffled before their last letter; of all, at most one in twenty may come out as some target of its protein."""
    opts = DigestOptions(missed_cleavages=0, decoy_type="peptide", decoy_method="shuffle")
    proteins = fx.proteins(spark, sf_dir)
    decoys = materialize(dig.digest_decoys(proteins, opts))
    targets = dig.digest(proteins, opts).select("protein_id", "seq").distinct()
    same = decoys.join(targets, ["protein_id", "seq"], "left_semi").agg(F.count(F.lit(1))).scalar()
    whole = decoys.agg(F.count(F.lit(1))).scalar()
    n = F.length("seq")
    rows = decoys.withColumn("w", F.concat(_sorted_letters(F.left("seq", n - 1)), F.right("seq", F.lit(1))))
    return rows.groupBy("protein_id").agg(
        F.countDistinct("w").alias("n"),
        F.sum_distinct(F.pmod(chem.stable_id(F.col("w")), F.lit(1_000_003))).alias("checksum"),
    ).withColumn("moved", same * 20 <= whole)


@query(
    sql(
        """SELECT length(seq)::INTEGER AS length, count(*) AS n, """
        + _check("seq")
        + """ FROM (SELECT DISTINCT seq FROM dpeps WHERE seq NOT IN (SELECT seq FROM peps)) GROUP BY 1"""
    )
)
def decoy_dedup(spark, sf_dir):
    prot = fx.proteins(spark, sf_dir)
    targets = cand.with_fixed_mods(dig.digest(prot).select("seq").distinct())
    decoys = cand.with_fixed_mods(dig.digest_decoys(prot).select("seq").distinct())
    return cand.drop_colliding_decoys(decoys, targets).groupBy(F.length("seq").alias("length")).agg(
        F.count(F.lit(1)).alias("n"), check(F.col("seq"))
    )


@query(
    sql(
        """SELECT length, decoy, count(*) AS n, sum(round(mass * 1e6)::BIGINT)::BIGINT AS mass_sum,
        sum(length(descr))::BIGINT AS desc_letters, """
        + _check("modseq || descr")
        + """ FROM cands GROUP BY 1, 2"""
    )
)
def candidate_table(spark, sf_dir):
    rows = cand.build_candidates(fx.proteins(spark, sf_dir))
    return rows.groupBy("length", "decoy").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(micro(F.col("mass"))).alias("mass_sum"),
        F.sum(F.length("desc")).alias("desc_letters"),
        check(F.concat("modseq", "desc")),
    )


@query(
    sql(
        """SELECT seq, min(descr) FILTER (NOT decoy OR alone) AS descr, alone AS decoy, count(*) AS n_proteins
        FROM (SELECT *, bool_and(decoy) OVER (PARTITION BY seq) AS alone
              FROM (SELECT seq, descr, false AS decoy FROM peps UNION ALL SELECT seq, descr, true FROM dpeps))
        GROUP BY seq, alone"""
    )
)
def candidate_first_names(spark, sf_dir):
    """One name per peptide, with the full relation beside it."""
    relation = cand.peptide_proteins(fx.proteins(spark, sf_dir))
    merged = cand.merge_peptides(relation, names="first")
    counts = relation.groupBy("seq").agg(F.count(F.lit(1)).alias("n_proteins"))
    return merged.join(counts, "seq").select("seq", F.col("desc").alias("descr"), "decoy", "n_proteins")


# ---------------------------------------------------------------- spectra


@query(sql("SELECT query_id, charge, round(pepmass * charge - (charge - 1) * 1.00727646688e0 - 1.00727646688e0, 6) AS mass FROM every_planted"))
def precursor_mass(spark, sf_dir):
    mass = chem.precursor_mass(F.col("pepmass"), F.col("charge"))
    return fx.planted(spark, sf_dir, every=True).select("query_id", "charge", F.round(mass, 6).alias("mass"))


@query(sql("SELECT query_id, title, rt, charge, round(mass, 6) AS mass FROM every_spectra WHERE mass BETWEEN 1000 AND 3000 AND charge BETWEEN 2 AND 3"))
def query_filter(spark, sf_dir):
    opts = QueryOptions(min_mass=1000.0, max_mass=3000.0, max_charge=3)
    return fx.spectra(spark, sf_dir, opts, every=True).select("query_id", "title", "rt", "charge", F.round("mass", 6).alias("mass"))


@query(sql("SELECT query_id, round(min_mass, 6) AS min_mass, round(max_mass, 6) AS max_mass FROM every_spectra"))
def tolerance_window_ppm(spark, sf_dir):
    return fx.spectra(spark, sf_dir, every=True).select("query_id", F.round("min_mass", 6).alias("min_mass"), F.round("max_mass", 6).alias("max_mass"))


@query(sql("SELECT query_id, round(mass - 0.5e0, 6) AS min_mass, round(mass + 1.5e0, 6) AS max_mass FROM every_spectra"))
def tolerance_window_abs(spark, sf_dir):
    rows = fx.spectra(spark, sf_dir, search=SearchOptions(tolerance=(-0.5, 1.5), unit="abs"), every=True)
    return rows.select("query_id", F.round("min_mass", 6).alias("min_mass"), F.round("max_mass", 6).alias("max_mass"))


@query(
    sql(
        f"""SELECT query_id, round(abs(s.mass - t.true_mass) / t.true_mass * 1e6, 4) AS ppm FROM every_spectra s JOIN
        (SELECT protein_id * 1000000 + k AS query_id, (sums[-1] + {o._TERMS}) / 1e9 AS true_mass FROM every_psums) t USING (query_id)"""
    )
)
def ppm_error(spark, sf_dir):
    rows = fx.spectra(spark, sf_dir, every=True).withColumn("seq", F.replace("truth", F.lit("C[57.0215]"), F.lit("C")))
    rows = cand.with_fixed_mods(rows, PLAIN)
    true = chem.peptide_mass(F.col("seq"), F.col("mods"), PLAIN.nterm, PLAIN.cterm)
    return rows.select("query_id", F.round(chem.ppm_distance(F.col("mass"), true), 4).alias("ppm"))


@query(sql("SELECT query_id, count(*)::INTEGER AS n_peaks FROM every_spectra JOIN every_peaks USING (query_id) GROUP BY 1 HAVING count(*) BETWEEN 30 AND 90"))
def peak_count_filter(spark, sf_dir):
    rows = fx.spectra(spark, sf_dir, QueryOptions(min_peaks=30, max_peaks=90), every=True)
    return rows.select("query_id", F.size("peaks").alias("n_peaks"))


@query(sql("SELECT query_id, max(intensity) AS max_norm, sum(intensity) AS sum_norm FROM ev_peaks GROUP BY 1"))
def spectrum_norm(spark, sf_dir):
    peaks = fx.event_peaks(spark, sf_dir)
    top = spec.spectrum_norm(peaks, "max").withColumnRenamed("norm", "max_norm")
    return top.join(spec.spectrum_norm(peaks, "sum").withColumnRenamed("norm", "sum_norm"), "query_id")


_BINNED = """SELECT query_id, bin, s / max(s) OVER (PARTITION BY query_id) AS v FROM (
    SELECT query_id, round_even(mz / 0.1e0, 0)::INTEGER AS bin, sum(intensity) AS s FROM ev_peaks
    WHERE round_even(mz / 0.1e0, 0) < 50000 GROUP BY 1, 2)"""


@query(sql(f"SELECT query_id, bin, round(v, 6) AS intensity, round(sqrt(v), 6) AS root FROM ({_BINNED})"))
def spectrum_binned(spark, sf_dir):
    peaks = fx.event_peaks(spark, sf_dir)
    bins = spec.bin_spectra(peaks, 0.1, 50_000)
    return bins.select("query_id", "bin", F.round("intensity", 6).alias("intensity"), F.round(F.sqrt("intensity"), 6).alias("root"))


@query(sql("SELECT query_id, floor(mz / 25e0)::INTEGER AS bin, max(intensity) AS intensity FROM ev_peaks GROUP BY 1, 2"))
def spectrum_bin_max(spark, sf_dir):
    return spec.bin_max(fx.event_peaks(spark, sf_dir), 25.0)


@query(
    sql(
        f"""SELECT query_id, bin, round(v, 6) AS intensity FROM ({_BINNED})
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY v DESC, bin) <= 20"""
    )
)
def spectrum_top_peaks(spark, sf_dir):
    bins = spec.bin_spectra(fx.event_peaks(spark, sf_dir), 0.1, 50_000)
    return spec.top_peaks(bins, 20).withColumn("intensity", F.round("intensity", 6))


@query(sql("SELECT query_id, floor(mz)::INTEGER AS bin, sum(intensity) AS intensity FROM ev_peaks WHERE mz < 20000 GROUP BY 1, 2"))
def spectrum_dense_vector(spark, sf_dir):
    return spec.dense_bins(fx.event_peaks(spark, sf_dir))


# ---------------------------------------------------------------- precursor join


@query(sql("SELECT query_id, count(*) AS n, sum(cand_id % 1000003)::BIGINT AS checksum FROM pairs GROUP BY 1"))
def precursor_range_join(spark, sf_dir):
    cands = materialize(cand.build_candidates(fx.proteins(spark, sf_dir)).select("cand_id", "mass"))
    pairs = precursor_join(materialize(fx.spectra(spark, sf_dir).drop("peaks")), cands)
    return pairs.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.pmod("cand_id", F.lit(1_000_003))).alias("checksum")
    )


def _length_probs(spark, sf_dir) -> DataFrame:
    values = F.transform(F.slice("embedding", 1, learned.N_LENGTHS), lambda e: F.abs(e.cast("double")))
    rows = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), values.alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x)
    rows = rows.withColumn("total", total)
    return rows.select("query_id", F.transform("v", lambda x: x / F.col("total")).alias("length_probs"))


_LENGTHS = """SELECT query_id, list_transform(v, lambda x: x / list_sum(v)) AS probs FROM (
    SELECT vec_id AS query_id, list_transform(embedding[1:35], lambda e: abs(e::DOUBLE)) AS v FROM embeddings)"""


@query(
    sql(
        """SELECT query_id, count(*) AS n FROM pairs LEFT JOIN lengths USING (query_id)
        WHERE NOT (coalesce(probs[length - 5], 0) >= 0.05 AND len(list_filter(range(1, 36),
            lambda i: probs[i] > probs[length - 5] OR (probs[i] = probs[length - 5] AND i < length - 5))) >= 2)
        GROUP BY 1""",
        lengths=_LENGTHS,
    )
)
def candidate_filter_length(spark, sf_dir):
    spectra = fx.spectra(spark, sf_dir).drop("peaks").join(_length_probs(spark, sf_dir), "query_id", "left")
    none = F.array_repeat(F.lit(0.0), learned.N_LENGTHS)
    spectra = materialize(spectra.withColumn("length_probs", F.coalesce("length_probs", none)))
    cands = materialize(cand.build_candidates(fx.proteins(spark, sf_dir)).select("cand_id", "mass", "length"))
    pairs = precursor_join(spectra, cands, cand_filter=learned.length_filter(0.05))
    return pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- xcorr


@query(sql("SELECT query_id, round(res, 9) AS res, n_bins FROM grid"))
def xcorr_bins(spark, sf_dir):
    return xc.xcorr_bins(fx.spectra(spark, sf_dir)).select("query_id", F.round("res", 9).alias("res"), "n_bins")


_R, _KNEE = 20e-6, 0.001 / 20e-6


@query(
    sql(
        f"""SELECT query_id, n_bins, count(DISTINCT bin) AS occupied, sum(DISTINCT bin::BIGINT)::BIGINT AS checksum FROM (
            SELECT query_id, bin, max(bin) OVER (PARTITION BY query_id) + 76 AS n_bins FROM (
                SELECT query_id, (CASE WHEN mz < {_KNEE!r}::DOUBLE THEN floor(mz / 0.001e0)
                    ELSE {int(_KNEE / 0.001)} + floor(ln(greatest(mz, {_KNEE!r}::DOUBLE) / {_KNEE!r}::DOUBLE)
                        / {-math.log1p(-_R)!r}::DOUBLE) END)::INTEGER AS bin
                FROM spectra JOIN peaks USING (query_id))) GROUP BY 1, 2"""
    )
)
def xcorr_variable_bins(spark, sf_dir):
    opts = XcorrOptions(ppm_mode="bins")
    grid = xc.Binning(opts)
    rows = xc.xcorr_bins(fx.spectra(spark, sf_dir), opts)
    bins = F.array_distinct(F.transform("peaks", lambda p: grid.bin(p["mz"], F.col("res"))))
    return rows.select(
        "query_id", "n_bins", F.size(bins).cast("bigint").alias("occupied"),
        F.aggregate(bins, F.lit(0).cast("bigint"), lambda acc, b: acc + b).alias("checksum"),
    )


@query(sql("SELECT query_id, bin, round(value, 6) AS value FROM normed"))
def xcorr_normalize(spark, sf_dir):
    rows = xc.xcorr_normalize(fx.spectra(spark, sf_dir)).select("query_id", F.inline_outer("bins"))
    return rows.where(F.col("bin").isNotNull()).select("query_id", "bin", F.round("value", 6).alias("value"))


def _corrected(spark, sf_dir, mode: str) -> DataFrame:
    opts = XcorrOptions(flank_mode=mode)
    normalized = materialize(xc.xcorr_normalize(fx.spectra(spark, sf_dir), opts).select("query_id", "n_bins", "bins"))
    return xc.xcorr_correct(normalized, opts).withColumn("value", F.round("value", 6))


@query(o.corrected({0: 1.0}))
def xcorr_background(spark, sf_dir):
    return _corrected(spark, sf_dir, "none")


@query(o.corrected(o.gauss()))
def xcorr_flank_gauss(spark, sf_dir):
    return _corrected(spark, sf_dir, "gauss")


@query(o.corrected(o.halves()))
def xcorr_flank_exp(spark, sf_dir):
    return _corrected(spark, sf_dir, "exp")


@query(o.corrected({-1: 0.5, 0: 1.0, 1: 0.5}, sides=True))
def xcorr_flank_sides(spark, sf_dir):
    return _corrected(spark, sf_dir, "sides")


def _all_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    cands = materialize(cand.build_candidates(fx.proteins(spark, sf_dir)))
    return materialize(fx.spectra(spark, sf_dir)), cands


def _scored_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """``_all_sides`` for queries that read nothing else than scorers do."""
    cands = materialize(cand.build_candidates(fx.proteins(spark, sf_dir)).select(*search_ops.CANDIDATE_COLUMNS))
    return materialize(fx.spectra(spark, sf_dir)), cands


@query(
    sql("SELECT query_id, cand_id, round(score, 6) AS score, total_matched, round(sum_i, 6) AS sum_i FROM xc")
)
def xcorr_score(spark, sf_dir):
    rows = search_ops.score_xcorr(*_scored_sides(spark, sf_dir))
    return rows.select(
        "query_id", "cand_id", F.round("score", 6).alias("score"), "total_matched", F.round("sum_i", 6).alias("sum_i")
    )


# ---------------------------------------------------------------- hyperscore


def _matches(spark, sf_dir, opts: HyperscoreOptions) -> DataFrame:
    # a cell's matches leave it as one table
    sides = cell_rows(*search_ops._narrow(*_scored_sides(spark, sf_dir)), SearchOptions(pairs_per_cell=500_000))
    rows = hyper.match_ions(*sides, opts)
    return rows.groupBy("query_id", "series", "z").agg(
        F.count(F.lit(1)).alias("n"), F.sum(micro(F.col("share"))).alias("share_sum")
    )


_MATCH_SQL = """SELECT query_id, series, z::INTEGER AS z, count(*) AS n, sum(round(share * 1e6)::BIGINT)::BIGINT AS share_sum
    FROM ({}) GROUP BY 1, 2, 3"""


@query(sql(_MATCH_SQL.format("SELECT DISTINCT query_id, cand_id, peak, share, series, z FROM matches")))
def hyperscore_matches_closest(spark, sf_dir):
    return _matches(spark, sf_dir, HyperscoreOptions())


@query(sql(_MATCH_SQL.format("SELECT query_id, cand_id, peak, share, series, z FROM matches")))
def hyperscore_matches_all(spark, sf_dir):
    return _matches(spark, sf_dir, HyperscoreOptions(closest_only=False))


@query(
    sql("SELECT query_id, cand_id, round(log10(score), 6) AS log_score, total_matched, round(log10(sum_all * norm), 6) AS sum_i FROM hyper")
)
def hyperscore_score(spark, sf_dir):
    rows = search_ops.score_hyperscore(*_scored_sides(spark, sf_dir))
    return rows.select(
        "query_id", "cand_id", F.round(F.log10("score"), 6).alias("log_score"), "total_matched", F.round("sum_i", 6).alias("sum_i")
    )


@query(
    sql(
        """SELECT query_id, cand_id, round(log10(total * (CASE WHEN nb >= ny THEN factorial(least(20, nb)::INTEGER) ELSE factorial(least(20, ny)::INTEGER) END)::DOUBLE), 6) AS log_score
        FROM (SELECT query_id, cand_id, sum(share) AS total, count(*) FILTER (series = 'b') AS nb, count(*) FILTER (series = 'y') AS ny
              FROM (SELECT DISTINCT query_id, cand_id, peak, share, series, z FROM matches) GROUP BY 1, 2)"""
    )
)
def hyperscore_disjoint(spark, sf_dir):
    opts = HyperscoreOptions(disjoint=True, type_best="series", max_best=1)
    rows = search_ops.score_hyperscore(*_scored_sides(spark, sf_dir), opts)
    return rows.select("query_id", "cand_id", F.round(F.log10("score"), 6).alias("log_score"))


# ---------------------------------------------------------------- search


@query(
    sql(
        """SELECT query_id, cand_id, round(score, 6) AS score, round(x, 6) AS xcorr, round(log10(h + 1), 6) AS log_hyperscore FROM joint"""
    )
)
def combined_score(spark, sf_dir):
    rows = search_ops.score_combined(*_scored_sides(spark, sf_dir))
    return rows.select(
        "query_id", "cand_id", F.round("score", 6).alias("score"), F.round("xcorr", 6).alias("xcorr"),
        F.round(F.log10(F.col("hyperscore") + 1), 6).alias("log_hyperscore"),
    )


@query(
    sql(
        """SELECT query_id, cand_id, round((cand_mass - query_mass) / cand_mass * 1e6, 4) AS dm_ppm,
        round(abs(cand_mass - query_mass) / cand_mass * 1e6, 4) AS absdm_ppm, length AS peplen, charge,
        (charge = 2)::INTEGER AS z2, (charge = 3)::INTEGER AS z3, (charge = 4)::INTEGER AS z4,
        round(total_matched / (least((charge - 1) * 2, 6) * (length - 1)), 6) AS ion_frac,
        round(sum_i, 6) AS sum_i, total_matched, round(log10(rawscore + 1), 6) AS log_raw, round(score, 6) AS score FROM best"""
    )
)
def psm_features(spark, sf_dir):
    rows = search_ops.search(*_all_sides(spark, sf_dir), retain=10)
    return rows.select(
        "query_id", "cand_id", F.round(F.col("dM") * 1e6, 4).alias("dm_ppm"), F.round(F.col("absdM") * 1e6, 4).alias("absdm_ppm"),
        "peplen", "charge", "z2", "z3", "z4", F.round("ionFrac", 6).alias("ion_frac"), F.round("sumI", 6).alias("sum_i"),
        "total_matched", F.round(F.log10(F.col("rawscore") + 1), 6).alias("log_raw"), F.round("score", 6).alias("score"),
    )


@query(
    sql(
        """SELECT title, descr, seq, modseq, round(score, 6) AS score, charge AS query_charge, round(query_mass, 6) AS query_mass,
        round(cand_mass * 1e9)::BIGINT AS cand_mass, cand_id AS candrow, query_id AS qrow FROM best"""
    )
)
def search_topn(spark, sf_dir):
    rows = search_ops.result_table(search_ops.search(*_all_sides(spark, sf_dir), retain=10))
    return rows.select(
        "title", F.col("desc").alias("descr"), "seq", "modseq", F.round("score", 6).alias("score"), "query_charge",
        F.round("query_mass", 6).alias("query_mass"), micro(F.col("cand_mass"), 1e9).alias("cand_mass"), "candrow", "qrow",
    )


@query()
def search_qvalues(spark, sf_dir):
    """Best match and q-value of a spectrum for every eligible fragment, many of them foreign, on default candidates."""
    cands = materialize(cand.build_candidates(fx.proteins(spark, sf_dir)))
    best = materialize(search_ops.search(materialize(fx.spectra_with_foreign(spark, sf_dir)), cands, retain=1))
    return fdr_ops.with_qvalue(best).select("query_id", "title", "modseq", "truth", "decoy", "score", "fdr", "q")


@query(
    sql(
        """SELECT query_id, cand_id, modseq, round(score, 6) AS score FROM (
            SELECT * FROM joint WHERE length > 9 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) <= 10)
        JOIN pairs USING (query_id, cand_id)"""
    )
)
def search_filtered(spark, sf_dir):
    """A condition on candidates, which cuts them before they are scored."""
    rows = search_ops.search(*_all_sides(spark, sf_dir), retain=10, cand_filter=F.col("length") > 9)
    return rows.select("query_id", "cand_id", "modseq", F.round("score", 6).alias("score"))


@query(
    sql(
        """SELECT query_id, cand_id, modseq, round(score, 6) AS score FROM (
            SELECT j.* FROM joint j LEFT JOIN lengths USING (query_id)
            WHERE NOT (coalesce(probs[length - 5], 0) >= 0.05 AND len(list_filter(range(1, 36),
                lambda i: probs[i] > probs[length - 5] OR (probs[i] = probs[length - 5] AND i < length - 5))) >= 2)
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) <= 10)
        JOIN pairs USING (query_id, cand_id)""",
        lengths=_LENGTHS,
    )
)
def search_length_filter(spark, sf_dir):
    """A condition on spectrum and candidate together, evaluated where they meet."""
    spectra, cands = _all_sides(spark, sf_dir)
    none = F.array_repeat(F.lit(0.0), learned.N_LENGTHS)
    spectra = spectra.join(_length_probs(spark, sf_dir), "query_id", "left").withColumn("length_probs", F.coalesce("length_probs", none))
    rows = search_ops.search(spectra, cands, retain=10, cand_filter=learned.length_filter(0.05))
    return rows.select("query_id", "cand_id", "modseq", F.round("score", 6).alias("score"))


def _matched_ions(spectra: pa.Table, cands: pa.Table) -> pa.Table:
    """A user's scorer: how many pairs of a peak above 1 % and an ion are within 20 ppm."""
    opts, ions = HyperscoreOptions(closest_only=False, tolerance=20.0), IonOptions()
    low, high, cands = in_windows(spectra, cands)
    listed, kernel = ions_of(cands, ions, 3), HyperscoreKernel(opts, ions)
    rows, counts = [np.zeros((2, 0), np.int64)], [np.zeros(0)]
    for i, row in enumerate(spectra.select(["charge", "peaks"]).to_pylist()):
        peaks = row["peaks"] if high[i] > low[i] else []
        top = max((p["intensity"] for p in peaks), default=1.0)
        kernel.take([p["mz"] for p in peaks if p["intensity"] / top > 0.01])
        for a, b in ion_steps(listed.first, low[i], high[i]):
            run = listed.below(a, b, row["charge"])
            n = np.bincount(run.of[kernel.hits(run)[0]], minlength=b - a)
            some = np.flatnonzero(n)
            rows.append(np.stack([np.full(len(some), i), some + a]))
            counts.append(n[some].astype(float))
    of, cand = np.concatenate(rows, axis=1)
    columns = [spectra["query_id"].take(pa.array(of)), cands["cand_id"].take(pa.array(cand)), pa.array(np.concatenate(counts))]
    return pa.table(columns, names=["query_id", "cand_id", "score"])


@query(
    sql(
        """SELECT query_id, cand_id, p.charge, p.length, round(query_mass, 6) AS query_mass, n AS score
        FROM (SELECT query_id, cand_id, count(*)::DOUBLE AS n FROM matches GROUP BY 1, 2) JOIN pairs p USING (query_id, cand_id)"""
    )
)
def user_cell_scorer(spark, sf_dir):
    """A user's function over the Arrow tables of a cell."""
    scorer = cell_scorer(_matched_ions, "score double")
    rows = scorer(*_all_sides(spark, sf_dir))
    return rows.select("query_id", "cand_id", "charge", "length", F.round("query_mass", 6).alias("query_mass"), "score")


@query(
    sql(
        """SELECT title, modseq, truth, decoy, modseq = truth AS found FROM best
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) = 1"""
    )
)
def search_best(spark, sf_dir):
    rows = search_ops.search(*_all_sides(spark, sf_dir), retain=1)
    return rows.select("title", "modseq", "truth", "decoy", (F.col("modseq") == F.col("truth")).alias("found"))


@query(sql("SELECT title, count(*) AS n, round(sum(score), 6) AS score_sum, " + _check("modseq") + " FROM top10 GROUP BY 1"))
def psm_tsv_roundtrip(spark, sf_dir):
    path = _fresh(spark, "psms")
    psms = fx.event_psms(spark, sf_dir).withColumn("cand_id", F.col("psm_id"))
    tables.write_psm_tsv(psms, path, 10)
    rows = tables.read_psm_tsv(spark, path)
    return rows.groupBy("title").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("score_sum"), check(F.col("modseq"))
    )


# ---------------------------------------------------------------- false discovery rates and reports


def _levels(df: DataFrame) -> DataFrame:
    return df.select("score", "n", "cum_targets", "cum_decoys", F.round("fdr", 9).alias("fdr"), F.round("q", 9).alias("q"))


def _top1(spark, sf_dir) -> DataFrame:
    psms = fx.event_psms(spark, sf_dir).withColumn("length", F.length("seq"))
    return fdr_ops.reported(psms)


@query(
    sql(
        """SELECT score, n, cum_targets::BIGINT AS cum_targets, cum_decoys::BIGINT AS cum_decoys, round(fdr, 9) AS fdr, round(q, 9) AS q FROM lv_all"""
    )
)
def fdr_running(spark, sf_dir):
    return _levels(fdr_ops.score_table(fx.event_psms(spark, sf_dir)))


@query(sql("SELECT psm_id, round(fdr, 9) AS fdr, round(q, 9) AS q FROM ev_psms JOIN lv_all USING (score)"))
def qvalues(spark, sf_dir):
    rows = fdr_ops.with_qvalue(fx.event_psms(spark, sf_dir))
    return rows.select("psm_id", F.round("fdr", 9).alias("fdr"), F.round("q", 9).alias("q"))


@query(
    sql(
        """SELECT psm_id, round(last_value(ratio IGNORE NULLS) OVER (ORDER BY score DESC, psm_id ROWS UNBOUNDED PRECEDING), 9) AS fdr
        FROM (SELECT *, CASE WHEN opens THEN least(1e0, d / greatest(n - d, 1)) END AS ratio FROM (
            SELECT *, count(*) FILTER (opens AND decoy) OVER w AS d, count(*) OVER w AS n FROM (
                SELECT *, coalesce(lag(score) OVER v <> score, true) OR coalesce(lag(decoy) OVER v, true) AS opens
                FROM ev_psms WINDOW v AS (ORDER BY score DESC, psm_id))
            WINDOW w AS (ORDER BY score DESC, psm_id ROWS UNBOUNDED PRECEDING)))"""
    )
)
def fdr_tie_scan(spark, sf_dir):
    order = [F.desc("score"), F.asc("psm_id")]
    rows = fdr_ops.with_fdr_in_order(fx.event_psms(spark, sf_dir), order)
    return rows.select("psm_id", F.round("fdr", 9).alias("fdr"))


@query(sql("SELECT round(q, 9) AS q, n::BIGINT AS n FROM curve"))
def fdr_curve(spark, sf_dir):
    curve = fdr_ops.fdr_curve(fdr_ops.score_table(_top1(spark, sf_dir)))
    return curve.select(F.round("q", 9).alias("q"), "n")


_LIMIT = 0.3
_SUMMARY = """SELECT count(*) AS n_psms, count(DISTINCT title) AS n_spectra,
    round(count(*) FILTER (decoy) / nullif(count(*) FILTER (NOT decoy), 0), 9) AS overall_fdr,
    count(*) FILTER (score >= cut) AS psms_at, count(DISTINCT modseq) FILTER (score >= cut) AS unique_at,
    count(*) FILTER (score >= cut AND NOT decoy) AS targets_at, count(*) FILTER (score >= cut AND decoy) AS decoys_at,
    count(DISTINCT title) FILTER (score >= cut) AS spectra_at, count(DISTINCT modseq) AS unique_all, max(cut) AS cutoff,
    count(DISTINCT title) - count(DISTINCT title) FILTER (score >= cut) AS spectra_not_at
    FROM (SELECT *, (SELECT min(score) FROM {levels} WHERE q <= 0.3) AS cut FROM {rows})"""


@query(sql(_SUMMARY.format(levels="lv_top", rows="top1")))
def fdr_summary(spark, sf_dir):
    rows = fdr_ops.fdr_summary(_top1(spark, sf_dir), ReportOptions(fdr=_LIMIT))
    return rows.withColumn("overall_fdr", F.round("overall_fdr", 9))


@query(sql("SELECT DISTINCT modseq FROM ev_psms WHERE score >= (SELECT min(score) FROM lv_all WHERE q <= 0.25)"))
def unique_peptides_at_fdr(spark, sf_dir):
    psms = fx.event_psms(spark, sf_dir)
    cutoff = fdr_ops.threshold(fdr_ops.score_table(psms), 0.25).scalar()
    return psms.where(F.col("score") >= cutoff).select("modseq").distinct()


@query(
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS dimension, {p / 10} AS p, round(quantile_cont({c}, {p / 10}), 6) AS value FROM top1"
            for c in ("score", "length", "query_mass")
            for p in range(1, 10)
        )
    ).replace("AS p,", "::DOUBLE AS p,")
)
def score_deciles(spark, sf_dir):
    rows = _top1(spark, sf_dir)
    parts = [
        report.deciles(rows.withColumn(c, F.col(c).cast("double")), c).select(F.lit(c).alias("dimension"), "p", F.round("value", 6).alias("value"))
        for c in ("score", "length", "query_mass")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _by_decile(column: str, include_last: bool = False, panel: str = "") -> str:
    keep = "" if include_last else "WHERE bin < 9"
    return sql(
        f"""SELECT {panel} bin::INTEGER AS bin, decoy, count(*) AS n, min(score) AS min_score, round(avg(score), 6) AS mean_score, max(score) AS max_score
        FROM (SELECT *, len(list_filter((SELECT quantile_cont({column}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM top1),
            lambda e: e <= {column})) AS bin FROM top1) {keep} GROUP BY ALL"""
    )


def _distribution(rows: DataFrame) -> DataFrame:
    return rows.withColumn("mean_score", F.round("mean_score", 6))


@query(_by_decile("score"))
def score_by_score_decile(spark, sf_dir):
    return _distribution(report.scores_by_decile(_top1(spark, sf_dir), "score"))


@query(_by_decile("length", True))
def score_by_length_decile(spark, sf_dir):
    return _distribution(report.scores_by_decile(_top1(spark, sf_dir), "length", include_last=True))


@query(_by_decile("query_mass"))
def score_by_mass_decile(spark, sf_dir):
    return _distribution(report.scores_by_decile(_top1(spark, sf_dir), "query_mass"))


@query(
    sql(
        """SELECT charge AS bin, decoy, count(*) AS n, min(score) AS min_score, round(avg(score), 6) AS mean_score, max(score) AS max_score
        FROM top1 GROUP BY 1, 2"""
    )
)
def score_by_charge(spark, sf_dir):
    return _distribution(report.scores_by_charge(_top1(spark, sf_dir))).withColumnRenamed("charge", "bin")


_PANELS = " UNION ALL ".join(
    [f"({_by_decile(c, panel=repr(c) + ' AS panel,')})" for c in report.DECILE_PANELS]
    + [
        "(%s)" % sql(
            f"""SELECT {p!r} AS panel, {b} AS bin, decoy, count(*) AS n, min(score) AS min_score, round(avg(score), 6) AS mean_score,
            max(score) AS max_score FROM top1 GROUP BY ALL"""
        )
        for p, b in (("charge", "charge"), ("all", "0"))
    ]
)


@query(_PANELS)
def report_panels(spark, sf_dir):
    """All panels of a whole report; the saved tables are put together again."""
    psms = fx.event_psms(spark, sf_dir).withColumn("length", F.length("seq"))
    path = _fresh(spark, "report")
    report.save_report(report.report_tables(psms), path, "one")
    parts = [
        report.load_report(spark, path, f"scores_by_{name}").select(F.lit(panel).alias("panel"), "*")
        for panel, name in (("score", "score"), ("length", "length"), ("query_mass", "mass"), ("charge", "charge"))
    ]
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    total = everything.where("panel = 'charge'").groupBy("decoy").agg(
        F.sum("n").alias("n"), F.min("min_score").alias("min_score"),
        (F.sum(F.col("mean_score") * F.col("n")) / F.sum("n")).alias("mean_score"), F.max("max_score").alias("max_score"),
    )
    total = total.join(report.load_report(spark, path, "score_quantiles").select("decoy"), "decoy")
    total = total.select(F.lit("all").alias("panel"), F.lit(0).alias("bin"), "decoy", "n", "min_score", "mean_score", "max_score")
    return _distribution(everything.select(*total.columns).unionByName(total))


@query(
    sql(
        """SELECT run_id, decoy, bin, round(lo + (hi - lo) / 20e0 * bin, 6) AS low, count(*) AS n FROM (
            SELECT *, least(19, floor((v - lo) / ((hi - lo) / 20e0)))::INTEGER AS bin
            FROM (SELECT *, min(v) OVER () AS lo, max(v) OVER () AS hi FROM two)) GROUP BY ALL""",
        two="""SELECT 'a' AS run_id, decoy, score::DOUBLE AS v FROM top1 UNION ALL
            SELECT 'b', decoy, score / 2 + total_matched FROM top1""",
    )
)
def compare_histograms(spark, sf_dir):
    rows = _top1(spark, sf_dir)
    runs = {"a": rows, "b": rows.withColumn("score", F.col("score") / 2 + F.col("total_matched"))}
    return report.compare_histograms(runs, bins=20).withColumn("low", F.round("low", 6))


@query(
    sql(
        """SELECT min(score) AS min_score, max(score) AS max_score, min(length) AS min_length, max(length) AS max_length,
        min(charge) AS min_charge, max(charge) AS max_charge, round(min(query_mass), 6) AS min_query_mass,
        round(max(query_mass), 6) AS max_query_mass FROM top1"""
    )
)
def report_ranges(spark, sf_dir):
    rows = report.ranges(_top1(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("min_query_mass", "max_query_mass")})


@query(
    sql(
        """SELECT len(list_filter(range(1, 10), lambda i: floor(i * m / 10) <= idx))::INTEGER AS decile,
        round(avg(q), 9) AS mean_fdr, count(*) AS n
        FROM (SELECT q, row_number() OVER (ORDER BY q DESC) - 1 AS idx, count(*) OVER () AS m FROM curve) GROUP BY 1"""
    )
)
def fdr_by_curve_decile(spark, sf_dir):
    levels = fdr_ops.score_table(_top1(spark, sf_dir))
    return report.fdr_by_decile(levels).withColumn("mean_fdr", F.round("mean_fdr", 9))


_FALSE = """SELECT * REPLACE (modseq <> truth AS decoy) FROM top1 JOIN (
    SELECT title, truth FROM (SELECT title, modseq AS truth, row_number() OVER (PARTITION BY title ORDER BY score DESC, psm_id) AS rn
    FROM ev_psms WHERE seq NOT LIKE 'click%') WHERE rn = 1) USING (title)"""


@query(sql(_SUMMARY.format(levels="lv_false", rows="false1"), false1=_FALSE, lv_false=o.levels("false1")))
def fdp_report(spark, sf_dir):
    psms = fx.event_psms(spark, sf_dir)
    # the best match that is no click counts as the truth
    titles = search_ops.top_n(psms.where(~F.col("seq").like("click%")), 1, "title", ("psm_id",))
    titles = titles.select("title", F.col("modseq").alias("truth"))
    out = report.fdp_report(psms, titles, ReportOptions(fdr=_LIMIT))["summary"]
    return out.withColumn("overall_fdr", F.round("overall_fdr", 9))


@query(
    sql(
        """SELECT round(coalesce(a.q, b.q), 9) AS q, a.n::BIGINT AS n_a, b.n::BIGINT AS n_b
        FROM curve a FULL OUTER JOIN (SELECT q, max(cum_n) AS n FROM lv_other GROUP BY q) b ON a.q = b.q""",
        lv_other=o.levels("other"),
        other="SELECT * REPLACE (total_matched::DOUBLE AS score) FROM ev_psms",
    )
)
def compare_runs(spark, sf_dir):
    a = fdr_ops.fdr_curve(fdr_ops.score_table(_top1(spark, sf_dir)))
    other = fx.event_psms(spark, sf_dir).withColumn("score", F.col("total_matched").cast("double"))
    b = fdr_ops.fdr_curve(fdr_ops.score_table(other))
    return report.compare_runs(a, b).withColumn("q", F.round("q", 9))


# ---------------------------------------------------------------- feature tables and rescoring


@query(
    sql(
        """SELECT title AS "PSMId", CASE WHEN decoy THEN -1 ELSE 1 END AS "Label", query_id AS "ScanNr", charge::DOUBLE AS charge,
        score, total_matched::DOUBLE AS total_matched, round(delt, 6) AS "deltLCn", modseq AS "Peptide", descr AS "Proteins" FROM top10"""
    )
)
def pin_table(spark, sf_dir):
    return pin_ops.pin_features(fx.event_psms(spark, sf_dir).withColumn("cand_id", F.col("psm_id"))).withColumn(
        "deltLCn", F.round("deltLCn", 6)
    )


def _pin(spark, sf_dir) -> DataFrame:
    psms = fx.event_psms(spark, sf_dir).withColumn("cand_id", F.col("psm_id"))
    return pin_ops.pin_features(psms)


@query(
    sql(
        """SELECT title AS "PSMId", modseq AS "Peptide", score, total_matched::DOUBLE AS total_matched, round(delt, 6) AS "deltLCn" FROM top10"""
    )
)
def pin_roundtrip(spark, sf_dir):
    path = _fresh(spark, "pin")
    tables.write_pin(_pin(spark, sf_dir), path)
    rows = tables.read_pin(spark, path, ["score", "total_matched", "deltLCn"])
    return rows.select("PSMId", "Peptide", "score", "total_matched", F.round("deltLCn", 6).alias("deltLCn"))


@query(sql("SELECT psm_id, round(delt, 6) AS delt FROM top10"))
def delta_lcn(spark, sf_dir):
    psms = fx.event_psms(spark, sf_dir).withColumn("cand_id", F.col("psm_id"))
    rows = pin_ops.delta_lcn(search_ops.top_n(psms, 10))
    return rows.select("psm_id", F.round("deltLCn", 6).alias("delt"))


@query(
    sql(
        """SELECT psm_id, title, modseq, best AS score FROM ev_psms JOIN (
            SELECT title, modseq, max(score * 2 + total_matched) AS best FROM ev_psms WHERE score > 20 GROUP BY 1, 2) USING (title, modseq)"""
    )
)
def external_scores_import(spark, sf_dir):
    psms = fx.event_psms(spark, sf_dir)
    scores = psms.where(F.col("score") > 20).select(
        F.col("title").alias("PSMId"),
        (F.col("score") * 2 + F.col("total_matched")).alias("score"),
        F.concat(F.lit("-."), "modseq", F.lit(".-")).alias("peptide"),
        "decoy",
    )
    out = tables.import_external_scores(psms, scores.where(~F.col("decoy")), scores.where("decoy"))
    return out.select("psm_id", "title", "modseq", "score")


@query(
    sql(
        """SELECT title AS "PSMId", modseq AS "Peptide", (query_id % 5)::DOUBLE AS "mgf:IONS", 0e0 AS "mgf:NOTE", score FROM top10"""
    )
)
def pin_extra(spark, sf_dir):
    """Metadata of spectra as features: a number as text, and a text that is none."""
    psms = fx.event_psms(spark, sf_dir).withColumn("cand_id", F.col("psm_id"))
    entries = [F.lit("mgf:IONS"), F.pmod("query_id", F.lit(5)).cast("string"), F.lit("mgf:NOTE"), F.lit("none")]
    opts = PinOptions(use_extra=True, extra_keys=("mgf:IONS", "mgf:NOTE"))
    rows = pin_ops.pin_features(psms.withColumn("meta", F.create_map(*entries)), opts)
    return rows.select("PSMId", "Peptide", "mgf:IONS", "mgf:NOTE", "score")


_UNPIVOT = """SELECT feature, direction, value * direction AS value, decoy FROM (
    SELECT decoy, unnest(['score', 'charge', 'total_matched']) AS feature,
        unnest([score, charge::DOUBLE, total_matched::DOUBLE]) AS value FROM top10), (SELECT unnest([1, -1]) AS direction)"""


@query(
    sql(
        """SELECT feature, direction::INTEGER AS direction, sum(CASE WHEN q <= 0.25 THEN n ELSE 0 END)::BIGINT AS n FROM lv_feats GROUP BY 1, 2""",
        feats=_UNPIVOT,
        lv_feats=o.levels("feats", "value", "decoy", "feature, direction"),
    )
)
def best_feature_direction(spark, sf_dir):
    return rescoring.feature_hits(_pin(spark, sf_dir), ["score", "charge", "total_matched"], 0.25)


@query(sql("SELECT round(score, 6) AS level FROM ev_psms ORDER BY score DESC LIMIT 1 OFFSET (SELECT count(*) // 2 FROM events)"))
def middle_level(spark, sf_dir):
    return rescoring.middle_level(fx.event_psms(spark, sf_dir), "score").select(F.round("level", 6).alias("level"))


def _search_pin(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    spectra, cands = _all_sides(spark, sf_dir)
    psms = materialize(search_ops.search(spectra, cands, retain=10))
    pin = materialize(pin_ops.pin_features(psms))
    truth = spectra.select("title", F.replace("truth", F.lit("C[57.0215]"), F.lit("C")).alias("truth"))
    return psms, pin, truth


def _of_matches(rescored: DataFrame, pin: DataFrame) -> DataFrame:
    """With ``is_match``: whether the row is a match of that spectrum, with its label."""
    known = pin.select("PSMId", "Peptide", "Label").distinct().withColumn("is_match", F.lit(True))
    return rescored.join(known, ["PSMId", "Peptide", "Label"], "left").withColumn("is_match", F.coalesce("is_match", F.lit(False)))


# what must hold of scores that no SQL can learn: who has one, what it belongs to, and where it lies
@query(sql('SELECT title AS "PSMId", count(*) AS n_matches, true AS is_match, true AS in_unit FROM best GROUP BY 1'))
def rf_rescore(spark, sf_dir):
    psms, pin, _ = _search_pin(spark, sf_dir)
    rows = _of_matches(rescoring.rf_rescore(pin), pin)
    sizes = pin.groupBy("PSMId").agg(F.count(F.lit(1)).alias("n_matches"))
    return rows.join(sizes, "PSMId").select("PSMId", "n_matches", "is_match", F.col("new_score").between(0, 1).alias("in_unit"))


_FOLD = f"({o._stable_id('title')} % 10)::INTEGER"


@query(sql(f"SELECT {_FOLD} AS fold, count(*) AS n_rows, true AS within FROM best GROUP BY 1"))
def rf_train(spark, sf_dir):
    """Folds by title, with the rows held out of each and whether no more than those were identified."""
    _, pin, truth = _search_pin(spark, sf_dir)
    counts = rescoring.train_rf(pin, truth)[1]
    sizes = pin.groupBy(rescoring.fold_of(F.col("PSMId"), 10).alias("fold")).agg(F.count(F.lit(1)).alias("n_rows"))
    return sizes.join(counts, "fold", "left").select("fold", "n_rows", F.col("n").between(0, F.col("n_rows")).alias("within"))


@query(sql('SELECT DISTINCT title AS "PSMId", true AS is_match, true AS blended, true AS same_when_loaded FROM best'))
def rescorer_blend(spark, sf_dir):
    """A forest trained on the truth, saved, loaded, and blended with one tuned on the data."""
    _, pin, truth = _search_pin(spark, sf_dir)
    fitted, _ = rescoring.train_rf(pin, truth)
    path = _fresh(spark, "forest")
    fitted.save(path)
    loaded = rescoring.TrainedForest.load(spark, path)
    rows = _of_matches(rescoring.rf_rescore(pin, loaded, parts=True), pin)
    before = fitted.probability(fitted.scaled(pin), "fitted").select("PSMId", "Peptide", "fitted")
    mixed = F.lit(0.75) * F.col("base") + F.lit(0.25) * F.col("tuned")
    return rows.join(before, ["PSMId", "Peptide"]).select(
        "PSMId", "is_match",
        (F.abs(F.col("new_score") - mixed) < 1e-12).alias("blended"),
        (F.abs(F.col("base") - F.col("fitted")) < 1e-12).alias("same_when_loaded"),
    )


@query(sql("SELECT psm_id, title, modseq, true AS in_unit, true AS auc_known FROM top10"))
def linear_rescore(spark, sf_dir):
    psms = fx.event_psms(spark, sf_dir).withColumn("length", F.length("seq")).withColumn("cand_id", F.col("psm_id"))
    scored, auc = rescoring.linear_rescore(psms)
    return scored.select(
        "psm_id", "title", "modseq", F.col("score").between(0, 1).alias("in_unit"), F.lit(0.0 <= auc <= 1.0).alias("auc_known")
    )


@query(sql("SELECT title, modseq, decoy, true AS scored FROM best"))
def semi_supervised_rescore(spark, sf_dir):
    psms, pin, _ = _search_pin(spark, sf_dir)
    rescored = rescoring.apply_scores(psms, rescoring.semi_supervised_rescore(pin))
    return rescored.select("title", "modseq", "decoy", (F.abs("score") < float("inf")).alias("scored"))


# ---------------------------------------------------------------- learned features


@query(
    sql(
        """SELECT psm_id, round(coalesce(sum(coalesce(ob.v, 0) * pr.p) /
            (sqrt(sum(coalesce(ob.v, 0) * coalesce(ob.v, 0))) * sqrt(sum(pr.p * pr.p)) + 1e-10), 0), 6) AS cosine
        FROM ps LEFT JOIN pr ON ps.query_id = pr.vec AND ps.charge = pr.z LEFT JOIN ob ON ps.query_id = ob.query_id AND pr.bin = ob.bin GROUP BY 1""",
        ps="SELECT DISTINCT query_id AS psm_id, query_id, charge FROM ev_psms",
        pr="""SELECT vec_id AS vec, 2 + vec_id % 3 AS z, i AS bin, abs(embedding[i + 1]::DOUBLE) AS p
            FROM (SELECT *, unnest(range(0, len(embedding))) AS i FROM embeddings)""",
        ob="""SELECT query_id, bin, s / max(s) OVER (PARTITION BY query_id) AS v FROM (
            SELECT query_id, round_even(mz / 40e0, 0) AS bin, sum(intensity) AS s FROM ev_peaks
            WHERE round_even(mz / 40e0, 0) < 64 GROUP BY 1, 2)""",
    )
)
def spectral_cosine(spark, sf_dir):
    psms = fx.event_psms(spark, sf_dir).select("query_id", "charge").distinct()
    psms = psms.select(F.col("query_id").alias("psm_id"), "query_id", "charge", F.concat(F.lit("v"), F.col("query_id").cast("string")).alias("modseq"))
    predicted = fx.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("modseq"),
        (F.lit(2) + F.pmod("vec_id", F.lit(3))).cast("int").alias("z"),
        F.posexplode("embedding").alias("bin", "e"),
    )
    predicted = predicted.select("modseq", "z", "bin", F.abs(F.col("e").cast("double")).alias("intensity"))
    observed = spec.bin_spectra(fx.event_peaks(spark, sf_dir), 40.0, 64)
    out = learned.spectral_similarity(psms, observed, predicted)
    return out.select("psm_id", F.round("MLCorr", 6).alias("cosine"))


_LGT = """SELECT psm_id, round(pred, 6) AS pred, round(prob, 6) AS prob, round(prob / list_max(probs), 6) AS rel,
    round(pred - length, 6) AS delta, round(prob * score, 6) AS lscore, round(prob - list_max(probs), 6) AS best,
    round(prob - list_min(probs), 6) AS worst,
    round(CASE WHEN prob = 0 THEN 0 ELSE prob - s[greatest(1, list_position(s, prob) - 1)] END, 6) AS prev,
    round(CASE WHEN prob = 0 THEN 0 ELSE prob - s[least(35, list_position(s, prob) + 1)] END, 6) AS nxt
    FROM (SELECT p.*, probs, list_reverse_sort(probs) AS s, (list_position(probs, list_max(probs)) + 5)::DOUBLE AS pred,
            CASE WHEN length BETWEEN 6 AND 40 THEN probs[length - 5] ELSE 0e0 END AS prob
          FROM ev_psms p JOIN lengths USING (query_id))"""


@query(sql(_LGT, lengths=_LENGTHS))
def length_features(spark, sf_dir):
    psms = fx.event_psms(spark, sf_dir).withColumn("length", F.length("seq"))
    rows = learned.length_features(psms, _length_probs(spark, sf_dir))
    names = {
        "LgtPred": "pred", "LgtProb": "prob", "LgtRelProb": "rel", "LgtDelta": "delta", "LgtScore": "lscore",
        "LgtProbDeltaBest": "best", "LgtProbDeltaWorst": "worst", "LgtProbDeltaPrev": "prev", "LgtProbDeltaNext": "nxt",
    }
    return rows.select("psm_id", *[F.round(a, 6).alias(b) for a, b in names.items()])


_SPLIT = f"""CASE WHEN {o._stable_id('seq')} % 10 < 8 THEN 'train' WHEN {o._stable_id('seq')} % 10 = 8 THEN 'test' ELSE 'valid' END"""


@query(
    sql(
        f"""SELECT split, min(length(seq))::INTEGER AS min_length, max(length(seq))::INTEGER AS max_length, count(*) AS n
        FROM (SELECT seq, {_SPLIT} AS split FROM frags) GROUP BY 1"""
    )
)
def peptide_split(spark, sf_dir):
    rows = fx.fragment_rows(spark, sf_dir).select(F.length("seq").alias("length"), learned.split_of(F.col("seq")).alias("split"))
    return learned.length_ranges(rows)


@query(
    sql(
        f"""SELECT query_id, seq FROM (SELECT protein_id AS query_id, seq, {_SPLIT} AS split FROM picked) WHERE split = 'train'
        ORDER BY {o._stable_id("concat('7|', query_id)")}, query_id LIMIT 100"""
    )
)
def split_sample(spark, sf_dir):
    """The capped random sample a training split is cut to."""
    rows = fx.planted(spark, sf_dir).select("query_id", F.replace("truth", F.lit("C[57.0215]"), F.lit("C")).alias("seq"))
    rows = rows.withColumn("split", learned.split_of(F.col("seq")))
    return learned.sample_split(rows, "train", 100, seed=7).select("query_id", "seq")


@query(
    sql(
        """SELECT modseq, z, bin, round(p, 6) AS intensity FROM (
            SELECT modseq, z::INTEGER AS z, i::INTEGER AS bin, (i + 1) * 1e0 / (length(seq) + z * i) AS p
            FROM (SELECT DISTINCT seq, replace(seq, 'C', 'C[57.0215]') AS modseq FROM picked),
                (SELECT unnest([1, 2]) AS z), (SELECT unnest(range(0, 30)) AS i))
        QUALIFY row_number() OVER (PARTITION BY modseq, z ORDER BY p DESC, bin) <= 5"""
    )
)
def predicted_spectra(spark, sf_dir):
    """Predictions of a batch function for every candidate, cut to the largest peaks."""

    def predict(batches):
        import numpy as np
        import pandas as pd

        z, i = (a.ravel() for a in np.meshgrid([1, 2], np.arange(30), indexing="ij"))
        for pdf in batches:
            n = pdf["seq"].str.len().to_numpy()[:, None]
            yield pd.DataFrame(
                {
                    "modseq": np.repeat(pdf["modseq"].to_numpy(), len(z)),
                    "z": np.tile(z, len(pdf)).astype("int32"),
                    "bin": np.tile(i, len(pdf)).astype("int32"),
                    "intensity": ((i + 1) / (n + z * i)).ravel(),
                }
            )

    seqs = fx.planted(spark, sf_dir).select(F.replace("truth", F.lit("C[57.0215]"), F.lit("C")).alias("seq")).distinct()
    cands = cand.with_fixed_mods(seqs, PLAIN).withColumns(
        {"modseq": chem.render_modseq(F.col("seq"), F.col("mods")), "mass": F.lit(0.0)}
    )
    best = learned.top_predicted(learned.with_predicted_spectra(cands, predict), 5)
    return best.select("modseq", "z", "bin", F.round("intensity", 6).alias("intensity"))


@query(
    sql(
        """SELECT length, n, round(n / sum(n) OVER (), 9) AS prior, round(1 / (35 * (n / sum(n) OVER ())), 6) AS weight
        FROM (SELECT length(seq)::INTEGER AS length, count(*) AS n FROM frags WHERE length(seq) BETWEEN 6 AND 40 GROUP BY 1)"""
    )
)
def length_class_weights(spark, sf_dir):
    rows = fx.fragment_rows(spark, sf_dir).select(F.length("seq").alias("length"))
    out = learned.length_class_weights(rows)
    return out.select("length", "n", F.round("prior", 9).alias("prior"), F.round("weight", 6).alias("weight"))


@query(
    sql(
        """SELECT seq, 943 AS cells, 40::BIGINT AS hot, round(41 * mass / 5000, 3) AS mass_sum,
        round(57.021e0 * (length(seq) - length(replace(seq, 'C', ''))), 3) AS mod_sum FROM (
            SELECT seq, (list_sum([CASE seq[i] """
        + " ".join(f"WHEN '{a}' THEN {m + (57_021_000_000 if a == 'C' else 0)}" for a, m in chem.RESIDUE_MASS.items() if a != "_")
        + f""" END for i in range(1, length(seq) + 1)])::BIGINT + {o._TERMS}) / 1e9 AS mass FROM planted_seq)""",
        planted_seq="SELECT DISTINCT seq FROM picked WHERE length(seq) < 40",
    )
)
def peptide_embedding(spark, sf_dir):
    rows = fx.planted(spark, sf_dir).select("query_id", "charge", F.replace("truth", F.lit("C[57.0215]"), F.lit("C")).alias("seq"))
    rows = learned.spectrum_training_rows(rows).dropDuplicates(["seq"])
    flat = F.flatten("embedding")

    def total(first: int, last: int) -> Column:
        return F.aggregate(
            "embedding", F.lit(0.0),
            lambda acc, r: acc + F.aggregate(F.slice(r, first, last - first + 1), F.lit(0.0), lambda a, x: a + x.cast("double")),
        )

    return rows.select(
        "seq", F.size(flat).alias("cells"), total(1, 21).cast("bigint").alias("hot"),
        F.round(total(22, 22), 3).alias("mass_sum"), F.round(total(23, 23), 3).alias("mod_sum"),
    )


_LENGTH_BINS = """SELECT query_id, bin, sqrt(s / max(s) OVER (PARTITION BY query_id)) AS v FROM (
    SELECT query_id, round_even(mz / 0.1e0, 0)::INTEGER AS bin, sum(intensity) AS s FROM peaks JOIN spectra USING (query_id)
    WHERE round_even(mz / 0.1e0, 0) < 20000 GROUP BY 1, 2)"""


@query(
    sql(
        """SELECT query_id, 20001 AS size, count(*)::INTEGER + 1 AS filled, sum(bin)::BIGINT + 20000 AS places,
        round(sum(v), 6) AS total, round(max(mass) / 2000, 9) AS last FROM lbins JOIN spectra USING (query_id) GROUP BY 1""",
        lbins=_LENGTH_BINS,
    )
)
def length_vectors(spark, sf_dir):
    """The sparse vectors length models learn from, as their entries."""
    v = F.unwrap_udt("features")
    rows = learned.length_vectors(materialize(fx.spectra(spark, sf_dir))).select("query_id", v.alias("v"))
    sums = F.aggregate(F.col("v.values"), F.lit(0.0), lambda a, x: a + x) - F.element_at("v.values", -1)
    return rows.select(
        "query_id", F.col("v.size").alias("size"), F.size("v.indices").alias("filled"),
        F.aggregate(F.col("v.indices"), F.lit(0).cast("long"), lambda a, x: a + x).alias("places"),
        F.round(sums, 6).alias("total"), F.round(F.element_at("v.values", -1), 9).alias("last"),
    )


@query(
    sql(
        """SELECT query_id, 35 AS n, true AS sums_to_one, true AS in_unit FROM spectra
        JOIN (SELECT protein_id AS query_id, seq FROM picked) USING (query_id) WHERE length(seq) BETWEEN 6 AND 40"""
    )
)
def length_classifier(spark, sf_dir):
    """Lengths from 20,000 bins and the mass, by a classifier with its default iterations."""
    from pyspark.ml.classification import LogisticRegression

    spectra = materialize(fx.spectra(spark, sf_dir))
    labelled = spectra.select("query_id", F.replace("truth", F.lit("C[57.0215]"), F.lit("C")).alias("seq"))
    rows = learned.length_training_rows(labelled)
    data = materialize(learned.length_vectors(spectra).join(rows, "query_id"))
    model = LogisticRegression(weightCol="weight").fit(data.where("split = 'train' and weight is not null"))
    out = learned.predict_lengths(data.select("query_id", "features"), model)
    total = F.aggregate("length_probs", F.lit(0.0), lambda x, y: x + y)
    return out.select(
        "query_id", F.size("length_probs").alias("n"), (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        F.forall("length_probs", lambda p: p.between(0, 1)).alias("in_unit"),
    )


# ---------------------------------------------------------------- whole runs


@query(sql(_SUMMARY.replace("0.3)", "0.05)").format(levels="lv_best", rows="best1"), lv_best=o.levels("best1"),
    # a report breaks ties by the number of the match
    best1=f"""SELECT * FROM best QUALIFY row_number() OVER (
        PARTITION BY title ORDER BY score DESC, {o._stable_id("query_id || '|' || cand_id")}) = 1""")
    .replace("max(cut) AS cutoff", "round(max(cut), 6) AS cutoff"))
def stage_resume(spark, sf_dir):
    """Search once with default options, then report again from the stored stages with another limit."""
    from massloom.plans.run import RunOptions, run_stages

    path = _fresh(spark, "run")
    inputs = dict(proteins=fx.proteins(spark, sf_dir), spectra=fx.planted(spark, sf_dir))
    run_stages(spark, path, **inputs, stages=("candidates", "spectra", "psms"))
    run_stages(spark, path, opts=RunOptions(report=ReportOptions(fdr=0.05)), stages=("report", "pin"))
    rows = report.load_report(spark, f"{path}/report", "summary").drop("run_id")
    return rows.withColumns({"overall_fdr": F.round("overall_fdr", 9), "cutoff": F.round("cutoff", 6)})


@query(
    sql(
        """SELECT title, modseq, round(3 * closeness + 1.5, 6) AS score, 1.5e0 AS extra_feature, n_peaks FROM (
            SELECT query_id, modseq, 1 / (1 + abs(cand_mass - query_mass)) AS closeness FROM pairs WHERE length(seq) > 7
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY closeness DESC, cand_id) <= 10)
        JOIN spectra USING (query_id) JOIN (SELECT query_id, count(*)::INTEGER AS n_peaks FROM peaks GROUP BY 1) USING (query_id)"""
    )
)
def hooks_roundtrip(spark, sf_dir):
    """A run with a user function in every slot."""
    from massloom.plans.hooks import Hooks, batch_hook
    from massloom.plans.run import RunOptions, run_stages

    def later(pdf):
        return pdf.assign(rt=pdf["length"] * 1.5)

    def plain_score(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("score", F.size("ions") / (1.0 + F.abs(F.col("cand_mass") - F.col("query_mass"))))

    def one_ion(cands: DataFrame) -> DataFrame:
        ion = F.struct(
            F.lit("b").alias("series"), F.lit(1).alias("z"), F.lit(1).alias("pos"), F.lit(500.0).alias("mz"), F.lit(1.0).alias("weight")
        )
        return cands.withColumn("ions", F.array(ion))

    def user_rescore(psms: DataFrame, pin: DataFrame) -> DataFrame:
        user = pin.select(F.col("PSMId").alias("title"), F.col("Peptide").alias("modseq"), "user_feature")
        new = F.col("score") + F.col("extra_feature") + F.col("user_feature")
        return psms.join(user, ["title", "modseq"]).withColumn("score", new).select(*psms.columns)

    scorer = search_ops.pairwise_scorer(plain_score)
    hooks = Hooks(
        proteins=lambda p, opts: dig.digest(p, opts),
        decoy_proteins=lambda p, opts: dig.digest_decoys(p, opts),
        spectrum=one_ion,
        retention_time=batch_hook(later, "rt double"),
        candidates=lambda c: c.where(F.col("rt") > 0),
        spectra=lambda s: s.withColumn("n_peaks", F.size("peaks")),
        cand_filter=F.col("length") > 7,
        scorer=scorer,
        post_search=lambda p: p.withColumn("extra_feature", F.col("cand_rt") / F.col("length")),
        pin_features=lambda p: p.withColumn("user_feature", F.col("score") * 2),
        rescore=user_rescore,
    )
    done = run_stages(
        spark, _fresh(spark, "run"), fx.proteins(spark, sf_dir), fx.planted(spark, sf_dir),
        RunOptions(), ("candidates", "spectra", "psms", "pin", "rescored"), hooks,
    )
    return done["rescored"].select("title", "modseq", F.round("score", 6).alias("score"), "extra_feature", "n_peaks")
