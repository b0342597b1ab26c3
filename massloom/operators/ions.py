"""Theoretical fragment ions of candidates."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.functions import chem
from massloom.options import IonOptions

FROM_START = "abc"
FROM_END = "xyz"
ION_FIELDS = ("series", "z", "pos", "mz", "weight", "rank")


def end_nano(series: str, opts: IonOptions) -> int:
    """What the end groups of a series add to its residues."""
    cterm = chem.nano(opts.cterm)
    return cterm - chem.HYDROXYL + chem.HYDROGEN if series in FROM_START else cterm + 2 * chem.HYDROGEN


def ion_shift(series: str) -> float:
    """A series' distance from b or y."""
    base = "b" if series in FROM_START else "y"
    return chem.ION_SHIFT[series] - chem.ION_SHIFT[base] if series != base else 0.0


def letter_weight(series: str, opts: IonOptions) -> np.ndarray:
    """Weight of an ion of ``series`` by the character code of its residue."""
    told = opts.weights.get(series) or {}
    out = np.ones(256)
    for letter, value in told.items():
        if letter != "series":
            out[ord(letter)] = value
    return out * float(told.get("series", 1.0))


def _ion_mz(series: Column, z: Column, nano: Column, opts: IonOptions) -> Column:
    """m/z of an ion whose residues sum to ``nano``."""
    ends = F.when(series.isin(*FROM_START), F.lit(end_nano("b", opts))).otherwise(F.lit(end_nano("y", opts)))
    charged = (nano + ends + F.lit(chem.HYDROGEN) * (z - 1)) / F.lit(1e9)
    shift = F.lit(0.0)
    for s in opts.series:
        if s not in "by":
            shift = F.when(series == s, F.lit(ion_shift(s))).otherwise(shift)
    if opts.charge_division == "standard":
        return (charged - shift) / z
    return (charged / z - shift) / z


def _weight(series: Column, letter: Column, opts: IonOptions) -> Column:
    weight = F.lit(1.0)
    for s in opts.series:
        table = opts.weights.get(s)
        if not table:
            continue
        w = F.lit(1.0)
        for aa, value in table.items():
            if aa != "series":
                w = F.when(letter == aa, F.lit(float(value))).otherwise(w)
        weight = F.when(series == s, w * F.lit(float(table.get("series", 1.0)))).otherwise(weight)
    return weight


def ion_rows(cands: DataFrame, keep: list[str], opts: IonOptions = IonOptions()) -> DataFrame:
    """One row per ion: ``keep`` and series, z, pos, mz, weight, rank.

    ``rank`` orders the ions of a candidate by charge, series and position. A
    candidate table with its own ``ions`` column (a user spectrum function)
    supplies the ions itself.
    """
    if any(s not in FROM_START + FROM_END for s in opts.series):
        raise ValueError(f"unknown ion series in {opts.series!r}")
    n_series = len(opts.series)
    place = F.lit(0)
    for i, s in enumerate(opts.series):
        place = F.when(F.col("series") == s, F.lit(i)).otherwise(place)
    rank = ((F.col("z") - 1) * n_series + place) * F.lit(1 << 20) + F.col("pos")
    if "ions" in cands.columns:
        return cands.select(*keep, F.inline("ions")).withColumn("rank", rank)

    kinds = F.array(
        *[
            F.struct(F.lit(s).alias("series"), F.lit(z).alias("z"))
            for z, s in product(range(1, opts.max_charge + 1), opts.series)
        ]
    )
    ladder = cands.select(
        *keep,
        F.col("seq"),
        F.length("seq").alias("_n"),
        chem.prefix_masses(F.col("seq"), F.col("mods")).alias("_sums"),
    )
    # rung i cuts after residue i: the first i residues to the left, the rest to the right
    rungs = ladder.select(
        *keep, "seq", "_n", F.get("_sums", F.col("_n") - 1).alias("_total"), F.posexplode_outer("_sums").alias("_i0", "_sum")
    ).withColumn("_i", F.col("_i0") + 1)
    if opts.exclude_end:
        rungs = rungs.where(F.col("_i") < F.col("_n"))
    last = F.col("_i") == F.col("_n")
    ions = rungs.select("*", F.explode(kinds).alias("_kind")).select("*", "_kind.*")
    left = F.col("series").isin(*FROM_START)
    nano = F.when(left, F.col("_sum")).otherwise(
        F.when(last, F.col("_total")).otherwise(F.col("_total") - F.col("_sum"))
    )
    pos = F.when(left | last, F.col("_i")).otherwise(F.col("_n") - F.col("_i"))
    at = F.when(left, F.col("_i")).otherwise(F.when(last, F.lit(1)).otherwise(F.col("_i") + 1))
    weight = _weight(F.col("series"), F.substr("seq", at, F.lit(1)), opts) if opts.weights else F.lit(1.0)
    return (
        ions.withColumn("pos", pos)
        .withColumn("mz", _ion_mz(F.col("series"), F.col("z"), nano, opts))
        .withColumn("weight", weight)
        .withColumn("rank", rank)
        .select(*keep, *ION_FIELDS)
    )


def theoretical_ions(cands: DataFrame, opts: IonOptions = IonOptions()) -> DataFrame:
    return ion_rows(cands, ["cand_id", "seq", "modseq"], opts)
