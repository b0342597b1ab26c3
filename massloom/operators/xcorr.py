"""Cross-correlation score.

The corrected spectrum is linear in the normalised one: every occupied bin adds
a fixed pattern (its own flanks, less its share of the background) to the bins
around it. A pair's score is therefore a join of occupied bins to ion bins
within reach of that pattern, and a sum; no dense spectrum is ever built.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.functions import chem
from massloom.functions.chem import bind
from massloom.operators.matching import PAIR, carried_columns, ions_considered, match, mz_buckets
from massloom.operators.precursor import CELL
from massloom.options import IonOptions, XcorrOptions


class Binning:
    """m/z to bin number and back, for one setting of the options.

    ``res`` is the bin width of a spectrum; the ``bins`` mode has widths that
    grow with m/z instead, with edges stepping down from ``max_mass``.
    """

    def __init__(self, opts: XcorrOptions):
        self.opts = opts
        self.variable = opts.unit == "ppm" and opts.ppm_mode == "bins"
        if self.variable:
            if opts.min_bin <= 0:
                raise ValueError("the bins mode needs a positive min_bin")
            self.rate = opts.resolution * 1e-6
            self.knee = min(opts.min_bin / self.rate, opts.max_mass)  # below: constant width
            self.linear = int(self.knee / opts.min_bin)

    def width(self, mass: Column, top: Column) -> Column:
        o = self.opts
        if o.unit != "ppm":
            return F.lit(float(o.resolution))
        least = F.lit(max(0.0, o.min_bin))
        base = mass if o.ppm_mode == "mass" else top
        return F.greatest(base * F.lit(1e-6) * F.lit(o.resolution), least)

    def bin(self, mz: Column, res: Column) -> Column:
        if not self.variable:
            return F.floor(mz / res).cast("int")
        low = F.floor(mz / F.lit(self.opts.min_bin))
        high = F.floor(F.log(F.greatest(mz, F.lit(self.knee)) / F.lit(self.knee)) / F.lit(-math.log1p(-self.rate)))
        return F.when(mz < self.knee, low).otherwise(F.lit(self.linear) + high).cast("int")

    def number(self, mz: np.ndarray, res: float) -> np.ndarray:
        """``bin`` of an array."""
        if not self.variable:
            return np.floor(mz / res).astype(np.int64)
        low = np.floor(mz / self.opts.min_bin)
        high = np.floor(np.log(np.maximum(mz, self.knee) / self.knee) / -math.log1p(-self.rate))
        return np.where(mz < self.knee, low, self.linear + high).astype(np.int64)

    def low_edge(self, bin_: Column, res: Column) -> Column:
        if not self.variable:
            return bin_ * res
        low = bin_ * F.lit(self.opts.min_bin)
        high = F.lit(self.knee) * F.exp((bin_ - self.linear) * F.lit(-math.log1p(-self.rate)))
        return F.when(bin_ < self.linear, low).otherwise(high)


def xcorr_bins(spectra: DataFrame, opts: XcorrOptions = XcorrOptions()) -> DataFrame:
    """Bin width ``res`` and number of bins ``n_bins`` of each spectrum."""
    grid = Binning(opts)
    top = F.array_max(F.transform("peaks", lambda p: p["mz"]))
    df = spectra.withColumn("max_mz", top).where(F.col("max_mz").isNotNull())
    df = df.withColumn("res", grid.width(F.col("mass"), F.col("max_mz")))
    return df.withColumn("n_bins", grid.bin(F.col("max_mz"), F.col("res")) + F.lit(opts.window + 1))


def xcorr_normalize(spectra: DataFrame, opts: XcorrOptions = XcorrOptions()) -> DataFrame:
    """Add ``bins``, the occupied bins with their normalised intensity.

    Highest peak per bin, square root, then each of ``norm_windows`` equal
    stretches scaled by its own maximum; what lies below the cutoff or beyond
    the last stretch is zero and left out. Works inside the spectrum's row.
    """
    grid = Binning(opts)
    df = xcorr_bins(spectra, opts)
    res = F.col("res")
    reach = F.least(grid.bin(F.col("mass") + 50, res), grid.bin(F.col("max_mz"), res))
    df = df.withColumn("_stretch", F.floor(reach / F.lit(opts.norm_windows) + 1).cast("int"))
    stretch = F.col("_stretch")

    placed = F.array_sort(
        F.transform(
            "peaks",
            lambda p: F.struct(
                grid.bin(p["mz"], res).alias("bin"), (-F.sqrt(p["intensity"])).alias("neg")
            ),
        )
    )

    def highest(sorted_peaks: Column) -> Column:
        first = F.filter(
            sorted_peaks,
            lambda p, i: (i == 0) | (F.get(sorted_peaks, i - 1)["bin"] != p["bin"]),
        )
        return F.transform(first, lambda p: F.struct(p["bin"].alias("bin"), (-p["neg"]).alias("v")))

    def scaled(occupied: Column) -> Column:
        cutoff = F.array_max(F.transform(occupied, lambda b: b["v"])) * F.lit(opts.cutoff)
        tops = F.transform(
            F.sequence(F.lit(0), F.lit(opts.norm_windows - 1)),
            lambda i: F.array_max(
                F.transform(
                    F.filter(occupied, lambda b: F.floor(b["bin"] / stretch) == i), lambda b: b["v"]
                )
            ),
        )

        def apply(limits: Column) -> Column:
            least, heights = limits["cutoff"], limits["tops"]
            kept = F.filter(
                occupied, lambda b: (b["v"] > least) & (F.floor(b["bin"] / stretch) < opts.norm_windows)
            )
            return F.transform(
                kept,
                lambda b: F.struct(
                    b["bin"].alias("bin"),
                    (
                        b["v"]
                        * (F.lit(opts.multiplier) / F.get(heights, F.floor(b["bin"] / stretch).cast("int")))
                    ).alias("value"),
                ),
            )

        return bind(F.struct(cutoff.alias("cutoff"), tops.alias("tops")), apply)

    occupied = bind(placed, highest)
    return df.withColumn("bins", bind(occupied, scaled)).drop("_stretch")


def kernel(opts: XcorrOptions) -> dict[int, float]:
    """Weight a corrected bin hands to the bin at each offset."""
    if opts.flank_length < 0:
        raise ValueError("flank_length must not be negative")
    if opts.flank_mode == "none":
        return {0: 1.0}
    if opts.flank_mode == "sides":
        return {-1: 0.5, 0: 1.0, 1: 0.5}
    offsets = range(-opts.flank_length, opts.flank_length + 1)
    if opts.flank_mode == "exp":
        return {k: 0.5 ** abs(k) for k in offsets}
    if opts.flank_mode == "gauss":
        return {k: math.exp(-0.5 * k * k) / math.sqrt(2 * math.pi) for k in offsets}
    raise ValueError(f"unknown flank mode {opts.flank_mode!r}")


def _in_background(source: Column, occupied: Column, opts: XcorrOptions) -> Column:
    """Whether an occupied bin is in the moving sum around ``source``.

    The reference form takes bins source-w-1 to source+w-1, and the first w bins,
    once in, never leave the sum.
    """
    w = opts.window
    if opts.background == "symmetric":
        return F.abs(source - occupied) <= w
    return (occupied <= source + (w - 1)) & ((occupied < w) | (occupied >= source - (w + 1)))


def _share(target: Column, occupied: Column, n_bins: Column, opts: XcorrOptions) -> Column:
    """What one unit at bin ``occupied`` adds to the corrected spectrum at ``target``."""
    w2 = 2 * opts.window
    total = F.lit(0.0)
    for k, weight in kernel(opts).items():
        source = target - k
        inside = (source >= 0) & (source < n_bins)
        if k != 0 and opts.flank_mode == "sides":
            inside = inside & ((source < n_bins - 1) if k > 0 else (source > 0))
        elif k != 0:
            # flanks stop where they would reach either end of the spectrum
            inside = inside & (source > abs(k)) & (n_bins - 1 - source > abs(k))
        own = F.when(source == occupied, F.lit(1 + 1 / w2)).otherwise(F.lit(0.0))
        lost = F.when(_in_background(source, occupied, opts), F.lit(1 / w2)).otherwise(F.lit(0.0))
        total = total + F.when(inside, F.lit(weight) * (own - lost)).otherwise(F.lit(0.0))
    return total


def _reach(opts: XcorrOptions) -> int:
    return opts.window + 2 + max(kernel(opts))


def _in_reach(target: Column, occupied: Column, opts: XcorrOptions) -> Column:
    far = _reach(opts)
    stays = F.lit(opts.background == "reference") & (occupied < opts.window)
    return (target >= occupied - far) & (stays | (target <= occupied + far))


def _reach_end(occupied: Column, n_bins: Column, opts: XcorrOptions) -> Column:
    stays = F.lit(opts.background == "reference") & (occupied < opts.window)
    return F.when(stays, n_bins).otherwise(F.least(occupied + _reach(opts) + 1, n_bins))


def xcorr_correct(
    normalized: DataFrame, opts: XcorrOptions = XcorrOptions(), at: DataFrame | None = None
) -> DataFrame:
    """Corrected value at the bins of ``at(query_id, bin)``, or else at the occupied bins."""
    block = 2 * _reach(opts)
    sources = normalized.select("query_id", "n_bins", F.inline("bins").alias("occupied", "value")).select(
        "*",
        F.explode(
            F.sequence(
                F.floor(F.greatest(F.col("occupied") - _reach(opts), F.lit(0)) / block).cast("int"),
                F.floor(_reach_end(F.col("occupied"), F.col("n_bins"), opts) / block).cast("int"),
            )
        ).alias("_block"),
    )
    if at is None:
        at = normalized.select("query_id", F.inline("bins")).select("query_id", "bin")
    targets = at.withColumn("_block", F.floor(F.col("bin") / block).cast("int"))
    near = targets.join(sources, ["query_id", "_block"]).where(
        _in_reach(F.col("bin"), F.col("occupied"), opts) & (F.col("bin") < F.col("n_bins"))
    )
    share = _share(F.col("bin"), F.col("occupied"), F.col("n_bins"), opts)
    return near.groupBy("query_id", "bin").agg(F.sum(F.col("value") * share).alias("value"))


def _occupied(spectra: DataFrame, opts: XcorrOptions) -> DataFrame:
    """Occupied bins under every m/z bucket their pattern reaches."""
    grid = Binning(opts)
    carried = carried_columns(spectra)
    described = spectra.select(*CELL, "query_id", "charge", "mass", "min_mass", "max_mass", "peaks", *carried)
    names = described.columns[len(CELL) + 6 :]
    rows = xcorr_normalize(described, opts).select(
        *CELL, "query_id", "charge", F.col("mass").alias("query_mass"), "min_mass", "max_mass", *names, "res", "n_bins",
        F.inline_outer("bins").alias("occupied", "value"),
    ).where(F.col("value").isNotNull())
    low = F.greatest(F.col("occupied") - _reach(opts), F.lit(0))
    high = _reach_end(F.col("occupied"), F.col("n_bins"), opts) + 1
    return rows.select(
        "*",
        mz_buckets(
            grid.low_edge(low, F.col("res")), grid.low_edge(high, F.col("res")), opts.mz_bucket
        ).alias("mz_bucket"),
    )


def xcorr(
    spectra: DataFrame,
    cands: DataFrame,
    opts: XcorrOptions = XcorrOptions(),
    ions: IonOptions = IonOptions(),
    pair_filter=None,
) -> DataFrame:
    """Score of every pair with an ion near a peak, from both sides labelled by cell.

    A bin counts once per pair however many ions fall into it. A pair without
    an ion in reach of any peak would score zero and does not appear.
    """
    grid = Binning(opts)
    ion_bin = grid.bin(F.col("ion_mz"), F.col("res"))
    near = match(
        _occupied(spectra, opts),
        cands,
        _in_reach(ion_bin, F.col("occupied"), opts) & (ion_bin < F.col("n_bins")),
        opts.mz_bucket,
        ions,
        pair_filter,
    )
    by = PAIR + ["n_bins", "occupied", "value", "ion_bin"]
    near = near.withColumn("ion_bin", ion_bin)
    if opts.ignore_weights:
        once = near.groupBy(*by).agg(F.count(F.lit(1)).alias("_")).withColumn("weight", F.lit(1.0))
    else:
        first = F.min(F.struct("rank", "weight"))
        once = near.groupBy(*by).agg(first.alias("_f")).withColumn("weight", F.col("_f.weight"))
    share = _share(F.col("ion_bin"), F.col("occupied"), F.col("n_bins"), opts)
    hit = F.col("ion_bin") == F.col("occupied")
    return (
        once.groupBy(*PAIR)
        .agg(
            chem.exact_sum(F.col("value") * share * F.col("weight"), opts.multiplier).alias("score"),
            F.count(F.when(hit, 1)).alias("total_matched"),
            chem.exact_sum(F.when(hit, F.col("value")).otherwise(0.0), opts.multiplier).alias("sum_i"),
        )
        .where(F.col("score") > 0)
        .withColumn("ion_frac", F.col("total_matched") / ions_considered(ions, opts.series_count))
        .select(*PAIR, "score", "total_matched", "sum_i", "ion_frac")
    )
