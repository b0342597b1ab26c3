"""Cross-correlation and hyperscore of whole cells with numpy.

Candidates of a cell lie in the order of their masses, so the candidates of a spectrum are one run of them and their
ions one run of a flat array. The corrected spectrum is laid out once per spectrum, its background from running sums;
both scores then look at the same ions.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from massloom.functions import chem
from massloom.operators.cells import score_cells
from massloom.operators.ions import FROM_START, end_nano, ion_shift, letter_weight
from massloom.operators.precursor import CELL
from massloom.operators.xcorr import Binning, kernel, xcorr_normalize
from massloom.options import HyperscoreOptions, IonOptions, SearchOptions, XcorrOptions

SLICE = 1 << 19  # ions looked at in one step
NEAR_STRETCHES = 1 << 14  # stretches of m/z that tell where a spectrum has peaks
CEILING = sys.float_info.max
FACTORIAL = np.cumprod([1.0, *range(1, 21)])
PAIR_SCHEMA = "query_id bigint, charge int, query_mass double, cand_id bigint, cand_mass double, length int"
VALUES = "score double, rawscore double, total_matched bigint, sum_i double, ion_frac double"


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column end to end, and where each row begins; null is empty."""
    rows = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    counts = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return rows.flatten(), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _numbers(column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


class OwnIons:
    """Ions that candidates bring along, end to end; those of candidate i lie from ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, cands: pa.Table, opts: IonOptions):
        listed, self.first = _lists(cands["ions"])
        series, self.z, self.pos, self.mz, self.weights = (
            _numbers(listed.field(x)) for x in ("series", "z", "pos", "mz", "weight")
        )
        self.place = np.zeros(len(series), np.int64)
        for i, s in enumerate(opts.series):
            self.place[series == s] = i
        self.of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def below(self, a: int, b: int, charge: int) -> IonRun:
        own = np.flatnonzero(self.z[self.first[a] : self.first[b]] < charge) + self.first[a]
        return IonRun(self, own, self.mz[own], self.of[own] - a)

    def describe(self, own: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, ...]:
        at = own[which]
        return self.z[at].astype(np.int64), self.place[at], self.pos[at].astype(np.int64), self.weights[at].astype(float)


class LadderIons:
    """The series of candidates with seq and mods: a row for each cut, a column for each charge and series.

    Cuts of candidate i are the rows from ``first[i]`` to ``first[i + 1]`` (in ions), charges ascend along the columns,
    so the ions below a charge are the first columns.
    """

    def __init__(self, cands: pa.Table, opts: IonOptions, most_z: int):
        self.opts = opts
        self.letters = np.frombuffer("".join(cands["seq"].to_pylist()).encode("ascii"), np.uint8)
        delta, self.at = _lists(cands["mods"])
        delta = _numbers(delta) * 1e9
        masses = np.zeros(256, np.int64)
        for letter, nano in chem.RESIDUE_MASS.items():
            masses[ord(letter)] = nano
        sums = np.cumsum(masses[self.letters] + (np.sign(delta) * np.floor(np.abs(delta) + 0.5)).astype(np.int64))
        self.size = np.diff(self.at)
        ends = np.concatenate([[0], sums])
        start, total = ends[self.at[:-1]], ends[self.at[1:]] - ends[self.at[:-1]]
        self.cut = np.arange(len(self.letters)) - np.repeat(self.at[:-1], self.size) + 1
        self.of = np.repeat(np.arange(len(self.size)), self.size)
        own = sums - np.repeat(start, self.size)
        if opts.exclude_end:
            keep = self.cut < self.size[self.of]
            self.cut, self.of, own = self.cut[keep], self.of[keep], own[keep]
        self.rows = np.concatenate([[0], np.cumsum(np.bincount(self.of, minlength=len(self.size)))]).astype(np.int64)
        rest = np.where(self.cut == self.size[self.of], total[self.of], total[self.of] - own)
        kinds = [(z, k) for z in range(1, min(opts.max_charge, most_z) + 1) for k in range(len(opts.series))]
        self.kinds = np.array(kinds, np.int64).reshape(-1, 2)
        self.mz = np.empty((len(self.cut), len(kinds)))
        for column, (z, k) in enumerate(kinds):
            s = opts.series[k]
            charged = ((own if s in FROM_START else rest) + end_nano(s, opts) + chem.HYDROGEN * (z - 1)) / 1e9
            shift = ion_shift(s)
            self.mz[:, column] = (charged - shift) / z if opts.charge_division == "standard" else (charged / z - shift) / z
        self.first = self.rows * max(len(kinds), 1)
        self.left = np.array([s in FROM_START for s in opts.series])
        self.weight_of = np.array([letter_weight(s, opts) for s in opts.series])

    def below(self, a: int, b: int, charge: int) -> IonRun:
        rows = slice(self.rows[a], self.rows[b])
        n = int(np.searchsorted(self.kinds[:, 0], charge, "left"))
        return IonRun(self, (self.rows[a], n), self.mz[rows, :n].ravel(), np.repeat(self.of[rows] - a, n))

    def describe(self, own: tuple[int, int], which: np.ndarray) -> tuple[np.ndarray, ...]:
        row, column = np.divmod(which, max(own[1], 1))
        row = row + own[0]
        z, place = self.kinds[column].T
        cut, size, left = self.cut[row], self.size[self.of[row]], self.left[place]
        last = cut == size
        letter = self.letters[self.at[self.of[row]] + np.where(left, cut - 1, np.where(last, 0, np.minimum(cut, size - 1)))]
        return z, place, np.where(left | last, cut, size - cut), self.weight_of[place, letter]


@dataclass
class IonRun:
    """Ions of a run of candidates: m/z, and the number of the candidate within the run."""

    source: OwnIons | LadderIons
    own: object
    mz: np.ndarray
    of: np.ndarray

    def describe(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """Charge, number of the series, position and weight of some of the ions."""
        return self.source.describe(self.own, which)


def ions_of(cands: pa.Table, opts: IonOptions, most_z: int) -> OwnIons | LadderIons:
    return OwnIons(cands, opts) if "ions" in cands.column_names else LadderIons(cands, opts, most_z)


def corrected(bins: np.ndarray, values: np.ndarray, n_bins: int, opts: XcorrOptions) -> tuple[np.ndarray, np.ndarray]:
    """The normalised and the corrected spectrum over all bins.

    The background is a difference of running sums, which are whole numbers of 2^-40 and so leave nothing behind.
    """
    grain, w, n = 2.0**40, opts.window, n_bins
    x, whole = np.zeros(n), np.zeros(n + 1, np.int64)
    x[bins] = values
    whole[bins + 1] = np.rint(values * grain)
    upto = np.cumsum(whole)  # upto[b]: bins before b
    total = np.full(n, upto[n])
    if opts.background == "symmetric":
        total[: max(n - w, 0)] = upto[w + 1 : n + 1]
        total[w:] -= upto[: max(n - w, 0)]
    else:
        total[: max(n - w, 0)] = upto[w:n]
        # the first w bins, once in, never leave the sum
        total[2 * w + 2 :] -= upto[w + 1 : max(n - w - 1, w + 1)] - upto[min(w, n)]
    less = x + (x - total / grain) / (2 * w)
    out = np.zeros(n)
    for k, weight in kernel(opts).items():
        if k == 0:
            low, high = 0, n
        elif opts.flank_mode == "sides":
            low, high = (0, n - 1) if k > 0 else (1, n)
        else:
            low, high = abs(k) + 1, n - 1 - abs(k)  # flanks stop short of either end
        if low < high:
            out[low + k : high + k] += weight * less[low:high]
    return x, out


def _considered(charge: int, length: np.ndarray, ions: IonOptions, series_count: int) -> np.ndarray:
    kept = min((charge - 1) * series_count, ions.max_charge * len(ions.series))
    return kept * (length - 1 if ions.exclude_end else length)


class XcorrKernel:
    """Sums of the corrected spectrum at the ion bins of each candidate; a bin counts once per candidate."""

    def __init__(self, opts: XcorrOptions, ions: IonOptions):
        self.opts, self.ions, self.grid = opts, ions, Binning(opts)
        self.unit = chem.FINE / opts.multiplier if opts.multiplier else chem.FINE

    def prepare(self, spectra: DataFrame) -> DataFrame:
        return xcorr_normalize(spectra, self.opts).drop("max_mz")

    def read(self, spectra: pa.Table) -> None:
        listed, self.at = _lists(spectra["bins"])
        self.bin, self.value = (_numbers(x) for x in listed.flatten())
        self.res, self.n_bins = _numbers(spectra["res"]), _numbers(spectra["n_bins"])

    def spectrum(self, i: int) -> None:
        own = slice(self.at[i], self.at[i + 1])
        self.size, self.width = int(self.n_bins[i]), self.res[i]
        self.occupied, self.corrected = corrected(self.bin[own], self.value[own], self.size, self.opts)
        self.marked = (self.corrected != 0) | (self.occupied != 0)

    def __call__(self, run: IonRun, n: int) -> tuple[np.ndarray, ...]:
        """Score, matched bins and their intensity for the ``n`` candidates of ``run``."""
        bins = self.grid.number(run.mz, self.width)
        place = np.flatnonzero((bins >= 0) & (bins < self.size))
        place = place[self.marked[bins[place]]]
        key = run.of[place] * self.size + bins[place]
        weight = 1.0
        if self.opts.ignore_weights:
            key = np.unique(key)
        else:
            z, series, pos, weight = run.describe(place)
            order = np.lexsort((pos, series, z, key))
            key, first = np.unique(key[order], return_index=True)
            weight = weight[order][first]
        cand, bins = np.divmod(key, self.size)
        value = self.occupied[bins]
        score = np.bincount(cand, np.rint(self.corrected[bins] * weight * self.unit), n) / self.unit
        matched = np.bincount(cand[value != 0], minlength=n)
        return score, matched, np.bincount(cand, np.rint(value * self.unit), n) / self.unit


class HyperscoreKernel:
    """Peaks matched with the ions of each candidate, and the factorials of their counts."""

    def __init__(self, opts: HyperscoreOptions, ions: IonOptions):
        self.opts, self.ions = opts, ions
        self.unit = chem.FINE / opts.multiplier if opts.multiplier else chem.FINE

    def prepare(self, spectra: DataFrame) -> DataFrame:
        intensities = F.transform("peaks", lambda p: p["intensity"])
        norm = F.aggregate(intensities, F.lit(0.0), lambda a, x: a + x) if self.opts.norm == "sum" else F.array_max(intensities)
        with_norm = spectra.withColumn("norm", norm)
        shares = F.transform("peaks", lambda p: F.struct(p["mz"].alias("mz"), F.try_divide(p["intensity"], F.col("norm")).alias("share")))
        return with_norm.withColumn("shares", F.filter(shares, lambda p: p["share"] > self.opts.cutoff))

    def read(self, spectra: pa.Table) -> None:
        listed, self.at = _lists(spectra["shares"])
        self.all_mz, self.all_share, *more = (_numbers(x) for x in listed.flatten())
        self.all_place = more[0] if more else None
        self.norms = _numbers(spectra["norm"])

    def spectrum(self, i: int) -> None:
        own = slice(self.at[i], self.at[i + 1])
        order = np.argsort(self.all_mz[own], kind="stable")
        self.mz, self.share, self.norm = self.all_mz[own][order], self.all_share[own][order], self.norms[i]
        self.place = None if self.all_place is None else self.all_place[own][order]
        self.near = None

    def take(self, mz: Sequence[float]) -> None:
        """The peaks of one spectrum, for ``hits``."""
        self.mz, self.near = np.sort(np.array(mz, float)), None

    def _near(self, ion_mz: np.ndarray) -> np.ndarray:
        """Places of all ions that may meet a peak, and of some more: those in stretches of m/z that a peak's tolerance reaches."""
        if len(ion_mz) < NEAR_STRETCHES:
            return np.arange(len(ion_mz))
        if self.near is None:
            o = self.opts
            reach = o.tolerance * 1e-6 * np.abs(self.mz) if o.unit == "ppm" else o.tolerance
            reach = reach + 1e-8 * np.abs(self.mz) + 1e-8
            low, high = np.maximum(self.mz - reach, 0.0), np.maximum(self.mz + reach, 0.0)
            top = high.max()
            self.per_mz = (NEAR_STRETCHES - 2) / top if 0 < top < np.inf else 0.0
            edges = np.zeros(NEAR_STRETCHES + 1, np.int64)
            np.add.at(edges, (low * self.per_mz).astype(np.int64), 1)
            np.add.at(edges, (high * self.per_mz).astype(np.int64) + 1, -1)
            self.near = np.cumsum(edges[:-1]) > 0
            self.near[0] |= self.per_mz == 0.0
        # the last stretch lies beyond all peaks
        at = np.clip(ion_mz * self.per_mz, 0, NEAR_STRETCHES - 1).astype(np.int64)
        return np.flatnonzero(self.near[at])

    def hits(self, run: IonRun) -> tuple[np.ndarray, np.ndarray]:
        """Ion (place within ``run``) and peak of every match."""
        o = self.opts
        if not len(self.mz):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = self._near(run.mz)
        ion_mz = run.mz[own]
        if o.unit == "ppm":
            part = o.tolerance * 1e-6
            low, high = ion_mz / (1 + part), ion_mz / (1 - part) if part < 1 else np.full(len(ion_mz), np.inf)
        else:
            low, high = ion_mz - o.tolerance, ion_mz + o.tolerance
        slack = 1e-9 * np.abs(ion_mz) + 1e-9
        begin = np.searchsorted(self.mz, low - slack, "left")
        some = np.flatnonzero(np.append(self.mz, np.inf)[begin] <= high + slack)  # most ions meet no peak
        begin = begin[some]
        count = np.searchsorted(self.mz, (high + slack)[some], "right") - begin
        ion = np.repeat(some, count)
        peak = np.arange(len(ion)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
        delta = self.mz[peak] - ion_mz[ion]
        away = np.abs(delta / self.mz[peak] * 1e6) if o.unit == "ppm" else np.abs(delta)
        near = away <= o.tolerance
        ion, peak, away = own[ion[near]], peak[near], away[near]
        if o.closest_only and len(ion):
            # of each series and charge the nearest ion of a peak, the first position among equals
            z, place, pos, _ = run.describe(ion)
            kind = z * len(self.ions.series) + place
            group = (run.of[ion] * (kind.max() + 1) + kind) * len(self.mz) + peak
            order = np.lexsort((pos, away, group))
            first = order[np.append(True, group[order][1:] != group[order][:-1])]
            ion, peak = ion[first], peak[first]
        return ion, peak

    def __call__(self, run: IonRun, n: int, charge: int) -> tuple[np.ndarray, ...]:
        """Score, matches and summed intensity (log10) for the ``n`` candidates of ``run``."""
        o = self.opts
        ion, peak = self.hits(run)
        cand = run.of[ion]
        z, place, _, weight = run.describe(ion)
        place = place % o.series_count
        charges = min(charge - 1, self.ions.max_charge)
        key, n_keys, real = {
            "charge": (z - 1, self.ions.max_charge, charges),
            "series": (place, o.series_count, o.series_count),
            "both": ((z - 1) * o.series_count + place, self.ions.max_charge * o.series_count, charges * o.series_count),
        }[o.type_best]
        value = np.rint(self.share[peak] * (1.0 if o.ignore_weights else weight) * o.multiplier * self.unit)
        matched = np.bincount(cand, minlength=n)
        total = np.bincount(cand, value, n) / self.unit
        counts = np.bincount(cand * n_keys + key, minlength=n * n_keys).reshape(n, n_keys)
        sums = np.bincount(cand * n_keys + key, value, n * n_keys).reshape(n, n_keys)
        keys = (sums, counts) if o.criterion == "matches" else (counts, sums)
        m = min(o.max_best, max(real, 0))
        best = np.lexsort(keys)[:, ::-1][:, :m]
        chosen = np.take_along_axis(counts, best, 1)
        with np.errstate(over="ignore", divide="ignore"):
            score = np.power(total, 1.0 if o.disjoint else float(m)) * FACTORIAL[np.minimum(chosen, 20)].prod(1)
            sum_i = np.log10(total * self.norm)
        return np.where(chosen.sum(1) > 0, np.minimum(score, CEILING), 0.0), matched, sum_i


def ion_steps(first: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Runs of the candidates ``low`` to ``high`` with about ``SLICE`` ions each."""
    while low < high:
        to = min(high, max(low + 1, int(np.searchsorted(first, first[low] + SLICE, "right")) - 1))
        yield low, to
        low = to


def in_windows(spectra: pa.Table, cands: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """The candidates in some window, in the order of their masses, and where those of each spectrum begin and end."""
    mass = _numbers(cands["mass"])
    order = np.argsort(mass, kind="stable")
    mass = mass[order]
    low, high = (np.searchsorted(mass, _numbers(spectra[x]), side) for x, side in (("min_mass", "left"), ("max_mass", "right")))
    # candidates outside of all windows need no ions
    covered = np.zeros(len(mass) + 1, np.int64)
    full = high > low
    np.add.at(covered, low[full], 1)
    np.add.at(covered, high[full], -1)
    wanted = np.cumsum(covered[:-1]) > 0
    before = np.concatenate([[0], np.cumsum(wanted)])
    return before[low], before[high], cands.take(pa.array(order[wanted]))


def cell_function(
    xcorr: XcorrKernel | None,
    hyper: HyperscoreKernel | None,
    ions: IonOptions,
    carried: Sequence[tuple[str, bool, str]] = (),
    best: int | None = None,
):
    """The scores of one cell, for ``score_cells``: either kernel, or both combined.

    ``carried`` names columns that pairs have besides: name, whether of the spectrum, and the column there. With ``best``
    only that many pairs of a spectrum leave the cell, and those as good as the last of them.
    """

    def run(spectra: pa.Table, cands: pa.Table) -> pa.Table:
        low, high, cands = in_windows(spectra, cands)
        charge = _numbers(spectra["charge"])
        listed = ions_of(cands, ions, int(charge.max(initial=1)) - 1)
        length = _numbers(cands["length"])
        for k in (xcorr, hyper):
            if k is not None:
                k.read(spectra)
        names = ["rows", "cand", "score", "rawscore", "matched", "sum_i", "frac", "xcorr", "hyper"]
        out: dict[str, list] = {x: [] for x in names}
        for i in np.flatnonzero(high > low):
            for k in (xcorr, hyper):
                if k is not None:
                    k.spectrum(i)
            done = {x: len(v) for x, v in out.items()}
            for a, b in ion_steps(listed.first, low[i], high[i]):
                own, n = listed.below(a, b, int(charge[i])), b - a
                x = xcorr(own, n) if xcorr is not None else None
                h = hyper(own, n, int(charge[i])) if hyper is not None else None
                if x is None or h is None:
                    score, matched, sum_i = x or h
                    raw, count = score, (xcorr or hyper).opts.series_count
                    frac = matched / _considered(charge[i], length[a:b], ions, count)
                else:
                    has = x[0] > 0
                    raw_x = np.where(has, x[0], 0.0)
                    root = np.sqrt(np.log10(h[0] + 1))
                    score = np.maximum(0.0, np.maximum(raw_x, np.maximum(root, raw_x * root)))
                    raw, matched, sum_i = (np.where(has, p, q) for p, q in ((x[0], h[0]), x[1:2] + h[1:2], x[2:] + h[2:]))
                    frac = np.where(
                        has,
                        matched / _considered(charge[i], length[a:b], ions, xcorr.opts.series_count),
                        matched / _considered(charge[i], length[a:b], ions, hyper.opts.series_count),
                    )
                    out["xcorr"].append(raw_x[score > 0])
                    out["hyper"].append(h[0][score > 0])
                kept = np.flatnonzero(score > 0)
                out["rows"].append(np.full(len(kept), i))
                out["cand"].append(kept + a)
                for name, column in zip(names[2:7], (score, raw, matched, sum_i, frac)):
                    out[name].append(column[kept])
            if best and sum(map(len, out["score"][done["score"] :])) > best:
                own = {x: np.concatenate(v[done[x] :]) for x, v in out.items() if len(v) > done[x]}
                top = own["score"] >= np.partition(own["score"], -best)[-best]
                for x, v in own.items():
                    out[x][done[x] :] = [v[top]]
        joined = {x: np.concatenate(v) if v else np.zeros(0) for x, v in out.items()}
        row, cand = joined["rows"].astype(np.int64), joined["cand"].astype(np.int64)
        columns = [spectra["query_id"], spectra["charge"], spectra["mass"]]
        columns = [x.take(pa.array(row)) for x in columns] + [cands[x].take(pa.array(cand)) for x in ("cand_id", "mass", "length")]
        columns += [pa.array(joined[x], pa.int64() if x == "matched" else pa.float64()) for x in names[2:7]]
        fields = ["query_id", "charge", "query_mass", "cand_id", "cand_mass", "length", "score", "rawscore", "total_matched", "sum_i", "ion_frac"]
        if xcorr is not None and hyper is not None:
            columns += [pa.array(joined["xcorr"]), pa.array(joined["hyper"])]
            fields += ["xcorr", "hyperscore"]
        for name, of_spectrum, source in carried:
            columns.append(spectra[source].take(pa.array(row)) if of_spectrum else cands[source].take(pa.array(cand)))
            fields.append(name)
        return pa.table(columns, names=fields)

    return run


def score_by_cell(
    spectra: DataFrame,
    cands: DataFrame,
    xcorr: XcorrOptions | None,
    hyper: HyperscoreOptions | None,
    ions: IonOptions = IonOptions(),
    search: SearchOptions = SearchOptions(),
    carried: Sequence[tuple[str, bool, str]] = (),
    best: int | None = None,
) -> DataFrame:
    """Scores of all pairs with a positive one; with both options the combined score, with xcorr and hyperscore.

    For ``carried`` and ``best`` see ``cell_function``.
    """
    x = XcorrKernel(xcorr, ions) if xcorr is not None else None
    h = HyperscoreKernel(hyper, ions) if hyper is not None else None
    own = spectra if any(source == "peaks" for _, of_spectrum, source in carried if of_spectrum) else spectra.drop("peaks")
    added = [StructField(name, (spectra if of_spectrum else cands).schema[source].dataType) for name, of_spectrum, source in carried]
    for k in (x, h):
        if k is not None:
            spectra = k.prepare(spectra)
    spectra = spectra.select(*own.columns, *(c for c in spectra.columns if c not in own.columns and c != "peaks"))
    both = ", xcorr double, hyperscore double" if x is not None and h is not None else ""
    schema = StructType([*StructType.fromDDL(f"{PAIR_SCHEMA}, {VALUES}{both}").fields, *added])
    return score_cells(spectra, cands, cell_function(x, h, ions, carried, best), schema, search)


MATCH_SCHEMA = (
    "mass_bin int, scell int, ccell int, query_id bigint, charge int, query_mass double, cand_id bigint, cand_mass double, "
    "length int, norm double, peak int, share double, series string, z int, weight double"
)


def matches_by_cell(spectra: DataFrame, cands: DataFrame, opts: HyperscoreOptions, ions: IonOptions = IonOptions()) -> DataFrame:
    """Every match of a peak and an ion, from both sides labelled and partitioned by cell."""
    kernel = HyperscoreKernel(opts, ions)
    # a share keeps the number of its peak
    shares = F.transform("peaks", lambda p, i: F.struct(p["mz"].alias("mz"), F.try_divide(p["intensity"], F.col("norm")).alias("share"), i.alias("peak")))
    numbered = F.filter(shares, lambda p: p["share"] > opts.cutoff)
    s = kernel.prepare(spectra).withColumn("shares", numbered).drop("peaks")
    letters = np.array(list(ions.series))
    names = [x.split()[0] for x in MATCH_SCHEMA.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cell = [left[x][0].as_py() if left.num_rows else 0 for x in CELL]
        low, high, right = in_windows(left, right)
        charge = _numbers(left["charge"])
        listed = ions_of(right, ions, int(charge.max(initial=1)) - 1)
        kernel.read(left)
        # rows that share a number count as one for the nearest ion
        shared = opts.closest_only and any(pc.count_distinct(x).as_py() < len(x) for x in (left["query_id"], right["cand_id"]))
        out: list[list[np.ndarray]] = [[np.zeros(0, kind)] for kind in (np.int64, np.int64, np.int32, float, letters.dtype, np.int32, float)]
        far: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0))]
        for i in np.flatnonzero(high > low):
            kernel.spectrum(i)
            for a, b in ion_steps(listed.first, low[i], high[i]):
                own = listed.below(a, b, int(charge[i]))
                ion, peak = kernel.hits(own)
                z, place, pos, weight = own.describe(ion)
                weight = np.ones(len(ion)) if opts.ignore_weights else weight
                if shared:
                    delta = kernel.mz[peak] - own.mz[ion]
                    far.append((np.abs(delta / kernel.mz[peak] * 1e6) if opts.unit == "ppm" else np.abs(delta), pos))
                found = (np.full(len(ion), i), own.of[ion] + a, kernel.place[peak], kernel.share[peak], letters[place], z, weight)
                for listing, column in zip(out, found):
                    listing.append(column)
        row, cand, peak, share, series, z, weight = map(np.concatenate, out)
        n, row, cand = len(row), pa.array(row), pa.array(cand)
        columns = [pa.array(np.full(n, c, np.int32)) for c in cell]
        columns += [left[x].take(row) for x in ("query_id", "charge", "mass")] + [right[x].take(cand) for x in ("cand_id", "mass", "length")]
        columns += [left["norm"].take(row), pa.array(peak.astype(np.int32)), pa.array(share), pa.array(series, pa.string())]
        columns += [pa.array(z.astype(np.int32)), pa.array(weight)]
        table = pa.table(columns, names=names)
        if shared:
            away, pos = (np.concatenate(x) for x in zip(*far))
            table = table.take(pa.array(np.lexsort((weight, pos, away)))).append_column("at", pa.array(np.arange(n)))
            table = table.take(table.group_by(names[:-1]).aggregate([("at", "min")])["at_min"]).drop_columns(["at"])
        return table

    return s.groupBy(*CELL).cogroup(cands.groupBy(*CELL)).applyInArrow(run, MATCH_SCHEMA)
