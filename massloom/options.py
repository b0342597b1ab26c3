"""User-visible settings, one frozen dataclass per stage.

Worker, batch and shard settings have no counterpart here: Spark's partitioning
takes their place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# The cleavage rule here and the defaults below are the established settings, needed for equal results.
TRYPSIN = r"([RK](?!P))|((?<=W)K(?=P))|((?<=M)R(?=P))"

# precursor-mass bins up to max_mass, at most: what is counted per bin can be broadcast
MOST_BINS = 500_000


@dataclass(frozen=True)
class DigestOptions:
    rule: str = TRYPSIN
    missed_cleavages: int = 2
    min_length: int = 7
    max_length: int = 40
    min_mass: float = 250.0
    max_mass: float = 6000.0
    variable_mods: tuple[tuple[str, float], ...] = (("M", 15.994915),)
    fixed_mods: tuple[tuple[str, float], ...] = (("C", 57.0215),)
    max_variable: int = 3
    alternatives: bool = False  # True: several deltas of one residue compete instead of adding up
    nterm: float = 1.007825
    cterm: float = 17.002735
    keep_single: bool = False  # True: one-residue fragments take part in missed cleavages
    met_truncation: str = "reference"  # or "initiator" (one residue only), "none"
    decoys: bool = True
    decoy_prefix: str = "DECOY_"
    decoy_method: str = "reverse"  # or "shuffle"
    decoy_type: str = "protein"  # or "peptide"
    seed: int = 0
    names: str = "merged"  # or "first": one protein name per peptide, the rest in peptide_proteins


@dataclass(frozen=True)
class IonOptions:
    max_charge: int = 3
    series: str = "by"
    exclude_end: bool = True
    # {"y": {"P": 5.0, "series": 1.0}}; missing values are 1
    weights: dict = field(default_factory=dict)
    charge_division: str = "reference"  # or "standard": divide by the charge once
    cterm: float = 17.002735


@dataclass(frozen=True)
class QueryOptions:
    min_mass: float = 250.0
    max_mass: float = 6000.0
    min_charge: int = 2
    max_charge: int = 4
    min_peaks: int = 0
    max_peaks: int = 2**31 - 1


@dataclass(frozen=True)
class SearchOptions:
    tolerance: tuple[float, float] = (-100.0, 100.0)
    unit: str = "ppm"  # anything else: absolute
    bin_width: float | None = None  # precursor-mass bin; None: window width at 2000 Da
    max_mass: float = 6000.0
    # rows of either side, and pairs, that meet in one cell before a mass bin is split
    spectra_per_cell: int = 5_000
    candidates_per_cell: int = 50_000
    pairs_per_cell: int = 20_000_000
    retain: int = 10

    def width(self) -> float:
        if self.bin_width is not None:
            return max(self.bin_width, self.max_mass / MOST_BINS)
        span = self.tolerance[1] - self.tolerance[0]
        return max(span * 1e-6 * 2000.0 if self.unit == "ppm" else span, self.max_mass / MOST_BINS)


@dataclass(frozen=True)
class XcorrOptions:
    resolution: float = 20.0
    unit: str = "ppm"
    ppm_mode: str = "max"  # max, mass or bins
    min_bin: float = 0.001
    window: int = 75
    norm_windows: int = 10
    cutoff: float = 0.05
    multiplier: float = 1.0
    flank_mode: str = "gauss"  # none, sides, exp, gauss
    flank_length: int = 2
    ignore_weights: bool = True
    series_count: int = 2
    background: str = "reference"  # or "symmetric"
    max_mass: float = 6000.0  # top edge of the bins mode
    mz_bucket: float = 5.0  # m/z slice on which peaks and ions meet


@dataclass(frozen=True)
class HyperscoreOptions:
    norm: str = "max"  # or "sum"
    tolerance: float = 20.0
    unit: str = "ppm"
    closest_only: bool = True
    cutoff: float = 0.01
    multiplier: float = 1.0
    disjoint: bool = False
    max_best: int = 2
    criterion: str = "matches"  # or "intensity"
    type_best: str = "charge"  # charge, series or both
    series_count: int = 2
    ignore_weights: bool = True
    mz_bucket: float = 0.25

    def __post_init__(self):
        if self.max_best <= 0:
            raise ValueError("max_best must be positive")
        if self.type_best not in ("charge", "series", "both"):
            raise ValueError("type_best must be charge, series or both")


@dataclass(frozen=True)
class ReportOptions:
    top_n: int = 1
    fdr: float = 0.01
    decoy_prefix: str = "DECOY_"


@dataclass(frozen=True)
class PinOptions:
    max_scores: int = 10
    use_extra: bool = False
    extra_keys: tuple[str, ...] = ()  # entries of the spectrum's metadata that become features with use_extra
    decoy_prefix: str = "DECOY_"
