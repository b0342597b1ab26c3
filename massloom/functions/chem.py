"""Masses, and column expressions on peptide strings.

Masses are summed in whole nano-daltons (1e-9 Da), which holds every constant
below exactly, so a mass does not depend on the order of the summation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Element masses in nano-daltons.
CARBON = 12_000_000_000
HYDROGEN = 1_007_825_035
NITROGEN = 14_003_074_000
OXYGEN = 15_994_914_630
SULFUR = 31_972_070_700
HYDROXYL = OXYGEN + HYDROGEN

# Fixed value: proton mass in daltons.
PROTON = 1.00727646688

# Atoms (C, H, N, O, S) of each amino-acid residue.
RESIDUE_ATOMS = {
    "A": (3, 5, 1, 1, 0),
    "C": (3, 5, 1, 1, 1),
    "D": (4, 5, 1, 3, 0),
    "E": (5, 7, 1, 3, 0),
    "F": (9, 9, 1, 1, 0),
    "G": (2, 3, 1, 1, 0),
    "H": (6, 7, 3, 1, 0),
    "I": (6, 11, 1, 1, 0),
    "K": (6, 12, 2, 1, 0),
    "L": (6, 11, 1, 1, 0),
    "M": (5, 9, 1, 1, 1),
    "N": (4, 6, 2, 2, 0),
    "P": (5, 7, 1, 1, 0),
    "Q": (5, 8, 2, 2, 0),
    "R": (6, 12, 4, 1, 0),
    "S": (3, 5, 1, 2, 0),
    "T": (4, 7, 1, 2, 0),
    "V": (5, 9, 1, 1, 0),
    "W": (11, 10, 2, 1, 0),
    "Y": (9, 9, 1, 2, 0),
}

# Fixed value: mass of the padding residue, beyond any mass filter.
PADDING = "_"
PADDING_MASS = 999_999_999_000_000_000

# Mass shift of each ion series in daltons.
ION_SHIFT = {
    "a": 46.00547930326002,
    "b": 18.010564683699954,
    "c": 0.984015582689949,
    "x": -25.979264555419945,
    "y": 0.0,
    "z": 17.026549101010005,
}

# Order of the alphabet in a one-hot peptide embedding.
EMBEDDING_ALPHABET = "_GASPVTCLINDQKEMHFRYW"

ALPHABET_PATTERN = "^[ACDEFGHIKLMNPQRSTVWY_]+$"

RESIDUE_MASS = {
    aa: c * CARBON + h * HYDROGEN + n * NITROGEN + o * OXYGEN + s * SULFUR
    for aa, (c, h, n, o, s) in RESIDUE_ATOMS.items()
} | {PADDING: PADDING_MASS}


def nano(daltons: float) -> int:
    return round(daltons * 1e9)


def residues(seq: Column) -> Column:
    """The letters of a peptide as an array."""
    return F.split(seq, "")


def by_letter(table: dict[str, float], default=None, cast: str = "bigint"):
    """A lookup from a one-letter column to a number: an array indexed by character code."""
    codes = range(ord("A"), ord("_") + 1)
    values = F.array(*[F.lit(table.get(chr(c), default)).cast(cast) for c in codes])
    return lambda letter: F.get(values, F.ascii(letter) - F.lit(ord("A")))


def residue_masses(seq: Column, mods: Column) -> Column:
    """Nano-dalton mass of every residue with its modification."""
    mass = by_letter(RESIDUE_MASS)
    return F.zip_with(
        residues(seq), mods, lambda aa, m: mass(aa) + F.round(m * 1e9).cast("bigint")
    )


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def prefix_masses(seq: Column, mods: Column) -> Column:
    """Running nano-dalton sums from the first residue on."""
    return F.aggregate(
        residue_masses(seq, mods),
        F.array().cast("array<bigint>"),
        lambda acc, x: F.array_append(acc, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x),
    )


def peptide_mass(seq: Column, mods: Column, nterm: float, cterm: float) -> Column:
    """Peptide mass in daltons."""
    return (total(residue_masses(seq, mods)) + F.lit(nano(nterm) + nano(cterm))) / F.lit(1e9)


def charged_mass(mass: Column, charge: Column | int) -> Column:
    """m/z of a peptide at a charge."""
    z = F.lit(charge) if isinstance(charge, int) else charge
    return (mass + F.lit(PROTON) * (z - 1)) / z


def precursor_mass(mz: Column, charge: Column) -> Column:
    """Neutral mass of a measured precursor."""
    return mz * charge - (charge - 1) * F.lit(PROTON) - F.lit(PROTON)


def ppm_distance(x: Column, y: Column) -> Column:
    return F.abs(x - y) / y * F.lit(1e6)


def tolerance_delta(mass: Column, tolerance: float, unit: str) -> Column:
    return F.lit(tolerance) * F.lit(1e-6) * mass if unit == "ppm" else F.lit(float(tolerance))


def render_modseq(seq: Column, mods: Column) -> Column:
    """``seq`` with ``[delta]`` after every modified residue."""
    marked = F.array_join(
        F.zip_with(
            residues(seq),
            mods,
            lambda aa, m: F.when(m == 0, aa).otherwise(F.concat(aa, F.lit("["), m.cast("string"), F.lit("]"))),
        ),
        "",
    )
    return F.when(F.exists(mods, lambda m: m != 0), marked).otherwise(seq)


def truth_modseq(truth: Column) -> Column:
    """Ground-truth notation (``M(ox)``, plain C) as a modified sequence."""
    return F.replace(
        F.replace(truth, F.lit("M(ox)"), F.lit("M[15.994915]")), F.lit("C"), F.lit("C[57.0215]")
    )


def stable_id(*cols: Column) -> Column:
    """60-bit identifier from the values themselves: the same in every run and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("bigint")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# unit of the sums behind scores
FINE = 1e12


def exact_sum(value: Column, scale: float = 1.0) -> Column:
    """Sum in whole units of ``scale`` / 1e12, so it does not depend on the order of the rows.

    Equal evidence then gives equal scores, whatever the partitioning.
    """
    unit = FINE / scale if scale else FINE
    return F.sum(F.rint(value * F.lit(unit)).cast("bigint")) / F.lit(unit)


def is_decoy(desc: Column, prefix: str = "DECOY_") -> Column:
    return F.startswith(desc, F.lit(prefix))
