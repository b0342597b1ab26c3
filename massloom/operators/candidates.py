"""Peptides to the candidate table: merging, decoys, modifications, masses."""

from __future__ import annotations

import functools
import itertools
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.functions import chem
from massloom.operators.digest import digest, digest_both
from massloom.options import DigestOptions


def _deltas(listed: tuple[tuple[str, float], ...]) -> dict[str, list[float]]:
    out = defaultdict(list)
    for aa, delta in listed:
        out[aa].append(float(delta))
    return dict(out)


def _fixed(opts: DigestOptions) -> dict[str, float]:
    return {aa: sum(ds) for aa, ds in _deltas(opts.fixed_mods).items()}


def _has_any(seq: Column, letters) -> Column:
    return seq.rlike("[" + "".join(sorted(letters)) + "]")


def fixed_mods(seq: Column, opts: DigestOptions = DigestOptions()) -> Column:
    """Modification vector of the fixed modifications: one delta per residue."""
    fixed = _fixed(opts)
    none = F.array_repeat(F.lit(0.0), F.length(seq))
    if not fixed:
        return none
    delta = chem.by_letter(fixed, default=0.0, cast="double")
    return F.when(_has_any(seq, fixed), F.transform(chem.residues(seq), delta)).otherwise(none)


def with_fixed_mods(peptides: DataFrame, opts: DigestOptions = DigestOptions()) -> DataFrame:
    return peptides.withColumn("mods", fixed_mods(F.col("seq"), opts))


def _choices(opts: DigestOptions) -> Column | None:
    """Every set of at most ``max_variable`` modified sites of ``seq``, with their deltas."""
    variable = _deltas(opts.variable_mods)
    if not variable or opts.max_variable <= 0:
        return None
    offered = {aa: ds if opts.alternatives else [sum(ds)] for aa, ds in variable.items()}
    table = F.create_map(*[c for aa, ds in offered.items() for c in (F.lit(aa), F.array(*map(F.lit, ds)))])
    sites = F.filter(
        F.transform(
            F.arrays_zip(chem.residues(F.col("seq")).alias("aa"), F.col("mods").alias("m")),
            lambda x, i: F.struct(
                i.alias("pos"), F.try_element_at(table, x["aa"]).alias("deltas"), x["m"].alias("m")
            ),
        ),
        lambda s: s["deltas"].isNotNull() & (s["m"] == 0),
    )
    unmodified = F.array(F.array().cast("array<struct<pos:int,delta:double>>"))
    subsets = F.aggregate(
        sites,
        unmodified,
        lambda acc, s: F.concat(
            acc,
            F.flatten(
                F.transform(
                    F.filter(acc, lambda chosen: F.size(chosen) < opts.max_variable),
                    lambda chosen: F.transform(
                        s["deltas"],
                        lambda d: F.array_append(chosen, F.struct(s["pos"].alias("pos"), d.alias("delta"))),
                    ),
                )
            ),
        ),
    )
    return F.when(_has_any(F.col("seq"), variable), subsets).otherwise(unmodified)


def _placed() -> Column:
    """The modification vector with the chosen sites filled in."""
    filled = F.transform(
        F.col("mods"),
        lambda m, i: F.coalesce(F.get(F.filter("_chosen", lambda c: c["pos"] == i), F.lit(0))["delta"], m),
    )
    return F.when(F.size("_chosen") == 0, F.col("mods")).otherwise(filled)


def explode_variable_mods(peptides: DataFrame, opts: DigestOptions = DigestOptions()) -> DataFrame:
    """One row per choice of at most ``max_variable`` modified sites.

    A residue that carries a fixed modification takes no variable one.
    """
    choices = _choices(opts)
    if choices is None:
        return peptides
    return peptides.withColumn("_chosen", F.explode_outer(choices)).withColumn("mods", _placed()).drop("_chosen")


def peptide_proteins(proteins: DataFrame, opts: DigestOptions = DigestOptions()) -> DataFrame:
    """Every peptide with every protein it is cut from: ``(protein_id, desc, seq, decoy)``."""
    if opts.decoys:
        return digest_both(proteins, opts)
    return digest(proteins, opts).withColumn("decoy", F.lit(False))


def merge_peptides(targets: DataFrame, decoys: DataFrame | None = None, names: str = "merged") -> DataFrame:
    """One row per sequence, protein names joined by ``;``; a target hides an equal decoy.

    Merging, duplicate elimination and the target-over-decoy rule share one
    shuffle on the sequence, before modifications multiply the rows. ``targets``
    may hold both kinds already, told apart by a ``decoy`` column. With names
    ``first`` only the smallest name stays, and a peptide that very many proteins
    share shrinks to one row per task before the shuffle.
    """
    if names not in ("merged", "first"):
        raise ValueError("names is merged or first")
    flag = F.col("decoy") if "decoy" in targets.columns else F.lit(False)
    rows = targets.select("seq", "desc", flag.alias("decoy"))
    if decoys is not None:
        rows = rows.unionByName(decoys.select("seq", "desc", F.lit(True).alias("decoy")))
    if names == "first":
        # false sorts before true, so a target's name comes first
        first = rows.groupBy("seq").agg(F.min(F.struct("decoy", "desc")).alias("_f"))
        return first.select("seq", "_f.desc", "_f.decoy")
    merged = rows.groupBy("seq").agg(
        F.min("decoy").alias("decoy"),
        F.collect_list(F.when(~F.col("decoy"), F.col("desc"))).alias("_t"),
        F.collect_list(F.when(F.col("decoy"), F.col("desc"))).alias("_d"),
    )
    kept = F.when(F.col("decoy"), F.col("_d")).otherwise(F.col("_t"))
    return merged.select("seq", F.array_join(F.sort_array(kept), ";").alias("desc"), "decoy")


def drop_colliding_decoys(decoys: DataFrame, targets: DataFrame) -> DataFrame:
    """Decoys without those whose sequence and modifications also occur as a target.

    Modifications are compared where equal sequences meet; as a key of the join they would be shuffled.
    """
    t = targets.select(F.col("seq").alias("_seq"), F.col("mods").alias("_mods"))
    alike = F.array_position(F.array("_mods"), F.col("mods")) > 0
    return decoys.join(t, (F.col("seq") == F.col("_seq")) & alike, "left_anti")


class FormTable:
    """What a letter stands for under some options: masses, sites, and the text and delta of each residue as written.

    A token is a residue with its delta; the first 128 are the letters with their fixed modifications, those of variable
    modifications follow.
    """

    def __init__(self, opts: DigestOptions, text: Callable[[float], str]):
        fixed = _fixed(opts)
        self.nano, self.known = np.zeros(256, np.int64), np.zeros(256, bool)
        for aa, mass in chem.RESIDUE_MASS.items():
            self.nano[ord(aa)], self.known[ord(aa)] = mass + chem.nano(fixed.get(aa, 0.0)), True
        self.ends = chem.nano(opts.nterm) + chem.nano(opts.cterm)
        self.limits, self.most = (opts.min_mass, opts.max_mass), opts.max_variable
        letters, deltas = [chr(c) for c in range(128)], [fixed.get(chr(c), 0.0) for c in range(128)]
        self.options = np.zeros(256, np.int64)  # how many variable deltas a letter has
        self.first = np.zeros(256, np.int64)  # and the token of the first
        for aa, offered in _deltas(opts.variable_mods).items() if opts.max_variable > 0 else ():
            # a residue that carries a fixed modification takes no variable one
            if len(aa) == 1 and aa in chem.RESIDUE_MASS and fixed.get(aa, 0.0) == 0:
                offered = offered if opts.alternatives else [sum(offered)]
                self.options[ord(aa)], self.first[ord(aa)] = len(offered), len(letters)
                letters += [aa] * len(offered)
                deltas += offered
        self.delta = np.array(deltas)
        self.added = np.array([int(math.copysign(math.floor(abs(d) * 1e9 + 0.5), d)) for d in deltas], np.int64)
        written = [(aa if d == 0 else f"{aa}[{text(d)}]").encode() for aa, d in zip(letters, deltas)]
        self.size = np.array([len(w) for w in written], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.written = np.frombuffer(b"".join(written), np.uint8)


@functools.lru_cache(maxsize=64)
def _choices_of(n: int, most: int) -> np.ndarray:
    """Every choice of at most ``most`` of ``n`` as a row, filled up with -1."""
    rows = [c for k in range(min(n, most) + 1) for c in itertools.combinations(range(n), k)]
    out = np.full((len(rows), max(most, 1)), -1, np.int64)
    for i, c in enumerate(rows):
        out[i, : len(c)] = c
    return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``size`` of them, end to end."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


# forms, letters and bytes of names that are laid out in one step
FORMS, LAID_LETTERS, LAID_BYTES = 1 << 17, 1 << 21, 1 << 26
FORM_SCHEMA = "seq string, desc string, decoy boolean, mass double, mods array<double>, modseq string"


def _forms(batch: pa.RecordBatch, t: FormTable) -> Iterator[pa.RecordBatch]:
    """All modified forms of the peptides of a batch (seq, desc, decoy) within the mass limits."""
    batch = batch.filter(pc.greater(pc.fill_null(pc.binary_length(batch.column("seq")), 0), 0))
    if not batch.num_rows:
        return
    told = batch.take(pa.array(np.arange(batch.num_rows)))  # buffers from their beginning
    _, offsets, data = told.column("seq").buffers()
    at = np.frombuffer(offsets, np.int32)[: batch.num_rows + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[: at[-1]]
    size = np.diff(at)

    def summed(values: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return upto[at[1:]] - upto[at[:-1]]

    base = summed(t.nano[data]) + t.ends
    # letters without a mass have no form; ten of the padding are beyond any mass
    good = (summed(~t.known[data]) == 0) & (summed(data == ord(chem.PADDING)) < 10)
    options = t.options[data]
    place = np.repeat(np.arange(len(data)), options)  # of each option
    token = _ranges(t.first[data][options > 0], options[options > 0])
    count = summed(options)
    begin = np.cumsum(count) - count
    ways = np.array([sum(math.comb(int(n), k) for k in range(min(int(n), t.most) + 1)) for n in range(count.max() + 1)], np.int64)
    rows = np.flatnonzero(good)
    upto, low = np.cumsum(ways[count[rows]]), 0
    while low < len(rows):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + FORMS, "right")))
        some, low = rows[low:high], high
        of, chosen = [], []
        for n in np.unique(count[some]):
            own, choice = some[count[some] == n], _choices_of(int(n), t.most)
            of.append(np.repeat(own, len(choice)))
            chosen.append(np.where(choice < 0, -1, choice + begin[own][:, None, None]).reshape(-1, choice.shape[1]))
        yield from _laid_out(told, t, at, size, data, base, place, token, np.concatenate(of), np.concatenate(chosen))


def _laid_out(told, t: FormTable, at, size, data, base, place, token, of, chosen) -> Iterator[pa.RecordBatch]:
    """Rows of the forms: ``of`` has the peptide of each, ``chosen`` the numbers of its options in ``place`` and ``token``."""
    taken = chosen >= 0
    nano, fits = base[of], np.ones(len(of), bool)
    if len(place):
        nano = nano + np.where(taken, t.added[token[chosen]], 0).sum(1)
        for i, j in itertools.combinations(range(chosen.shape[1]), 2):  # one delta to a site
            fits &= ~(taken[:, i] & taken[:, j] & (place[chosen[:, i]] == place[chosen[:, j]]))
    mass = nano / 1e9
    kept = np.flatnonzero(fits & (mass >= t.limits[0]) & (mass <= t.limits[1]))
    of, chosen, taken, mass = of[kept], chosen[kept], taken[kept], mass[kept]
    names = pc.fill_null(pc.binary_length(told.column("desc")), 0).to_numpy(zero_copy_only=False)[of].astype(np.int64)
    step = np.maximum(np.cumsum(size[of]) // LAID_LETTERS, np.cumsum(names) // LAID_BYTES)
    for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(step)) + 1):
        if not len(part):
            continue
        own = of[part]
        ends = np.concatenate([[0], np.cumsum(size[own])])
        spelled = data[_ranges(at[own], size[own])].astype(np.int64)
        form, column = np.nonzero(taken[part])
        option = chosen[part][form, column]
        spelled[ends[form] + place[option] - at[own[form]]] = token[option]
        length = t.size[spelled]
        text = t.written[_ranges(t.at[spelled], length)]
        text_ends = np.concatenate([[0], np.cumsum(length)])[ends]
        row = pa.array(own)
        yield pa.RecordBatch.from_arrays(
            [
                *(told.column(c).take(row) for c in ("seq", "desc", "decoy")),
                pa.array(mass[part]),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(t.delta[spelled])),
                pa.StringArray.from_buffers(len(own), pa.py_buffer(text_ends.astype(np.int32)), pa.py_buffer(text)),
            ],
            names=["seq", "desc", "decoy", "mass", "mods", "modseq"],
        )


def modify(peptides: DataFrame, opts: DigestOptions = DigestOptions()) -> DataFrame:
    """Peptide rows to candidate rows: modifications, mass and its filter, identifiers.

    Forms are laid out a batch of peptides at a time; those outside the mass limits go before their vectors are built.
    """
    written = peptides.sparkSession._jvm.java.lang.Double.toString  # as a cast writes a number
    table = FormTable(opts, lambda delta: written(float(delta)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _forms(batch, table)

    return peptides.select("seq", "desc", "decoy").mapInArrow(run, FORM_SCHEMA).select(
        chem.stable_id(F.col("modseq")).alias("cand_id"),
        "desc",
        "decoy",
        F.lit(0.0).alias("rt"),
        F.length("seq").alias("length"),
        "mass",
        "seq",
        "mods",
        "modseq",
        F.lit(None).cast("map<string,double>").alias("meta"),
    )


def build_candidates(proteins: DataFrame, opts: DigestOptions = DigestOptions()) -> DataFrame:
    """Proteins to the candidate table."""
    return modify(merge_peptides(peptide_proteins(proteins, opts), names=opts.names), opts)
