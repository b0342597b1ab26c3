"""Proteins to peptides: cleavage, missed cleavages, methionine truncation.

Everything happens inside the protein's row, so digestion needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.functions import chem
from massloom.options import DigestOptions

EMPTY = "array<string>"


def fragments(seq: Column, opts: DigestOptions = DigestOptions()) -> Column:
    """Fragments between cleavage sites, in order."""
    parts = F.split(seq, f"(?<={opts.rule})")
    shortest = 0 if opts.keep_single else 1
    return F.filter(parts, lambda p: F.length(p) > shortest)


def _fits(opts: DigestOptions):
    return lambda p: F.length(p).between(opts.min_length, opts.max_length)


def _run(start: Column, length: int) -> Column:
    """``length`` neighbouring fragments joined; single look-ups, as ``slice`` copies its array."""
    return F.concat(*[F.get("_frags", start + j) for j in range(length)])


def _joins(missed: int) -> Column:
    """Concatenations of ``missed + 1`` neighbouring fragments."""
    frags = F.col("_frags")
    last = F.size(frags) - 1 - missed
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: _run(i, missed + 1),
        ),
    ).otherwise(F.array().cast(EMPTY))


def _truncations(missed: int, upto: Column) -> Column:
    """Suffixes of a leading methionine fragment joined to the following fragments."""
    frags = F.col("_frags")
    first = F.get(frags, F.lit(0))
    tail = _run(F.lit(1), missed)
    applies = (F.size(frags) > missed) & F.startswith(first, F.lit("M")) & (upto >= 1)
    return F.when(
        applies,
        F.transform(
            F.sequence(F.lit(1), F.greatest(upto, F.lit(1))),
            lambda x: F.concat(F.substr(first, x + 1), tail),
        ),
    ).otherwise(F.array().cast(EMPTY))


def peptide_arrays(proteins: DataFrame, opts: DigestOptions = DigestOptions(), frags: Column | None = None) -> DataFrame:
    """Add ``peptides``, the distinct peptides of each protein within the length limits."""
    fits = _fits(opts)
    df = proteins.withColumn("_frags", fragments(F.col("seq"), opts) if frags is None else frags)
    pieces = [F.filter("_frags", fits)]
    held = F.size("_frags")  # entries in the growing list when a round of joins starts
    scratch = ["_frags"]
    for missed in range(1, opts.missed_cleavages + 1):
        joined, cut = f"_join{missed}", f"_cut{missed}"
        if opts.met_truncation == "reference":
            upto = held - 1
        elif opts.met_truncation == "initiator":
            upto = F.least(held - 1, F.lit(1))
        else:
            upto = F.lit(0)
        df = df.withColumn(joined, F.filter(_joins(missed), fits)).withColumn(
            cut, F.filter(_truncations(missed, upto), fits)
        )
        pieces += [F.col(joined), F.col(cut)]
        scratch += [joined, cut]
        if missed < opts.missed_cleavages:
            df = df.withColumn(f"_held{missed}", held + F.size(joined) + F.size(cut))
            held = F.col(f"_held{missed}")
            scratch.append(f"_held{missed}")
    return df.withColumn("peptides", F.array_distinct(F.concat(*pieces))).drop(*scratch)


def digest(proteins: DataFrame, opts: DigestOptions = DigestOptions()) -> DataFrame:
    """``(protein_id, desc, seq)`` proteins to the same columns with one row per peptide.

    Peptides with letters outside the residue alphabet are dropped.
    """
    return _explode(peptide_arrays(proteins, opts))


def _explode(df: DataFrame) -> DataFrame:
    # the outer form: before a plain explode Spark adds a filter on the array's size and
    # pushes it down to the scan, where the whole digestion would be computed once more
    return df.select(
        "protein_id",
        F.split("desc", " ").getItem(0).alias("desc"),
        F.explode_outer("peptides").alias("seq"),
        *[c for c in ("decoy",) if c in df.columns],
    ).where(F.col("seq").rlike(chem.ALPHABET_PATTERN))


def shuffle_letters(text: Column, salt: Column, seed: int) -> Column:
    """A repeatable permutation of a string: letters sorted by a hash of their place."""
    keyed = F.transform(
        chem.residues(text),
        lambda aa, i: F.struct(F.xxhash64(F.lit(seed), salt, i).alias("k"), i.alias("i"), aa.alias("aa")),
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["aa"]), "")


def reverse_keep_last(pep: Column) -> Column:
    return F.concat(F.reverse(F.left(pep, F.length(pep) - 1)), F.right(pep, F.lit(1)))


def _decoy_protein(opts: DigestOptions) -> Column:
    """Sequence of a decoy protein; where fragments are turned instead, the protein's own."""
    if opts.decoy_method not in ("reverse", "shuffle") or opts.decoy_type not in ("protein", "peptide"):
        raise ValueError("decoys are made by reverse or shuffle, of protein or peptide")
    if opts.decoy_type == "peptide":
        return F.col("seq")
    if opts.decoy_method == "reverse":
        return F.reverse("seq")
    return shuffle_letters(F.col("seq"), F.col("desc"), opts.seed)


def _decoy_fragments(opts: DigestOptions) -> Column:
    """Fragments of a decoy protein, each turned about its last residue where the options say so."""
    base = fragments(F.col("seq"), opts)
    if opts.decoy_type == "protein":
        return base
    if opts.decoy_method == "reverse":
        return F.transform(base, reverse_keep_last)
    return F.transform(
        base,
        lambda p: F.concat(shuffle_letters(F.left(p, F.length(p) - 1), p, opts.seed), F.right(p, F.lit(1))),
    )


def digest_decoys(proteins: DataFrame, opts: DigestOptions = DigestOptions()) -> DataFrame:
    """Decoy peptides, by reversing or shuffling whole proteins or single fragments."""
    turned = proteins.withColumns(
        {"desc": F.concat(F.lit(opts.decoy_prefix), F.col("desc")), "seq": _decoy_protein(opts)}
    )
    return _explode(peptide_arrays(turned, opts, _decoy_fragments(opts)))


def digest_both(proteins: DataFrame, opts: DigestOptions = DigestOptions()) -> DataFrame:
    """Target and decoy peptides with a ``decoy`` flag, from one pass over the proteins."""
    forms = F.array(
        F.struct(F.col("desc"), F.col("seq"), F.lit(False).alias("decoy")),
        F.struct(
            F.concat(F.lit(opts.decoy_prefix), F.col("desc")).alias("desc"),
            _decoy_protein(opts).alias("seq"),
            F.lit(True).alias("decoy"),
        ),
    )
    both = proteins.select("protein_id", F.inline_outer(forms))
    frags = F.when(F.col("decoy"), _decoy_fragments(opts)).otherwise(fragments(F.col("seq"), opts))
    return _explode(peptide_arrays(both, opts, frags if opts.decoy_type == "peptide" else None))
