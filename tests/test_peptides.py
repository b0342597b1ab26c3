"""Digestion, modifications, masses, ions and decoys on hand-computed cases."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from massloom.functions import chem
from massloom.operators import candidates as cand
from massloom.operators import digest as dig
from massloom.operators.ions import ion_rows
from massloom.options import TRYPSIN, DigestOptions, IonOptions

SHORT = DigestOptions(min_length=1, max_length=100, missed_cleavages=0)


def proteins(spark, *seqs):
    return spark.createDataFrame([(i, f"p{i} some name", s) for i, s in enumerate(seqs)], "protein_id long, desc string, seq string")


def frags(spark, seq, opts=DigestOptions()):
    return proteins(spark, seq).select(dig.fragments(F.col("seq"), opts).alias("f")).first()["f"]


@pytest.mark.parametrize(
    "seq, expected",
    [
        ("AAAKKBBBR", ["AAAK", "BBBR"]),
        ("MARPWKPGGK", ["MARPWK", "PGGK"]),
        ("AKPRPMRPC", ["AKPRPMR", "PC"]),
        ("PEPTIDE", ["PEPTIDE"]),
        ("", []),
    ],
)
def test_fragments(spark, seq, expected):
    assert frags(spark, seq) == expected


def test_fragments_join_to_the_protein(spark):
    rng = random.Random(3)
    for _ in range(5):
        seq = "".join(rng.choice("AKRPWMG") for _ in range(60))
        assert "".join(frags(spark, seq, DigestOptions(keep_single=True))) == seq


def listed_peptides(seq, missed, low, high):
    """The growing-list definition of missed cleavages and methionine truncation, read off its description."""
    cuts = [m.end() for m in re.finditer(TRYPSIN, seq)]
    pieces = [seq[a:b] for a, b in zip([0] + cuts, cuts + [len(seq)])]
    base = [p for p in pieces if len(p) > 1]
    held = list(base)
    for c in range(1, missed + 1):
        before = len(held)
        for i in range(len(base) - c):
            starts = [base[i]]
            if i == 0 and base[0].startswith("M"):
                starts += [base[0][x:] for x in range(1, before)]
            for s in starts:
                whole = s + "".join(base[i + 1 : i + c + 1])
                if low <= len(whole) <= high:
                    held.append(whole)
    return {p for p in held if low <= len(p) <= high}


def test_missed_cleavages_and_truncation(spark):
    rng = random.Random(11)
    seqs = ["M" * (i % 2) + "".join(rng.choice("ACDEGKRMPW") for _ in range(rng.randint(5, 80))) for i in range(40)]
    opts = DigestOptions(min_length=4, max_length=30)
    got = {}
    for r in dig.digest(proteins(spark, *seqs), opts).collect():
        got.setdefault(r["protein_id"], []).append(r["seq"])
    for i, s in enumerate(seqs):
        assert sorted(got.get(i, [])) == sorted(listed_peptides(s, 2, 4, 30))


def test_alphabet_and_description(spark):
    rows = dig.digest(proteins(spark, "AAAKBBBKCCCK"), SHORT).collect()
    assert {(r["desc"], r["seq"]) for r in rows} == {("p0", "AAAK"), ("p0", "CCCK")}


def mods_of(spark, seq, opts):
    df = spark.createDataFrame([(seq,)], "seq string")
    rows = cand.explode_variable_mods(cand.with_fixed_mods(df, opts), opts).collect()
    return [tuple(r["mods"]) for r in rows]


def test_variable_sites(spark):
    ox, cam = 15.994915, 57.0215
    got = mods_of(spark, "AMCMK", DigestOptions())
    assert sorted(got) == sorted(
        (0.0, a, cam, b, 0.0) for a, b in itertools.product([0.0, ox], repeat=2)
    )


def test_number_of_subsets_is_bounded_by_max_variable(spark):
    assert len(mods_of(spark, "MMMMMM", DigestOptions())) == 1 + 6 + 15 + 20


def test_alternative_deltas(spark):
    two = DigestOptions(variable_mods=(("M", 1.0), ("M", 2.0)))
    assert sorted(mods_of(spark, "AM", two)) == [(0.0, 0.0), (0.0, 3.0)]
    either = DigestOptions(variable_mods=(("M", 1.0), ("M", 2.0)), alternatives=True)
    assert sorted(mods_of(spark, "AM", either)) == [(0.0, 0.0), (0.0, 1.0), (0.0, 2.0)]


def test_known_mass(spark):
    df = spark.createDataFrame([("PEPTIDE", [0.0] * 7)], "seq string, mods array<double>")
    m = df.select(chem.peptide_mass(F.col("seq"), F.col("mods"), 1.007825, 17.002735)).first()[0]
    assert m == pytest.approx(799.35994, abs=1e-4)


def test_modseq(spark):
    df = spark.createDataFrame([("ACM", [0.0, 57.0215, 15.994915])], "seq string, mods array<double>")
    assert df.select(chem.render_modseq(F.col("seq"), F.col("mods"))).first()[0] == "AC[57.0215]M[15.994915]"


def test_ions_against_sums(spark):
    df = spark.createDataFrame([("GAC", [0.0, 0.0, 57.0215])], "seq string, mods array<double>")
    aa = {k: v / 1e9 for k, v in chem.RESIDUE_MASS.items()}
    masses = [aa["G"], aa["A"], aa["C"] + 57.0215]
    h, oh, cterm = chem.HYDROGEN / 1e9, chem.HYDROXYL / 1e9, 17.002735
    rows = ion_rows(df, [], IonOptions(max_charge=2, series="by", exclude_end=False)).collect()
    assert len(rows) == 12
    for r in rows:
        part = sum(masses[: r["pos"]]) if r["series"] == "b" else sum(masses[-r["pos"] :])
        ends = cterm - oh + h if r["series"] == "b" else cterm + 2 * h
        assert r["mz"] == pytest.approx((part + ends + h * (r["z"] - 1)) / r["z"] / r["z"], abs=1e-9)
    once = ion_rows(df, [], IonOptions(max_charge=2, charge_division="standard")).where("z = 2 and series = 'b' and pos = 1")
    assert once.first()["mz"] == pytest.approx((masses[0] + cterm - oh + 2 * h) / 2)


def test_unknown_series(spark):
    with pytest.raises(ValueError):
        ion_rows(spark.createDataFrame([("GAC", [0.0] * 3)], "seq string, mods array<double>"), [], IonOptions(series="q"))


def test_peptide_decoys(spark):
    opts = DigestOptions(min_length=1, max_length=100, missed_cleavages=0, decoy_type="peptide")
    rows = dig.digest_decoys(proteins(spark, "ACDEKFGHIK"), opts).collect()
    assert {(r["desc"], r["seq"]) for r in rows} == {("DECOY_p0", "EDCAK"), ("DECOY_p0", "IHGFK")}
    shuffled = DigestOptions(**{**opts.__dict__, "decoy_method": "shuffle"})
    a = sorted(r["seq"] for r in dig.digest_decoys(proteins(spark, "ACDEKFGHIK"), shuffled).collect())
    b = sorted(r["seq"] for r in dig.digest_decoys(proteins(spark, "ACDEKFGHIK"), shuffled).collect())
    assert a == b and all(s.endswith("K") for s in a)
    assert sorted("".join(a)) == sorted("ACDEKFGHIK")


def test_targets_hide_decoys_and_names_merge(spark):
    t = spark.createDataFrame([("AAK", "b"), ("AAK", "a"), ("CCK", "a")], "seq string, desc string")
    d = spark.createDataFrame([("AAK", "DECOY_a"), ("DDK", "DECOY_b")], "seq string, desc string")
    rows = {r["seq"]: (r["desc"], r["decoy"]) for r in cand.merge_peptides(t, d).collect()}
    assert rows == {"AAK": ("a;b", False), "CCK": ("a", False), "DDK": ("DECOY_b", True)}


def test_forms_against_plain_loops(spark):
    """All forms of a batch at once, without a function that runs for every letter of a row."""
    opts = DigestOptions(variable_mods=(("M", 15.994915), ("M", 1.5), ("S", 79.966331), ("C", 3.0)), alternatives=True, max_variable=2)
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACDMKST") for _ in range(rng.randrange(1, 20))) for _ in range(150)] + ["AZB", "", None, "mMK", "M" * 22]
    df = spark.createDataFrame([(s, f"p{i}", i % 2 == 0) for i, s in enumerate(seqs)], "seq string, desc string, decoy boolean")
    offered, want = {"M": [15.994915, 1.5], "S": [79.966331]}, []
    for i, s in enumerate(seqs):
        if not s or set(s) - set(chem.RESIDUE_MASS):
            continue
        options = [(k, d) for k, aa in enumerate(s) for d in offered.get(aa, [])]
        for n in range(3):
            for some in itertools.combinations(options, n):
                if len({k for k, _ in some}) < n:
                    continue
                mods = [57.0215 if aa == "C" else 0.0 for aa in s]
                for k, d in some:
                    mods[k] = d
                mass = (sum(chem.RESIDUE_MASS[aa] + chem.nano(m) for aa, m in zip(s, mods)) + chem.nano(opts.nterm) + chem.nano(opts.cterm)) / 1e9
                if opts.min_mass <= mass <= opts.max_mass:
                    want.append((s, f"p{i}", i % 2 == 0, mass, mods, "".join(aa + (f"[{m}]" if m else "") for aa, m in zip(s, mods)), len(s)))
    got = cand.modify(df, opts)
    assert sorted(map(tuple, got.select("seq", "desc", "decoy", "mass", "mods", "modseq", "length").collect())) == sorted(want)
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()


def test_colliding_decoys_and_what_is_shuffled(spark):
    kind = "seq string, mods array<double>"
    decoys = spark.createDataFrame([("AK", [0.0, 0.0]), ("AK", [1.5, 0.0]), ("CK", [57.0215, 0.0]), ("MK", [0.0, 0.0]), (None, [0.0]), ("A", None)], kind)
    targets = spark.createDataFrame([("AK", [0.0, 0.0]), ("AK", [2.5, 0.0]), ("CK", [57.0215, 0.0]), ("KM", [0.0, 0.0]), (None, [0.0]), ("A", None)], kind)
    got = {(r["seq"], tuple(r["mods"] or ())) for r in cand.drop_colliding_decoys(decoys, targets).collect()}
    assert got == {("AK", (1.5, 0.0)), ("MK", (0.0, 0.0)), (None, (0.0,)), ("A", ())}
    one, other = (cand.with_fixed_mods(spark.range(n).select(F.col("id").cast("string").alias("seq")).distinct()) for n in (50, 70))
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")  # as a session has it that says nothing
    plan = cand.drop_colliding_decoys(one, other.hint("merge"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(setting, before)
    assert plan.count("Exchange hashpartitioning") == 2
