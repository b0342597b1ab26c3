"""Cells: their bounds, scores by cell against scores by join, user scorers of a cell, conditions on pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from massloom.operators import cellscores
from massloom.operators import search as search_ops
from massloom.operators.cells import PACK, cell_scorer, pack_rows
from massloom.operators.hyperscore import joined_ions, match_ions
from massloom.operators.precursor import CELL, cell_rows, mass_bin, precursor_join
from massloom.options import HyperscoreOptions, IonOptions, SearchOptions, XcorrOptions
from tests.test_scoring import naive_pairs, sides  # noqa: F401


def scores(df):
    names = [c for c in df.columns if c not in CELL]
    return {(r["query_id"], r["cand_id"]): {c: r[c] for c in names} for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys() and got
    for pair, row in want.items():
        for name, value in row.items():
            assert got[pair][name] == pytest.approx(value, rel=1e-9, abs=1e-9), (pair, name)


XCORR = [
    XcorrOptions(),
    XcorrOptions(flank_mode="exp", flank_length=3),
    XcorrOptions(flank_mode="sides", background="symmetric"),
    XcorrOptions(flank_mode="none", resolution=1.0, unit="abs", window=30),
    XcorrOptions(resolution=5.0, unit="abs", window=400),  # the window is wider than the spectrum
    XcorrOptions(resolution=5.0, unit="abs", window=400, background="symmetric"),
    XcorrOptions(ppm_mode="bins", ignore_weights=False, multiplier=3.0),
    XcorrOptions(ppm_mode="mass", min_bin=0.5, ignore_weights=False),
]
HYPER = [
    HyperscoreOptions(),
    HyperscoreOptions(closest_only=False, norm="sum", cutoff=0.0),
    HyperscoreOptions(type_best="series", disjoint=True, max_best=1),
    HyperscoreOptions(type_best="both", criterion="intensity", max_best=3, ignore_weights=False),
    HyperscoreOptions(unit="abs", tolerance=0.5, ignore_weights=False, multiplier=2.0),
]
IONS = [
    IonOptions(),
    IonOptions(exclude_end=False, charge_division="standard", weights={"b": {"P": 3.0, "series": 0.5}, "y": {"K": 2.0}}),
    IonOptions(series="abcxyz", max_charge=2, weights={"c": {"A": 0.25}}),
]


@pytest.mark.parametrize("k", range(len(XCORR)))
def test_xcorr_by_cell_is_xcorr_by_join(sides, k):  # noqa: F811
    spectra, cands, _ = sides
    ions = IONS[k % len(IONS)]
    got = search_ops.score_xcorr(spectra, cands, XCORR[k], ions)
    want = search_ops.joined_xcorr(spectra, cands, XCORR[k], ions, SearchOptions())
    # near 0 either sum may round to nothing
    got, want = ({p: r for p, r in scores(x).items() if r["score"] > 1e-8} for x in (got, want))
    same(got, want)


@pytest.mark.parametrize("k", range(len(HYPER)))
def test_hyperscore_by_cell_is_hyperscore_by_join(sides, k):  # noqa: F811
    spectra, cands, _ = sides
    ions = IONS[(k + 1) % len(IONS)]
    got = search_ops.score_hyperscore(spectra, cands, HYPER[k], ions)
    same(scores(got), scores(search_ops.joined_hyperscore(spectra, cands, HYPER[k], ions, SearchOptions())))


@pytest.mark.parametrize("search", [SearchOptions(), SearchOptions(spectra_per_cell=2, candidates_per_cell=3, pairs_per_cell=4, max_mass=900.0)], ids=["whole", "cut"])
def test_combined_by_cell_is_combined_by_join(sides, search):  # noqa: F811
    spectra, cands, _ = sides
    got = search_ops.score_combined(spectra, cands, search=search)
    want = search_ops.joined_combined(spectra, cands, XcorrOptions(), HyperscoreOptions(), IonOptions(), search)
    same(scores(got), scores(want))


def test_own_ions_and_odd_spectra(spark, sides):  # noqa: F811
    spectra, cands, _ = sides
    ion = "struct<series: string, z: int, pos: int, mz: double, weight: double>"
    own = F.transform(F.sequence(F.lit(1), F.col("length") - 1), lambda i: F.struct(
        F.when(i % 2 == 0, "b").otherwise("y").alias("series"), (1 + i % 3).alias("z"), i.alias("pos"), (i * 97.1).alias("mz"), (i * 0.5).alias("weight")))
    cands = cands.withColumn("ions", F.when(F.length("seq") % 4 != 0, own.cast(f"array<{ion}>")))
    none = F.array().cast("array<struct<mz:double,intensity:double>>")
    odd = spectra.withColumn("peaks", F.when(F.col("query_id") == 0, none).when(F.col("query_id") != 1, F.col("peaks")))
    odd = odd.withColumn("charge", F.when(F.col("query_id") == 2, 9).when(F.col("query_id") == 3, 1).otherwise(F.col("charge")))
    for scorer, joined, opts in (
        (search_ops.score_xcorr, search_ops.joined_xcorr, XcorrOptions(ignore_weights=False, resolution=2.0, unit="abs")),
        (search_ops.score_hyperscore, search_ops.joined_hyperscore, HyperscoreOptions(ignore_weights=False, unit="abs", tolerance=2.0)),
    ):
        same(scores(scorer(odd, cands, opts)), scores(joined(odd, cands, opts, IonOptions(), SearchOptions())))
        assert scorer(spectra.limit(0), cands, opts).count() == 0 and scorer(spectra, cands.limit(0), opts).count() == 0


def one_mass(spark, n_s, n_c):
    """Every spectrum and candidate at one mass, but for a few far beyond all bins."""
    s = spark.range(n_s).selectExpr("id as query_id", "if(id % 7 = 0, 1e9, 500.0D) as mass")
    s = s.selectExpr("*", "mass * (1 - 1e-4) as min_mass", "mass * (1 + 1e-4) as max_mass")
    return s, spark.range(n_c).selectExpr("id as cand_id", "if(id % 11 = 0, 1e9, 500.0D) as mass")


@pytest.mark.parametrize("rows", [cell_rows, pack_rows])
@pytest.mark.parametrize("n_s, n_c", [(3000, 4000), (30, 20000), (20000, 30), (1, 5000)])
def test_no_cell_is_larger_than_stated(spark, rows, n_s, n_c):
    opts = SearchOptions(spectra_per_cell=1000, candidates_per_cell=1500, pairs_per_cell=200_000)
    spectra, cands = one_mass(spark, n_s, n_c)
    keys = CELL if rows is cell_rows else PACK
    s, c = (df.groupBy(*keys).count() for df in rows(spectra, cands, opts))
    cells = s.withColumnRenamed("count", "n").join(c.withColumnRenamed("count", "m"), keys).collect()
    # the hash deals parts of a few hundred rows within a fifth of evenly
    assert max(r["n"] for r in cells) <= 1200 and max(r["m"] for r in cells) <= 1800
    assert max(r["n"] * r["m"] for r in cells) <= 1.44 * 200_000
    copied = sum(r["n"] for r in cells) + sum(r["m"] for r in cells)
    assert copied <= 2 * (n_s + n_c) * max(1, (n_s * n_c / 200_000) ** 0.5)


def test_every_pair_meets_once(spark):
    rng = random.Random(2)
    masses = [rng.choice([300.0, 300.05, 1000.0, 5999.9, 6000.3, 1e5, 1e9]) * (1 + rng.uniform(-3e-4, 3e-4)) for _ in range(500)]
    s = spark.createDataFrame([(i, m, m * (1 - 1e-4), m * (1 + 1e-4)) for i, m in enumerate(masses[:200])], "query_id long, mass double, min_mass double, max_mass double")
    c = spark.createDataFrame(list(enumerate(masses[200:])), "cand_id long, mass double")
    want = sorted((i, j) for i, m in enumerate(masses[:200]) for j, x in enumerate(masses[200:]) if m * (1 - 1e-4) <= x <= m * (1 + 1e-4))
    for opts in (SearchOptions(), SearchOptions(spectra_per_cell=3, candidates_per_cell=4, pairs_per_cell=5)):
        assert sorted(map(tuple, precursor_join(s, c, opts).select("query_id", "cand_id").collect())) == want
        left, right = pack_rows(s, c.withColumnRenamed("mass", "cand_mass").withColumn("mass", F.col("cand_mass")), opts)
        met = left.join(right.drop("mass"), PACK).where("cand_mass between min_mass and max_mass")
        assert sorted(map(tuple, met.select("query_id", "cand_id").collect())) == want


def test_number_of_mass_bins_is_bounded(spark):
    opts = SearchOptions(bin_width=1e-9)
    top = spark.range(1).select(mass_bin(F.lit(6000.0), opts).alias("a"), mass_bin(F.lit(1.7e308), opts).alias("b")).first()
    assert top["a"] <= 500_001 and top["b"] < 8_000_000
    edges = spark.range(5990, 6100).select(F.col("id").cast("double").alias("m")).select(mass_bin(F.col("m"), SearchOptions()).alias("b"))
    bins = [r["b"] for r in edges.collect()]
    assert bins == sorted(bins)


def test_user_scorer_of_a_cell(sides):  # noqa: F811
    spectra, cands, _ = sides

    def closeness(s: pa.Table, c: pa.Table) -> pa.Table:
        ids, masses = c["cand_id"].to_numpy(), c["mass"].to_numpy()
        rows = [(q, int(i), float(m)) for q, lo, hi in zip(s["query_id"].to_pylist(), s["min_mass"].to_pylist(), s["max_mass"].to_pylist())
                for i, m in zip(ids, masses) if lo <= m <= hi]
        q, i, m = zip(*rows) if rows else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "cand_id": pa.array(i, pa.int64()), "score": np.array(m) - 900.0})

    for opts in (SearchOptions(), SearchOptions(spectra_per_cell=2, candidates_per_cell=2, pairs_per_cell=2)):
        out = search_ops.search(spectra, cands, cell_scorer(closeness, "score double"), opts).collect()
        want = {(s["query_id"], c["cand_id"]): c["mass"] - 900 for s, c in naive_pairs(sides) if c["mass"] > 900}
        assert {(r["query_id"], r["cand_id"]): r["score"] for r in out} == pytest.approx(want)
        assert all(r["charge"] and r["cand_mass"] == r["score"] + 900 and r["length"] == len(r["seq"]) for r in out)


BOTH = [
    "abs(query_mass - cand_mass) < length * 5e-3",
    "charge * 4 > length and length > 7",
    "startswith(seq, substring(title, 1, 0)) and charge + length(seq) > 11",
    "size(filter(probs, p -> p < length)) > 1",
]


@pytest.mark.parametrize("scorer, k", [("xcorr", 0), ("hyperscore", 1), ("xcorr", 2), ("combined", 3)])
def test_conditions_on_both_sides(sides, scorer, k):  # noqa: F811
    spectra, cands, _ = sides
    spectra = spectra.withColumn("probs", F.array(F.lit(8), F.lit(10), F.col("charge") * 3))
    every = search_ops.search(spectra, cands, scorer)
    condition = F.expr(BOTH[k])
    want = scores(every.where(condition).select("query_id", "cand_id", "score", "modseq"))
    got = scores(search_ops.search(spectra, cands, scorer, cand_filter=condition).select("query_id", "cand_id", "score", "modseq"))
    assert 0 < len(want) < every.count()
    assert got.keys() == want.keys() and all(got[p]["score"] == pytest.approx(want[p]["score"], rel=1e-9) for p in want)
    ranked = search_ops.search(spectra, cands, scorer, cand_filter=[condition, F.col("score") > 0.1, F.col("length") < 12], retain=1)
    best = {}
    for (q, c), r in want.items():
        best.setdefault(q, []).append(r["score"])
    assert all(r["length"] < 12 and r["score"] > 0.1 and r["score"] <= max(best[r["query_id"]]) * (1 + 1e-9) for r in ranked.collect())


def test_a_condition_stands_below_the_sums(sides):  # noqa: F811
    spectra, cands, _ = sides
    condition = F.col("query_mass") * 7 < F.col("cand_mass") * F.col("length")
    for scorer in ("xcorr", "hyperscore", "combined"):
        rows = search_ops.search(spectra, cands, scorer, cand_filter=condition, retain=3)
        plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
        at = [i for i, line in enumerate(plan) if "* 7.0" in line or "* cast(7 as double)" in line]
        sums = [i for i, line in enumerate(plan) if "Aggregate" in line and "total_matched" in line]
        assert at and sums and min(at) > min(sums)
        # and in the join itself, so that a refused pair gives no row
        assert all("Join" in plan[i] for i in at)


@pytest.mark.parametrize("k", range(len(HYPER)))
def test_matches_of_a_cell_are_those_of_the_join(sides, k):  # noqa: F811
    spectra, cands, _ = sides
    ions = IONS[k % len(IONS)]
    both = cell_rows(*search_ops._narrow(spectra, cands), SearchOptions(spectra_per_cell=3, candidates_per_cell=20, pairs_per_cell=50))
    got, want = match_ions(*both, HYPER[k], ions), joined_ions(*both, HYPER[k], ions)
    assert got.dtypes == want.dtypes
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rows(got) == rows(want) and rows(got)
    assert "SortMergeJoin" not in got.select("peak")._jdf.queryExecution().executedPlan().toString().replace("mass_bin", "")


def test_ions_far_from_all_peaks_are_passed_over(monkeypatch, sides):  # noqa: F811
    """In stretches of m/z without peaks no ion is compared; the matches are the same."""
    spectra, cands, _ = sides
    for opts in HYPER:
        every = scores(search_ops.score_hyperscore(spectra, cands, opts))
        kernel = cellscores.HyperscoreKernel(opts, IonOptions())
        rng = np.random.default_rng(5)
        kernel.mz, kernel.share, kernel.near = np.sort(rng.uniform(50, 1900, 60)), np.ones(60), None
        ion = np.concatenate([rng.uniform(-5, 4000, 40_000), kernel.mz * (1 + 19.9e-6), kernel.mz + 0.49, [0.0, 1e9]])
        assert every
        near = kernel._near(ion)
        reach = opts.tolerance * 1e-6 * kernel.mz if opts.unit == "ppm" else opts.tolerance
        meets = np.flatnonzero((np.abs(ion[:, None] - kernel.mz) <= reach).any(1))
        assert set(meets) <= set(near) and len(near) < len(ion) / 2


def test_a_cell_leaves_out_what_is_not_among_the_best(sides):  # noqa: F811
    spectra, cands, _ = sides
    left_out = 0
    for scorer in (search_ops.score_xcorr, search_ops.score_hyperscore, search_ops.score_combined):
        every, few = scores(scorer(spectra, cands)), scores(scorer(spectra, cands, best=1))
        of = {}
        for (q, _), r in every.items():
            of.setdefault(q, []).append(r["score"])
        want = {p for p, r in every.items() if r["score"] == max(of[p[0]])}
        assert want <= set(few)
        same(few, {p: every[p] for p in few})
        left_out += len(every) - len(few)
    assert left_out > 0


def test_a_nested_column_is_not_carried_beside_peaks(sides):  # noqa: F811
    spectra, cands, _ = sides
    spectra = spectra.withColumn("probs", F.array(F.lit(8), F.lit(10), F.col("charge") * 3))
    rows = search_ops.search(spectra, cands, cand_filter=F.expr(BOTH[3]), retain=3)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_rows_that_share_their_number(sides):  # noqa: F811
    """Repeated spectra and candidates give what the joins of peaks and ions give."""
    spectra, cands, _ = sides
    spectra = spectra.withColumn("probs", F.array(F.lit(8), F.lit(10), F.col("charge") * 3))
    moved = F.transform("peaks", lambda p: F.struct((p["mz"] + 1e-3).alias("mz"), p["intensity"].alias("intensity")))
    spectra = spectra.unionByName(spectra.where("query_id < 3")).unionByName(spectra.where("query_id = 1").withColumn("peaks", moved))
    twice = cands.unionByName(cands.where("length % 2 = 0"))
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    for k in (0, 1, 4):
        both = cell_rows(*search_ops._narrow(spectra, twice))
        assert rows(match_ions(*both, HYPER[k])) == rows(joined_ions(*both, HYPER[k], IonOptions()))
    condition = F.expr(BOTH[3])
    got = search_ops.search(spectra, cands, cand_filter=condition).select("query_id", "cand_id", "score")
    pairs = search_ops.PairFilter(condition, ("probs", "length"))
    want = search_ops.joined_combined(spectra, cands, XcorrOptions(), HyperscoreOptions(), IonOptions(), SearchOptions(), pairs)
    same(scores(got), scores(want.select("query_id", "cand_id", "score")))


def test_only_what_a_query_reads_is_stored(spark, sf, monkeypatch):
    from massloom.plans import registry

    stored = []
    monkeypatch.setattr(registry, "materialize", lambda df, path=None: stored.append(df.columns) or df.limit(0))
    registry.precursor_range_join(spark, sf)
    registry.candidate_filter_length(spark, sf)
    registry.xcorr_score(spark, sf)
    assert ["cand_id", "mass"] in stored and ["cand_id", "mass", "length"] in stored
    assert search_ops.CANDIDATE_COLUMNS in stored and not any("desc" in x for x in stored)


def test_user_scorer_of_the_registry(sides):  # noqa: F811
    """Counts of peaks and ions within 20 ppm against all pairs of them; pairs without any are not listed."""
    from massloom.plans import registry

    spectra, cands, _ = sides
    s, c = spectra.toArrow(), cands.toArrow()
    got = {(r["query_id"], r["cand_id"]): r["score"] for r in registry._matched_ions(s, c).to_pylist()}
    listed, want = cellscores.ions_of(c, IonOptions(), 3), {}
    for row in s.to_pylist():
        top = max(p["intensity"] for p in row["peaks"])
        peaks = np.array([p["mz"] for p in row["peaks"] if p["intensity"] / top > 0.01])
        for i, (cand_id, mass) in enumerate(zip(c["cand_id"].to_pylist(), c["mass"].to_pylist())):
            if row["min_mass"] <= mass <= row["max_mass"]:
                ions = listed.below(i, i + 1, row["charge"]).mz
                if n := int((np.abs((peaks[:, None] - ions) / peaks[:, None] * 1e6) <= 20).sum()):
                    want[row["query_id"], cand_id] = float(n)
    assert got == want and want
