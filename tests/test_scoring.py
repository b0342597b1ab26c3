"""Precursor join and scorers against brute force on small random input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.functions import chem
from massloom.operators import search as search_ops
from massloom.operators import spectra as spec
from massloom.operators import xcorr as xc
from massloom.operators.candidates import modify
from massloom.operators.ions import ion_rows
from massloom.operators.precursor import cell_rows, precursor_join
from massloom.options import DigestOptions, HyperscoreOptions, IonOptions, SearchOptions, XcorrOptions

OPTS = DigestOptions(min_mass=0.0, variable_mods=())


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(5)
    letters = "ACDEFGHKLMNPQRSTVWY"
    seqs = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(7, 12))) for _ in range(60)})
    # rearrangements, so that several candidates share a mass
    seqs += sorted({"".join(rng.sample(s, len(s))) for s in seqs[:30]} - set(seqs))
    peps = spark.createDataFrame([(s, "p", False) for s in seqs], "seq string, desc string, decoy boolean")
    cands = modify(peps, OPTS).cache()
    ions = {}
    for r in ion_rows(cands, ["cand_id"], IonOptions()).collect():
        ions.setdefault(r["cand_id"], []).append(r)
    rows = []
    listed = cands.collect()
    for i, c in enumerate(rng.sample(listed, 25)):
        own = [x["mz"] for x in ions[c["cand_id"]] if x["z"] == 1 and rng.random() < 0.7]
        peaks = [(m * (1 + rng.uniform(-15e-6, 15e-6)), rng.uniform(1, 100)) for m in own]
        peaks += [(rng.uniform(30, 1400), rng.uniform(1, 60)) for _ in range(25)]
        peaks += [(peaks[0][0] + 1e-4, 50.0)]
        rows.append((i, f"s{i}", 0.0, 2 + i % 3, c["mass"] * (1 + rng.uniform(-9e-5, 9e-5)), sorted(peaks)))
    spectra = spark.createDataFrame(
        rows, "query_id long, title string, rt double, charge int, mass double, peaks array<struct<mz double, intensity double>>"
    )
    return spec.with_tolerance(spectra).cache(), cands, ions


def naive_pairs(sides):
    spectra, cands, _ = sides
    cs = cands.collect()
    return [(s, c) for s in spectra.collect() for c in cs if s["min_mass"] <= c["mass"] <= s["max_mass"]]


@pytest.mark.parametrize("per_cell", [20_000, 2, 1])
@pytest.mark.parametrize("width", [None, 0.05, 50.0])
def test_precursor_join_is_the_plain_join(sides, per_cell, width):
    spectra, cands, _ = sides
    opts = SearchOptions(bin_width=width, spectra_per_cell=per_cell, candidates_per_cell=per_cell, max_mass=1500.0)
    got = sorted((r["query_id"], r["cand_id"]) for r in precursor_join(spectra, cands, opts).collect())
    assert got == sorted((s["query_id"], c["cand_id"]) for s, c in naive_pairs(sides))
    assert len(got) > 25


def brute_hyperscore(s, c, ions, closest=True):
    top = max(p["intensity"] for p in s["peaks"])
    counts, total = {}, 0.0
    series = {}
    for ion in ions[c["cand_id"]]:
        if ion["z"] < s["charge"]:
            series.setdefault((ion["z"], ion["series"]), []).append(ion)
    for p in s["peaks"]:
        if p["intensity"] / top <= 0.01:
            continue
        for (z, _), listed in series.items():
            near = [i for i in listed if abs((p["mz"] - i["mz"]) / p["mz"] * 1e6) <= 20]
            for _ in near[:1] if closest else near:
                counts[z] = counts.get(z, 0) + 1
                total += p["intensity"] / top
    if not counts:
        return 0.0
    groups = min(s["charge"] - 1, 3)
    best = sorted([counts.get(z, 0) for z in range(1, groups + 1)])[-2:]
    return total ** len(best) * math.prod(math.factorial(min(20, n)) for n in best)


@pytest.mark.parametrize("closest", [True, False])
@pytest.mark.parametrize("per_cell", [20_000, 1])
def test_hyperscore(sides, closest, per_cell):
    spectra, cands, ions = sides
    split = SearchOptions(spectra_per_cell=per_cell, candidates_per_cell=per_cell)
    scored = search_ops.score_hyperscore(spectra, cands, HyperscoreOptions(closest_only=closest), search=split)
    got = {(r["query_id"], r["cand_id"]): r["score"] for r in scored.collect()}
    want = {(s["query_id"], c["cand_id"]): brute_hyperscore(s, c, ions, closest) for s, c in naive_pairs(sides)}
    want = {k: v for k, v in want.items() if v > 0}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9)


def dense_xcorr(s, opts):
    """Bin width, normalised and corrected spectrum, each from its formula.

    x: the root of each bin's largest peak over the largest of its segment, 0 at or below the cutoff.
    S(j): the sum of x before j + w, less that from w to before j - w - 1.
    corrected: flank weights applied to x - (S - x) / 2w; a flank d bins away counts if it is closer than both ends.
    """
    mz = np.array([p["mz"] for p in s["peaks"]])
    res = max(mz.max() * 1e-6 * opts.resolution, opts.min_bin) if opts.unit == "ppm" else opts.resolution
    size = int(mz.max() / res) + opts.window + 1
    root = np.zeros(size)
    np.maximum.at(root, (mz / res).astype(int), np.sqrt([p["intensity"] for p in s["peaks"]]))
    length = int(min(int((s["mass"] + 50) / res), int(mz.max() / res)) / opts.norm_windows + 1)
    segment = np.arange(size) // length
    largest = np.zeros(segment[-1] + 1)
    np.maximum.at(largest, segment, root)
    kept = (segment < opts.norm_windows) & (root > opts.cutoff * root.max())
    x = np.divide(root, largest[segment], out=np.zeros(size), where=kept)

    w, j = opts.window, np.arange(size)
    before = np.concatenate([[0.0], np.cumsum(x)])
    total = before[np.minimum(j + w, size)] - (before[np.maximum(j - w - 1, w)] - before[w])
    less = x - (total - x) / (2 * w)

    if opts.flank_mode == "sides":
        weights, reach = [1.0, 0.5], np.full(size, 2)
    else:
        d = np.arange(opts.flank_length + 1)
        weights = {"gauss": np.exp(-d * d / 2) / math.sqrt(2 * math.pi), "exp": 0.5**d}.get(opts.flank_mode, [1.0])
        reach = np.minimum(np.minimum(j, size - j - 1), len(weights))
    corrected = weights[0] * less
    for d, weight in enumerate(weights[1:], 1):
        near = np.where(d < reach, weight * less, 0)
        corrected[:-d] += near[d:]
        corrected[d:] += near[:-d]
    return res, x, corrected


def test_dense_xcorr_by_hand():
    opts = XcorrOptions(resolution=1.0, unit="abs", flank_mode="none", window=2, norm_windows=1, cutoff=0.1)
    spectrum = {"peaks": [{"mz": 3.2, "intensity": 4.0}, {"mz": 5.1, "intensity": 1.0}], "mass": 100.0}
    res, x, corrected = dense_xcorr(spectrum, opts)
    assert res == 1.0 and x.tolist() == [0, 0, 0, 1, 0, 0.5, 0, 0]
    # S is 0 0 1 1 1.5 1.5 1.5 1.5: bins 0 to j + 1, less bins 2 to j - 4
    assert corrected == pytest.approx([0, 0, -0.25, 1.0, -0.375, 0.25, -0.375, -0.125])


SETTINGS = [
    XcorrOptions(),
    XcorrOptions(flank_mode="exp", flank_length=3),
    XcorrOptions(flank_mode="sides"),
    XcorrOptions(flank_mode="none"),
    # wide bins: the first window of bins is occupied and never leaves the background
    XcorrOptions(resolution=1.0, unit="abs"),
    XcorrOptions(resolution=1.0, unit="abs", flank_mode="sides", window=30),
]


@pytest.mark.parametrize("opts", SETTINGS, ids=lambda o: f"{o.flank_mode}-{o.unit}-{o.window}")
def test_xcorr(sides, opts):
    spectra, cands, ions = sides
    scored = search_ops.score_xcorr(spectra, cands, opts)
    got = {(r["query_id"], r["cand_id"]): r for r in scored.collect()}
    want = {}
    dense = {s["query_id"]: dense_xcorr(s, opts) for s in spectra.collect()}
    for s, c in naive_pairs(sides):
        res, normed, corrected = dense[s["query_id"]]
        bins = {int(i["mz"] / res) for i in ions[c["cand_id"]] if i["z"] < s["charge"]}
        bins = [b for b in bins if b < len(corrected)]
        score = sum(corrected[b] for b in bins)
        if score > 0:
            want[s["query_id"], c["cand_id"]] = (score, sum(normed[b] > 0 for b in bins), sum(normed[b] for b in bins))
    assert got.keys() == want.keys()
    for k, (score, n, total) in want.items():
        assert got[k]["score"] == pytest.approx(score, rel=1e-6, abs=1e-9)
        assert got[k]["total_matched"] == n
        assert got[k]["sum_i"] == pytest.approx(total, rel=1e-6)


@pytest.mark.parametrize("opts", SETTINGS, ids=lambda o: f"{o.flank_mode}-{o.unit}-{o.window}")
def test_xcorr_correct_everywhere(spark, sides, opts):
    spectra = sides[0].where("query_id < 3")
    normalized = xc.xcorr_normalize(spectra, opts)
    at = normalized.select("query_id", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    got = {(r["query_id"], r["bin"]): r["value"] for r in xc.xcorr_correct(normalized, opts, at).collect()}
    for s in spectra.collect():
        _, _, corrected = dense_xcorr(s, opts)
        for b, v in enumerate(corrected):
            assert got.get((s["query_id"], b), 0.0) == pytest.approx(v, abs=1e-9)


def test_variable_bins_edges(spark):
    opts = XcorrOptions(ppm_mode="bins")
    grid = xc.Binning(opts)
    df = spark.range(1, 2000, 7).select((F.col("id") * 1.37).alias("mz"))
    rows = df.select("mz", grid.bin(F.col("mz"), F.lit(0.0)).alias("b"))
    rows = rows.select("mz", "b", grid.low_edge(F.col("b"), F.lit(0.0)).alias("low"), grid.low_edge(F.col("b") + 1, F.lit(0.0)).alias("high"))
    for r in rows.collect():
        assert r["low"] <= r["mz"] * (1 + 1e-9) and r["mz"] <= r["high"] * (1 + 1e-9)
        assert r["high"] - r["low"] == pytest.approx(max(r["mz"] * 20e-6, 0.001), rel=1e-3)


def test_xcorr_runs_on_variable_bins_and_weights(sides):
    spectra, cands, _ = sides
    plain = search_ops.score_xcorr(spectra, cands, XcorrOptions(ppm_mode="bins")).count()
    assert plain > 0
    weighted = search_ops.score_xcorr(
        spectra, cands, XcorrOptions(ignore_weights=False), IonOptions(weights={"b": {"series": 2.0}, "y": {"series": 2.0}})
    )
    single = search_ops.score_xcorr(spectra, cands, XcorrOptions())
    a = {(r["query_id"], r["cand_id"]): r["score"] for r in weighted.collect()}
    for r in single.collect():
        assert a[r["query_id"], r["cand_id"]] == pytest.approx(2 * r["score"])


def test_combined_and_user_scorers(sides):
    spectra, cands, ions = sides
    rows = search_ops.search(spectra, cands, retain=2).collect()
    for r in rows:
        root = math.sqrt(math.log10(r["hyperscore"] + 1))
        assert r["score"] == pytest.approx(max(0, r["xcorr"], root, r["xcorr"] * root))
    scorer = search_ops.pairwise_scorer(lambda p: p.withColumn("score", F.lit(1.0) + F.col("length")))
    best = search_ops.search(spectra, cands, scorer, retain=1, cand_filter=F.col("length") < 12).collect()
    assert best and all(r["length"] < 12 for r in best)
    custom = cands.withColumn(
        "ions", F.array(F.struct(F.lit("b").alias("series"), F.lit(1).alias("z"), F.lit(1).alias("pos"), F.lit(500.0).alias("mz"), F.lit(1.0).alias("weight")))
    )
    assert search_ops.score_hyperscore(spectra, custom).count() < len(rows)


def test_filters_of_one_side_cut_it_before_scoring(sides):
    spectra, cands, _ = sides
    everything = search_ops.search(spectra, cands).select("query_id", "cand_id", "length", "charge", "query_mass", "score").collect()
    assert everything
    one_sided = [(F.col("length") < 12, lambda r: r["length"] < 12), (F.col("charge") > 2, lambda r: r["charge"] > 2),
                 (F.col("query_mass") > 1000, lambda r: r["query_mass"] > 1000)]
    for condition, holds in one_sided:
        s, c, left = search_ops._filter_sides(spectra, cands, condition)
        assert left is None and s.columns == spectra.columns and c.columns == cands.columns
        got = {(r["query_id"], r["cand_id"]): r["score"] for r in search_ops.search(spectra, cands, cand_filter=condition).collect()}
        assert got == pytest.approx({(r["query_id"], r["cand_id"]): r["score"] for r in everything if holds(r)})
    both = F.abs(F.col("query_mass") - F.col("cand_mass")) < F.col("length") * 1e-4
    for condition in (both, F.col("score") > 1):
        s, c, left = search_ops._filter_sides(spectra, cands, condition)
        assert (s, c) == (spectra, cands) and left is not None


def test_planted_spectra_come_back(spark, sf):
    from massloom.plans import registry

    found = registry.search_best(spark, sf).where("found").count()
    assert found == registry.search_best(spark, sf).count()


def test_plan_has_no_nested_loops_and_one_shuffle_per_side(sides):
    spectra, cands, _ = sides
    s, c = cell_rows(*search_ops._narrow(spectra, cands))
    df = search_ops.joined_combined(spectra, cands, XcorrOptions(), HyperscoreOptions(), IonOptions(), SearchOptions())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    lines = plan.splitlines()
    joined = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line and "FullOuter" in line)
    # nothing is shuffled between the cells' exchange and the joined scores
    assert not any("Exchange hashpartitioning(query_id" in line for line in lines[joined:])
    assert s.columns[-3:] and c.columns[-3:]
