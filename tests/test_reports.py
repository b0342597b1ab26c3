"""Running totals, FDR, percentiles, reports and feature tables against brute force."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from massloom.operators import fdr, learned, pin, report, rescoring, running
from massloom.operators import spectra as spectra_ops
from massloom.operators.search import top_n
from massloom.options import PinOptions, ReportOptions
from massloom.plans import fixtures
from massloom.plans.registry import search_qvalues


def table(spark, rows):
    return spark.createDataFrame(rows, "psm_id long, title string, score double, decoy boolean")


def brute_q(rows):
    """FDR with ties sharing the ratio at their end, and its minimum over this and lower scores."""
    scores = sorted({r[2] for r in rows}, reverse=True)
    out, low = {}, 1.0
    for s in scores:
        t = sum(r[2] >= s and not r[3] for r in rows)
        d = sum(r[2] >= s and r[3] for r in rows)
        out[s] = min(1.0, d / max(t, 1))
    q = {}
    for s in reversed(scores):
        low = min(low, out[s])
        q[s] = low
    return out, q


def test_qvalues_of_a_whole_search(spark, sf):
    """Every spectrum with a candidate has its best match, foreign ones fit decoys as often as targets, q as counted."""
    rows = search_qvalues(spark, sf).withColumn("foreign", fixtures.is_foreign()).collect()
    ids = {r.query_id for r in fixtures.spectra_with_foreign(spark, sf).select("query_id").collect()}
    assert len({r.query_id for r in rows}) == len(rows) and {r.query_id for r in rows} <= ids
    own, foreign = ([r for r in rows if r.foreign == f] for f in (False, True))
    assert len(own) == sum(i * 7919 % 10 >= 3 for i in ids)  # each has its own peptide at least
    assert sum(r.truth == r.modseq for r in own) > 0.99 * len(own) and sum(r.q <= 0.01 for r in own) > 0.99 * len(own)
    assert len(foreign) > 1000 and 0.45 < sum(r.decoy for r in foreign) / len(foreign) < 0.55
    assert 0 < sum(r.q <= 0.01 and r.decoy for r in rows) <= 0.01 * sum(r.q <= 0.01 and not r.decoy for r in rows)
    order = sorted(rows, key=lambda r: -r.score)
    scores = np.array([r.score for r in order])
    decoys, targets = (np.cumsum([r.decoy == d for r in order]) for d in (True, False))
    end = np.searchsorted(-scores, -scores, "right") - 1  # ties share the ratio at their end
    ratio = np.minimum(1.0, decoys[end] / np.maximum(targets[end], 1))
    assert [r.fdr for r in order] == pytest.approx(ratio.tolist())
    assert [r.q for r in order] == pytest.approx(np.minimum.accumulate(ratio[::-1])[::-1].tolist())


def test_worked_example(spark):
    rows = [(i, f"t{i}", 10.0 - i, d) for i, d in enumerate([False, False, True, False, True])]
    got = sorted((r["psm_id"], r["fdr"], r["q"]) for r in fdr.with_fdr(table(spark, rows)).collect())
    want = [0, 0, 1 / 2, 1 / 3, 2 / 3], [0, 0, 1 / 3, 1 / 3, 2 / 3]
    assert [g[1] for g in got] == pytest.approx(want[0]) and [g[2] for g in got] == pytest.approx(want[1])


@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_two_pass_totals_equal_one_window(spark, ranges):
    rng = random.Random(ranges)
    rows = [(i, f"t{i % 40}", float(rng.choice([1, 2, 3, 5, 8, rng.random() * 10])), rng.random() < 0.3) for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = {r["psm_id"]: (r["fdr"], r["q"]) for r in fdr.with_fdr(table(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    f, q = brute_q(rows)
    for r in rows:
        assert got[r[0]] == pytest.approx((f[r[2]], q[r[2]]))


def test_reference_tie_scan(spark):
    rng = random.Random(9)
    rows = [(i, f"t{i}", float(rng.randint(1, 12)), rng.random() < 0.4) for i in range(80)]
    ordered = sorted(rows, key=lambda r: (-r[2], r[0]))
    want, targets, decoys, i = {}, 0, 0, 0
    while i < len(ordered):
        targets, decoys = targets + (not ordered[i][3]), decoys + ordered[i][3]
        ratio = min(1, decoys / max(targets, 1))
        want[ordered[i][0]] = ratio
        while not ordered[i][3] and i < len(ordered) - 1 and ordered[i][2] == ordered[i + 1][2]:
            targets += 1
            i += 1
            want[ordered[i][0]] = ratio
        i += 1
    order = [F.desc("score"), F.asc("psm_id")]
    got = fdr.with_fdr_in_order(table(spark, rows), order).collect()
    assert {r["psm_id"]: r["fdr"] for r in got} == pytest.approx(want)
    assert got and all(set(r.asDict()) == {"psm_id", "title", "score", "decoy", "fdr"} for r in got)


def test_percentiles(spark):
    rng = random.Random(4)
    values = [(i % 3, rng.choice([1.5, 2.0, rng.gauss(0, 5)])) for i in range(301)]
    df = spark.createDataFrame(values, "g int, v double")
    for r in running.percentiles(df, "v", report.DECILES).collect():
        assert r["value"] == pytest.approx(np.percentile([v for _, v in values], r["p"] * 100))
    for r in running.percentiles(df, "v", [0.0, 0.5, 1.0], ["g"]).collect():
        assert r["value"] == pytest.approx(np.percentile([v for g, v in values if g == r["g"]], r["p"] * 100))


def test_top_n_and_infinite_scores(spark):
    rows = [(i, "a", float(s), False) for i, s in enumerate([3, 9, float("inf"), 9, 1])]
    assert [r["psm_id"] for r in fdr.reported(table(spark, rows), ReportOptions(top_n=2)).collect()] == [1, 3]
    assert "WindowGroupLimit" in top_n(table(spark, rows), 2, "title", ("psm_id",))._jdf.queryExecution().executedPlan().toString()


def test_missing_truth_is_an_error(spark):
    psms = table(spark, [(1, "a", 1.0, False)]).withColumn("modseq", F.lit("AK"))
    truth = spark.createDataFrame([("b", "AK")], "title string, truth string")
    with pytest.raises(Exception, match="ground truth"):
        report.with_truth(psms, truth).collect()


def test_saved_reports_compare(spark, tmp_path):
    rows = table(spark, [(i, f"t{i}", float(i), i % 4 == 0) for i in range(40)]).withColumn("modseq", F.col("title"))
    for run in ("a", "b"):
        report.save_report(report.tda_fdr(rows), str(tmp_path), run)
    curves = report.load_report(spark, str(tmp_path), "curve")
    both = report.compare_runs(curves.where("run_id = 'a'"), curves.where("run_id = 'b'")).collect()
    assert both and all(r["n_a"] == r["n_b"] for r in both)


def test_features_must_fit_the_model(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    rescoring.check_features(["b", "a"], df)
    with pytest.raises(ValueError):
        rescoring.check_features(["a", "c"], df)
    assert pin.feature_names(df.withColumn("query_id", F.lit(1)).withColumn("deltLCn", F.lit(1.0))) == ["a", "b", "deltLCn"]


def test_text_and_doubled_features_are_refused(spark):
    df = spark.createDataFrame([(1.0, "2")], "a double, b string")
    with pytest.raises(ValueError, match="not numbers"):
        rescoring.check_features(["a", "b"], df)
    with pytest.raises(ValueError, match="more than once"):
        rescoring.check_features(["a", "a"], df)


def forest_pin(spark, n=120):
    rows = [(f"t{i}", 1 if i % 3 else -1, i, float(i % 7) + (2.0 if i % 3 else 0.0), float(i % 5), f"P{i}K", "d") for i in range(n)]
    return spark.createDataFrame(rows, "PSMId string, Label int, ScanNr long, a double, b double, Peptide string, Proteins string")


def test_a_forest_is_kept_and_blended(spark, tmp_path):
    pin = forest_pin(spark)
    truth = pin.select(F.col("PSMId").alias("title"), F.when(F.col("Label") > 0, F.col("Peptide")).otherwise("AK").alias("truth"))
    fitted, counts = rescoring.train_rf(pin, truth, folds=3, trees=4)
    assert fitted.feats == ["a", "b"] and counts.count() == 3
    fitted.save(str(tmp_path / "f"))
    loaded = rescoring.TrainedForest.load(spark, str(tmp_path / "f"))
    assert (loaded.feats, loaded.version) == (fitted.feats, fitted.version)
    # columns in another order and further ones do not matter
    other = pin.select("b", F.lit(1.0).alias("c"), *[c for c in pin.columns if c != "b"])
    got = {r["PSMId"]: r for r in rescoring.rf_rescore(other, loaded, folds=3, trees=4, parts=True).collect()}
    want = {r["PSMId"]: r["p"] for r in fitted.probability(fitted.scaled(pin), "p").collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert r["base"] == pytest.approx(want[k]) and r["new_score"] == pytest.approx(0.75 * r["base"] + 0.25 * r["tuned"])
    with pytest.raises(ValueError, match="not in the table"):
        rescoring.rf_rescore(pin.drop("a"), loaded)
    alone = rescoring.rf_rescore(pin, folds=3, trees=4, parts=True).collect()
    assert all(r["base"] is None and r["new_score"] == r["tuned"] for r in alone)


def test_report_reads_its_rows_once(spark):
    rows = [(i, f"t{i // 2}", float(i % 37), i % 4 == 0) for i in range(400)]
    psms = table(spark, rows).withColumns(
        {"modseq": F.col("title"), "length": F.lit(9), "charge": (F.col("psm_id") % 3).cast("int"), "query_mass": F.col("score") * 11}
    )
    seen = spark.sparkContext.accumulator(0)
    watched = psms.mapInPandas(lambda parts: (seen.add(len(p)) or p for p in parts), psms.schema)
    tables = report.report_tables(watched)
    best = fdr.reported(psms)
    for name, column in (("scores_by_score", "score"), ("scores_by_mass", "query_mass"), ("scores_by_length", "length")):
        want = report.scores_by_decile(best, column)
        got = tables[name].select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert tables["ranges"].collect() == report.ranges(best).collect()
    assert tables["summary"].collect() == fdr.fdr_summary(best).collect()
    assert seen.value == 400
    empty = report.report_tables(psms.limit(0))
    assert empty["scores_by_score"].count() == 0 and empty["summary"].first()["n_psms"] == 0


def test_histograms_share_their_bins(spark):
    a = table(spark, [(i, "t", float(i), False) for i in range(10)])
    b = table(spark, [(0, "t", 19.0, True), (1, "t", float("inf"), True), (2, "t", 0.0, False)])
    got = {(r["run_id"], r["decoy"], r["bin"]): r["n"] for r in report.compare_histograms({"a": a, "b": b}, bins=2).collect()}
    assert got == {("a", False, 0): 10, ("b", True, 1): 1, ("b", False, 0): 1}
    one = report.compare_histograms({"a": a.where("score = 3")}).collect()
    assert [(r["bin"], r["low"], r["n"]) for r in one] == [(0, 3.0, 1)]
    assert report.compare_histograms({"a": a.limit(0)}).count() == 0


def test_metadata_as_features(spark):
    rows = [(1, "a", 3.0, False, {"k": "1.5"}), (2, "b", 2.0, False, {"k": "x"}), (3, "c", 1.0, True, None)]
    psms = spark.createDataFrame(rows, "psm_id long, title string, score double, decoy boolean, meta map<string,string>").withColumns(
        {"query_id": F.col("psm_id"), "cand_id": F.col("psm_id"), "desc": F.lit("d"), "modseq": F.lit("AK")}
    )
    got = pin.pin_features(psms, PinOptions(use_extra=True, extra_keys=("k",)))
    assert {r["PSMId"]: r["k"] for r in got.collect()} == {"a": 1.5, "b": 0.0, "c": 0.0}
    assert "k" not in pin.pin_features(psms).columns
    with pytest.raises(ValueError, match="meta"):
        pin.pin_features(psms.drop("meta"), PinOptions(use_extra=True, extra_keys=("k",)))


def test_cosine_against_plain_sums(spark):
    r = random.Random(3)
    seen = [(q, b, r.random()) for q in range(6) for b in sorted(r.sample(range(60), r.randrange(12))) if q != 4]
    predicted = [(f"m{m}", z, b, r.random()) for m in range(4) for z in (1, 2) for b in r.sample(range(60), 9)]
    matches = [(i, r.randrange(6), f"m{r.randrange(5)}", r.randrange(1, 4)) for i in range(60)] + [(0, 4, "m0", 1)]
    psms = spark.createDataFrame(matches, "psm_id long, query_id long, modseq string, charge int")
    a = spark.createDataFrame(seen, "query_id long, bin int, intensity double")
    b = spark.createDataFrame(predicted, "modseq string, z int, bin int, intensity double")
    got = learned.spectral_similarity(psms, a, b, max_charge=2)
    assert got.columns == [*psms.columns, "MLCorr"] and got.count() == len(matches)
    for row in got.collect():
        p = {x[2]: x[3] for x in predicted if x[:2] == (row["modseq"], min(row["charge"], 2))}
        o = {x[1]: x[2] for x in seen if x[0] == row["query_id"]}
        ab, aa, bb = sum(o.get(k, 0) * v for k, v in p.items()), sum(o.get(k, 0) ** 2 for k in p), sum(v * v for v in p.values())
        assert row["MLCorr"] == pytest.approx(ab / ((aa * bb) ** 0.5 + 1e-10))
    assert learned.spectral_similarity(psms, a.limit(0), b).where("MLCorr != 0").isEmpty()
    assert learned.spectral_similarity(psms, a, b.limit(0)).where("MLCorr != 0").isEmpty()


def test_sparse_vectors(spark):
    bins = spark.createDataFrame([(1, 5, 0.5), (1, 2, 1.0), (1, 9, 0.3), (2, 3, 0.0)], "query_id long, bin int, intensity double")
    spectra = spark.createDataFrame([(1, 0.7), (2, 0.0), (3, 0.2)], "query_id long, mass double")
    got = {r["query_id"]: r["features"] for r in spectra_ops.sparse_vectors(bins, 8, spectra, "mass").collect()}
    assert got == {1: Vectors.sparse(9, [2, 5, 8], [1.0, 0.5, 0.7]), 2: Vectors.sparse(9, [], []), 3: Vectors.sparse(9, [8], [0.2])}
    lone = spark.createDataFrame([(1, 500.0, [(100.02, 4.0), (100.0, 5.0), (50.0, 1.0)])], "query_id long, mass double, peaks array<struct<mz:double,intensity:double>>")
    assert learned.length_vectors(lone).first()["features"] == Vectors.sparse(20_001, [500, 1000, 20_000], [1 / 3, 1.0, 0.25])


def test_labelled_sequences(spark):
    df = spark.createDataFrame([("_AM(ox)CK_",), ("C+10.5A-3K",), ("-AK",)], "seq string")
    rows = {r["seq"]: r["mods"] for r in learned.parse_modseq(df).collect()}
    assert rows == {"AMCK": [0.0, 15.995, 57.021, 0.0], "CAK": [10.5, -3.0, 0.0]}


def test_splits_share_no_peptide(spark):
    df = spark.range(3000).select((F.col("id") % 500).cast("string").alias("p"))
    per = df.select("p", learned.split_of(F.col("p")).alias("s")).groupBy("p").agg(F.countDistinct("s").alias("n"), F.first("s").alias("s"))
    assert per.where("n > 1").count() == 0
    assert 0.7 < per.where("s = 'train'").count() / 500 < 0.9


def test_many_groups_and_ranges(spark):
    """Running totals have no bound on groups times ranges."""
    counts = spark.range(3000).selectExpr("id % 500 AS g", "id AS v", "1 AS n")
    got = running.cumulate(counts, "v", ["n"], ["g"], descending=False, ranges=600)
    assert got.where("cum_n != (v - g) div 500 + 1").count() == 0 and got.count() == 3000
