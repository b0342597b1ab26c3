"""Runs over stored stages: what is stale is refused, what is not needed is not read."""

import pytest
from pyspark.sql import functions as F

from massloom.operators.rescoring import apply_scores, semi_supervised_rescore, train_rf
from massloom.options import DigestOptions, PinOptions, QueryOptions, ReportOptions, SearchOptions
from massloom.plans import fixtures as fx
from massloom.plans.hooks import Hooks
from massloom.plans.run import RESCORERS, STAGES, RunOptions, run_stages
from massloom.sources.stages import SLAB, StageStore, StaleStage, describe, near_masses, write_by_mass

SMALL = DigestOptions(missed_cleavages=0, variable_mods=())


def quick(psms, pin):
    """The default method with one round."""
    return apply_scores(psms, semi_supervised_rescore(pin, iterations=1)).select(*psms.columns)


QUICK = Hooks(rescore=quick)


def opts(**more):
    return RunOptions(digest=SMALL, **more)


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("run"))
    proteins, spectra = fx.proteins(spark, sf), fx.planted(spark, sf)
    return folder, proteins, spectra, run_stages(spark, folder, proteins, spectra, opts(), hooks=QUICK)


def test_a_run_rescores(spark, stored):
    folder, _, _, done = stored
    assert RunOptions().rescore in RESCORERS and STAGES[-2:] == ("rescored", "rescored_report")
    assert set(done) == {"candidates", "spectra", "psms", "pin", "rescored"} and SLAB not in done["candidates"].columns
    psms, rescored = done["psms"], done["rescored"]
    assert rescored.columns == psms.columns and 0 < rescored.count() <= psms.count()
    assert rescored.join(psms, ["title", "modseq"], "left_anti").isEmpty()
    runs = {r["run_id"] for r in spark.read.parquet(f"{folder}/report/summary").select("run_id").distinct().collect()}
    assert runs == {"output", "rescored"}


@pytest.mark.parametrize(
    "changed, stages, said",
    [
        (dict(opts=RunOptions()), ("psms",), "candidates"),
        (dict(opts=opts(query=QueryOptions(max_charge=3))), ("psms",), "spectra"),
        (dict(opts=opts(search=SearchOptions(tolerance=(-5.0, 5.0)))), ("report",), "spectra"),
        (dict(opts=opts(search=SearchOptions(retain=3))), ("report",), "psms"),
        (dict(opts=opts(), hooks=Hooks(scorer="xcorr")), ("pin",), "psms"),
        (dict(opts=opts(pin=PinOptions(max_scores=2))), ("rescored",), "pin"),
        (dict(opts=opts(rescore="random_forest")), ("rescored_report",), "rescored"),
        (dict(opts=opts(), hooks=Hooks(rescore=lambda psms, pin: psms)), ("rescored_report",), "rescored"),
    ],
)
def test_stale_stages_are_refused(spark, stored, changed, stages, said):
    with pytest.raises(StaleStage, match=f"stage {said}"):
        run_stages(spark, stored[0], stages=stages, **changed)


def test_what_still_fits_is_used(spark, stored):
    folder, proteins, spectra, done = stored
    again = run_stages(spark, folder, proteins, spectra, opts(report=ReportOptions(fdr=0.2), search=SearchOptions(spectra_per_cell=7)), ("report",))
    assert again["psms"].count() == done["psms"].count()


def test_other_inputs_are_refused(spark, sf, stored, tmp_path):
    other = fx.proteins(spark, sf.replace("0.001", "0.01"))
    with pytest.raises(StaleStage, match="candidates was made with another input"):
        run_stages(spark, stored[0], proteins=other, opts=opts(), stages=("psms",))
    with pytest.raises(StaleStage, match="no stage candidates"):
        run_stages(spark, str(tmp_path), opts=opts(), stages=("psms",))


def test_a_stage_made_again_makes_later_ones_stale(spark, sf, tmp_path):
    folder = str(tmp_path)
    run_stages(spark, folder, fx.proteins(spark, sf).limit(5), fx.planted(spark, sf), opts(), ("candidates", "spectra", "psms"))
    run_stages(spark, folder, spectra=fx.planted(spark, sf), opts=opts(), stages=("spectra",))
    with pytest.raises(StaleStage, match="psms was made with another version of spectra"):
        run_stages(spark, folder, opts=opts(), stages=("pin",))
    nothing = fx.planted(spark, sf).limit(0)
    done = run_stages(spark, folder, fx.proteins(spark, sf).limit(5), nothing, opts(), STAGES, QUICK)
    assert done["rescored"].count() == done["psms"].count() == 0


def test_a_saved_forest_is_blended_in(spark, stored, tmp_path):
    folder, _, spectra, done = stored
    truth = spectra.select("title", F.replace("truth", F.lit("C[57.0215]"), F.lit("C")).alias("truth"))
    path = str(tmp_path / "forest")
    train_rf(done["pin"], truth, folds=2, trees=2)[0].save(path)
    blended = opts(rescore="random_forest", base_forest=path)
    out = run_stages(spark, folder, opts=blended, stages=("rescored",))["rescored"]
    assert out.columns == done["psms"].columns and out.where("score not between 0 and 1").isEmpty()
    assert 0 < out.count() == out.select("title").distinct().count()
    # another forest under the same path makes the stage stale, and so does none
    train_rf(done["pin"], truth, folds=2, trees=3)[0].save(path)
    for other in (blended, opts(rescore="random_forest")):
        with pytest.raises(StaleStage, match="stage rescored"):
            run_stages(spark, folder, opts=other, stages=("rescored_report",))
    with pytest.raises(ValueError, match="random_forest"):
        run_stages(spark, folder, opts=opts(base_forest=path), stages=("rescored",))


def test_an_unfinished_stage_is_refused(spark, tmp_path):
    store = StageStore(spark, str(tmp_path))

    def broken(df, path):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.write("x", spark.range(3), {"settings": "a"}, broken)
    with pytest.raises(StaleStage, match="not written to its end"):
        store.read("x", {"settings": "a"})
    table, version = store.write("x", spark.range(3), {"settings": "a", "input": "f"})
    assert store.read("x", {"settings": "a"})[1] == version and table.count() == 3


def test_only_matching_masses_are_read(spark, tmp_path):
    cands = spark.range(5000).selectExpr("id as cand_id", "if(id % 3 = 0, 777.7D, 100.0 + id * 2.0D) as mass", "id as length")
    table = write_by_mass(cands, str(tmp_path / "c"))
    assert table.count() == 5000 and table.drop(SLAB).columns == cands.columns
    spectra = spark.createDataFrame([(777.0, 778.0), (1049.5, 1050.5), (2e9, 3e9)], "min_mass double, max_mass double")
    got = near_masses(table, spectra)
    assert got.columns == cands.columns
    want = cands.join(spectra, F.col("mass").between(F.col("min_mass"), F.col("max_mass")), "left_semi")
    assert want.join(got, "cand_id", "left_anti").isEmpty() and got.count() < 0.45 * 5000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [mass_slab" in plan.replace("isnotnull(mass_slab#", "mass_slab#").replace("[,", "[") and "PushedFilters: [" in plan
    files = got.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r["f"].split(f"{SLAB}=")[1].split("/")[0] for r in files} <= {"15", "20", "21", "200"}
    assert near_masses(table, spectra.limit(0)).count() == 0


def test_descriptions_do_not_depend_on_the_session():
    assert describe((SMALL, {"b": describe, "a": 1.5})) == describe((DigestOptions(missed_cleavages=0, variable_mods=()), {"a": 1.5, "b": describe}))
    assert describe(lambda x: x) != describe(describe) and "0x" not in describe(lambda x: x)
