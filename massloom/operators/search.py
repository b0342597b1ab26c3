"""The search: every pair scored, the best of each spectrum kept."""

from __future__ import annotations

import dataclasses
import functools
import inspect
import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from massloom.functions import chem
from massloom.operators.cellscores import score_by_cell
from massloom.operators.hyperscore import hyperscore
from massloom.operators.matching import PAIR
from massloom.operators.precursor import CAND_NAMES, CELL, QUERY_NAMES, _renamed, cell_rows, precursor_join
from massloom.operators.xcorr import xcorr
from massloom.options import HyperscoreOptions, IonOptions, SearchOptions, XcorrOptions

# spectra and candidate columns the built-in scorers read
SPECTRUM_COLUMNS = ["query_id", "charge", "mass", "min_mass", "max_mass", "peaks"]
CANDIDATE_COLUMNS = ["cand_id", "mass", "length", "seq", "mods"]

FEATURES = ["score", "rawscore", "total_matched", "sum_i", "ion_frac"]
# columns of scored pairs that neither side gives
SCORED = [*FEATURES, "xcorr", "hyperscore", *CELL]


def _narrow(spectra: DataFrame, cands: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """What the built-in scorers read, and what a condition on pairs needs besides."""
    extra = ["ions"] if "ions" in cands.columns else []
    s, c = SPECTRUM_COLUMNS, [*CANDIDATE_COLUMNS, *extra]
    return (
        spectra.select(*s, *[F.col(_source(x, QUERY_NAMES, spectra)) for x in keep if _in_side(x, s, QUERY_NAMES, spectra)]),
        cands.select(*c, *[F.col(_source(x, CAND_NAMES, cands)) for x in keep if _in_side(x, c, CAND_NAMES, cands)]),
    )


def _source(name: str, names: dict[str, str], side: DataFrame) -> str:
    """The column of ``side`` that a pair calls ``name``."""
    return next((a for a, b in names.items() if b == name and a in side.columns), name)


def _in_side(name: str, had: list[str], names: dict[str, str], side: DataFrame) -> bool:
    """Whether a pair's column ``name`` is one of ``side`` and not among the columns it has anyway."""
    source = _source(name, names, side)
    return source in side.columns and source not in had and name not in names


@dataclass(frozen=True)
class PairFilter:
    """A condition on both sides of a pair, the columns of the pair that it reads, and whether any is an array, map or struct.

    Beside every peak or ion such a column would be most of what is shuffled and sorted.
    """

    condition: Column
    columns: tuple[str, ...]
    nested: bool = False


def joined_xcorr(spectra, cands, opts, ions, search, pair_filter: PairFilter | None = None) -> DataFrame:
    """Xcorr from a join of peaks and ions; ``pair_filter`` is evaluated in that join."""
    sides = cell_rows(*_narrow(spectra, cands, pair_filter.columns if pair_filter else ()), search)
    scored = xcorr(*sides, opts, ions, pair_filter)
    return scored.withColumn("rawscore", F.col("score"))


def joined_hyperscore(spectra, cands, opts, ions, search, pair_filter: PairFilter | None = None) -> DataFrame:
    """Hyperscore from a join of peaks and ions; ``pair_filter`` is evaluated in that join."""
    sides = cell_rows(*_narrow(spectra, cands, pair_filter.columns if pair_filter else ()), search)
    scored = hyperscore(*sides, opts, ions, pair_filter)
    return scored.where(F.col("score") > 0).withColumn("rawscore", F.col("score"))


def joined_combined(
    spectra, cands, xcorr_opts, hyper_opts, ions, search, pair_filter: PairFilter | None = None
) -> DataFrame:
    """Both scores and their combination from joins of peaks and ions.

    The two sides are shuffled once for both scorers, and the two results are
    partitioned alike, so putting them together moves nothing.
    """
    s, c = cell_rows(*_narrow(spectra, cands, pair_filter.columns if pair_filter else ()), search)
    values = ["score", "total_matched", "sum_i", "ion_frac"]
    x = xcorr(s, c, xcorr_opts, ions, pair_filter).withColumnsRenamed({v: f"_x_{v}" for v in values})
    h = hyperscore(s, c, hyper_opts, ions, pair_filter).withColumnsRenamed({v: f"_h_{v}" for v in values})
    both = x.join(h, PAIR, "full_outer")
    raw_x = F.coalesce(F.col("_x_score"), F.lit(0.0))
    raw_h = F.coalesce(F.col("_h_score"), F.lit(0.0))
    root = F.sqrt(F.log10(raw_h + 1))
    # xcorr's features where it scored, the hyperscore's elsewhere
    return (
        both.select(
            *PAIR,
            F.greatest(F.lit(0.0), raw_x, root, raw_x * root).alias("score"),
            F.coalesce("_x_score", "_h_score").alias("rawscore"),
            *[F.coalesce(f"_x_{v}", f"_h_{v}").alias(v) for v in values[1:]],
            raw_x.alias("xcorr"),
            raw_h.alias("hyperscore"),
        )
        .where(F.col("score") > 0)
    )


PAIR_COLUMNS = ["query_id", "charge", "query_mass", "cand_id", "cand_mass", "length"]
# pairs of a cell that bring nested columns along, at most
NESTED_PAIRS = 500_000


def _by_cell(spectra, cands, xcorr_opts, hyper_opts, ions, search, pair_filter, best) -> DataFrame:
    """Scores a cell at a time. A condition is applied to the pairs as they leave their cell, with the columns it reads.

    Spectra that share their number count as one under a condition, so these few are joined.
    """
    if pair_filter is None:
        return score_by_cell(*_narrow(spectra, cands), xcorr_opts, hyper_opts, ions, search, best=best)
    shared = spectra.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("query_id")
    several, spectra = (spectra.join(shared, "query_id", kind).select(*spectra.columns) for kind in ("left_semi", "left_anti"))
    if xcorr_opts is not None and hyper_opts is not None:
        joined = joined_combined(several, cands, xcorr_opts, hyper_opts, ions, search, pair_filter)
    elif xcorr_opts is not None:
        joined = joined_xcorr(several, cands, xcorr_opts, ions, search, pair_filter)
    else:
        joined = joined_hyperscore(several, cands, hyper_opts, ions, search, pair_filter)
    wanted = [x for x in pair_filter.columns if x not in PAIR_COLUMNS]
    s, c = _narrow(spectra, cands, pair_filter.columns)
    carried = [
        (x, source in s.columns, source if source in s.columns else _source(x, CAND_NAMES, c))
        for x, source in ((x, _source(x, QUERY_NAMES, s)) for x in wanted)
    ]
    search = dataclasses.replace(search, pairs_per_cell=min(search.pairs_per_cell, NESTED_PAIRS))
    rows = score_by_cell(s, c, xcorr_opts, hyper_opts, ions, search, carried)
    rows = rows.where(pair_filter.condition).drop(*wanted)
    return rows.unionByName(joined.select(*rows.columns))


def score_xcorr(
    spectra, cands, opts=XcorrOptions(), ions=IonOptions(), search=SearchOptions(),
    pair_filter: PairFilter | None = None, best: int | None = None,
) -> DataFrame:
    """Xcorr of all pairs with a positive score, a cell at a time; under a condition on plain columns in a join of peaks and ions.

    ``best`` lets a cell leave out what is not among that many of a spectrum.
    """
    if pair_filter is not None and not pair_filter.nested:
        return joined_xcorr(spectra, cands, opts, ions, search, pair_filter)
    return _by_cell(spectra, cands, opts, None, ions, search, pair_filter, best)


def score_hyperscore(
    spectra, cands, opts=HyperscoreOptions(), ions=IonOptions(), search=SearchOptions(),
    pair_filter: PairFilter | None = None, best: int | None = None,
) -> DataFrame:
    """Hyperscore of all pairs with a positive score; see ``score_xcorr``."""
    if pair_filter is not None and not pair_filter.nested:
        return joined_hyperscore(spectra, cands, opts, ions, search, pair_filter)
    return _by_cell(spectra, cands, None, opts, ions, search, pair_filter, best)


def score_combined(
    spectra, cands, xcorr_opts=XcorrOptions(), hyper_opts=HyperscoreOptions(), ions=IonOptions(), search=SearchOptions(),
    pair_filter: PairFilter | None = None, best: int | None = None,
) -> DataFrame:
    """Both scores and their combination, of all pairs with a positive one, from one look at the ions."""
    if pair_filter is not None and not pair_filter.nested:
        return joined_combined(spectra, cands, xcorr_opts, hyper_opts, ions, search, pair_filter)
    return _by_cell(spectra, cands, xcorr_opts, hyper_opts, ions, search, pair_filter, best)


SCORERS: dict[str, Callable] = {
    "xcorr": score_xcorr,
    "hyperscore": score_hyperscore,
    "combined": score_combined,
}


def pairwise_scorer(score: Callable[[DataFrame], DataFrame], cand_filter=None) -> Callable:
    """A scorer from a function of the joined pairs.

    ``score`` adds a ``score`` column, and any features, to the pair rows; it may
    use column expressions, pandas UDFs or ``mapInPandas``.
    """

    def scorer(spectra, cands, search: SearchOptions = SearchOptions(), pair_filter: PairFilter | None = None) -> DataFrame:
        pairs = precursor_join(spectra, cands, search, cand_filter)
        if pair_filter is not None:
            pairs = pairs.where(pair_filter.condition)
        return score(pairs).where(F.col("score") > 0)

    return scorer


def top_n(psms: DataFrame, n: int, by: str = "query_id", ties: tuple[str, ...] = ("cand_id",)) -> DataFrame:
    """The ``n`` best rows of each spectrum; Spark cuts to ``n`` before the shuffle too."""
    best = Window.partitionBy(by).orderBy(F.desc("score"), *[F.asc(t) for t in ties])
    return psms.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= n).drop("_rank")


def feature_columns(psms: DataFrame) -> DataFrame:
    """The per-match feature vector, under its established names."""
    relative = (F.col("cand_mass") - F.col("query_mass")) / F.col("cand_mass")
    names = {"sum_i": "sumI", "ion_frac": "ionFrac"}
    return (
        psms.withColumnsRenamed({a: b for a, b in names.items() if a in psms.columns})
        .withColumn("dM", relative)
        .withColumn("absdM", F.abs(relative))
        .withColumn("peplen", F.col("length"))
        .withColumns({f"z{z}": (F.col("charge") == z).cast("int") for z in (2, 3, 4)})
        .withColumn("expMass", F.col("query_mass"))
        .withColumn("calcMass", F.col("cand_mass"))
    )


def search(
    spectra: DataFrame,
    cands: DataFrame,
    scorer: str | Callable = "combined",
    opts: SearchOptions = SearchOptions(),
    retain: int | None = None,
    cand_filter: Callable[[], Column | Sequence[Column]] | Column | Sequence[Column] | None = None,
    **scorer_options,
) -> DataFrame:
    """Peptide-spectrum matches with their features.

    ``retain`` keeps that many per spectrum; ``None`` keeps every match with a
    positive score. ``cand_filter`` is a condition on the columns of a pair, or
    several that must all hold. A condition on one side only cuts that side
    before anything is scored; one on both sides is evaluated where the sides
    meet: before anything is summed, or, if it reads an array, map or struct, on the pairs as they leave their cell. Only a condition on scores, or one for a
    scorer without a ``pair_filter``, is applied to scored pairs. Names and
    sequences are fetched for the surviving rows only, unless such a condition
    needs them first.
    """
    run = SCORERS[scorer] if isinstance(scorer, str) else scorer
    conditions = cand_filter() if callable(cand_filter) else cand_filter
    conditions = [] if conditions is None else [conditions] if isinstance(conditions, Column) else list(conditions)
    before, after = [], []
    for condition in conditions:
        spectra, cands, left = _filter_sides(spectra, cands, condition)
        if left is not None:
            inside = "pair_filter" in inspect.signature(run).parameters and _resolves(_pair(spectra, cands), left)
            (before if inside else after).append(left)
    if before:
        condition = functools.reduce(operator.and_, before)
        read = _read_by(condition, spectra, cands)
        kinds = _pair(spectra, cands).schema
        nested = any(isinstance(kinds[x].dataType, (ArrayType, MapType, StructType)) for x in read)
        scorer_options["pair_filter"] = PairFilter(condition, read, nested)
    condition = functools.reduce(operator.and_, after) if after else None
    if retain and not before and not after and run in SCORERS.values():
        scorer_options["best"] = retain
    psms = run(spectra, cands, search=opts, **scorer_options)
    if condition is not None:
        psms = _describe(psms, spectra, cands).where(condition)
    if retain is not None:
        psms = top_n(psms, retain)
    if condition is None:
        psms = _describe(psms, spectra, cands)
    return feature_columns(psms.drop(*CELL)).withColumn(
        "psm_id", chem.stable_id(F.col("query_id").cast("string"), F.col("cand_id").cast("string"))
    )


def _resolves(df: DataFrame, condition: Column) -> bool:
    try:
        df.select(condition).schema  # a filter would find columns that were dropped below
    except AnalysisException:
        return False
    return True


def _pair(spectra: DataFrame, cands: DataFrame) -> DataFrame:
    """The columns of a pair, without rows."""
    s, c = _renamed(spectra, QUERY_NAMES), _renamed(cands, CAND_NAMES)
    new = [x for x in c.columns if x not in s.columns]
    return spectra.sparkSession.createDataFrame([], StructType([*s.schema.fields, *(c.schema[x] for x in new)]))


def _read_by(condition: Column, spectra: DataFrame, cands: DataFrame) -> tuple[str, ...]:
    """The columns of a pair without which ``condition`` has no meaning."""
    pair = _pair(spectra, cands)
    return tuple(x for x in pair.columns if not _resolves(pair.drop(x), condition))


def _filter_sides(
    spectra: DataFrame, cands: DataFrame, condition: Column
) -> tuple[DataFrame, DataFrame, Column | None]:
    """Both sides, the one that alone settles the condition cut by it, and what is left of the condition."""
    s, c = _renamed(spectra, QUERY_NAMES), _renamed(cands, CAND_NAMES)
    for own, other, names in ((c, s, CAND_NAMES), (s, c, QUERY_NAMES)):
        # a name that both sides or the scorers have may mean another column in a pair
        usable = [x for x in own.columns if x not in other.columns and x not in SCORED]
        if not _resolves(own.select(*usable), condition):
            continue
        cut = own.where(condition).withColumnsRenamed({b: a for a, b in names.items()})
        return (spectra, cut, None) if own is c else (cut, cands, None)
    return spectra, cands, condition


def _describe(psms: DataFrame, spectra: DataFrame, cands: DataFrame) -> DataFrame:
    """Add what the scorers did not carry: names, sequences, metadata."""
    c = _renamed(cands, CAND_NAMES)
    c = c.select("cand_id", *[x for x in c.columns if x not in psms.columns and x != "ions"])
    s = _renamed(spectra, QUERY_NAMES)
    s = s.select("query_id", *[x for x in s.columns if x not in psms.columns and x != "peaks"])
    return psms.join(c, "cand_id").join(s, "query_id")


def result_table(psms: DataFrame) -> DataFrame:
    """The result columns, ordered by spectrum and descending score."""
    return psms.select(
        "title",
        "desc",
        "seq",
        "modseq",
        "score",
        F.col("charge").alias("query_charge"),
        "query_mass",
        "cand_mass",
        F.col("cand_id").alias("candrow"),
        F.col("query_id").alias("qrow"),
        F.lit("psms").alias("file"),
        F.col("psm_id").alias("rrow"),
    ).orderBy("qrow", F.desc("score"), "candrow")
