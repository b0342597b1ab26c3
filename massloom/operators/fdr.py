"""Target-decoy false discovery rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators.running import cumulate, suffix_min
from massloom.operators.search import top_n
from massloom.options import ReportOptions
from massloom.sources.stages import materialize
from massloom.sources.tables import finite


def score_table(
    psms: DataFrame,
    score: str = "score",
    decoy: str = "decoy",
    by: list[str] | tuple[str, ...] = (),
    descending: bool = True,
) -> DataFrame:
    """One row per distinct score: ``n, targets, decoys``, running counts, ``fdr`` and ``q``.

    Rows of equal score share the ratio at the end of their tie.
    """
    return levels_of(value_counts(psms, [*by, score], decoy), score, by, descending)


def value_counts(psms: DataFrame, keys: list[str], decoy: str = "decoy") -> DataFrame:
    """``n, targets, decoys`` of each combination of ``keys``."""
    return psms.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(~F.col(decoy), 1)).alias("targets"),
        F.count(F.when(F.col(decoy), 1)).alias("decoys"),
    )


def levels_of(counts: DataFrame, score: str = "score", by: list[str] | tuple[str, ...] = (), descending: bool = True) -> DataFrame:
    """``score_table`` from the counts of each score."""
    by = list(by)
    ran = cumulate(counts, score, ["n", "targets", "decoys"], by, descending)
    ratio = F.least(F.lit(1.0), F.col("cum_decoys") / F.greatest(F.col("cum_targets"), F.lit(1)))
    return suffix_min(ran.withColumn("fdr", ratio), score, "fdr", "q", by, descending).drop("_range")


def with_fdr(psms: DataFrame, score: str = "score", decoy: str = "decoy", by=(), descending: bool = True) -> DataFrame:
    """Every row with the false discovery rate and q-value of its score."""
    keys = [*by, score]
    levels = score_table(psms, score, decoy, by, descending).select(*keys, "fdr", "q")
    return psms.join(levels, keys)


with_qvalue = with_fdr


def with_fdr_in_order(psms: DataFrame, order: list[Column], score: str = "score", decoy: str = "decoy") -> DataFrame:
    """FDR replaying a scan over a stated total order, ties and all.

    A target opens a run of equal scores; rows of the run count as targets and
    keep the run's first ratio, until a decoy has closed it. Rows are dealt into
    ordered parts, written once so that they stay put; what one part needs of
    those before it is one row per part.
    """
    dealt = materialize(psms.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    parts_before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)

    def carried(table: DataFrame, **what: Column) -> DataFrame:
        """Per part, the last values of ``what`` and how they reach the next part."""
        back = Window.partitionBy("_part").orderBy(F.desc("_place"))
        last = table.withColumn("_back", F.row_number().over(back)).where(F.col("_back") == 1)
        return last.select("_part", *[c.alias(n) for n, c in what.items()])

    rows = dealt.withColumn("_place", F.row_number().over(inside))
    ends = carried(rows, _last_score=F.col(score), _last_decoy=F.col(decoy))
    ends = ends.select(
        "_part",
        F.last("_last_score").over(parts_before).alias("_last_score"),
        F.last("_last_decoy").over(parts_before).alias("_last_decoy"),
    )
    rows = rows.join(F.broadcast(ends), "_part")
    first = F.col("_place") == 1
    before_score = F.when(first, F.col("_last_score")).otherwise(F.lag(score).over(inside))
    before_decoy = F.when(first, F.col("_last_decoy")).otherwise(F.lag(decoy).over(inside))
    opens = F.coalesce(before_score != F.col(score), F.lit(True)) | F.coalesce(before_decoy, F.lit(True))
    rows = rows.withColumn("_opens", opens)
    rows = rows.withColumn("_decoys", F.sum((F.col("_opens") & F.col(decoy)).cast("int")).over(running))

    sums = carried(rows, _d=F.col("_decoys"), _n=F.col("_place"))
    sums = sums.select("_part", *[F.coalesce(F.sum(c).over(parts_before), F.lit(0)).alias(c) for c in ("_d", "_n")])
    n_decoys = F.col("_decoys") + F.col("_d")
    ratio = F.least(F.lit(1.0), n_decoys / F.greatest(F.col("_place") + F.col("_n") - n_decoys, F.lit(1)))
    rows = rows.join(F.broadcast(sums), "_part").withColumn("_ratio", F.when(F.col("_opens"), ratio))
    rows = rows.withColumn("_ratio", F.last("_ratio", ignorenulls=True).over(running))

    runs = carried(rows, _run=F.col("_ratio"))
    runs = runs.select("_part", F.last("_run", ignorenulls=True).over(parts_before).alias("_run"))
    out = rows.join(F.broadcast(runs), "_part").withColumn("fdr", F.coalesce("_ratio", "_run"))
    return out.select(*psms.columns, "fdr")


def reported(psms: DataFrame, opts: ReportOptions = ReportOptions(), ties: tuple[str, ...] = ("psm_id",)) -> DataFrame:
    """The rows a report is about: finite scores, the best per spectrum title."""
    return top_n(psms.where(finite()), opts.top_n, "title", ties)


def fdr_curve(levels: DataFrame) -> DataFrame:
    """Per distinct q-value, the number of rows at or below it.

    q never falls as the score does, so that is the running count at the last score of the q.
    """
    return levels.groupBy("q").agg(F.max("cum_n").alias("n"))


def threshold(levels: DataFrame, limit: float) -> DataFrame:
    """One row: the score of the last row with q at or below the limit; null if there is none."""
    return levels.where(F.col("q") <= limit).agg(F.min("score").alias("cutoff"))


def fdr_summary(psms: DataFrame, opts: ReportOptions = ReportOptions(), levels: DataFrame | None = None) -> DataFrame:
    """One row: sizes, overall ratio, and counts above the score cutoff at the FDR limit.

    ``levels`` is the score table of ``psms``, where it is there already.
    """
    levels = score_table(psms) if levels is None else levels
    rows = psms.withColumn("cutoff", threshold(levels, opts.fdr).scalar())
    passed = F.coalesce(F.col("score") >= F.col("cutoff"), F.lit(False))
    n_targets, n_decoys = F.count(F.when(~F.col("decoy"), 1)), F.count(F.when(F.col("decoy"), 1))
    return rows.agg(
        F.count(F.lit(1)).alias("n_psms"),
        F.countDistinct("title").alias("n_spectra"),
        F.try_divide(n_decoys, n_targets).alias("overall_fdr"),
        F.count(F.when(passed, 1)).alias("psms_at"),
        F.countDistinct(F.when(passed, F.col("modseq"))).alias("unique_at"),
        F.count(F.when(passed & ~F.col("decoy"), 1)).alias("targets_at"),
        F.count(F.when(passed & F.col("decoy"), 1)).alias("decoys_at"),
        F.countDistinct(F.when(passed, F.col("title"))).alias("spectra_at"),
        F.countDistinct("modseq").alias("unique_all"),
        F.max("cutoff").alias("cutoff"),
    ).withColumn("spectra_not_at", F.col("n_spectra") - F.col("spectra_at"))
