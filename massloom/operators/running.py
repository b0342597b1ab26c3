"""Running totals over a whole table in score order, without one task seeing it all.

Rows are first counted per distinct score, so ties are one row. The distinct
scores are dealt to ranges by score and written with the number of their range;
ranges run in parallel and start from the totals of the ranges before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.sources.stages import materialize


def cumulate(
    counts: DataFrame,
    value: str,
    sums: list[str],
    by: list[str] | tuple[str, ...] = (),
    descending: bool = True,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``cum_<c>`` for each column of ``sums``: its total over rows up to and including this one.

    ``counts`` has one row per group and distinct ``value``.
    """
    by = list(by)
    ranges = ranges or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written with the number of its range, so that a row has the same range whenever it is read
    placed = counts.repartitionByRange(ranges, *by, value).withColumn("_range", F.spark_partition_id())
    placed = materialize(placed)
    # a range holds few groups or one group few ranges: about ranges + groups rows
    totals = placed.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    order = F.desc("_range") if descending else F.asc("_range")
    before = (
        (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *by, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )
    within = (
        Window.partitionBy(*by, "_range")
        .orderBy(F.desc(value) if descending else F.asc(value))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        placed.join(offsets, [*by, "_range"])
        .withColumns({f"cum_{c}": F.col(f"_o_{c}") + F.sum(c).over(within) for c in sums})
        .drop(*[f"_o_{c}" for c in sums])
    )


def suffix_min(
    table: DataFrame, value: str, target: str, out: str, by: list[str] | tuple[str, ...] = (), descending: bool = True
) -> DataFrame:
    """Add ``out``: the least ``target`` at this row or any later one. Needs the ``_range`` of ``cumulate``."""
    by = list(by)
    lows = table.groupBy(*by, "_range").agg(F.min(target).alias("_low"))
    order = F.desc("_range") if descending else F.asc("_range")
    after = (
        (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
        .orderBy(order)
        .rowsBetween(1, Window.unboundedFollowing)
    )
    later = lows.select(*by, "_range", F.min("_low").over(after).alias("_later"))
    within = (
        Window.partitionBy(*by, "_range")
        .orderBy(F.asc(value) if descending else F.desc(value))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        table.join(later, [*by, "_range"])
        .withColumn(out, F.least(F.min(target).over(within), F.col("_later")))
        .drop("_later")
    )


def percentiles(df: DataFrame, value: str, probs: list[float], by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Exact percentiles, linear between neighbours: one row per group and probability."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return percentiles_of(counts, value, probs, by)


def percentiles_of(counts: DataFrame, value: str, probs: list[float], by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The same from ``n``, the number of rows of each group and distinct value."""
    by = list(by)
    ranked = cumulate(counts, value, ["n"], by, descending=False)
    if by:
        ranked = ranked.join(counts.groupBy(*by).agg(F.sum("n").alias("_size")), by)
    else:
        ranked = ranked.withColumn("_size", counts.agg(F.sum("n")).scalar())
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1

    def here(p: Column) -> Column:
        at = p * (F.col("_size") - 1)
        return F.floor(at).between(first, last) | F.ceil(at).between(first, last)

    wanted = F.array(*[F.lit(float(p)) for p in probs])
    near = ranked.withColumn("p", F.explode_outer(F.filter(wanted, here))).where(F.col("p").isNotNull())
    near = near.withColumn("_at", F.col("p") * (F.col("_size") - 1))
    low = F.max(F.when(F.floor("_at").between(first, last), F.col(value)))
    high = F.max(F.when(F.ceil("_at").between(first, last), F.col(value)))
    share = F.max(F.col("_at") - F.floor("_at"))
    return near.groupBy(*by, "p").agg((low + (high - low) * share).alias("value"))
