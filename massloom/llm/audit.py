"""Which filter removes what, in every order of a set of filters.

Each filter stores the ids of the rows that fail it. What survives a prefix of filters is the id table less those
relations, by left-anti joins; label losses follow the rows that a left-semi join finds among the labels. A prefix
counts by its set of filters only, so every id is listed once for each of the 2^n sets, after the one shuffle that
brings it to the failing ids, and one left-anti join for each filter leaves the survivors of all sets. What a step
removes is the difference of two sets.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.sources.stages import materialize

KEY = ("id", "row")
MOST_FILTERS = 7  # 128 sets, 5,040 orders


@dataclass(frozen=True)
class AuditTables:
    """``ids`` (id, row, doc_id, part): all rows; ``failing``: for each filter's letter the id and row of those that fail it."""

    ids: DataFrame
    failing: dict[str, DataFrame]


def conditions(text: Column) -> dict[str, Column]:
    """The failure conditions that look at one text only. Words end at spaces and 09-0D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "words": words,
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct("words")) < 80 * n,
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failing_ids(docs: DataFrame) -> AuditTables:
    """One table of ids for each of the filters A to E, written to the shared folder.

    A: under 100 words; B: under 80 % of the words distinct; C: over 10 % capitals A-Z; D: any of ``#$%&*|``; E: the
    text of a row with a smaller doc_id. Null texts are empty. A row is known by its doc_id and a hash of text and lang,
    so rows that repeat a doc_id are judged each; a row without doc_id is neither smaller nor larger than another.
    """
    text, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), lang.alias("part"))
    told = conditions(F.col("text"))
    judged = plain.withColumn("words", told["words"]).select(
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64("doc_id", "text", "part").alias("row"),
        "doc_id",
        "part",
        F.unhex(F.md5("text")).alias("digest"),
        *(told[x].alias(x) for x in "ABCD"),
    )
    judged = materialize(judged)
    failing = {x: materialize(judged.where(x).select(*KEY)) for x in "ABCD"}
    # a group of equal texts may be a third of all rows: only its smallest id is looked up, by id
    named = judged.where("doc_id is not null")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    failing["E"] = materialize(named.join(first, ["doc_id", "digest"], "left_anti").select(*KEY))
    return AuditTables(judged.select(*KEY, "doc_id", "part"), failing)


def survivors(ids: DataFrame, failing: dict[str, DataFrame], label_ids: dict[str, DataFrame]) -> DataFrame:
    """part, passed (the set of filters passed, as bits), rows and one count per label of what is left.

    ``ids`` has id, row, doc_id, part; ``label_ids`` names tables of a doc_id. Every set has a row for every part, zeros
    included.
    """
    letters = sorted(failing)
    kinds = ["rows", *sorted(label_ids)]
    followed = ids.withColumn("kind", F.lit(0))
    for k, name in enumerate(kinds[1:], 1):
        known = label_ids[name].select(F.col("doc_id").cast("long").alias("doc_id"))
        marked = ids.join(known, "doc_id", "left_semi").select(*ids.columns)
        followed = followed.union(marked.withColumn("kind", F.lit(k)))
    followed = materialize(followed.select(*KEY, "part", "kind"))
    sets = F.explode(F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1))).alias("passed")
    # dealt out by key before each id is listed for every set, as the joins want it
    left = followed.repartition(*KEY).select("*", sets)
    for i, letter in enumerate(letters):
        fails = failing[letter].toDF("f_id", "f_row")
        met = (F.col("id") == F.col("f_id")) & (F.col("row") == F.col("f_row"))
        left = left.join(fails, met & (F.col("passed").bitwiseAND(1 << i) != 0), "left_anti")
    sums = left.groupBy("part", "passed").agg(*(F.count_if(F.col("kind") == k).alias(name) for k, name in enumerate(kinds)))
    every = followed.groupBy("part").count().select("part", sets)
    return every.join(sums, ["part", "passed"], "left").select(
        "part", "passed", *(F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in kinds)
    )


def audit_orders(ids: DataFrame, failing: dict[str, DataFrame], label_ids: dict[str, DataFrame]) -> DataFrame:
    """Every order of the filters of ``failing``, a row for each part and step.

    ``ids`` has id, row, doc_id, part; ``failing`` the id and row of what fails each filter, which may repeat;
    ``label_ids`` the doc_ids of each label. Columns: part, filter_order, step (from 1), kept, removed, redundant (fails
    this filter and was removed before), unique_fails (fails this filter alone), <label>_lost (of those removed here,
    the rows with that label), shapley (rows that this filter removes, summed over all orders). No rows, no result.
    """
    letters = sorted(failing)
    if not 0 < len(letters) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters, not {len(letters)}")
    all_sets = (1 << len(letters)) - 1
    counts = materialize(survivors(ids, failing, label_ids))
    steps = []
    for order in itertools.permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            own = 1 << letters.index(letter)
            steps.append(("".join(order), step, own, before, before | own))
            before |= own
    # sets of filters that a step compares: before and after it, its own alone, all others, none, all
    c = F.col
    compared = {"b": c("before"), "a": c("after"), "o": c("own"), "r": all_sets - c("own"), "n": F.lit(0), "f": F.lit(all_sets)}
    out = ids.sparkSession.createDataFrame(steps, "filter_order string, step int, own int, before int, after int")
    for name, passed in compared.items():
        side = counts.select(c("part").alias("p"), c("passed").alias("s"), *(c(x).alias(f"{name}_{x}") for x in counts.columns[2:]))
        if name == "b":
            out = out.join(side, c("s") == passed).withColumnRenamed("p", "part").drop("s")
        else:
            out = out.join(side, (c("p") == c("part")) & (c("s") == passed)).drop("p", "s")
    removed = c("b_rows") - c("a_rows")
    return out.select(
        "part",
        "filter_order",
        "step",
        c("a_rows").alias("kept"),
        removed.alias("removed"),
        (c("n_rows") - c("o_rows") - removed).alias("redundant"),
        (c("r_rows") - c("f_rows")).alias("unique_fails"),
        *((c(f"b_{x}") - c(f"a_{x}")).alias(f"{x}_lost") for x in sorted(label_ids)),
        F.sum(removed).over(Window.partitionBy("part", "own")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The filters A to E of ``failing_ids`` over ``docs``, in all 120 orders, for every lang (null: empty string).

    good_lost counts rows whose doc_id has quality 1 in ``labels``, toxic_lost those with toxic 1; a doc_id labelled more
    than once counts if any label says so. Rows that repeat a doc_id count each. Other columns are ignored. Without
    documents there are no parts and no rows.
    """
    tables = failing_ids(docs)
    known = {"good": labels.where("quality = 1"), "toxic": labels.where("toxic = 1")}
    return audit_orders(tables.ids, tables.failing, known)
