"""Quality verdicts by a learned decision list, in DataFrame functions only.

Sequential covering: a rule is grown from threshold conditions over text statistics, one at a time, on two thirds of
the labelled texts, and pruned on the rest; texts it covers leave, and the next rule is grown on what remains. A rule
that does not hold on the rest is dropped, and another first condition is tried; the list ends when none is left, so
the number of rules and of their conditions follows from the labels. The list is applied as one ordered conditional
expression. Counting is Spark's; the driver sees one small table of counts per feature, bin and label for each step. A
step counts the texts a condition covers or those it leaves out, whichever are fewer; the others' counts are the rest.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.sources.stages import materialize

SEPARATOR = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class RuleOptions:
    """``precision`` is what a rule must reach on the texts it is pruned on; rarer rules than ``least`` are not made."""

    bins: int = 32
    precision: float = 0.95
    least: int = 20


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    good: int = 0  # covered texts of either label, in all labelled texts left to it
    bad: int = 0

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & F.coalesce(c.column(), F.lit(False))
        return out


@dataclass(frozen=True)
class _Step:
    """A condition and what a rule covers with it: bad and good texts it is grown on, and those it is pruned on."""

    gain: float
    condition: Condition
    bad: int
    good: int
    held_bad: int
    held_good: int

    @property
    def covered(self) -> int:
        return self.bad + self.good + self.held_bad + self.held_good

    @property
    def share(self) -> float:
        return (self.held_bad + 1) / (self.held_bad + self.held_good + 2)


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each rejecting what it covers; what none covers is kept."""

    rules: tuple[Rule, ...] = field(default=())

    def rule(self) -> Column:
        """Number of the first rule that covers a text, from 1; null if none does."""
        out = F.lit(None).cast("int")
        for i, r in reversed(list(enumerate(self.rules, 1))):
            out = F.when(r.column(), F.lit(i)).otherwise(out)
        return out


BASE = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "digit_share", "stop_share"]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _covered(words: Column) -> Column:
    """Words inside windows of eight that occur twice or more in the text."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - 7), lambda i: F.xxhash64(F.slice(words, i, 8)))

    def where_repeated(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        n = F.size(hashes)

        def with_equals(at: Column) -> Column:
            same = lambda k, x: F.get(at, k)["h"] == x["h"]
            again = F.filter(
                at, lambda x, k: ((k > 0) & same(F.greatest(k - 1, F.lit(0)), x)) | ((k < n - 1) & same(F.least(k + 1, n - 1), x))
            )
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def total(starts: Column) -> Column:
            first = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-8).alias("last"))
            step = lambda acc, i: F.struct(
                (acc["sum"] + F.least(F.lit(8), i - acc["last"])).alias("sum"), i.alias("last")
            )
            return F.aggregate(starts, first, step, lambda acc: acc["sum"])

        return _let(_let(placed, with_equals), total)

    none = F.lit(0).cast("long")
    found = _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), where_repeated(h)).otherwise(none))
    return F.when(F.size(words) >= 9, found).otherwise(none)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the ratios rules are made of; null and empty texts have zeros everywhere."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SEPARATOR), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    # an outer generator keeps the arrays from being computed again in every expression over them
    cut = docs.select(F.col("doc_id"), text.alias("text"), F.explode_outer(F.array(F.struct(words.alias("w"), lines.alias("l")))).alias("x"))
    cut = cut.select("doc_id", "text", F.col("x.w").alias("w"), F.col("x.l").alias("l"))
    counted = cut.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SEPARATOR, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size("l").cast("long").alias("n_lines"),
        _covered(F.col("w")).alias("n_repeat_words"),
        F.regexp_count("text", F.lit(r"\p{Lu}{2,}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("[!?]{2,}")).cast("long").alias("n_bang"),
        F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("n_digits"),
        F.regexp_count("text", F.lit(r"\.")).cast("long").alias("n_stops"),
    )
    return counted.select(
        "doc_id",
        "n_words",
        *BASE,
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word"),
        _ratio(F.col("n_symbols"), F.col("word_chars")).alias("symbol_share"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        _ratio(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_share"),
        _ratio(F.col("n_upper"), F.col("n_words")).alias("upper_share"),
        _ratio(F.col("n_bang"), F.col("n_words")).alias("bang_share"),
        _ratio(F.col("n_digits"), F.col("n_words")).alias("digit_share"),
        _ratio(F.col("n_stops"), F.col("n_words")).alias("stop_share"),
    )


def _entropy_gain(bad: int, good: int, bad0: int, good0: int) -> float:
    """How much better a refined rule tells bad from good, for each bad text it keeps."""
    if not bad:
        return -math.inf
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def learn_rules(stats: DataFrame, labels: DataFrame, opts: RuleOptions = RuleOptions()) -> DecisionList:
    """A decision list that rejects texts like those labelled ``quality`` 0.

    All labelled texts are used. Without labels, or with one kind only, the list is empty. A doc_id labelled more than
    once counts as bad if any label says so; labels of 0 and 1 only count. Of equally good conditions the first feature
    in the order of ``RATIOS`` is taken, and of its cuts the middle one.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    names = RATIOS
    data = stats.join(known, "doc_id").select("doc_id", "bad", *[F.col(c).cast("double").alias(c) for c in names])
    data = materialize(data)
    cuts = {}
    probs = [i / opts.bins for i in range(1, opts.bins)]
    # cuts from both kinds of text, so that what only bad texts have is cut finely as well
    for kind in (True, False):
        row = data.where(F.col("bad") == kind).agg(*[F.percentile_approx(c, probs, 2000).alias(c) for c in names]).first()
        for c in names:
            cuts.setdefault(c, set()).update(row[c] or [])
    # and the middles between them, so that a cut can stand clear of both kinds
    cuts = {c: sorted(v | {(a + b) / 2 for a, b in itertools.pairwise(sorted(v))}) for c, v in cuts.items()}

    def place(c: str) -> Column:
        points = F.array(*[F.lit(x) for x in cuts[c]]) if cuts[c] else F.array().cast("array<double>")
        return F.size(F.filter(points, lambda t: t < F.col(c))).cast("short")

    # bin b of a feature: the value is above b of its cuts
    binned = materialize(
        data.select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"), *[place(c).alias(c) for c in names])
    )

    def within(c: Condition) -> Column:
        at = cuts[c.feature].index(c.threshold)
        return F.col(c.feature) > at if c.above else F.col(c.feature) <= at

    def covers(conditions) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & within(c)
        return out

    def histogram(rows: DataFrame) -> dict[str, dict[int, tuple[int, ...]]]:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("b")) for c in names]))
        of = [F.col("bad") & ~F.col("held"), ~F.col("bad") & ~F.col("held"), F.col("bad") & F.col("held"), ~F.col("bad") & F.col("held")]
        counts = rows.select("bad", "held", pairs.alias("x")).groupBy("x.f", "x.b").agg(
            *[F.count_if(kind).alias(f"n{i}") for i, kind in enumerate(of)]
        )
        out: dict[str, dict[int, tuple[int, ...]]] = {c: {} for c in names}
        for r in counts.collect():  # features x bins rows
            out[r["f"]][r["b"]] = (r["n0"], r["n1"], r["n2"], r["n3"])
        return out

    def minus(seen: dict[str, dict[int, tuple[int, ...]]], part: dict[str, dict[int, tuple[int, ...]]]) -> dict[str, dict[int, tuple[int, ...]]]:
        none = (0, 0, 0, 0)
        return {c: {b: tuple(n - m for n, m in zip(x, part[c].get(b, none))) for b, x in bins.items()} for c, bins in seen.items()}

    def refined(rows: DataFrame, seen: dict[str, dict[int, tuple[int, ...]]], step: _Step) -> dict[str, dict[int, tuple[int, ...]]]:
        """The histogram of those of ``rows``, whose own is ``seen``, that a step's condition covers."""
        every = sum(sum(x) for x in seen[step.condition.feature].values())
        if 2 * step.covered <= every:
            return histogram(rows.where(within(step.condition)))
        return minus(seen, histogram(rows.where(~within(step.condition))))

    def best_step(seen: dict[str, dict[int, tuple[int, ...]]], without: set[tuple[str, bool]]) -> _Step | None:
        best = None
        equal: dict[tuple[str, bool], list[_Step]] = {}
        for c, bins in seen.items():
            every = [sum(x[i] for x in bins.values()) for i in range(4)]
            if not every[0] or not every[1]:
                continue
            low = [0] * 4
            for at, threshold in enumerate(cuts[c]):
                low = [n + m for n, m in zip(low, bins.get(at, (0, 0, 0, 0)))]
                for above, counts in ((True, [n - m for n, m in zip(every, low)]), (False, low)):
                    if counts[0] < opts.least or (c, above) in without:
                        continue
                    gain = _entropy_gain(counts[0], counts[1], every[0], every[1])
                    tied = equal.setdefault((c, above), [])
                    if tied and gain > tied[0].gain + 1e-9:
                        tied.clear()
                    if not tied or gain >= tied[0].gain - 1e-9:
                        tied.append(_Step(gain, Condition(c, above, threshold), *counts))
        for tied in equal.values():
            if tied[0].gain > (best.gain if best else 0.0) + 1e-9:
                best = tied[len(tied) // 2]
        return best

    rules: list[Rule] = []
    left = binned
    seen, failed = histogram(left), set()
    while True:
        grown: list[_Step] = []
        inside = [seen]  # of the rule's beginnings, from that without a condition
        rows = left
        step = best_step(seen, failed)
        while step is not None:
            grown.append(step)
            # with no more bad texts than that among the held ones, no longer rule can reach the precision
            if not step.good or (step.held_bad + 1) / (step.held_bad + 2) < opts.precision:
                break
            inside.append(refined(rows, inside[-1], step))
            rows = rows.where(within(step.condition))
            step = best_step(inside[-1], set())
        if not grown:
            return DecisionList(tuple(rules))
        # pruning: of the rule and its beginnings, the one with the best record on the held texts
        last = max(grown, key=lambda s: s.share)
        if last.share < opts.precision:
            failed.add((grown[0].condition.feature, grown[0].condition.above))
            continue
        kept = tuple(s.condition for s in grown[: grown.index(last) + 1])
        rules.append(Rule(kept, last.good + last.held_good, last.bad + last.held_bad))
        if len(kept) == len(inside):
            inside.append(refined(left.where(covers(kept[:-1])), inside[-1], last))
        seen, failed = minus(seen, inside[len(kept)]), set()
        left = left.where(~covers(kept))


def judge_quality(docs: DataFrame, labels: DataFrame, opts: RuleOptions = RuleOptions()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, the base counts, base_failed, kept, rule.

    A text fails the base with fewer than 20 words or when repeated 8-word windows hold over 30 % of its words; so
    null, empty and blank texts fail. ``rule`` is the rule of the list that rejects a text, null if none does. Rows
    that repeat a doc_id are judged each; other columns are ignored.
    """
    stats = materialize(text_statistics(docs.select("doc_id", "text")))
    rules = learn_rules(stats, labels.select("doc_id", "quality"), opts)
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return stats.withColumn("base_failed", failed).withColumn("rule", rules.rule()).select(
        "doc_id", "n_words", *BASE, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule"
    )
