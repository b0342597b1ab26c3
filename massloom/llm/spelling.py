"""Spelling variants: words one edit apart, found through a reduced alphabet.

Every letter stands for one of a few symbols, dealt out by how often the letter occurs. Two words one edit apart are
at most one edit apart when so reduced, so the whole one-edit neighbourhood of every reduced word, joined with the
reduced vocabulary, finds all of them; candidates are then compared as written. Of a pair of reduced words the pair is
generated on one side only, so each is met once. Reduced words travel as 64-bit sums that an edit changes in one step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.text import mix
from massloom.sources.stages import materialize

LETTER = "[a-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
SLICE = 1 << 18


@dataclass(frozen=True)
class SpellingOptions:
    """Words of at least ``shortest`` code points seen ``least`` times; a form is seen ``lead`` times as often as the word.

    ``symbols`` letters of the reduced alphabet: more make more neighbours, fewer make more candidates; results are the same.
    """

    shortest: int = 5
    least: int = 3
    lead: int = 2
    symbols: int = 8


def runs(text: Column, shortest: int = 1) -> Column:
    """Maximal runs of letters a-z (A-Z lower-cased) and 00C0-00FF of at least ``shortest`` code points, as an array."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"{LETTER}{{{shortest},}}"), F.lit(0))


def slip_sum(doc_id: Column, run: Column) -> Column:
    """crc32 of ``<doc_id>:<run>``; a null doc_id counts as an empty one."""
    return F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))


def count_words(docs: DataFrame, opts: SpellingOptions = SpellingOptions(), slips: int | None = None) -> DataFrame:
    """word, n: the words of all whole texts with at least ``opts.least`` occurrences.

    Where ``slips`` divides the ``slip_sum`` of a run, the code point at that sum modulo the run's length is missing, as
    a made typing error. Null texts have no words, rows that repeat a doc_id count each.
    """
    run = F.col("run")
    each = docs.select("doc_id", F.explode(runs(F.col("text"), opts.shortest)).alias("run"))
    if slips:
        h = slip_sum(F.col("doc_id"), run)
        # the sum of longer runs is computed once, below
        each = each.where((F.length(run) > opts.shortest) | (h % slips != 0))
        at = (h % F.length(run)).cast("int")
        cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
        run = F.when(h % slips == 0, cut).otherwise(run)
    return each.select(run.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= opts.least)


def reduced(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """``vocabulary`` with ``reduced``: its letters by frequency, dealt out to the symbols forth and back."""
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter"))
    ranked = [r["letter"] for r in letters.groupBy("letter").count().orderBy(F.desc("count"), "letter").collect()]  # an alphabet
    there_and_back = [*range(symbols), *reversed(range(symbols))]
    stands = "".join(chr(ord("a") + there_and_back[i % len(there_and_back)]) for i in range(len(ranked)))
    return vocabulary.withColumn("reduced", F.translate("word", "".join(ranked), stands))


def _power(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _by_length(words: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words of one length and their symbols as a matrix, at most about ``most`` cells at a time."""
    sizes = words.cast(pa.binary()).to_numpy(zero_copy_only=False)
    lengths = np.fromiter(map(len, sizes), np.int64, len(sizes))
    for size in np.unique(lengths):
        own = np.flatnonzero(lengths == size)
        step = max(1, most // max(int(size), 1))
        for i in range(0, len(own), step):
            some = own[i : i + step]
            cells = np.frombuffer(b"".join(sizes[some]), np.uint8).reshape(len(some), size)
            yield some, cells.astype(np.uint64) - np.uint64(ord("a"))


def _terms(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base, running sums before each letter (one more column than letters), and the sum of each word."""
    powers = _power(_BASE, cells.shape[1] + 1)
    before = np.zeros((len(cells), cells.shape[1] + 1), np.uint64)
    np.cumsum((cells + np.uint64(1)) * powers[:-1], axis=1, out=before[:, 1:])
    return powers, before, before[:, -1]


def _codes(words: pa.Array) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for some, cells in _by_length(words, SLICE):
        out[some] = _terms(cells)[2]
    return mix(out).view(np.int64)


def with_codes(words: DataFrame) -> DataFrame:
    """``reduced`` as a 64-bit ``code``."""

    @F.arrow_udf("long")
    def code(column: pa.Array) -> pa.Array:
        return pa.array(_codes(column))

    return words.withColumn("code", code("reduced"))


def neighbourhoods(words: DataFrame, symbols: int) -> DataFrame:
    """code, near: each reduced word (``reduced``, distinct) itself, without one letter, and with one letter replaced.

    A replacement is listed at the word of the larger code only. Words with one letter more list this word themselves.
    """

    def told(own: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(near)], names=["code", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = np.arange(symbols, dtype=np.uint64)
        for batch in batches:
            for _, cells in _by_length(batch.column(0), SLICE):
                powers, before, total = _terms(cells)
                code = mix(total).view(np.int64)
                yield told(code, code)
                step = max(1, SLICE // len(cells))
                for i in range(0, cells.shape[1], step):
                    here = cells[:, i : i + step]
                    rest = total[:, None] - before[:, i + 1 : i + 1 + here.shape[1]]
                    gone = mix(before[:, i : i + here.shape[1]] + rest * np.uint64(_UNBASE)).view(np.int64)
                    # within a run of one symbol it does not matter which letter goes
                    first = np.ones(here.shape, bool)
                    first[:, 1:] = here[:, 1:] != here[:, :-1]
                    if i:
                        first[:, 0] = here[:, 0] != cells[:, i - 1]
                    row, at = np.nonzero(first)
                    yield told(code[row], gone[row, at])
                    swapped = total[:, None, None] + (other[None, None, :] - here[:, :, None]) * powers[None, i : i + here.shape[1], None]
                    swapped = mix(swapped).view(np.int64)
                    row, at, symbol = np.nonzero(swapped < code[:, None, None])
                    yield told(code[row], swapped[row, at, symbol])

    return words.select("reduced").mapInArrow(run, "code long, near long")


def near_pairs(vocabulary: DataFrame, symbols: int = 8) -> DataFrame:
    """word, n, other, other_n for every two different words of ``vocabulary`` (word, n; distinct) one edit apart, both ways.

    An edit inserts, deletes or replaces one code point.
    """
    coded = materialize(with_codes(reduced(vocabulary.select("word", "n"), symbols)))
    near = neighbourhoods(coded.select("reduced").distinct(), symbols)
    left, right = (coded.select(F.col("code").alias(f"{x}_code"), F.struct("word", "n").alias(x)) for x in "ab")
    # sort-merge, because size estimates take neighbourhoods for as small as the words they unfold from
    met = near.hint("merge").join(right.hint("merge"), F.col("near") == F.col("b_code"))
    met = met.hint("merge").join(left.hint("merge"), F.col("code") == F.col("a_code"))
    a, b = F.col("a.word"), F.col("b.word")
    met = met.where((F.col("code") != F.col("near")) | (a < b))
    apart = met.where(F.abs(F.length(a) - F.length(b)) <= 1).where(F.levenshtein(a, b, 1) == 1)
    sides = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    both = apart.select(sides.alias("p")).select(
        F.col("p.x.word").alias("word"), F.col("p.x.n").alias("n"), F.col("p.y.word").alias("other"), F.col("p.y.n").alias("other_n")
    )
    return both.distinct()  # equal sums of different reduced words could list a pair again


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word of ``forms`` (word, form) along the forms to the last.

    Every round doubles the way gone. A form is more frequent than its word by a factor, so ways are short.
    """
    ways = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        stepped = ways.hint("merge").join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        stepped = materialize(stepped)
        ways = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return ways


def group_variants(vocabulary: DataFrame, opts: SpellingOptions = SpellingOptions()) -> DataFrame:
    """One row per word of ``vocabulary`` (word, n): word, form, root, n, n_near, form_n.

    n_near: words one edit apart. form: the most frequent of them (ties: the first in code-point order) if it is seen
    ``opts.lead`` times as often, else null. root: the last on the way along forms, the word itself without a form.
    """
    vocabulary = materialize(vocabulary.select("word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"), F.col("other_n").alias("n")))
    found = near_pairs(vocabulary, opts.symbols).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    judged = vocabulary.hint("merge").join(found.hint("merge"), "word", "left")
    enough = F.col("best.n") >= opts.lead * F.col("n")
    judged = materialize(
        judged.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.word")).alias("form"),
            F.when(enough, F.col("best.n")).alias("form_n"),
        )
    )
    ends = roots(judged.where("form is not null").select("word", "form"))
    out = judged.hint("merge").join(ends.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, opts: SpellingOptions = SpellingOptions(), slips: int | None = None) -> DataFrame:
    """``group_variants`` over the words of all whole texts of ``docs`` (doc_id, text).

    Null and empty texts have no words; very long words are words like others; rows that repeat a doc_id count each;
    other columns are ignored. Documents without words give no rows.
    """
    return group_variants(count_words(docs, opts, slips), opts)
