"""Spelling variants against all pairs of words, and odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from massloom.llm import spelling
from massloom.llm.spelling import SpellingOptions, group_variants, near_pairs, spelling_variants

DOCS = "doc_id long, text string, word string, n long, run string, code int"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(counts, lead=2):
    forms, out = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        top = min(others, key=lambda x: (-counts[x], x), default=None)
        forms[w] = top if top is not None and counts[top] >= lead * n else None
        out[w] = len(others)
    rows = []
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, out[w], counts[forms[w]] if forms[w] else None))
    return sorted(rows, key=lambda r: r[0])


@pytest.mark.parametrize("symbols", [1, 2, 8, 26])
def test_all_pairs(spark, symbols):
    r = random.Random(symbols)
    words = {"".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7))) for _ in range(260)}
    words |= {"é" * 3000, "é" * 2999, "é" * 3001, "é" * 1500 + "a" + "é" * 1499, "\U0001f389abcd", "abcd\U0001f389", "abcd"}
    counts = {w: r.randrange(1, 60) for w in sorted(words)}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = group_variants(vocabulary, SpellingOptions(symbols=symbols)).collect()
    assert sorted(map(tuple, got)) == plain(counts)
    pairs = near_pairs(vocabulary, symbols)
    assert pairs.count() == sum(r[4] for r in plain(counts)) and pairs.columns == ["word", "n", "other", "other_n"]


def test_chain_of_forms_and_ties(spark):
    counts = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 32, "ccccc": 5, "ccccd": 10, "cccce": 10}
    got = group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert sorted(map(tuple, got)) == plain(counts)
    assert {r.word: r.root for r in got}["aaaaa"] == "bbbbb" and {r.word: r.form for r in got}["ccccc"] == "ccccd"


def words_plain(rows, slips, shortest=5, least=3):
    seen = Counter()
    for d, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if n >= least and len(w) >= shortest}


@pytest.mark.parametrize("slips", [None, 1, 3, 97])
def test_whole_texts(spark, slips):
    r = random.Random(7)
    words = ["".join(r.choice("abÉé÷x") for _ in range(r.randrange(3, 8))) for _ in range(60)]
    rows = [(d, " ".join(r.choices(words, k=40)) + r.choice(["", "1", "Straße", "ÀÉ"])) for d in range(30)]
    rows += [(30, None), (31, ""), (32, "abcdefgh " * 30000), (None, words[0] + ", " + words[1]), (5, "repeat " * 3), (5, "repeat " * 3), (33, "é" * 50000)]
    docs = spark.createDataFrame([(d, t, "w", 1, "r", 2) for d, t in rows], DOCS)
    got = spelling_variants(docs, slips=slips).collect()
    assert sorted(map(tuple, got)) == plain(words_plain(rows, slips))


def test_nothing(spark):
    assert spelling_variants(spark.createDataFrame([], DOCS), slips=97).count() == 0
    only = spark.createDataFrame([(1, None, "w", 1, "r", 2), (2, "a b c", "w", 1, "r", 2)], DOCS)
    assert spelling_variants(only).count() == 0


def test_each_pair_of_reduced_words_is_listed_once(spark):
    words = spark.createDataFrame([("aab",), ("ab",), ("aaab",), ("bab",), ("aa",)], "reduced string")
    codes = {r.reduced: r.code for r in spelling.with_codes(words).collect()}
    names = {c: w for w, c in codes.items()}
    listed = [frozenset((names[r.code], names[r.near])) for r in spelling.neighbourhoods(words, 2).collect() if r.near in names]
    assert len(listed) == len(set(listed))
    assert {x for x in listed if len(x) == 2} == {frozenset(p) for p in (("aab", "ab"), ("aab", "aaab"), ("aab", "bab"), ("ab", "aa"), ("aab", "aa"), ("bab", "ab"))}


def test_neighbourhoods_are_not_broadcast(spark):
    """Their size is estimated as that of the words they unfold from, so nothing of these joins goes through the driver."""
    vocabulary = spark.createDataFrame([("aaaaa", 1), ("aaaab", 3), ("bbbbb", 5)], "word string, n long")
    assert "Broadcast" not in near_pairs(vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in group_variants(vocabulary)._jdf.queryExecution().executedPlan().toString()
