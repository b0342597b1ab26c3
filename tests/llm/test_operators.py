"""Small cases of each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from check_oracle import compare, connect

from massloom.llm import chat, leaks, queries
from massloom.llm.minhash import NearOptions, near_duplicates
from massloom.llm.quality import RATIOS, judge_quality, learn_rules, text_statistics
from massloom.llm.sharding import shard_rows
from massloom.llm.toxicity import ToxicOptions, find_voters, score_toxicity, without_toxic
from massloom.llm.urls import UrlRule, judge_urls

DOCS = "doc_id long, text string, rep string, n long, key string, bands int"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "r", 1, "k", 2) for d, t in rows], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    assert compare(spark, connect(sf), name, sf).startswith("ok")


def near_plain(rows, percent):
    sets = []
    for _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * len(sets[i] | sets[j]) and both:
                a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                root[b] = a
    return sorted((d, len(s), None if d is None else rows[find(i)][0], d is None or rows[find(i)][0] == d) for i, ((d, _), s) in enumerate(zip(rows, sets)) if d is not None)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    r = random.Random(percent)
    base = [[r.choice("abcdefghijklmnop") * r.randrange(1, 5) for _ in range(60)] for _ in range(3)]
    rows = [(0, None), (1, ""), (2, " \t "), (3, "A b"), (4, "a B"), (5, "a"), (6, "x " * 20000), (7, "x " * 20000)]
    for d in range(8, 90):
        words = list(r.choice(base))
        for _ in range(r.randrange(4)):
            words[r.randrange(60)] = f"new{r.randrange(50)}"
        rows.append((d, " ".join(words)))
    got = near_duplicates(table(spark, [*rows, (None, "a b")]), NearOptions(percent=percent)).collect()
    assert sorted(map(tuple, (g for g in got if g.doc_id is not None))) == near_plain(rows, percent)
    assert [tuple(g) for g in got if g.doc_id is None] == [(None, 1, None, True)]
    assert near_duplicates(table(spark, [])).count() == 0


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    for t in (said, "<|", "<\\|", "<\\\\|x", "a<b|c", "", "\n\n", "é<|🎉|>"):
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", said), (1, 1, "assistant", said), (1, 2, None, None), (None, 0, "assistant", "é🎉 x")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, mask string")
    out = {r.conv_id: r for r in chat.format_conversations(turns, P.path("byte_bpe_50k.json")).collect()}
    one = out[1]
    assert chat.parse(one.formatted) == [("user", "hi"), ("assistant", said), ("assistant", said), ("", "")]
    assert chat.masked_texts(one.formatted, one.starts, one.ends, one.mask) == [said, said]
    assert chat.masked_texts(out[None].formatted, out[None].starts, out[None].ends, out[None].mask) == ["é🎉 x"]
    assert chat.format_conversations(turns.limit(0), P.path("byte_bpe_50k.json")).count() == 0
    assert chat.loss_mask(np.zeros((0, 2), int), [(0, 3)]).tolist() == []


def test_quality(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in judge_quality(docs, labels).collect()}
    for d in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        seen, twice = set(), set()
        for w in windows:
            (twice if w in seen else seen).add(w)
        held = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 8)}
        lines = [x for x in d.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = rows[d.doc_id]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", d.text)), len(lines) - len(set(lines)), len(held))
        assert tuple(got)[1:6] == want
        assert got.base_failed == (len(words) < 20 or 100 * len(held) > 30 * len(words))
        assert not (got.base_failed and got.kept)
    odd = table(spark, [(1, None), (1, ""), (None, " \n ")])
    got = judge_quality(odd, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(got) == 3 and all(r.base_failed and not r.kept and r.n_words == 0 for r in got)
    assert judge_quality(table(spark, []), labels).count() == 0


def test_learned_rules_reject_the_bad(spark):
    rows = [(i, ("# " * (i % 7 + 3) if i % 3 == 0 else "") + "plain words here " * 10) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int")
    rules = learn_rules(text_statistics(table(spark, rows)), labels).rules
    assert rules and rules[0].good == 0 and sum(r.bad for r in rules) == 100


def test_rules_have_no_limit_to_their_number(spark):
    """Twelve kinds of junk need twelve rules; rules cover what a plain loop over them covers, in their order."""
    r = random.Random(8)
    rows, marks = [], []
    for i in range(9000):
        values = {c: 0.4 + 0.2 * r.random() for c in RATIOS}
        kind = i % 30
        if kind < 12:
            values[RATIOS[kind % len(RATIOS)]] = 0.9 if kind < len(RATIOS) else 0.1
        rows.append((i, *(values[c] for c in RATIOS)))
        marks.append((i, int(kind >= 12)))
    stats = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} double" for c in RATIOS))
    found = learn_rules(stats, spark.createDataFrame(marks, "doc_id long, quality int"))
    assert len(found.rules) == 12 and sum(x.bad for x in found.rules) == 3600 and not any(x.good for x in found.rules)
    got = {g.doc_id: g.rule for g in stats.select("doc_id", found.rule().alias("rule")).collect()}
    left = {d: dict(zip(RATIOS, v)) for d, *v in rows}
    good = dict(marks)
    for n, rule in enumerate(found.rules, 1):
        hit = {d for d, v in left.items() if all((v[c.feature] > c.threshold) == c.above for c in rule.conditions)}
        assert hit == {d for d, k in got.items() if k == n}
        assert (rule.good, rule.bad) == (sum(good[d] for d in hit), sum(1 - good[d] for d in hit))
        left = {d: v for d, v in left.items() if d not in hit}
    assert all(got[d] is None and good[d] for d in left)


def test_a_rule_that_fails_pruning_does_not_end_the_list(spark):
    """The condition with the most to gain holds only where rules are grown; the next best one holds everywhere."""
    ids = spark.range(6000).selectExpr("id as doc_id", "pmod(xxhash64(id), 3) = 0 as held").collect()
    rows, marks = [], []
    for d, held in ids:
        first, second = d % 4 == 0, d % 4 == 1 and d % 8 == 1
        values = dict.fromkeys(RATIOS, 0.5)
        if first or (held and d % 4 == 2):
            values["bang_share"] = 0.9
        if second:
            values["digit_share"] = 0.9
        bad = (first and not held) or second
        rows.append((d, *(values[c] for c in RATIOS)))
        marks.append((d, int(not bad)))
    stats = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} double" for c in RATIOS))
    rules = learn_rules(stats, spark.createDataFrame(marks, "doc_id long, quality int")).rules
    assert [[c.feature for c in x.conditions] for x in rules] == [["digit_share"]] and rules[0].bad == 750


def test_a_step_counts_the_smaller_side(spark, monkeypatch):
    """Twelve rules do not read all texts twelve times: each step unfolds what it covers or leaves out, if fewer."""
    rows, marks = [], []
    for i in range(6000):
        values = dict.fromkeys(RATIOS, 0.5)
        if i % 40 < 12:
            values[RATIOS[i % 40 % len(RATIOS)]] = 0.9 if i % 40 < len(RATIOS) else 0.1
        rows.append((i, *(values[c] for c in RATIOS)))
        marks.append((i, int(i % 40 >= 12)))
    stats = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} double" for c in RATIOS))
    kind, unfolded = type(stats), []
    plain = kind.groupBy

    def counted(self, *by):
        if by == ("x.f", "x.b"):
            unfolded.append(self.count())
        return plain(self, *by)

    monkeypatch.setattr(kind, "groupBy", counted)
    found = learn_rules(stats, spark.createDataFrame(marks, "doc_id long, quality int"))
    assert len(found.rules) == 12 and sum(x.bad for x in found.rules) == 1800 and not any(x.good for x in found.rules)
    assert sum(unfolded) <= 2 * len(RATIOS) * 6000


def test_quality_of_odd_rows(spark):
    """Labels given twice, null or of other values, columns of clashing names, very long texts, repeated rows."""
    text = "some plain words here . " * 3 + " ".join(f"w{i}" for i in range(60))
    rows = [(i, text + (" # #" * 30 if i % 4 == 0 else "")) for i in range(200)]
    long = " ".join(f"v{i}" for i in range(300_000))
    rows += [(0, rows[0][1]), (900, long), (901, "# " * 200_000), (902, None)]
    marks = [(i, int(i % 4 != 0), "x", 1) for i in range(200)] + [(1, 1, "x", 2), (None, 0, "y", 1), (2, None, "y", 1), (3, 7, "y", 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, text string, bad int")
    got = judge_quality(table(spark, rows), labels).collect()
    assert len(got) == len(rows)
    verdict = {(g.doc_id, g.n_words, g.kept, g.base_failed) for g in got}
    assert {(d, k) for d, _, k, _ in verdict if d < 900} == {(i, i % 4 != 0) for i in range(200)}
    assert {v for v in verdict if v[0] >= 900} == {(900, 300_000, True, False), (901, 200_000, False, True), (902, 0, False, True)}


def test_sharding(spark):
    rows = [(i, "x" * (i % 5)) for i in range(2000)] + [(7, None)] * 500 + [(None, "é")]
    eight = shard_rows(table(spark, rows), 8).collect()
    assert len(eight) == len(rows)
    slots = {}
    for r in eight:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert len({r.shard for r in eight if r.doc_id == 7}) == 1
    one = next(r for r in eight if r.doc_id is None)
    assert (one.size, one.text_crc32) == (3, zlib.crc32("é".encode()))
    moved = sum(r.grown_shard == 8 for r in eight if r.doc_id != 7) / 2000
    assert 0.07 < moved < 0.16
    nine = {r.doc_id: r.shard for r in shard_rows(table(spark, rows), 9).collect()}
    assert all(nine[r.doc_id] == r.grown_shard for r in eight)
    assert shard_rows(table(spark, []), 8).count() == 0


def jumped(key, shards):
    """Shard of a key by a plain loop that draws from the same hash."""
    at, shard = 0, 0
    while at < shards:
        shard, h = at, 42
        for part in (key, at):
            if part is not None:  # a null leaves the hash as it is
                h = xxhash.xxh64(part.to_bytes(8, "little", signed=True), seed=h).intdigest()
        at = int(min((at + 1) * 2.0**53 / ((h >> 11) + 1), 2.0**40))
    return shard


def test_shards_are_those_of_a_plain_loop(spark):
    keys = [*range(-50, 3000), 2**40, -(2**63), 2**63 - 1, None]
    rows = table(spark, [(k, "x") for k in keys])
    for shards in (1, 2, 8, 100):
        got = {r.doc_id: (r.shard, r.grown_shard) for r in shard_rows(rows, shards).collect()}
        assert got == {k: (jumped(k, shards), jumped(k, shards + 1)) for k in keys}


def test_urls(spark):
    rules = [UrlRule("org", "/", "allow"), UrlRule("a.org", "/x/*z", "block"), UrlRule("", "/bad/", "block"), UrlRule("com", "", "block")]
    urls = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme": ("", "", None, "allow"),
        "http://A.org/x/yyz1": ("a.org", "/x/yyz1", "a.org/x/*z", "block"), "h://b.a.org/x/y?z": ("b.a.org", "/x/y", "org/", "allow"),
        "h://xa.org": ("xa.org", "", None, "allow"), "h://z.net/bad/1": ("z.net", "/bad/1", "/bad/", "block"),
        "h://q.com#f": ("q.com", "", "com", "block"), "h://qcom/": ("qcom", "/", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string, token string")
    got = judge_urls(pages, rules).collect()
    assert len(got) == 2 * len(urls)
    want = dict(enumerate(urls.values()))
    assert all(tuple(r)[1:] == want[r.page_id] for r in got)
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, [], default="block").collect()} == {"block"}


def test_toxicity(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    r = random.Random(1)
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(r.choices(words, k=30)) + (" vile scummy" if i % 4 == 0 else "")) for i in range(600)]
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    odd = [(1000, None), (1000, ""), (None, "vile scummy")]
    got = score_toxicity(table(spark, rows + odd), marks).collect()
    assert len(got) == 603 and all(0 <= g.score <= 1 for g in got)
    assert all(g.predicted == (g.doc_id % 4 == 0) for g in got if g.doc_id is not None and g.doc_id < 600)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got if g.doc_id is not None)
    left = without_toxic(table(spark, rows + odd), marks)
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")] and left.count() == 450 + 2
    assert score_toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert score_toxicity(table(spark, []), marks).count() == 0


def test_toxicity_of_many_rare_words(spark):
    """200 insults, one to a text, none in 1 % of the toxic ones, and beginnings whose words are rarer still."""
    r = random.Random(2)
    words = [f"word{i}" for i in range(200)]
    insults = ["".join(r.choices("abcdefghijk", k=8)) for _ in range(200)]
    rows = [(i, " ".join(r.choices(words, k=20)) + (" " + insults[i // 5 % 200] if i % 5 == 0 else "")) for i in range(12_000)]
    rows += [(20_000 + i, " ".join(r.choices(words, k=20)) + f" zzyx{r.random()}") for i in range(60)]
    marks = [(d, int(d % 5 == 0 or d >= 20_000)) for d, _ in rows]
    got = score_toxicity(table(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    true = dict(marks)
    missed = [g.doc_id for g in got if g.predicted == 0 and true[g.doc_id] and g.held_out]
    assert not missed and not [g for g in got if g.predicted and not true[g.doc_id] and g.held_out]


def test_copies_make_no_voters(spark):
    """Words of one toxic text, copied with another ending each time, tell nothing, but for the three before it."""
    r = random.Random(3)
    words, odd = [f"word{i}" for i in range(200)], " ".join(f"odd{c}" for c in "abcdefghijklm")
    rows = [(i, " ".join(r.choices(words, k=20)) + (" vile" if i % 10 == 0 else "")) for i in range(1000)]
    rows += [(2000 + i, f"{odd} end{i}") for i in range(40)]
    marks = spark.createDataFrame([(d, int(d % 10 == 0 or d >= 2000)) for d, _ in rows], "doc_id long, toxic int")
    voters = find_voters(table(spark, rows), marks, ToxicOptions())
    assert "vile" in voters.words and set(voters.words) <= {"vile", "oddk", "oddl", "oddm"}
    assert not [b for b in voters.beginnings if b.startswith("odd")]


def edits(item, text):
    """Fewest edits between ``item`` and any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_against_all_places(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("theandionré") for _ in range(r.randrange(2, 8)))
    items = [" ".join(word() for _ in range(r.randrange(3, 30))) for _ in range(8)] + ["short", "", None, "x" * 40]
    texts = [None, "", "Short", "x" * 2000]
    for _ in range(60):
        t = list(r.choice(items[:8]))
        for _ in range(r.randrange(int(len(t) * 0.16) + 2)):
            i = r.randrange(len(t))
            t[i : i + r.randrange(2)] = r.choice(["", "q", "zz"])
        texts.append(" ".join(word() for _ in range(10)) + "\n" + "".join(t).upper() + "  " + " ".join(word() for _ in range(10)))
    fold = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", (t or "").lower())
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            codes = fold(item).strip()
            if len(codes) >= 8 and edits(codes, fold(t)) <= len(codes) // 10:
                want.add((d, i))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = table(spark, list(enumerate(texts)))
    found = leaks.find_leaks(docs, bench)
    assert {(g.doc_id, g.item_id) for g in found.collect()} == want and len(want) > 20
    assert {g.doc_id for g in leaks.without_leaks(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert leaks.find_leaks(table(spark, []), bench).count() == 0 == leaks.find_leaks(docs, bench.limit(0)).count()
    held = leaks.Items([i or "" for i in items], leaks.LeakOptions())
    assert not list(held.matches(pa.array([None, ""])))
    twice = leaks.find_leaks(docs.union(docs), bench)  # rows that repeat a doc_id are reported each
    assert twice.count() == 2 * found.count()


def test_short_items_have_their_edits(spark):
    """Every item of 8 to 60 characters is found with a tenth of its characters replaced, left out or put in."""
    r = random.Random(5)
    items = ["".join(r.choices("abcdefghijklmnop", k=m)) for m in range(8, 61) for _ in range(3)]
    texts, want = [], set()
    for i, item in enumerate(items):
        k = len(item) // 10
        for more in (0, 1):
            t = list(item)
            # spread evenly, as this leaves the shortest untouched stretches
            for n in range(k + more):
                at = (n + 1) * len(item) // (k + more + 1)
                t[at] = r.choice(["", "#", "#" + t[at]])
            texts.append("0123456789" * 30 + "".join(t) + "9876543210")
    low = [t[300:-10] for t in texts]
    for d, t in enumerate(low):
        for i, item in enumerate(items):
            if abs(len(item) - len(t)) <= 20 and edits(item, t) <= len(item) // 10:
                want.add((d, i))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = leaks.find_leaks(table(spark, list(enumerate(texts))), bench).collect()
    assert {(f.doc_id, f.item_id) for f in found} == want
    assert {(2 * i, i) for i in range(len(items))} <= want


def test_repetitive_texts_are_counted_in_slices(monkeypatch):
    """Equal q-grams everywhere are counted a slice at a time, with the same result as at once."""
    r = random.Random(6)
    items = ["-" * 300, "ab" * 60, "".join(r.choices("abcd", k=50)), "-" * 12 + "x" + "-" * 12]
    texts = ["-" * 5000, "ab" * 900 + "-" * 290, items[2] * 3 + "--x--", None, "", "-" * 311 + "x" + "-" * 40]
    at_once = list(leaks.Items(items, leaks.LeakOptions()).matches(pa.array(texts)))
    monkeypatch.setattr(leaks, "_SLICE", 500)
    held = leaks.Items(items, leaks.LeakOptions())
    assert list(held.matches(pa.array(texts))) == at_once
    assert {(d, i) for d, i, *_ in at_once} == {(0, 0), (0, 3), (1, 0), (1, 1), (1, 3), (2, 2), (5, 0), (5, 3)}
    place, found = held.grams[-1].shared(np.full(5000, 45, np.uint32))
    sizes = [len(w) for w, _, _ in held.grams[-1].slices(place, found)]
    assert max(sizes) <= 600 and sum(sizes) > 1_000_000


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf)
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count(), name
    out = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in kept.collect())
