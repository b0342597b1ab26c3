"""Language labels: Viterbi in blocks against a plain loop, mixed scripts, held-out accuracy, odd rows."""

import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest

from massloom.llm import language as lid
from massloom.llm.text import text_buffers

DOCS = "doc_id long, text string, lang string, bucket int, word string, spans string, held_out boolean"
PARTS = {
    "en": ["the", "tion", "er", "ing", "and", "wh", "ea"],
    "es": ["ción", "ado", "que", "os", "ña", "ie", "ll"],
    "ru": ["ство", "ни", "ко", "ая", "про", "ть"],
    "el": ["του", "και", "ση", "λο", "ρια"],
}


def sentence(r, lang, n):
    return " ".join("".join(r.choices(PARTS[lang], k=r.randrange(1, 4))) for _ in range(n))


def corpus(n=400):
    r = random.Random(3)
    return [(i, sentence(r, lang := r.choice(list(PARTS)), r.randrange(5, 60)), lang) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(d, t, g, 1, "w", "s", True) for d, t, g in rows], DOCS)


def plain_viterbi(scores, first, prior, switch):
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        state, back = prior.copy(), []
        for row in scores[a:b]:
            ways = state[:, None] - switch * (1 - np.eye(len(state)))
            back.append(ways.argmax(0))
            state = ways.max(0) + row
        label = [int(state.argmax())]
        for came in back[:0:-1]:
            label.append(int(came[label[-1]]))
        out += label[::-1]
    return out


@pytest.mark.parametrize("block", [1, 2, 7, 128])
@pytest.mark.parametrize("labels", [1, 2, 5])
def test_viterbi(block, labels):
    r = np.random.default_rng(block + labels)
    counts = [0, 1, 2, 300, 0, 17, block, block + 1, 5 * block]
    first = np.concatenate([[0], np.cumsum(counts)])
    scores = r.normal(0, 3, (first[-1], labels))
    prior = r.normal(0, 1, labels)
    got = lid.viterbi(scores, first, prior, 4.0, block)
    assert got.tolist() == plain_viterbi(scores, first, prior, 4.0)


def test_words_are_runs_of_one_script():
    texts = ["Ab1é-Привет", "", "漢字かな x", "éa ́b", "🎉 _ ٣", "ǅΣ"]
    data, at = text_buffers(pa.array(texts))
    w = lid.words_of(data, at)
    cut = ["".join(map(chr, w.letters[a:b])) for a, b in zip(w.starts, w.ends)]
    assert [cut[a:b] for a, b in zip(w.first[:-1], w.first[1:])] == [["ab", "é", "привет"], [], ["漢字", "かな", "x"], ["éa", "b"], [], ["ǆ", "σ"]]
    script, _ = lid.letter_tables()
    some = random.Random(1).sample(range(0x20000), 5000)
    assert all((script[c] not in (0, lid.MARK)) == unicodedata.category(chr(c)).startswith("L") for c in some if not 0xD800 <= c < 0xE000)


def test_mixed_texts(spark):
    r = random.Random(5)
    train = corpus()
    mixed = [
        (1000, sentence(r, "en", 40) + " " + sentence(r, "es", 60), None),
        (1001, sentence(r, "ru", 10) + "\n" + sentence(r, "en", 30), None),
        (1002, sentence(r, "en", 4000) + " " + sentence(r, "es", 3000) + " " + sentence(r, "en", 2000), None),
        (1003, sentence(r, "en", 50) + " και", None),
    ]
    out = {x.doc_id: x for x in lid.predict_language(table(spark, train + mixed), spans=True).where("doc_id >= 1000").collect()}
    texts = {d: t for d, t, _ in mixed}

    def spans(d):
        return [(s.lang, len(texts[d][s.start : s.end].split())) for s in out[d].spans]

    assert [x for x, _ in spans(1000)] == ["en", "es"] and abs(spans(1000)[0][1] - 40) <= 1 and out[1000].lang_pred == "es"
    assert spans(1001) == [("ru", 10), ("en", 30)] and out[1001].lang_pred == "en"
    assert [x for x, _ in spans(1002)] == ["en", "es", "en"] and abs(spans(1002)[1][1] - 3000) <= 2
    # no language but Greek is a candidate for Greek letters
    assert spans(1003) == [("en", 50), ("el", 1)]
    share = sum(c.isalpha() for s in out[1000].spans if s.lang == "es" for c in texts[1000][s.start : s.end]) / sum(c.isalpha() for c in texts[1000])
    assert abs(out[1000].score - share) < 1e-6


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wrong = lid.predict_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang != lang_pred and lang is not null")
    assert wrong.count() == 0


def test_held_out_rows_and_ids_teach_nothing(spark):
    rows = corpus()
    changed = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 4 == 2 else g) for d, t, g in rows]
    a, b = (sorted(map(tuple, lid.predict_language(table(spark, x)).collect())) for x in (rows, changed))
    assert a == b and {x[1] for x in a} == {True, False}
    assert all(x[1] == (zlib.crc32(str(x[0]).encode()) % 4 == 2) for x in a)


def test_odd_rows(spark):
    rows = corpus() + [(900, None, "en"), (901, "", "en"), (902, "12 _ 🎉", None), (903, "日本", None), (None, "the", "en"), (7, "the", None)]
    rows += [(904, "theeringand " * 30000, None), (905, "theeringand" * 30000, "en"), (906, "the", "en"), (906, "the", "en")]
    out = lid.predict_language(table(spark, rows)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert [(by[d][0].lang_pred, by[d][0].score) for d in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[903][0].lang_pred in PARTS  # letters no language uses: the most frequent language
    assert by[904][0].lang_pred == by[905][0].lang_pred == "en" and len(by[906]) == 2 and by[None][0].held_out is False
    assert lid.predict_language(table(spark, [])).count() == 0
    unknown = lid.predict_language(table(spark, [(1, "abc", None)]), spans=True).collect()
    assert [(r.lang_pred, r.score, r.spans) for r in unknown] == [("und", 0.0, [])]
    with pytest.raises(ValueError):
        lid.predict_language(table(spark, corpus(50)), lid.LanguageOptions(most=2))


def test_counts_do_not_depend_on_partitions(spark):
    docs = table(spark, corpus(200))
    a, b = (sorted(map(tuple, lid.predict_language(docs.repartition(n)).collect())) for n in (1, 7))
    assert a == b
