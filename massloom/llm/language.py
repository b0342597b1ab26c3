"""Languages of mixed texts: script ranges narrow the candidates, Viterbi labels the words.

A word is a run of letters of one script. Languages that hardly use the script are no candidates for it; the others
score the word by its letter n-grams. The best labelling of all words of a text, where every change of language costs a
penalty, gives the spans; the language with most letters is the text's. Long texts are cut into blocks of words that
are solved side by side for every language they could begin in, and then chained, which gives the same labels.

The model is one count per language and n-gram bucket, summed by Spark over all labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.text import chunks, mix

UNKNOWN = "und"

# first and last code point of each range, and the script written with it; letters elsewhere are one more script
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0531, 0x058F, "Armenian"), (0x0591, 0x05F4, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0700, 0x074F, "Syriac"),
    (0x0750, 0x077F, "Arabic"), (0x08A0, 0x08FF, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"),
    (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B00, 0x0B7F, "Oriya"), (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0D80, 0x0DFF, "Sinhala"),
    (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"), (0x0F00, 0x0FFF, "Tibetan"), (0x1000, 0x109F, "Myanmar"),
    (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1200, 0x137F, "Ethiopic"), (0x1780, 0x17FF, "Khmer"),
    (0x1800, 0x18AF, "Mongolian"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x309F, "Hiragana"),
    (0x30A0, 0x30FF, "Katakana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
    (0xF900, 0xFAFF, "Han"), (0xFF21, 0xFF5A, "Latin"), (0x20000, 0x3FFFF, "Han"),
)
N_SCRIPTS = len({s for *_, s in SCRIPTS}) + 1
MARK = 255

_WINDOWS = ((-1, 0, 1), (-1, 0, 1, 2))
SLICE = 1 << 18
_tables: list[tuple[np.ndarray, np.ndarray]] = []


@dataclass(frozen=True)
class LanguageOptions:
    """``buckets`` for n-grams, a power of two; ``smooth`` is added to each count. A change of language costs ``switch``
    (natural log). A language is a candidate for a script that has ``share`` of its letters.

    The model is buckets x languages numbers, so more than ``most`` languages are an error.
    """

    buckets: int = 1 << 16
    smooth: float = 0.1
    switch: float = 10.0
    share: float = 0.01
    most: int = 500


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from. A null doc_id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its script from 1 (0: no letter, ``MARK``: belongs to the letter before), and its lower case."""
    if not _tables:
        import unicodedata

        every = np.arange(0x110000, dtype=np.uint32)
        every[0xD800:0xE000] = 0
        chars = every.view("U1")
        names = sorted({s for *_, s in SCRIPTS})
        script = np.full(len(every), len(names) + 1, np.uint8)
        for first, last, name in SCRIPTS:
            script[first : last + 1] = names.index(name) + 1
        script[~np.char.isalpha(chars)] = 0
        marks = [c for c in range(0x300, 0x3100) if unicodedata.category(chr(c))[0] == "M"]
        script[marks] = MARK
        lower = np.char.lower(chars).astype("U1").view(np.uint32)
        _tables.append((script, np.where(lower == 0, every, lower)))
    return _tables[0]


@dataclass(frozen=True)
class Words:
    """The words of a run of texts: code points (lower case), where each word begins and ends, its script, and the number of
    words before each text (one more entry than texts)."""

    letters: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    script: np.ndarray
    first: np.ndarray
    text_at: np.ndarray


def words_of(data: np.ndarray, at: np.ndarray) -> Words:
    """Words in UTF-8 ``data``, texts beginning at the bytes ``at``."""
    script, lower = letter_tables()
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text_at = before[at]
    kind = script[points]
    begins = np.zeros(len(points) + 1, bool)
    begins[text_at] = True
    marks = np.flatnonzero(kind == MARK)
    if len(marks):
        # a mark is of the last letter's script, nothing after a gap or at the beginning
        told = np.where((kind != MARK) | begins[:-1], np.arange(len(kind)), 0)
        kind = kind[np.maximum.accumulate(told)]
        kind[kind == MARK] = 0
    changes = begins.copy()
    changes[1:-1] |= kind[1:] != kind[:-1]
    edges = np.flatnonzero(changes)
    starts, ends = edges[:-1], edges[1:]
    inside = kind[starts] != 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[inside], ends[inside]
    return Words(lower[points], starts, ends, kind[starts] - 1, np.searchsorted(starts, text_at), text_at)


def _slices(words: Words) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of words of about ``SLICE`` letters: (words, their letters with 0 between words, where each begins there)."""
    sizes = words.ends - words.starts
    upto = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        done = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, done + SLICE, "right")))
        own = sizes[i:j]
        begin = np.concatenate([[0], np.cumsum(own + 1)])
        spaced = np.zeros(begin[-1] + 1, np.uint64)
        place = np.arange(own.sum()) + np.repeat(np.arange(1, j - i + 1), own)
        spaced[place] = words.letters[np.repeat(words.starts[i:j] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())]
        yield slice(i, j), spaced, begin[:-1]
        i = j


def gram_buckets(spaced: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    """For each kind of n-gram, one bucket per place of ``spaced``; those at the zeros between words mean nothing."""
    odd = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    for k, window in enumerate(_WINDOWS):
        total = np.full(len(spaced), k + 1, np.uint64)
        open_ = np.ones(len(spaced), bool)
        for step in window:
            letter = np.zeros(len(spaced), np.uint64)
            if step < 0:
                letter[-step:] = spaced[:step]
            elif step:
                letter[:-step] = spaced[step:]
            else:
                letter = spaced
            if step > 1:
                letter = np.where(open_, letter, np.uint64(0))  # not beyond the end of the word
            if step > 0:
                open_ &= letter != 0
            total += letter * odd[step + 1 + 2 * k]
        yield (mix(total) >> shift).astype(np.int64)


def count_grams(texts: DataFrame, buckets: int) -> DataFrame:
    """lang, bucket, n over all rows of ``texts`` (lang, text). Buckets below 0: -1 texts, -2 and less letters of a script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            for rows, data, at in chunks(batch.column(1)):
                words = words_of(data, at)
                own = codes[rows]
                of_word = np.repeat(own, np.diff(words.first))
                for some, spaced, begin in _slices(words):
                    lang = np.repeat(of_word[some], np.diff(np.append(begin, len(spaced) - 1)))
                    real = spaced[1:] != 0
                    for found in gram_buckets(spaced, buckets):
                        pairs = np.bincount(lang[real] * buckets + found[1:][real], minlength=len(names) * buckets)
                        for k in np.unique(of_word[some]):
                            table = counts.setdefault(names[k], np.zeros(buckets + 1 + N_SCRIPTS, np.int64))
                            table[:buckets] += pairs[k * buckets : (k + 1) * buckets]
                for k in np.unique(own):
                    table = counts.setdefault(names[k], np.zeros(buckets + 1 + N_SCRIPTS, np.int64))
                    table[buckets] += int((own == k).sum())
                    here = of_word == k
                    table[buckets + 1 :] += np.bincount(words.script[here], (words.ends - words.starts)[here], N_SCRIPTS).astype(np.int64)
        for name, table in counts.items():
            seen = np.flatnonzero(table)
            bucket = np.where(seen < buckets, seen, buckets - 1 - seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(seen), pa.string()), pa.array(bucket, pa.int32()), pa.array(table[seen], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    partial = texts.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
    return partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageModel:
    """``grams``: log probability by bucket and language; ``prior`` by language; ``allowed``: candidates by script."""

    languages: tuple[str, ...]
    grams: np.ndarray
    prior: np.ndarray
    allowed: np.ndarray
    switch: float


def learn_languages(docs: DataFrame, opts: LanguageOptions = LanguageOptions()) -> LanguageModel:
    """A model of the languages in ``docs`` (text, lang), from all rows with both."""
    labelled = docs.where("lang is not null and text is not null").select("lang", "text")
    counted = count_grams(labelled, opts.buckets)
    names = tuple(r["lang"] for r in counted.where("bucket = -1").select("lang").orderBy("lang").limit(opts.most + 1).collect())
    if len(names) > opts.most:
        raise ValueError(f"more than {opts.most} languages")
    return model_of(names, counted.toArrow(), opts)


def model_of(names: tuple[str, ...], counted: pa.Table, opts: LanguageOptions) -> LanguageModel:
    n = len(names)
    table = np.zeros((opts.buckets + 1 + N_SCRIPTS, n))
    place = {name: i for i, name in enumerate(names)}
    bucket = counted["bucket"].to_numpy()
    lang = np.array([place[x] for x in counted["lang"].to_pylist()], np.int64)
    table[np.where(bucket >= 0, bucket, opts.buckets - 1 - bucket), lang] = counted["n"].to_numpy()
    grams, texts, letters = table[: opts.buckets], table[opts.buckets], table[opts.buckets + 1 :]
    grams = np.log((grams + opts.smooth) / (grams.sum(0) + opts.smooth * opts.buckets))
    prior = np.log(texts / max(texts.sum(), 1))
    return LanguageModel(names, grams.astype(np.float32), prior, letters >= opts.share * np.maximum(letters.sum(0), 1), opts.switch)


def score_words(words: Words, model: LanguageModel) -> np.ndarray:
    """Log score of each word in each language. Languages that are no candidates for its script are far below; a word
    that has no candidate scores 0 in all."""
    out = np.zeros((len(words.starts), len(model.languages)))
    for some, spaced, begin in _slices(words):
        # the zero before a word counts for nothing
        real = (spaced != 0)[:, None]
        total = np.zeros((len(spaced), out.shape[1]), np.float32)
        for found in gram_buckets(spaced, len(model.grams)):
            total += np.where(real, model.grams[found], np.float32(0))
        out[some] = np.add.reduceat(total, begin, axis=0)
    candidates = model.allowed[words.script]
    out[~candidates] = -1e9
    out[~candidates.any(1)] = 0
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, prior: np.ndarray, switch: float, block: int = 128) -> np.ndarray:
    """The best label of every word: ``scores`` (words x labels), texts beginning at the words ``first`` (one more entry)."""
    n, labels = scores.shape
    counts = np.diff(first)
    per_text = -(-counts // block)
    text = np.repeat(np.arange(len(counts)), per_text)
    if not len(text):
        return np.zeros(0, np.int64)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    start = first[:-1][text] + nth * block
    size = np.minimum(first[1:][text] - start, block)
    order = np.argsort(-size, kind="stable")
    start, size, text, nth = start[order], size[order], text[order], nth[order]
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]))]  # blocks longer than t words
    block_at = np.zeros((len(counts), int(per_text.max())), np.int64)
    block_at[text, nth] = np.arange(len(text))
    enter = np.tile(prior, (len(text), 1))
    change = switch * (1 - np.eye(labels))

    # what each block adds on the way from any label before it to any label at its end, for texts of several blocks
    several = np.flatnonzero(per_text[text] > 1)
    through = np.zeros((len(several), labels, labels))
    step = max(1, (1 << 21) // labels**2)
    for i in range(0, len(several), step):
        own = several[i : i + step]
        way = scores[start[own]][:, None, :] - change
        for t in range(1, int(size[own[0]])):
            live = int(np.searchsorted(-size[own], -t, "left"))
            now = way[:live]
            np.maximum(now, now.max(2, keepdims=True) - switch, out=now)
            now += scores[start[own[:live]] + t][:, None, :]
        through[i : i + step] = way
    place = np.zeros(len(text), np.int64)
    place[several] = np.arange(len(several))
    for k in range(1, int(per_text.max())):
        texts = np.flatnonzero(per_text > k)
        before = block_at[texts, k - 1]
        enter[block_at[texts, k]] = (enter[before][:, :, None] + through[place[before]]).max(1)

    # once more with the labels before known; came: the label before each word if it has this one
    came = np.zeros((n, labels), np.uint16)
    state = enter
    for t in range(int(size[0])):
        live = active[t]
        now, here = state[:live], start[:live] + t
        best = now.argmax(1)
        switched = now[np.arange(live), best][:, None] - switch
        stay = now >= switched
        came[here] = np.where(stay, np.arange(labels), best[:, None])
        state[:live] = np.where(stay, now, switched) + scores[here]
    # back from every label at a block's end, then along the blocks of a text
    path = np.zeros((n, labels), np.uint16)
    at = np.tile(np.arange(labels), (len(text), 1))
    for t in range(int(size[0]) - 1, -1, -1):
        live = active[t]
        here = start[:live] + t
        path[here] = at[:live]
        at[:live] = np.take_along_axis(came[here], at[:live], 1)
    end = np.zeros(len(text), np.int64)
    for k in range(int(per_text.max()) - 1, -1, -1):
        texts = np.flatnonzero(per_text > k)
        own = block_at[texts, k]
        last = per_text[texts] == k + 1
        end[own[last]] = state[own[last]].argmax(1)
        if not last.all():
            follow = block_at[texts[~last], k + 1]
            end[own[~last]] = at[follow, end[follow]]
    back = np.argsort(order)  # blocks as they lie in the texts
    return path[np.arange(n), np.repeat(end[back], size[back])].astype(np.int64)


def label_texts(docs: DataFrame, model: LanguageModel, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and, if wanted, spans (start, end in code points, lang) of every row of ``docs``.

    lang_pred has most of the letters (ties: the first by name). score: its share of the letters, times the
    probability of this language for its words. Null texts and texts without letters are ``und`` with score 0, and so are
    all without any language learned.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    names = pa.array([*model.languages, UNKNOWN], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model.languages)
        for batch in batches:
            for rows, data, at in chunks(batch.column(1)):
                texts = len(at) - 1
                pred, score = np.full(texts, n), np.zeros(texts)
                words = words_of(data, at)
                label = np.zeros(0, np.int64)
                if n and len(words.starts):
                    scores = score_words(words, model)
                    label = viterbi(scores, words.first, model.prior, model.switch)
                    of = np.repeat(np.arange(texts), np.diff(words.first))
                    letters = np.bincount(of * n + label, words.ends - words.starts, texts * n).reshape(texts, n)
                    full = np.flatnonzero(letters.sum(1))
                    pred[full] = letters[full].argmax(1)
                    mine = np.flatnonzero(label == pred[of])
                    sums = np.zeros((texts, n))
                    np.add.at(sums, of[mine], scores[mine])
                    sums = sums[full] + model.prior
                    sure = 1 / np.exp(sums - sums[np.arange(len(full)), pred[full]][:, None]).clip(max=1e300).sum(1)
                    score[full] = letters[full, pred[full]] / letters[full].sum(1) * sure
                out = [batch.column(0)[rows], names.take(pa.array(pred)), pa.array(score)]
                if spans:
                    out.append(_spans(words, label, names, kind))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "spans"][: len(out)])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    more = ", spans array<struct<start: int, end: int, lang: string>>" if spans else ""
    return wanted.mapInArrow(run, "doc_id long, lang_pred string, score double" + more)


def _spans(words: Words, label: np.ndarray, names: pa.Array, kind: pa.DataType) -> pa.Array:
    texts = len(words.first) - 1
    if not len(label):
        return pa.array([[]] * texts, kind)
    of = np.repeat(np.arange(texts), np.diff(words.first))
    new = np.ones(len(label), bool)
    new[1:] = (label[1:] != label[:-1]) | (of[1:] != of[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(label)) - 1
    rows = of[begin]
    parts = [
        pa.array(words.starts[begin] - words.text_at[rows], pa.int32()),
        pa.array(words.ends[last] - words.text_at[rows], pa.int32()),
        names.take(pa.array(label[begin])),
    ]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=texts))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, names=["start", "end", "lang"]))


def predict_language(docs: DataFrame, opts: LanguageOptions = LanguageOptions(), spans: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score, and spans if wanted.

    Learns from all rows with text and lang that are not held out; only the text enters a prediction. Rows that repeat
    a doc_id are predicted each. Other columns are ignored. See ``label_texts`` for texts without letters.
    """
    model = learn_languages(docs.where(~held_out(F.col("doc_id"))), opts)
    out = label_texts(docs, model, spans)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *out.columns[1:])
