"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Voters are found in the labelled training texts: all words (lexicon voters), and beginnings of the words left (pattern
voters), that toxic texts have more often than chance explains, and a few fixed patterns of shouting. A voter fires or is silent. The label model
gives each voter its rates of firing on toxic and on clean texts, by expectation maximisation over all training texts,
labelled or not; the correlation of voters on toxic texts shrinks the weight of those that say the same. A logistic
regression on the votes is then trained on the posterior labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.text import LOWER, SPACE, Hashes, chunks, hash_of, list_array, mix, word_spans
from massloom.sources.stages import materialize

PUNCTUATION = ".,;:!?()[]\"'"
FIXED = ("shouting", "exclamations")

BETWEEN = SPACE.copy()
BETWEEN[[ord(c) for c in PUNCTUATION]] = True


@dataclass(frozen=True)
class ToxicOptions:
    """A voter is seen in at least ``least`` toxic texts, ``odds`` times as often as in clean ones, and so often that
    about ``chance`` of all words tested would be by chance. Texts in which the ``near`` words on both sides are the
    same, as in copies of one text, count once; next to a place where the copies differ they do not. There is no limit to
    the number of voters.

    Voters correlated above ``alike`` say the same and share their weight. Voters are looked for in at most ``sample``
    different labelled texts, those with the smallest hashes; rates and the classifier use all.
    """

    sample: int = 50_000
    lengths: tuple[int, ...] = (3, 4, 5, 6)
    least: int = 5
    odds: float = 5.0
    chance: float = 1.0
    near: int = 3
    alike: float = 0.5
    rounds: int = 5


@dataclass(frozen=True)
class Voters:
    words: tuple[str, ...]
    beginnings: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        return [*self.words, *(f"{b}-" for b in self.beginnings), *FIXED]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose labels are never learned from. A null doc_id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of ``data``, A-Z as a-z, as an Arrow column."""
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    picked = data[np.repeat(starts - at[:-1], ends - starts) + np.arange(at[-1])]
    return pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(at), pa.py_buffer(LOWER[picked].astype(np.uint8))
    ).cast(pa.string())


def _around(words: np.ndarray, first: np.ndarray, near: int) -> np.ndarray:
    """A hash of the ``near`` words of the text on either side of each word, and of where they lie."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    odd = mix(np.arange(1, 2 * near + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros(len(words), np.uint64)
    for k in range(1, min(near, len(words) - 1) + 1):
        same = text[k:] == text[:-k]
        out[k:] += np.where(same, words[:-k] * odd[2 * k - 2], np.uint64(0))
        out[:-k] += np.where(same, words[k:] * odd[2 * k - 1], np.uint64(0))
    return mix(out)


def _evidence(texts: DataFrame, opts: ToxicOptions, known: tuple[str, ...] | None = None) -> DataFrame:
    """word, toxic, clean: in how many texts of either kind, counting those with the same words around it once.

    With ``known``, beginnings of all other words instead of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = _Lookup(known or (), 0)
        for batch in batches:
            for rows, data, at in chunks(batch.column(1)):
                starts, ends, first = word_spans(data, at, BETWEEN)
                hashed = Hashes(data)
                words = hashed(starts, ends)
                around = _around(words, first, opts.near)
                text = np.repeat(np.arange(len(at) - 1), np.diff(first))
                spans = [(np.arange(len(starts)), ends)]
                if known is not None:
                    left = np.ones(len(starts), bool)
                    left[chosen(words)[0]] = False
                    letters = np.flatnonzero((data & 0xC0) != 0x80)
                    places = np.searchsorted(letters, starts)
                    letters = np.append(letters, [len(data)] * (max(opts.lengths) + 1))
                    spans = []
                    for n in opts.lengths:
                        cut = letters[places + n]
                        own = np.flatnonzero(left & (cut <= ends) & (places + n <= len(letters) - max(opts.lengths) - 1))
                        spans.append((own, cut[own]))
                own, cut = (np.concatenate(x) for x in zip(*spans))
                name = hashed(starts[own], cut)
                order = np.lexsort((around[own], name, text[own]))
                same = (name[order][1:] == name[order][:-1]) & (text[own][order][1:] == text[own][order][:-1])
                order = order[np.concatenate([[True], ~same])] if len(order) else order
                toxic = batch.column(0)[rows].take(pa.array(text[own][order]))
                yield pa.RecordBatch.from_arrays(
                    [toxic, _strings(data, starts[own][order], cut[order]), pa.array((around[own][order] >> np.uint64(32)).astype(np.uint32).view(np.int32))],
                    names=["toxic", "word", "around"],
                )

    seen = texts.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "toxic int, word string, around int")
    # 32 bits tell the texts of one word apart; a bit for each kind
    once = seen.groupBy("word", "around").agg(F.bit_or(F.col("toxic") + 1).alias("kinds"))
    return materialize(
        once.groupBy("word").agg(
            F.count_if(F.col("kinds").bitwiseAND(2) != 0).alias("toxic"),
            F.count_if(F.col("kinds").bitwiseAND(1) != 0).alias("clean"),
        )
    )


def find_voters(docs: DataFrame, labels: DataFrame, opts: ToxicOptions) -> Voters:
    """Words and word beginnings more frequent in toxic training texts than chance explains; equal texts count once."""
    train = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = train.select("doc_id", F.xxhash64("text").alias("h")).join(known, "doc_id")
    once = marked.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    once = materialize(once.orderBy("h", "doc_id").limit(opts.sample).drop("h"))
    total = once.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")).first()
    if not total["toxic"] or not total["clean"]:
        return Voters((), ())
    # at most ``sample`` rows of an id and a label
    texts = train.select("doc_id", "text").join(F.broadcast(once), "doc_id").select("toxic", "text")
    share = total["toxic"] / (total["toxic"] + total["clean"])

    def told(table: DataFrame) -> list:
        """Voters, those that say most first. Their surprise bounds -log of the chance of so many toxic texts."""
        odds = (F.col("toxic") + 0.5) / (total["toxic"] + 1) / ((F.col("clean") + 0.5) / (total["clean"] + 1))
        seen = F.col("toxic") + F.col("clean")
        surprise = F.col("toxic") * F.log(F.col("toxic") / seen / share) + F.when(
            F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / seen / (1 - share))
        ).otherwise(0.0)
        tested = table.where(F.col("toxic") >= opts.least)
        bar = math.log(max(tested.count(), 1) / opts.chance)
        likely = tested.withColumn("surprise", surprise).where((odds >= opts.odds) & (F.col("surprise") >= bar))
        return likely.orderBy(F.desc("surprise"), "word").collect()

    words = tuple(r["word"] for r in told(_evidence(texts, opts)))
    begun = {r["word"]: (r["toxic"], r["clean"]) for r in told(_evidence(texts, opts, words))}
    # a beginning seen just as often as a shorter one that it begins with adds nothing
    news = tuple(w for w, n in begun.items() if all(begun.get(w[:k]) != n for k in range(1, len(w))))
    return Voters(words, news)


class _Lookup:
    """Place of each hash in a small table, -1 for those not in it."""

    def __init__(self, words: Sequence[str], first: int):
        hashes = np.array([hash_of(w) for w in words], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.place = hashes[order], first + order
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are known, and the voters they stand for."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(self.hashes, hashes[maybe])
        at[at == len(self.hashes)] = 0
        true = self.hashes[at] == hashes[maybe]
        return maybe[true], self.place[at[true]]


class _Caster:
    """The voters that fire on each of a run of texts."""

    def __init__(self, voters: Voters):
        self.n_words = len(voters.words)
        self.fixed = self.n_words + len(voters.beginnings)
        self.lexicon = _Lookup(voters.words, 0)
        by_length: dict[int, list[int]] = {}
        for i, b in enumerate(voters.beginnings):
            by_length.setdefault(len(b.encode()), []).append(i)
        self.begun = {n: (np.array(own), _Lookup([voters.beginnings[i] for i in own], 0)) for n, own in by_length.items()}

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and voter of every vote, each once, in order."""
        starts, ends, first = word_spans(data, at, BETWEEN)
        hashed = Hashes(data)
        fired = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if self.n_words:
            fired.append(self.lexicon(hashed(starts, ends)))
        for n, (own, known) in self.begun.items():
            long = np.flatnonzero(ends - starts >= n)
            word, voter = known(hashed(starts[long], starts[long] + n))
            fired.append((long[word], self.n_words + own[voter]))
        word, voter = (np.concatenate(x) for x in zip(*fired))
        doc = np.searchsorted(first, word, "right") - 1
        capitals = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        marks = np.concatenate([[0], np.cumsum(data == ord("!"))])
        size = np.maximum(np.diff(at), 1)
        for k, loud in enumerate((np.diff(capitals[at]) / size > 0.3, np.diff(marks[at]) / size > 0.02)):
            doc = np.append(doc, np.flatnonzero(loud))
            voter = np.append(voter, np.full(int(loud.sum()), self.fixed + k))
        return np.divmod(np.unique(doc * (self.fixed + len(FIXED)) + voter), self.fixed + len(FIXED))


def cast_votes(docs: DataFrame, voters: Voters) -> DataFrame:
    """doc_id and votes: the numbers of the voters that fire on the whole text, ascending. Null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caster = _Caster(voters)
        for batch in batches:
            for rows, data, at in chunks(batch.column(1)):
                doc, voter = caster(data, at)
                votes = list_array(voter, np.bincount(doc, minlength=len(at) - 1), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], votes], names=["doc_id", "votes"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return wanted.mapInArrow(run, "doc_id long, votes array<int>")


@dataclass(frozen=True)
class LabelModel:
    """Firing rates on toxic and clean texts, the share of toxic texts, and what correlation leaves of each voter.

    A voter that fires speaks for toxic by the ratio of its rates; one that is silent abstains.
    """

    toxic: tuple[float, ...]
    clean: tuple[float, ...]
    prior: float
    share: tuple[float, ...]

    def posterior(self, votes: Column) -> Column:
        weights = [s * math.log(a / b) for a, b, s in zip(self.toxic, self.clean, self.share)]
        return _sigmoid(linear(votes, weights, math.log(self.prior / (1 - self.prior))))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(40.0)), F.lit(-40.0))))


def linear(votes: Column, weights: Sequence[float], start: float) -> Column:
    table = np.array(weights, float)

    @F.arrow_udf("double")
    def total(votes: pa.Array) -> pa.Array:
        fired = votes.flatten().to_numpy(zero_copy_only=False)
        counts = votes.value_lengths().to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(len(votes)), counts)
        return pa.array(start + np.bincount(text, table[fired], minlength=len(votes)))

    return total(votes)


def fit_label_model(patterns: DataFrame, voters: int, opts: ToxicOptions) -> LabelModel:
    """``patterns`` has votes, n (texts with just these votes), marked and toxic (those labelled, and labelled toxic)."""

    def rates(known: Column, of_toxic: Column, share, prior: float | None = None) -> LabelModel:
        """One maximisation: firing rates when ``of_toxic`` of ``known`` texts are toxic."""
        rows = patterns.select("votes", of_toxic.alias("t"), (known - of_toxic).alias("c"))
        total = rows.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
        fired = rows.select(F.explode("votes").alias("v"), "t", "c").groupBy("v").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        toxic, clean = [0.0] * voters, [0.0] * voters
        for r in fired.collect():  # one row per voter
            toxic[r["v"]], clean[r["v"]] = float(r["t"]), float(r["c"])
        all_toxic, all_clean = float(total["t"] or 0), float(total["c"] or 0)
        return LabelModel(
            tuple((x + 0.5) / (all_toxic + 1) for x in toxic),
            tuple((x + 0.5) / (all_clean + 1) for x in clean),
            prior or (all_toxic + 1) / (all_toxic + all_clean + 2),
            share,
        )

    model = rates(F.col("marked").cast("double"), F.col("toxic").cast("double"), (1.0,) * voters)

    def maximise(model: LabelModel) -> LabelModel:
        # labelled texts keep their label, the others have the model's belief
        belief = F.col("toxic") + (F.col("n") - F.col("marked")) * model.posterior(F.col("votes"))
        # silent texts say nothing on how many are toxic, so that stays as the labels have it
        return rates(F.col("n").cast("double"), belief, model.share, model.prior)

    for _ in range(opts.rounds):
        model = maximise(model)
    model = LabelModel(model.toxic, model.clean, model.prior, _shares(patterns, model, voters, opts))
    for _ in range(2):
        model = maximise(model)
    return model


def _shares(patterns: DataFrame, model: LabelModel, voters: int, opts: ToxicOptions) -> tuple[float, ...]:
    """1 / (1 + the sum of a voter's correlations on toxic texts with the voters that say the same)."""
    rows = patterns.select("votes", (F.col("n") * model.posterior(F.col("votes"))).alias("t"))
    total = float(rows.agg(F.sum("t")).first()[0] or 0)
    both = (
        rows.select("votes", "t", F.explode("votes").alias("v"))
        .select("t", "v", F.explode("votes").alias("w"))
        .where("v < w")
        .groupBy("v", "w")
        .agg(F.sum("t").alias("t"))
    )
    rates = both.sparkSession.createDataFrame(list(enumerate(model.toxic)), "x int, rate double")
    a, b = F.col("a"), F.col("b")
    found = (F.col("t") / (total + 1) - a * b) / F.sqrt(a * (1 - a) * b * (1 - b))
    alike = (
        both.join(F.broadcast(rates.toDF("v", "a")), "v")
        .join(F.broadcast(rates.toDF("w", "b")), "w")
        .select("v", "w", F.least(found, F.lit(1.0)).alias("found"))
        .where(F.col("found") > opts.alike)
    )
    sums = [0.0] * voters
    sides = alike.select(F.explode(F.array("v", "w")).alias("v"), "found")
    for r in sides.groupBy("v").agg(F.sum("found").alias("sum")).collect():  # at most one row per voter
        sums[r["v"]] = r["sum"]
    return tuple(1 / (1 + s) for s in sums)


@dataclass(frozen=True)
class Classifier:
    """Voters and the weights of their votes. Without voters every text scores 0."""

    voters: Voters
    weights: tuple[float, ...] = ()
    intercept: float = -40.0


def fit(docs: DataFrame, labels: DataFrame, opts: ToxicOptions = ToxicOptions()) -> tuple[Classifier, DataFrame]:
    """The classifier, and doc_id, held_out, votes of all documents."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    voters = find_voters(docs, labels, opts)
    m = len(voters.names)
    votes = materialize(cast_votes(docs, voters).withColumn("held_out", held_out(F.col("doc_id"))))
    if not voters.words and not voters.beginnings:
        return Classifier(voters), votes
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    train = votes.where("not held_out").join(known, "doc_id", "left")
    patterns = materialize(
        train.groupBy("votes").agg(
            F.count(F.lit(1)).alias("n"), F.count("label").alias("marked"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")
        )
    )
    model = fit_label_model(patterns, m, opts)
    sparse = F.udf(lambda votes: Vectors.sparse(m, votes, [1.0] * len(votes)), VectorUDT())
    # posterior labels: a label that was given is one more voter, which is taken at its word
    belief = F.col("toxic") + (F.col("n") - F.col("marked")) * model.posterior(F.col("votes"))
    sides = F.explode(
        F.array(
            F.struct(F.lit(1.0).alias("label"), belief.alias("weight")),
            F.struct(F.lit(0.0).alias("label"), (F.col("n") - belief).alias("weight")),
        )
    )
    rows = patterns.select(sparse("votes").alias("features"), sides.alias("x")).select("features", "x.label", "x.weight")
    fitted = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=100, standardization=False).fit(
        materialize(rows.where("weight > 1e-9"))
    )
    return Classifier(voters, tuple(fitted.coefficients.toArray().tolist()), float(fitted.intercept)), votes


def score_toxicity(docs: DataFrame, labels: DataFrame, opts: ToxicOptions = ToxicOptions()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    Labels (doc_id, toxic) of held-out rows are never read, and nothing but the text enters a score. Null and empty
    texts get the score of a text on which no voter fires. Rows that repeat a doc_id are scored each; a doc_id
    labelled more than once counts as toxic if any label says so. Without labels of both kinds, or without a word that
    tells them apart, all scores are next to 0. Other columns are ignored.
    """
    model, votes = fit(docs, labels, opts)
    score = _sigmoid(linear(F.col("votes"), model.weights or (0.0,) * len(model.voters.names), model.intercept))
    scored = votes.withColumn("score", score)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, opts: ToxicOptions = ToxicOptions()) -> DataFrame:
    """The rows of ``docs``, all columns, that score below 0.5."""
    model, _ = fit(docs, labels, opts)
    if not model.weights:
        return docs
    at_text, weights = docs.columns.index("text"), np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caster = _Caster(model.voters)
        for batch in batches:
            for rows, data, at in chunks(batch.column(at_text)):
                doc, voter = caster(data, at)
                score = model.intercept + np.bincount(doc, weights[voter], minlength=len(at) - 1)
                yield batch.slice(rows.start, rows.stop - rows.start).filter(pa.array(score < 0))

    return docs.mapInArrow(run, docs.schema)
