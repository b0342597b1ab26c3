"""Near-duplicate documents by circulant MinHash, banding and exact confirmation.

Two permutations of the positions 0..2^20-1 make all signature coordinates: the first scatters the shingles, the
second, circularly shifted by k, ranks them for coordinate k. In a table of the second permutation the ranks of one
shingle for all shifts are neighbours, so a signature is the minimum over rows of that table.

Texts with equal shingle sets form a class. Classes meet in buckets of equal bands. A bucket never emits all its
pairs: in every round each class meets one hub of the bucket, and confirmed links join components. Classes of buckets
that still hold several components then meet over their rarest shingles, which rules out most pairs of a large group
and no link. Every link is confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.llm.graph import components
from massloom.llm.scratch import scratch_table
from massloom.llm.text import chunks, list_array, mix, shingles, word_hashes
from massloom.sources.stages import materialize

POSITIONS = 1 << 20


@dataclass(frozen=True)
class NearOptions:
    """Link when ``100 * intersection >= percent * union`` of ``words``-word shingle sets.

    A pair at similarity s misses all bands with probability ``(1 - s**rows) ** bands``: 7e-11 at 0.85, 1e-7 at 0.8.
    """

    words: int = 5
    percent: int = 85
    bands: int = 40
    rows: int = 5
    seed: int = 17
    hub_rounds: int = 2


class Circulant:
    """Signatures of shingle sets from one scatter and one shifted permutation."""

    def __init__(self, coordinates: int, seed: int):
        second = np.random.default_rng(seed).permutation(POSITIONS).astype(np.int32)
        self.shifted = sliding_window_view(np.concatenate([second, second[: coordinates - 1]]), coordinates)
        self.scatter = mix(np.array([seed], np.uint64))[0]

    def __call__(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One row per text that has shingles."""
        counts = np.diff(first)
        filled = np.flatnonzero(counts)
        out = np.full((len(filled), self.shifted.shape[1]), np.iinfo(np.int32).max, np.int32)
        # the first permutation: a bijective mix of the hash, of which the top bits are the position
        at = (mix(hashes ^ self.scatter) >> np.uint64(44)).astype(np.int64)
        owner = np.repeat(np.arange(len(filled)), counts[filled])
        for low in range(0, len(at), 4096):
            own = owner[low : low + 4096]
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            least = np.minimum.reduceat(self.shifted[at[low : low + 4096]], cuts, axis=0)
            out[own[cuts]] = np.minimum(out[own[cuts]], least)
        return out


def _band_hashes(signatures: np.ndarray, opts: NearOptions) -> np.ndarray:
    odd = mix(np.arange(1, opts.rows + 1, dtype=np.uint64)) | np.uint64(1)
    by_band = signatures.astype(np.uint64).reshape(len(signatures), opts.bands, opts.rows)
    return mix((by_band * odd).sum(axis=2, dtype=np.uint64) + mix(np.arange(opts.bands, dtype=np.uint64)))


def signatures(docs: DataFrame, opts: NearOptions) -> DataFrame:
    """doc_id, n_shingles, fp (of the whole shingle set, null if empty), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(opts.bands * opts.rows, opts.seed)
        for batch in batches:
            for rows, data, at in chunks(batch.column(1)):
                hashes, first = shingles(*word_hashes(data, at), opts.words)
                sizes, prints = [], []
                for i in range(len(first) - 1):
                    own = np.unique(hashes[first[i] : first[i + 1]])
                    sizes.append(len(own))
                    prints.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                bands = _band_hashes(circulant(hashes, first), opts).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[rows],
                        pa.array(sizes, pa.int64()),
                        pa.array(prints, pa.binary()),
                        list_array(bands, (np.diff(first) > 0) * opts.bands, pa.int64()),
                    ],
                    names=["doc_id", "n_shingles", "fp", "bands"],
                )

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return wanted.mapInArrow(run, "doc_id long, n_shingles long, fp binary, bands array<long>")


def shingle_sets(docs: DataFrame, opts: NearOptions) -> DataFrame:
    """doc_id and the whole set of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in chunks(batch.column(1)):
                hashes, first = shingles(*word_hashes(data, at), opts.words)
                sets = [np.unique(hashes[first[i] : first[i + 1]]) for i in range(len(first) - 1)]
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                own = list_array(flat, np.array([len(s) for s in sets], np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], own], names=["rep", "members"])

    return docs.mapInArrow(run, "rep long, members array<long>")


def _long_enough(n: Column, m: Column, opts: NearOptions) -> Column:
    """Sets of sizes too far apart can't reach the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * opts.percent


def _confirm(pairs: DataFrame, sets: DataFrame, opts: NearOptions) -> DataFrame:
    left = sets.select(F.col("rep").alias("a"), F.col("members").alias("of_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("members").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    union = F.size("of_a").cast("long") + F.size("of_b") - both
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= union * opts.percent).select("a", "b").distinct()


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _unsettled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that more than one component meets in; the others have nothing left to find."""
    members = shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    members = members.withColumn("root", F.coalesce("root", "rep"))
    mixed = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    return members.join(mixed.select("key"), "key")


def _possible(rest: DataFrame, sets: DataFrame, opts: NearOptions) -> DataFrame:
    """Pairs of different components in ``rest`` (rep, root, n) that could still be links; none that is one is left out.

    Shingles are ordered by rarity. A link shares a shingle among the rarest few of both sets, and from there on
    enough shingles are left in both to reach the similarity. Edited copies of one text begin with shingles of their
    own, so the pairs of a large group are ruled out before they are formed.
    """
    tokens = sets.join(rest, "rep", "left_semi").select("rep", F.explode("members").alias("token"))
    rarity = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = tokens.join(rarity, "token")
    own = Window.partitionBy("rep")
    placed = shared.select(
        "rep", "token", F.row_number().over(own.orderBy("df", "token")).alias("rank"), F.count(F.lit(1)).over(own).alias("c")
    )
    # shingles of one set only come first and need no rows
    placed = placed.join(rest, "rep").withColumn("at", F.col("n") - F.col("c") + F.col("rank"))
    # at least ceil(percent * n / 100) shingles are common, so one is among the first n - that + 1
    prefix = F.col("n") - F.ceil(F.col("n") * opts.percent / F.lit(100)) + 1
    first = materialize(placed.where(F.col("at") <= prefix).select("token", "rep", "root", "n", "at"))
    other = first.toDF("token", "rep2", "root2", "n2", "at2")
    needed = F.ceil((F.col("n") + F.col("n2")) * opts.percent / F.lit(100 + opts.percent))
    left = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) + 1
    could = (F.col("root") < F.col("root2")) & _long_enough(F.col("n"), F.col("n2"), opts) & (left >= needed)
    met = first.join(other, (first["token"] == other["token"]) & could)
    return met.select(*_ordered(F.col("rep"), F.col("rep2"))).distinct()


def _linked(shared: DataFrame, sets: DataFrame, opts: NearOptions) -> DataFrame:
    """node, root of all classes with links; ``shared`` has key, rep, n, central of the members of buckets."""
    tested = links = labels = None
    members = shared.withColumn("root", F.col("rep"))
    for step in range(opts.hub_rounds):
        preferred = -F.col("central") if step == 0 else F.xxhash64("rep", F.lit(step))
        hubs = members.groupBy("key").agg(F.min(F.struct(preferred.alias("h"), "rep", "root", "n")).alias("hub"))
        met = members.join(hubs, "key").where(F.col("root") != F.col("hub.root"))
        met = met.where(_long_enough(F.col("n"), F.col("hub.n"), opts))
        # one hub for each class and round: the first of those its buckets offer
        chosen = met.groupBy("rep").agg(F.min("hub").alias("hub"))
        pairs = chosen.select(*_ordered(F.col("rep"), F.col("hub.rep"))).distinct()
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        found = materialize(_confirm(pairs, sets, opts))
        tested = pairs if tested is None else tested.union(pairs)
        links = found if links is None else links.union(found)
        labels = components(links)
        members = materialize(_unsettled(shared, labels))
    rest = members.select("rep", "root", "n").distinct()
    pairs = _possible(rest, sets, opts)
    pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"))
    return components(links.union(materialize(_confirm(pairs, sets, opts))))


def near_duplicates(docs: DataFrame, opts: NearOptions = NearOptions()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id reachable over links. Null and empty texts, and texts of separators only,
    have ``n_shingles`` 0 and are alone; a text with fewer words than a shingle is one shingle. Rows without doc_id
    link with nothing: their component_id is null and they are kept. Rows that repeat a doc_id are judged by their own
    text. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    signed = materialize(signatures(docs, opts))
    classes = materialize(
        signed.where("doc_id is not null and fp is not null")
        .groupBy("fp", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"))
    )
    buckets = classes.select(F.explode("bands").alias("key"), "rep", F.col("n_shingles").alias("n"))
    met = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = buckets.join(met, "key")
    # the text that others were copied from meets more of them than they meet each other
    central = shared.groupBy("rep").agg(F.sum("c").alias("central"))
    shared = materialize(shared.drop("c").join(central, "rep"))
    # the same plan at every size: the ids grow with the documents and are not broadcast
    met = shared.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    wanted = docs.join(met, "doc_id", "left_semi")
    with scratch_table(shingle_sets(wanted, opts)) as sets:
        labels = _linked(shared, sets, opts)

    by_class = classes.select("fp", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = by_class.select("fp", F.coalesce("root", "rep").alias("of_class"))
    return (
        signed.select("doc_id", "n_shingles", "fp")
        .join(by_class, "fp", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
