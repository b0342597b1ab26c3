"""Benchmark passages in documents by q-gram counting in diagonal bands and banded alignment.

An occurrence of an item of m characters with at most k edits shares at least ``m + 1 - q - k * q`` q-grams with it,
and all of them lie on diagonals (place in the text less place in the item) at most 2k apart. Bands are 4k + 2
diagonals wide and begin every 2k + 1, so one band holds them all. Bands with fewer shared q-grams are left; in the
others the item is aligned within the band. q is 8, or less for items so short that an occurrence with all its edits
need not share 8 characters in a row.

Texts and items are compared in lower case (A-Z and the letters of Latin-1) with white space as single blanks.
Documents are scanned once for each block of items; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.text import chunks

# the longest q-grams: eight characters as one 64-bit number
Q = 8
# items of fewer characters match nothing
SHORTEST = 8
# characters of items held by a worker at a time; a larger benchmark is scanned for in blocks of this size
BLOCK_CHARS = 2_000_000

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
# places of q-grams that are counted at a time
_SLICE = 1 << 20


@dataclass(frozen=True)
class LeakOptions:
    """``percent`` of an item's characters may be edited: inserted, left out or replaced."""

    percent: int = 10


def fold(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of texts as compared, where each text begins among them, and the place each had before."""
    upper = ((codes >= 65) & (codes <= 90)) | ((codes >= 0xC0) & (codes <= 0xDE) & (codes != 0xD7))
    codes = codes + upper.astype(np.uint32) * np.uint32(32)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    follows = np.zeros(len(codes), bool)
    follows[1:] = blank[:-1]
    follows[at[:-1][at[:-1] < len(codes)]] = True  # none at the beginning of a text
    place = np.flatnonzero(~(blank & follows))
    codes = np.where(blank, np.uint32(32), codes)[place]
    return codes, np.searchsorted(place, at), place


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """One number for the q characters from each place on; equal characters give equal numbers."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    low = np.zeros(len(codes) + Q - q, np.uint8)
    low[: len(codes)] = (codes ^ (codes >> np.uint32(8))) & np.uint32(0xFF)
    grams = np.ndarray((len(codes) - q + 1,), "<u8", low.tobytes(), strides=(1,))
    return grams & np.uint64((1 << 8 * q) - 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class _Grams:
    """The q-grams of some items and where they occur, for one q."""

    def __init__(self, q: int, items: np.ndarray, codes: list[np.ndarray]):
        self.q = q
        grams = [_grams(codes[i], q) for i in items]
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        self.grams, self.first = np.unique(flat[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(flat)))
        self.item = np.repeat(items, [len(g) for g in grams])[order]
        self.at = np.concatenate([np.arange(len(g)) for g in grams])[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self._slot(self.grams)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return ((grams * _SPREAD) >> np.uint64(64 - _BITS)).astype(np.int64)

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the text whose q-gram an item has, and the number of that q-gram."""
        grams = _grams(codes, self.q)
        place = np.flatnonzero(self.seen[self._slot(grams)])
        found = np.searchsorted(self.grams, grams[place])
        found[found == len(self.grams)] = 0
        true = self.grams[found] == grams[place]
        return place[true], found[true]

    def slices(self, place: np.ndarray, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Place in the text, item and place in the item of shared q-grams, some places of the text at a time."""
        ends = np.cumsum(self.count[found])
        start = 0
        while start < len(place):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + _SLICE, "right")))
            times = self.count[found[start:stop]]
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            own = np.repeat(self.first[found[start:stop]], times) + within
            yield np.repeat(place[start:stop], times), self.item[own], self.at[own]
            start = stop


class Items:
    """Benchmark items as compared, with the edits allowed and the q-grams an occurrence must share.

    With k edits an item falls into k + 1 stretches, one of which is untouched, so its q is at most m // (k + 1).
    """

    def __init__(self, texts: list[str], opts: LeakOptions):
        self.codes = []
        for text in texts:
            raw = _codes(text)
            codes, _, _ = fold(raw, np.array([0, len(raw)]))
            self.codes.append(codes[:-1] if len(codes) and codes[-1] == 32 else codes)
        self.sizes = np.array([len(c) for c in self.codes], np.int64)
        self.edits = self.sizes * opts.percent // 100
        q = np.minimum(Q, self.sizes // (self.edits + 1))
        self.need = np.maximum(1, self.sizes + 1 - q - self.edits * q)
        self.step = 2 * self.edits + 1
        self.widest = int(self.sizes.max(initial=0)) + 1
        usable = (self.sizes >= SHORTEST) & (q > 0)
        self.grams = [_Grams(int(n), np.flatnonzero(usable & (q == n)), self.codes) for n in np.unique(q[usable])]

    def bands(self, grams: _Grams, codes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """Text, item and band with as many shared q-grams as an occurrence needs, in this order.

        Places come in order, so bands that lie behind them are complete and are settled before the next slice.
        """
        place, found = grams.shared(codes)
        doc = np.searchsorted(first, place, "right") - 1
        whole = place + grams.q <= first[doc + 1]
        place, found = place[whole], found[whole]
        span = len(codes) + 2 * self.widest + 2  # of the numbers of bands
        open_keys, open_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = [open_keys]
        for where, item, inner in grams.slices(place, found):
            doc = np.searchsorted(first, where, "right") - 1
            band = (where - first[doc] - inner + self.widest) // self.step[item]
            # band numbers from 1; a q-gram counts for the band that begins at or before it and for the one before that
            keys = (doc * len(self.codes) + item) * span + band + 1
            keys, counts = np.unique(np.concatenate([keys, keys - 1]), return_counts=True)
            if len(open_keys):
                keys, at = np.unique(np.concatenate([open_keys, keys]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([open_counts, counts])).astype(np.int64)
            pair, band = np.divmod(keys, span)
            d, i = np.divmod(pair, len(self.codes))
            last = first[d] + (band + 1) * self.step[i] - self.widest + self.sizes[i]  # place after a band's last q-gram
            done = last < where[-1]
            out.append(keys[done & (counts >= self.need[i])])
            open_keys, open_counts = keys[~done], counts[~done]
        pair = open_keys // span % len(self.codes)
        out.append(open_keys[open_counts >= self.need[pair]])
        pair, band = np.divmod(np.sort(np.concatenate(out)), span)
        d, i = np.divmod(pair, len(self.codes))
        return list(zip(d.tolist(), i.tolist(), (band - 1).tolist()))

    def align(self, item: int, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
        """Fewest edits between the item and a stretch of ``text`` on diagonals low..high-1, its start and end."""
        codes = self.codes[item]
        begin = max(0, low)
        same = text[begin : max(0, high + len(codes))].tobytes().find(codes.tobytes())
        if same >= 0 and same % 4 == 0:
            return 0, begin + same // 4, begin + same // 4 + len(codes)
        unit = 1 << 32  # a cell is edits * unit + start
        diag = np.arange(low, high)
        slack = np.arange(len(diag), dtype=np.int64) * unit
        far = np.int64(1) << 60
        cells = np.where((diag >= 0) & (diag <= len(text)), np.maximum(diag, 0), far)
        padded = np.concatenate([np.zeros(max(0, -low) + 1, np.uint32), text, np.zeros(len(codes) + max(0, high) + 1, np.uint32)])
        shift = max(0, -low) + 1
        edge = low + 1 < 1 or high + len(codes) > len(text)  # some cells of the band lie outside the text
        skip = np.full(len(diag), far)
        for i, code in enumerate(codes, 1):
            here = padded[shift + i + low - 1 : shift + i + high - 1]
            skip[:-1] = cells[1:]
            step = np.minimum(cells + (here != code) * np.int64(unit), skip + unit)
            if edge:
                at = diag + i
                step[at == 0] = skip[at == 0] + unit
                inside = (at >= 0) & (at <= len(text))
                cells = np.where(inside, np.minimum.accumulate(np.where(inside, step, far) - slack) + slack, far)
            else:
                cells = np.minimum.accumulate(step - slack) + slack
            if i % 8 == 0 and int(cells.min()) // unit > self.edits[item]:
                return len(codes), 0, 0  # edits only grow from here on
        best = int(np.argmin(cells))
        return int(cells[best] // unit), int(cells[best] % unit), int(diag[best] + len(codes))

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """Row, item, start, end (code points of the text as it is) and edits of every occurrence."""
        for rows, data, at in chunks(texts, 1 << 20):
            codes = _codes(data.tobytes().decode())
            begins = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
            char_at = begins[at]
            folded, first, place = fold(codes, char_at)
            last = None
            for d, i, band in (b for grams in self.grams for b in self.bands(grams, folded, first)):
                low = band * int(self.step[i]) - self.widest
                text = folded[first[d] : first[d + 1]]
                edits, start, end = self.align(i, text, low, low + 2 * int(self.step[i]))
                if edits > self.edits[i] or (last and last[:2] == (d, i) and start < last[2]):
                    continue  # too far, or the occurrence the band before gave
                last = (d, i, end)
                own = place[first[d] : first[d + 1]] - char_at[d]
                yield rows.start + d, i, int(own[start]) if start < len(own) else 0, int(own[end - 1]) + 1 if end else 0, edits


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[str]]]:
    ids, texts, chars = [], [], 0
    for row in benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        if chars and chars + len(row["text"]) > BLOCK_CHARS:
            yield ids, texts
            ids, texts, chars = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        chars += len(row["text"])
    yield ids, texts


FOUND = "doc_id long, item_id long, start long, end long, edits long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, opts: LeakOptions = LeakOptions()) -> DataFrame:
    """One row per occurrence: doc_id, item_id, start, end (code points), edits.

    The benchmark (item_id, text) is read by the driver a block at a time; documents of any number and length are
    compared with all of it. Null or empty texts and items, and items under ``SHORTEST`` characters, match nothing. Equal items
    are all reported, as are rows that repeat a doc_id. Other columns are ignored.
    """

    def pass_over(ids: list, texts: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(texts, opts)
            for batch in batches:
                found = list(items.matches(batch.column(1)))
                owner = batch.column(0).to_pylist()
                columns = [[owner[f[0]] for f in found], [ids[f[1]] for f in found], *([f[k] for f in found] for k in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "edits"]
                )

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)

    out = None
    for ids, texts in _blocks(benchmark):
        found = pass_over(ids, texts)
        out = found if out is None else out.union(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, opts: LeakOptions = LeakOptions()) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no occurrence of an item."""

    def pass_over(kept: DataFrame, texts: list[str]) -> DataFrame:
        at = kept.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(texts, opts)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in items.matches(batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        return kept.mapInArrow(run, kept.schema)

    for _, texts in _blocks(benchmark):
        docs = pass_over(docs, texts)
    return docs
