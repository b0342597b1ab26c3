"""Words and shingles of whole texts as numpy arrays over Arrow buffers.

Nothing here makes a Python string per word: a batch of texts is one byte array, words are spans of it, and a word's
64-bit hash comes from running polynomial sums. Memory is bounded by ``CHUNK`` bytes of text at a time, or one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20

# the bytes between words: space and 09-0D
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint64)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (one more entry than texts). Null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(ends):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: (rows, bytes, offsets)."""
    data, at = text_buffers(texts)
    first, n = 0, len(texts)
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        last = min(last, n)
        yield slice(first, last), data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_spans(data: np.ndarray, at: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each text (one more entry than texts)."""
    inside = ~between[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def _power(base: int, n: int) -> np.ndarray:
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, CHUNK + 1), base, np.uint64)
        kept[0] = 1
        kept = np.cumprod(kept, dtype=np.uint64)
        if len(kept) <= 4 * CHUNK:
            _powers[base] = kept
    return kept


class Hashes:
    """Hashes of any spans of one byte array, A-Z taken as a-z."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((LOWER[data] + np.uint64(1)) * _power(_BASE, n)[:n], out=self.sums[1:])
        self.back = _power(_UNBASE, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        spans = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(spans + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash for every word of every text, and the number of words before each text."""
    starts, ends, first = word_spans(data, at)
    return Hashes(data)(starts, ends), first


def hash_of(word: str) -> int:
    """The hash ``word_hashes`` gives this word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(Hashes(raw)(np.array([0]), np.array([len(raw)]))[0])


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles and the number before each text; a shorter text is one shingle."""
    odd = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    counts = np.diff(first)
    out_counts = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(out_counts, out=out_first[1:])
    out = np.empty(out_first[-1], np.uint64)
    if len(words) >= size:
        rolled = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            rolled += words[k : len(words) - size + 1 + k] * odd[k]
        long = counts >= size
        starts = np.repeat(first[:-1][long], out_counts[long])
        within = np.arange(len(starts)) - np.repeat(np.cumsum(out_counts[long]) - out_counts[long], out_counts[long])
        into = np.repeat(out_first[:-1][long], out_counts[long]) + within
        out[into] = rolled[starts + within] + np.uint64(size)
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = words[first[i] : first[i + 1]]
        out[out_first[i]] = (own * odd[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), out_first


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from values end to end."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values, kind)).cast(pa.list_(kind))
