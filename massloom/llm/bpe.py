"""Byte-level BPE by dynamic programming over prefixes.

Merging by ranks gives every byte string exactly one token sequence, and so gives every prefix one last token. A token
t may end the prefix p when the prefix before t already has its last token s and the pair (s, t) is stable: encoding
the bytes of s and t together gives s, t again. Exactly one token passes. The stored last tokens answer two things
without encoding anew: a text that grows at its end, and a text edited somewhere, where work stops as soon as the
state agrees with the old one again.

A text is first cut by the vocabulary's pattern, each match by itself; no special tokens exist.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# entries a task remembers of pairs and, twice that, of pieces: time saved only, any size gives the same tokens
REMEMBERED = 1 << 18


class Vocabulary:
    """Ranks of byte strings, the splits their merges imply, and which neighbours are stable."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token_bytes = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        self._splits: dict[bytes, tuple[bytes, bytes]] = {}
        self.known_pairs: dict[int, bool] = {}
        # two generations: once the newer one is full, it becomes the older one
        self._pieces: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def split(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens whose merge made this one."""
        found = self._splits.get(token)
        if found is None:
            parts = [token[i : i + 1] for i in range(len(token))]
            own = self.ranks[token]
            while len(parts) > 2:
                best, at = min((self.ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if best >= own:
                    raise ValueError(f"no merges lead to token {own}")
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = self._splits[token] = (parts[0], parts[1])
        return found

    def stable(self, left: int, right: int) -> bool:
        """Whether these tokens stay as they are when their bytes stand side by side.

        Going back in time from the finished tokens, the younger of the two parts that touch is split again. A merge
        of the touching parts that would have come before the one just undone makes the pair unstable; of two equal
        merges the one further left comes first.
        """
        key = left << 32 | right
        known = self.known_pairs.get(key)
        if known is None:
            if len(self.known_pairs) >= REMEMBERED:
                self.known_pairs.clear()
            known = self.known_pairs[key] = self._check(self.token_bytes[left], self.token_bytes[right])
        return known

    def _check(self, x: bytes, y: bytes) -> bool:
        ranks = self.ranks
        before, leftmost = len(ranks) + len(self.token_bytes), True
        while True:
            across = ranks.get(x + y)
            if across is not None and (across < before or across == before and not leftmost):
                return False
            made_x = ranks[x] if len(x) > 1 else -1
            made_y = ranks[y] if len(y) > 1 else -1
            if made_x < 0 and made_y < 0:
                return True
            if made_x >= made_y:
                # among equal ranks the left one was merged first, so the right one is undone first
                if made_x == made_y:
                    before, leftmost, y = made_y, False, self.split(y)[0]
                else:
                    before, leftmost, x = made_x, True, self.split(x)[1]
            else:
                before, leftmost, y = made_y, False, self.split(y)[0]

    def piece(self, text: str) -> bytes:
        """Ids of one match of the pattern, little-endian, four bytes each."""
        known = self._pieces.get(text)
        if known is None:
            known = self._older.get(text)
            if known is None:
                raw = text.encode()
                whole = self.ranks.get(raw)
                ids = [whole] if whole is not None else Prefixes(self, raw).tokens()
                known = struct.pack(f"<{len(ids)}I", *ids)
            if len(known) <= 64:
                if len(self._pieces) >= REMEMBERED:
                    self._older, self._pieces = self._pieces, {}
                self._pieces[text] = known
        return known

    def forget(self) -> None:
        """Give back what was remembered, as workers outlive their tasks."""
        for known in (self._pieces, self._older, self.known_pairs):
            known.clear()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.pattern.findall(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


class Prefixes:
    """The last token of every prefix of one piece of text."""

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab = vocab
        self.data = b""
        self.last = [-1]
        self.append(data)

    def _fill(self, stop: int) -> None:
        """Store the last tokens of all prefixes up to ``stop`` bytes."""
        get, known, check, longest = self.vocab.ranks.get, self.vocab.known_pairs, self.vocab.stable, self.vocab.longest
        data, last = self.data, self.last
        for end in range(len(last), stop + 1):
            # exactly one token fits, so the order does not matter; most are short
            for start in range(end - 1, end - longest - 1 if end > longest else -1, -1):
                token = get(data[start:end])
                if token is not None:
                    if start == 0:
                        break
                    before = last[start]
                    fits = known.get(before << 32 | token)
                    if fits or fits is None and check(before, token):
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)

    def append(self, more: bytes) -> None:
        """Grow the text at its end; stored prefixes stay."""
        self.data += more
        self._fill(len(self.data))

    def replace(self, start: int, stop: int, by: bytes) -> None:
        """Edit bytes ``start:stop``; only prefixes near the edit are worked out anew.

        A state further right depends on the last ``longest`` states and bytes. Once that many in a row, all of them
        past the edit, agree with the old ones, the rest is as before.
        """
        old, shift = self.last, len(by) - (stop - start)
        self.data = self.data[:start] + by + self.data[stop:]
        self.last = old[: start + 1]
        agreed = 0
        for end in range(start + 1, len(self.data) + 1):
            self._fill(end)
            token = self.last[end]
            past = end - len(by) - start
            agreed = agreed + 1 if past > 0 and old[end - shift] == token else 0
            if agreed >= self.vocab.longest:
                self.last += old[end - shift + 1 :]
                return

    def tokens(self, end: int | None = None) -> list[int]:
        """Ids of the text, or of its first ``end`` bytes."""
        at, out = len(self.data) if end is None else end, []
        while at > 0:
            out.append(self.last[at])
            at -= len(self.vocab.token_bytes[out[-1]])
        return out[::-1]


@functools.cache
def load(path: str, pattern: str) -> Vocabulary:
    """Ranks of a file with a base64 byte string and its rank on each line. Kept once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return Vocabulary(ranks, pattern)


def _encoded(vocab: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and ids from doc_id and text."""
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            coded = [vocab.encode(t) if t else b"" for t in part.column(1).to_pylist()]
            ends = [0]
            for c in coded:
                ends.append(ends[-1] + len(c) // 4)
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(coded))])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])
    vocab.forget()


def _digested(vocab: Vocabulary, batches: Iterator[pa.RecordBatch], keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """doc_id and what ids are digested to, from doc_id and ids."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for part in batches:
        lists = part.column(1)
        ids = [lists[i].values.to_numpy() if lists[i].is_valid else np.zeros(0, np.int32) for i in range(len(lists))]
        columns = [
            part.column(0),
            pa.array([len(i) for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]),
            pa.array([hashlib.sha256(vocab.decode(i.tolist())).hexdigest() for i in ids]),
        ]
        yield pa.RecordBatch.from_arrays(columns + [lists] * keep_ids, names=names + ["ids"] * keep_ids)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text; null is empty. One row per row of ``docs``.

    ``path`` is a file every worker can open, such as one installed with the workers. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(load(path, pattern), batches)

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the bytes they stand for. Null ids are empty; an id outside the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(path, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                raw = [vocab.decode(ids or ()) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, bytes binary")


def encode_and_check(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit), decoded_sha256 (bytes the ids decode to).

    Encoding and decoding are steps of one task. With ``keep_ids`` the ids follow. Null texts are empty; one row per
    row of ``docs``; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(path, pattern)
        return _digested(vocab, _encoded(vocab, batches), keep_ids)

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return _texts(docs).mapInArrow(run, kinds)
