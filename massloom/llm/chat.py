"""Conversations as one formatted text with token ids and a loss mask.

A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a newline. Control strings are tokens of their own, so the
tokens of a text never reach over its ends. Inside roles and texts every ``<``, any backslashes, ``|`` gets one more
backslash: no control string can appear there, and taking one backslash away gives the text back.

A conversation is rendered whole and encoded once, with the offsets of its tokens. Turn spans and token spans are both
sorted, so the tokens of a turn are found by two binary searches.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (START, SEP, END)

_turn = re.compile(f"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}\n", re.DOTALL)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The formatted text of (role, text) turns, and role, start and end of each text in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        spans.append((role, at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at = spans[-1][2] + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns that ``render`` was given."""
    return [(unescape(role), unescape(text)) for role, text in _turn.findall(formatted)]


def loss_mask(offsets: np.ndarray, spans: Sequence[tuple[int, int]]) -> np.ndarray:
    """True for the tokens (rows of start, end; sorted) inside one of the sorted ``spans``."""
    edge = np.zeros(len(offsets) + 1, np.int32)
    if len(spans) and len(offsets):
        inside = np.asarray(spans).reshape(-1, 2)
        first = np.searchsorted(offsets[:, 0], inside[:, 0], "left")
        last = np.searchsorted(offsets[:, 1], inside[:, 1], "right")
        held = first < last
        np.add.at(edge, first[held], 1)
        np.add.at(edge, last[held], -1)
    return np.cumsum(edge[:-1]) > 0


def masked_texts(formatted: str, starts: Sequence[int], ends: Sequence[int], mask: Sequence[bool]) -> list[str]:
    """Unescaped stretches of the formatted text under the mask, one for each run of masked tokens."""
    on = np.flatnonzero(np.asarray(mask, bool))
    if not len(on):
        return []
    cuts = np.flatnonzero(np.diff(on) > 1) + 1
    return [unescape(formatted[starts[run[0]] : ends[run[-1]]]) for run in np.split(on, cuts)]


@functools.cache
def load(path: str) -> Tokenizer:
    """A byte-level tokenizer file with the control strings as tokens after its own. Kept once per worker."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens(list(CONTROL))
    return tokenizer


FORMATTED = "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"


def format_conversations(turns: DataFrame, path: str, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, ids, starts, ends, mask (one entry per token).

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Turns go by turn, then role, then text;
    repeated rows are repeated turns; null roles and texts are empty. Rows with a null conv_id are one conversation.
    The mask covers the texts of roles in ``learn``. Offsets count code points of ``formatted``. A conversation is
    one training example and is put together in one place; different conversations spread freely.
    """
    learned = frozenset(learn)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load(path)
        for batch in batches:
            for low in range(0, len(batch), 128):
                part = batch.iloc[low : low + 128]
                shown = [render([(t["role"], t["text"]) for t in own]) for own in part["turns"]]
                coded = tokenizer.encode_batch([s for s, _ in shown], add_special_tokens=False)
                rows = []
                for conv, (text, spans), got in zip(part["conv_id"], shown, coded):
                    offsets = np.array(got.offsets, np.int64).reshape(-1, 2)
                    mask = loss_mask(offsets, [(a, b) for role, a, b in spans if role in learned])
                    rows.append((conv, text, got.ids, offsets[:, 0], offsets[:, 1], mask))
                yield pd.DataFrame(rows, columns=["conv_id", "formatted", "ids", "starts", "ends", "mask"])

    kept = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("t"),
    )
    whole = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return whole.mapInPandas(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests taken from the output of ``format_conversations`` alone.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of every turn), loss_chars and loss_sha256 (unescaped
    text under the mask), formatted_chars.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, text, starts, ends, mask in batch.itertuples(index=False):
                turns = parse(text)
                shown = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(masked_texts(text, starts, ends, mask))
                digest = [hashlib.sha256(x.encode()).hexdigest() for x in (shown, loss)]
                rows.append((conv, len(turns), digest[0], len(loss), digest[1], len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pd.DataFrame(rows, columns=names)

    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "starts", "ends", "mask").mapInPandas(run, kinds)
