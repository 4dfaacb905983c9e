"""Chat formatting in budgeted, turn-aligned windows.

The turns of a conversation stream by in order. A running sum of turn tokens closes a window before
the turn that would exceed the budget; the next window begins with the system turn and as many of
the last turns as the history and the rest of the budget allow, marked as repeated and masked out of the loss. So a
task holds one window, however long a conversation is. Tokens are those of the SentencePiece model at ``model``, counted
on each turn as it is written out; without a model they are its white-space words.

A turn reads ``<s>[role]`` newline text ``</s>`` newline. In roles and texts a backslash stands before each
``<``, ``[``, ``]`` and backslash, so no marker can occur in them, and ``unescape`` gives back the original.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._graph import partitions
from ._text import small_batches
from .sentencepiece_codec import MODEL, codec

BUDGET, HISTORY = 512, 128
END = "</s>\n"
_CONTROL = re.compile(r"([\\<\[\]])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>\[((?:[^\\\[\]<]|\\.)*)\]\n((?:[^\\<\[\]]|\\.)*)</s>\n", re.DOTALL)
WINDOWS = "conv_id long, window long, formatted string, n_repeated int, spans array<struct<start:int,end:int>>, n_tokens long"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def escape(s: str) -> str:
    return _CONTROL.sub(r"\\\1", s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def render(turns: list[tuple[str, str]], repeated: int, target: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The window's text and the spans (code points) under the loss: new turns of the target role."""
    out, spans, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        head, body = f"<s>[{escape(role)}]\n", escape(text)
        if i >= repeated and role == target:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _counts(turns: list[tuple[str, str]], model: str | None) -> list[int]:
    """Tokens of each turn, written out."""
    shown = [render([turn], 0)[0] for turn in turns]
    if model is None:
        return [len(x.split()) for x in shown]
    return [len(ids) // 4 for ids in codec(model).packed(shown)]


class _Window:
    """Turn-aligned windows of one conversation, as its turns come."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.number, self.turns, self.sizes, self.repeated, self.system = 0, [], [], 0, None

    def add(self, turn: tuple[str, str], size: int):
        done = None
        fixed = self.sizes[0] if self.system else 0
        fresh = len(self.turns) - self.repeated - (self.system is not None and not self.repeated)
        if fresh > 0 and sum(self.sizes) + size > self.budget:
            done = self.close()
            least = len(self.turns)
            left = min(self.history, self.budget - size - fixed)
            while least > (self.system is not None) and self.sizes[least - 1] <= left:
                least -= 1
                left -= self.sizes[least]
            head = int(self.system is not None)
            self.turns, self.sizes = self.turns[:head] + self.turns[least:], self.sizes[:head] + self.sizes[least:]
            self.repeated = len(self.turns)
        if not self.number and not self.turns and turn[0] == "system":
            self.system = turn
        self.turns.append(turn)
        self.sizes.append(size)
        return done

    def close(self):
        text, spans = render(self.turns, self.repeated)
        self.number += 1
        return self.conv, self.number - 1, text, self.repeated, [{"start": a, "end": b} for a, b in spans], sum(self.sizes)


def _windows(budget: int, history: int, model: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        names = ["conv_id", "window", "formatted", "n_repeated", "spans", "n_tokens"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), _SPANS, pa.int64())
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            convs, *turns = (batch.column(i).to_pylist() for i in range(3))
            turns = list(zip(*turns, strict=True))
            for conv, turn, size in zip(convs, turns, _counts(turns, model), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        rows.append(now.close())
                    now = _Window(conv, budget, history)
                if done := now.add(turn, size):
                    rows.append(done)
                if len(rows) >= 500:
                    yield pack()
                    rows = []
        if now is not None:
            rows.append(now.close())
        if rows:
            yield pack()

    return run


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, model: str | None = MODEL) -> DataFrame:
    """Windows of every conversation: conv_id, window, formatted text, repeated turns, loss spans, tokens.

    Turns are ordered by (turn, role, text), nulls first; a null role or text counts as empty; rows with a null
    conv_id form one conversation. A window exceeds the budget only where the system turn and one more do: it holds just these two,
    whole. Repeated rows are turns
    of their own. An empty table gives no windows; other columns are ignored. The system turn is repeated only if it comes first. The model file must be on every machine.
    """
    small_batches(conversations.sparkSession)
    rows = conversations.selectExpr("cast(conv_id as long) as conv_id", "coalesce(role, '') as role", "coalesce(text, '') as text", "turn")
    dealt = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_windows(budget, history, model), WINDOWS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads formatted windows back, conversation by conversation, in the order they were written."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    at, state = None, None
    for batch in batches:
        rows = []
        for conv, window, text, repeated, spans in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if not window:
                if state:
                    rows.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))
                at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, said in parse(text)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for s in spans:
                loss = unescape(text[s["start"] : s["end"]])
                state[2] += len(loss)
                state[3].update(loss.encode())
            state[4] += len(text)
            state[5] += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]), kinds, strict=True)], names=names)


def chat_digest(windows: DataFrame) -> DataFrame:
    """What can be read back from ``chat_windows``: turns, text under the loss and length, per conversation.

    ``windows`` come as ``chat_windows`` gives them, in its order. A conversation whose turns are empty has zero loss_chars and the
    digest of nothing; the null conv_id is one conversation; no windows give no rows.
    """
    return windows.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
