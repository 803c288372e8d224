"""Chat formatting in budgeted windows.

A conversation's turns, in order, become windows of text for training. Prefix sums of turn tokens choose the turns of a
window: the system turn that opens the conversation, then as many earlier turns as fit a share of the budget, then new
turns while they fit. A turn's tokens are those of what is written for it, marks and escapes included; no token spans two turns, so a
window's tokens are the sum. Every turn is new in one window exactly, and only new assistant turns are under the loss mask: repeated
turns are there for context alone. Where the system turn and one new turn don't fit together, that window goes without the system
turn; a turn that is longer than the budget by itself has a window of its own, whole. No other window exceeds the budget.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts every ``<|``, also with backslashes between, gets one more
backslash, so no marker can occur in them, and taking one away restores them; line ends and backslashes in roles are escaped too.

Null text or role is empty; rows with a null id are one conversation; turns are ordered by (turn, role, text), so repeated
rows are repeated turns. An empty table gives no rows. Rows stream through sorted by conversation: a task holds a
window and the history it may repeat, never a whole conversation. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.chunks import small_batches
from strandloom.llm.packing import encoder
from strandloom.operators.shared import partitions

START, END = "<|im_start|>", "<|im_end|>"
WINDOWS = "conv_id long, window int, text string, loss array<struct<start: int, end: int>>, repeated int, turns int, n_tokens int"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def written(role: str, text: str) -> tuple[str, str]:
    """How a turn begins, and its text as it is written."""
    return f"{START}{escape_role(role)}\n", escape(text)


class Conversation:
    """The windows of one conversation, turn by turn. A turn is (role, beginning, written text, tokens, prefix sum)."""

    def __init__(self, budget: int, history: int):
        self.budget, self.most = budget, history
        self.system: tuple | None = None
        self.old: deque = deque()  # turns before the window's new ones, with their prefix sums
        self.new: list[tuple] = []
        self.sum, self.opening, self.first = 0, True, True

    @staticmethod
    def _size(turns) -> int:
        """Tokens of consecutive turns."""
        return turns[-1][4] - turns[0][4] + turns[0][3] if turns else 0

    def _context(self) -> int:
        """Tokens of the longest run of the latest old turns within the history's share, and of the system turn; earlier turns go."""
        while self._size(self.old) > self.most:
            self.old.popleft()
        return self._size(self.old) + (self.system[3] if self.system and not self.first else 0)

    def add(self, role: str, begin: str, body: str, tokens: int) -> tuple | None:
        done = None
        if self.new and self._context() + self._size(self.new) + tokens > self.budget:
            done = self.window()
        self.sum += tokens
        self.new.append((role, begin, body, tokens, self.sum))
        if self.opening and role == "system":
            self.system = self.new[0]
        self.opening = False
        return done

    def window(self) -> tuple:
        room = self.budget - self._size(self.new)
        while self.old and self._context() > room:  # history gives way to a long new turn
            self.old.popleft()
        repeated = [*([self.system] if self.system and not self.first and self._context() <= room else []), *self.old]
        parts, loss, at = [], [], 0
        for k, (role, begin, body, _, _) in enumerate([*repeated, *self.new]):
            if k >= len(repeated) and role == "assistant":
                loss.append((at + len(begin), at + len(begin) + len(body)))
            parts.append(f"{begin}{body}{END}\n")
            at += len(parts[-1])
        out = ("".join(parts), loss, len(repeated), len(repeated) + len(self.new), sum(x[3] for x in [*repeated, *self.new]))
        self.old.extend(x for x in self.new if x is not self.system)
        self.new, self.first = [], False
        return out


def chat_windows(turns: DataFrame, tokenizer: str, budget: int = 2048, history: int = 512, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Windows in order: their text, the spans under the loss mask, and how many of their first turns are repeated."""
    spark = turns.sparkSession
    small_batches(spark)
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = ["conv_id", "window", "text", "loss", "repeated", "turns", "n_tokens"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = (pa.int64(), pa.int32(), pa.string(), span, pa.int32(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, current, key, number = encoder(tokenizer), None, None, 0

        def put(out: list, window: tuple) -> None:
            nonlocal number
            text, loss, *rest = window
            out.append((key, number, text, [{"start": a, "end": b} for a, b in loss], *rest))
            number += 1

        def emit(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if current is None or conv != key:
                    if current is not None and current.new:
                        put(out, current.window())
                    current, key, number = Conversation(budget, history), conv, 0
                begin, body = written(role, text)
                done = current.add(role, begin, body, len(encode(f"{begin}{body}{END}\n")))
                if done:
                    put(out, done)
            if out:
                yield emit(out)
        if current is not None and current.new:
            out = []
            put(out, current.window())
            yield emit(out)

    return rows.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, WINDOWS)


def parse_window(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the written text) of each turn of a window."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError("a turn does not begin with its mark")
        line = text.index("\n", at)
        end = text.index(END, line + 1)
        out.append((unescape_role(text[at + len(START) : line]), unescape(text[line + 1 : end]), line + 1, end))
        at = end + len(END) + 1
    return out


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, digests of all turns and of all text under the loss mask, and characters written, from windows in the
    order in which ``chat_windows`` gives them."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def emit(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=names)

        def close() -> tuple:
            conv, turns, all_, chars, loss, written = state
            return conv, turns, all_.hexdigest(), chars, loss.hexdigest(), written

        for batch in batches:
            out = []
            for conv, window, text, spans, repeated in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "window", "text", "loss", "repeated")), strict=True):
                if window == 0:
                    if state:
                        out.append(close())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body, _, _ in parse_window(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
                for span in spans:
                    masked = unescape(text[span["start"] : span["end"]])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(text)
            if out:
                yield emit(out)
        if state:
            yield emit([close()])

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
