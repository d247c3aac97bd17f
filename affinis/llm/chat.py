"""Chat formatting in budgeted windows.

Prefix sums of turn tokens choose turn-aligned spans. Each window keeps the conversation's system turn, repeats a
limited history, and masks repeated targets, so every assistant text bears loss exactly once. Control strings inside
texts are escaped reversibly. Conversations stream through a task in order; none is ever gathered whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import arrow_limits

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 1024, 256


def escape(text: str) -> str:
    """Puts one more backslash between "<" and "|", so no control string is left; unescape takes it away."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its escaped text starts and ends in it."""
    head = f"{START}{_role_out(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted window."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        out.append((_role_in(role), unescape(rest[: rest.rindex(END)])))
    return out


class _Conversation:
    """Turns of one conversation on their way into windows; holds one window and the history before it."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple | None = None
        self.past: list[tuple] = []  # repeated turns, at most history tokens
        self.new: list[tuple] = []
        self.sums = [0]  # prefix sums of the tokens of past and new
        self.windows = 0

    def _used(self) -> int:
        return (self.system[3] if self.system else 0) + self.sums[-1]

    def add(self, turn: tuple, first: bool) -> tuple | None:
        """Takes a turn (role, rendered, (start, end), tokens); returns a window that is full without it."""
        if first and turn[0] == "system":
            self.system = turn
            return None
        out = None
        if self.new and self._used() + turn[3] > self.budget:
            out = self.emit()
            room = min(self.history, self.budget - turn[3] - (self.system[3] if self.system else 0))
            seen = self.past + self.new
            keep = bisect_left([self.sums[-1] - s for s in reversed(self.sums)], room + 1) - 1  # turns from the end that fit
            self.past, self.new = (seen[len(seen) - keep :] if keep > 0 else []), []
            self.sums = [0]
            for t in self.past:
                self.sums.append(self.sums[-1] + t[3])
        self.new.append(turn)
        self.sums.append(self.sums[-1] + turn[3])
        return out

    def emit(self) -> tuple | None:
        """(number, text, repeated turns, spans of new assistant texts) of what is held."""
        repeats_system = self.system is not None and self.windows > 0
        if not self.new and (self.system is None or repeats_system):
            return None
        turns = ([self.system] if self.system else []) + self.past + self.new
        repeated = len(self.past) + repeats_system
        at, spans = 0, []
        first_new = len(turns) - len(self.new)
        for k, (role, rendered, (a, b), _) in enumerate(turns):
            if k >= first_new and role == "assistant":
                spans.append((at + a, at + b))
            at += len(rendered)
        # With a system turn in its first window, that turn is new although it stands before the history.
        self.windows += 1
        return self.windows - 1, "".join(t[1] for t in turns), repeated, spans


WINDOWS = "conv_id long, window long, formatted string, repeated int, loss array<struct<start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    loss = [[{"start": a, "end": b} for a, b in spans] for spans in cols[4]]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), pa.array(loss, _SPAN)], names=["conv_id", "window", "formatted", "repeated", "loss"])


def format_chat(conversations: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None, name: str = "byte_bpe_50k.json") -> DataFrame:
    """Windows of at most ``budget`` tokens (one turn alone may have more; it is never cut) over all conversations.

    conversations: conv_id, turn, role, text; other columns are not read. Turns go by turn, then role, then text (null
    first); ties and repeated rows are turns each. A null text or role is empty; null conv_ids are one conversation. A
    leading system turn stands in every window. Returns conv_id, window, formatted, repeated (turns at the front that
    an earlier window has) and loss (spans of formatted, in code points, that bear loss: assistant texts that are new).
    Rows of a conversation stay in one task, in order.
    """
    arrow_limits(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        from affinis.llm.packing import _worker_bpe

        bpe = _worker_bpe(tokenizer or public_tokenizers.path(name))
        current, conv, any_yet = None, None, False
        for batch in batches:
            out = []
            ids, roles, texts = (batch.column(k).to_pylist() for k in (0, 1, 2))
            rendered = [render(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
            _, tokens = bpe.encode([r[0] for r in rendered])
            for c, role, (shown, a, b), n in zip(ids, roles, rendered, tokens.tolist(), strict=True):
                first = not any_yet or c != conv
                if first:
                    if current and (w := current.emit()):
                        out.append((conv, *w))
                    current, conv, any_yet = _Conversation(budget, history), c, True
                if w := current.add((role or "", shown, (a, b), n), first):
                    out.append((c, *w))
            if out:
                yield _window_batch(out)
        if current and (w := current.emit()):
            yield _window_batch([(conv, *w)])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, WINDOWS)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, windows long"


def read_chat(windows: DataFrame, *, in_order: bool = False) -> DataFrame:
    """Reads formatted windows back: digests of every conversation's turns and of its text under the loss mask.

    in_order: the rows come from format_chat as they are; else they are dealt and sorted first. No rows give no rows.
    """
    if not in_order:
        windows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, None

        def row() -> tuple:
            n, turns, chars, loss, shown, count = held
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), shown, count

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

        for batch in batches:
            out = []
            for c, formatted, repeated, spans in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if held is None or c != conv:
                    if held:
                        out.append(row())
                    conv, held = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                turns = parse(formatted)[repeated:]
                held[0] += len(turns)
                for role, text in turns:
                    held[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    text = unescape(formatted[s["start"] : s["end"]])
                    held[2] += len(text)
                    held[3].update(text.encode("utf-8", "surrogatepass"))
                held[4] += len(formatted)
                held[5] += 1
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([row()])

    return windows.mapInArrow(run, READ)
