"""Chat formatting in windows of a token budget.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Strings that could be
read as control strings, of this template or of other usual ones, are broken inside
texts by a backslash behind their first character; a backslash itself is doubled.
So no control string is left in an escaped text, and unescaping is exact.

Turns are taken in order. Running sums of their tokens decide how many fit into a
window. The next window repeats the system turn and, newest first and within the
limits, as many whole turns of history as fit. Only texts of assistant turns that are
new in a window are under its loss mask, so every target counts once.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.llm import tokens
from pitchloom.llm.common import partitions

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
# Control strings of this and of other usual templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))

FORMATTED = "conv_id long, window int, repeated int, n_tokens long, text string, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: m[1], text, flags=re.S) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def parse(text: str) -> list[tuple[str, str]]:
    """``(role, text)`` of the turns of a formatted text."""
    out = []
    for part in text.split(BEGIN)[1:]:
        role, _, said = part.removesuffix(END).partition("\n")
        out.append((unescape_role(role), unescape(said)))
    return out


class _Conversation:
    """Forms windows turn by turn; holds one window's turns at most."""

    def __init__(self, conv_id, budget: int, history: int, count):
        self.conv_id, self.budget, self.history, self.count = conv_id, budget, history, count
        self.number, self.system = 0, None
        self.turns: deque = deque()  # (role, written, where the text begins, tokens)
        self.repeated, self.used = 0, 0

    def add(self, role: str, text: str):
        """Yields a finished window, if the turn does not fit into it. Tokens are those of the turn as it is written."""
        head = f"{BEGIN}{escape_role(role)}\n"
        written = head + escape(text) + END
        n = self.count(written)
        if self.used + n > self.budget and len(self.turns) > self.repeated:
            yield self.window()
            kept, size = deque(), self.system[3] if self.system else 0
            sum_ = 0
            for turn in reversed(self.turns):
                if turn is self.system or sum_ + turn[3] > self.history or size + sum_ + turn[3] + n > self.budget:
                    break
                kept.appendleft(turn)
                sum_ += turn[3]
            if self.system:
                kept.appendleft(self.system)
            self.turns, self.repeated, self.used = kept, len(kept), size + sum_
        turn = (role, written, len(head), n)
        if role == "system" and self.system is None and not self.turns and self.number == 0:
            self.system = turn
        self.turns.append(turn)
        self.used += n

    def window(self) -> tuple:
        loss, at = [], 0
        for k, (role, written, begin, _) in enumerate(self.turns):
            if role == "assistant" and k >= self.repeated:
                loss.append({"start": at + begin, "end": at + len(written) - len(END)})
            at += len(written)
        self.number += 1
        return (self.conv_id, self.number - 1, self.repeated, self.used, "".join([t[1] for t in self.turns]), loss)


def format_windows(conversations: DataFrame, vocabulary: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """``conv_id, window, repeated, n_tokens, text, loss``: the windows of every conversation.

    ``repeated`` leading turns stood in earlier windows. ``loss`` has spans of code
    points. ``n_tokens`` counts the tokens of ``text`` as it is written, and is at most
    ``budget``; only where the system turn and a single new turn have more between them
    does a window exceed it, as a turn is never cut (no further history is in it then).
    Turns are ordered by ``turn``, then role and text. A null text or role is empty;
    rows with a null ``conv_id`` are one conversation, a null ``turn`` comes first, and
    repeated rows are turns of their own. An empty table has no windows. Further columns
    are left out, whatever their names. Rows of a conversation pass through one task in
    order; no more than a window of them is held.
    """

    def run(batches):
        import pyarrow as pa

        encoder = tokens.library_encoder(vocabulary, "space")
        kind = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        names = ["conv_id", "window", "repeated", "n_tokens", "text", "loss"]
        now = None
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        rows.append(now.window())
                    now = _Conversation(conv, budget, history, lambda written: len(encoder(written.encode())) // 4)
                rows += now.add(role, text)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, kind)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now.window(), kind)], names)

    named = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    ordered = named.repartition(4 * partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """What the windows say, read back: turns and masked text of every conversation, each once."""

    class Told:
        def __init__(self, conv):
            self.conv, self.n, self.size, self.chars = conv, 0, 0, 0
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, repeated: int, text: str, loss: list[dict]) -> None:
            for role, said in parse(text)[repeated:]:
                self.turns.update(f"{role}\n{said}\n".encode())
                self.n += 1
            for span in loss:
                target = unescape(text[span["start"] : span["end"]])
                self.loss.update(target.encode())
                self.chars += len(target)
            self.size += len(text)

        def row(self) -> tuple:
            return (self.conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.size)

    def run(batches):
        import pyarrow as pa

        kind = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now = None
        for batch in batches:
            rows = []
            for conv, repeated, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv:
                    if now is not None:
                        rows.append(now.row())
                    now = Told(conv)
                now.add(repeated, text, loss)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, kind)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now.row(), kind)], names)

    ordered = formatted.repartition(4 * partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.select("conv_id", "repeated", "text", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
