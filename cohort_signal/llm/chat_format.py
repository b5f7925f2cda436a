"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) turns to a string.
Successive prefixes of a conversation are rendered and consecutive outputs
compared: the newer output must begin with the older one, and what it adds is
the new turn's span.  Where it does not, the template has rewritten history;
the turn is marked and its span starts at the end of the common part.  Inside
a span the text's place is found by rendering the prefix with two one-letter
texts: where these outputs part is the text's start, what follows the letter is
the turn's closing part.

Output: one row per turn (conv_id, position, role, chunk, start, text_from,
text_to, loss, rewritten); the chunks of a conversation, joined in order, are
its formatted form, and the places count from the conversation's start.  Only
assistant texts are under the loss mask.

Scale: turns are dealt by conversation and sorted (spilled by Spark); a task
streams through its rows.  Whole prefixes are rendered at every length, so a
conversation takes memory in proportion to its characters and time to their
square.  Only for a template that declares that it renders each turn without
regard to the others (``template.history_independent = True``, as
plain_template does) the rendered context is, beyond FULL_CHARS characters,
the first turn and the last TAIL turns: memory is bounded and time linear.

Edge cases: null texts and roles are empty; turns are taken in the order of
turn, then role and text (ties, repeated rows and null turns included, nulls
first); rows with a null conversation are left out; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, slices

FULL_CHARS = 60_000
TAIL = 4
LOSS_ROLE = "assistant"

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Strings that models take for control; none may appear inside a turn's text.
CONTROL = ("<s>", "</s>", "<|start|>", "<|end|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.S)
_CHUNK = re.compile(r"(?:<s>)?<\|start\|>((?:\\.|[^\\\n])*)\n(.*)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    """Backslashes are doubled and a backslash parts each control string."""
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def plain_template(turns: list[Turn]) -> str:
    """<s>, then each turn between <|start|>role and <|end|>; a line break in
    a role follows a backslash, so that the first bare one ends the role."""
    parts = [f"<|start|>{escape(role).replace(chr(10), chr(92) + chr(10))}\n{escape(text)}<|end|>\n" for role, text in turns]
    return "<s>" + "".join(parts) if parts else ""


plain_template.history_independent = True


def read_chunk(chunk: str) -> Turn:
    """(role, text) of one turn's chunk of plain_template."""
    m = _CHUNK.fullmatch(chunk)
    if m is None:
        raise ValueError("not a chunk of this template")
    return unescape(m[1]), unescape(m[2])


def _common(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Renderer:
    """Spans of the turns of one conversation, given one by one."""

    def __init__(self, template: Template, full_chars: int = FULL_CHARS, tail: int = TAIL) -> None:
        self.template, self.full_chars, self.tail = template, full_chars, tail
        self.turns: list[Turn] = []
        self.chars = 0
        self.whole = True
        self.independent = getattr(template, "history_independent", False)
        self.out = ""
        self.written = 0

    def add(self, role: str, text: str) -> dict:
        turns = [*self.turns, (role, text)]
        new = self.template(turns)
        rewritten = not new.startswith(self.out)
        at = _common(self.out, new) if rewritten else len(self.out)
        x, y = (self.template([*self.turns, (role, c)]) for c in "xy")
        from_ = _common(x, y)
        after = len(x) - from_ - 1
        to = max(from_, len(new) - after)
        base = self.written - len(self.out)
        row = {"chunk": new[at:], "start": base + at, "text_from": base + from_, "text_to": base + to,
               "loss": role == LOSS_ROLE, "rewritten": rewritten}
        self.turns, self.out, self.written = turns, new, base + len(new)
        self.chars += len(text)
        if self.independent and len(self.turns) > self.tail + 1 and (not self.whole or self.chars > self.full_chars):
            # from now on the context is the first and the last turns
            self.whole = False
            self.turns = [self.turns[0], *self.turns[-self.tail:]]
            self.out = self.template(self.turns)
        return row


_FORMATTED = "conv_id long, position long, role string, chunk string, start long, text_from long, text_to long, loss boolean, rewritten boolean"


def _format(template: Template) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, renderer, position = None, None, 0
        for batch in slices(batches):
            rows = []
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if renderer is None or c != conv:
                    conv, renderer, position = c, Renderer(template), 0
                rows.append({"conv_id": c, "position": position, "role": role or "", **renderer.add(role or "", text or "")})
                position += 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return run


def format_conversations(conversations: DataFrame, template: Template = plain_template) -> DataFrame:
    """One row per turn; see the module text."""
    ship(conversations.sparkSession)
    src = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                               F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).filter("conv_id is not null")
    return (src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(_format(template), _FORMATTED))


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[dict] = []
    conv, state = None, None

    def close() -> None:
        if state is not None:
            done.append({"conv_id": conv, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2],
                         "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]})

    for batch in slices(batches):
        for c, chunk, start, from_, to, loss in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "chunk", "start", "text_from", "text_to", "loss"))):
            if state is None or c != conv:
                close()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_chunk(chunk)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if loss:
                masked = unescape(chunk[from_ - start:to - start])
                state[2] += len(masked)
                state[3].update(masked.encode("utf-8", "surrogatepass"))
            state[4] += len(chunk)
        if done:
            yield pa.RecordBatch.from_pylist(done)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_pylist(done)


def formatted_digests(conversations: DataFrame) -> DataFrame:
    """Format with plain_template, write the rows, read them back and return
    one row of digests per conversation."""
    written = materialise(format_conversations(conversations), "chat")
    return (written.select("conv_id", "position", "chunk", "start", "text_from", "text_to", "loss")
            .repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(_read_back, _DIGESTS))
