"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "### " role ": " text "</turn>\\n"

Within role and text a backslash makes the next character literal. Each turn is rendered raw
first, parsed again by the deterministic parser and compared with its source; as long as it
differs, conflicting content is escaped one level further (control strings, then every
character that isn't a letter, digit or space). A turn ends only at an unescaped "</turn>\\n",
so a conversation parses as the sequence of its turns, and turns can be rendered on their own.

Defined results: null texts and roles count as empty; turns are ordered by turn (nulls first),
then role and rendered text, so ties and repeated rows have one order; a null conv_id is a
conversation of its own; no rows, no conversations.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, COLON, END = "### ", ": ", "</turn>\n"
#: What opens, divides or closes something, and the escape itself.
CONTROL = {"role": re.compile(r"\\|### |: |</turn>"), "text": re.compile(r"\\|### |</turn>")}
LITERAL = re.compile(r"[^\w\s]|_", re.ASCII)
STEP = {"role": re.compile(r"\\.|: |### |</turn>|\\\Z", re.DOTALL), "text": re.compile(r"\\.|</turn>\n|</turn>|### |\\\Z", re.DOTALL)}
UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


class Conflict(ValueError):
    """Text that doesn't parse as turns."""


def _field(text: str, at: int, kind: str, stop: str) -> tuple[str, int]:
    """The raw field from `at` to the unescaped `stop`, and where it ends."""
    for m in STEP[kind].finditer(text, at):
        if m[0] == stop:
            return text[at : m.start()], m.end()
        if len(m[0]) != 2 or m[0][0] != "\\":
            raise Conflict(f"{m[0]!r} at {m.start()}")
    raise Conflict(f"no {stop!r} after {at}")


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the escaped text."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(HEAD, at):
            raise Conflict(f"no turn at {at}")
        role, at = _field(text, at + len(HEAD), "role", COLON)
        body, end = _field(text, at, "text", END)
        out.append((UNESCAPE.sub(r"\1", role), UNESCAPE.sub(r"\1", body), at, end - len(END)))
        at = end
    return out


def _escaped(value: str, kind: str, level: int) -> str:
    if level == 0:
        return value
    return (CONTROL[kind] if level == 1 else LITERAL).sub(lambda m: "\\" + m[0], value)


def render_turn(role: str, text: str) -> str:
    """One turn that parses back to exactly this role and text."""
    for level in range(3):
        out = HEAD + _escaped(role, "role", level) + COLON + _escaped(text, "text", level) + END
        try:
            got = parse(out)
        except Conflict:
            continue
        if len(got) == 1 and got[0][:2] == (role, text):
            return out
    raise AssertionError("an escaped turn always parses")


def render_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, rendered: one row a turn, without a shuffle."""

    def run(batches):
        for b in batches:
            roles, texts = (["" if x is None else x for x in b.column(k).to_pylist()] for k in (2, 3))
            out = [render_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(roles, pa.string()), pa.array(out, pa.string())], ["conv_id", "turn", "role", "rendered"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.mapInArrow(run, "conv_id long, turn long, role string, rendered string")


class _Reader:
    """Reads one conversation back turn by turn, holding digests only."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.chars, self.loss = conv, 0, 0, 0
        self.all, self.learnt = hashlib.sha256(), hashlib.sha256()

    def feed(self, rendered: str, learn: str) -> None:
        for role, text, start, end in parse(rendered):
            self.turns += 1
            raw = text.encode()
            self.all.update(b"%s\n%s\n" % (role.encode(), raw))
            if role == learn:
                under = UNESCAPE.sub(r"\1", rendered[start:end])
                self.loss += len(under)
                self.learnt.update(under.encode())
        self.chars += len(rendered)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.learnt.hexdigest(), self.chars


def read_back(rendered: DataFrame, learn: str = "assistant") -> DataFrame:
    """Parse the rendered turns of each conversation in order and return digests.

    One shuffle by conv_id. A digest of a conversation is sequential, so its rows meet in one
    task, but they stream through it in sorted order and are never held together.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        now, done = None, []
        for b in batches:
            for conv, rendered_turn in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(conv)
                now.feed(rendered_turn, learn)
            if len(done) >= 1000:
                yield batch(done)
                done = []
        if now is not None:
            yield batch([*done, now.row()])

    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "rendered")
    return ordered.select("conv_id", "rendered").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, rendered, loss_start, loss_end: the formatted conversation as ordered
    turns with the loss mask in code points of the turn (null bounds: not under the mask)."""
    out = render_turns(conversations)
    body = F.char_length("rendered") - len(END)
    head = F.char_length("rendered") - F.char_length(F.regexp_replace("rendered", r"(?s)^### assistant: ", ""))
    on = F.col("role") == "assistant"
    return out.withColumns({"loss_start": F.when(on, head), "loss_end": F.when(on, body)})
